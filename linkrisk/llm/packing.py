"""Packing: concatenate and cut.

Pass 1 tokenizes every text once and stores, per document, its ids, its task's
number and its start inside the task's run of tokens. The tasks' totals (one
row per task) get prefix sums, which turn the local starts into global offsets.
Pass 2 cuts the one long run at every multiple of the sequence length; a
document that crosses a cut leaves a piece on either side (boundary records).

Scale: no shuffle of texts or ids; pass 2 is a narrow read of the stored ids
joined with the per-task offsets, whose number is that of the input splits.
White-space-free chunks are encoded once per worker, many in one text, and then
looked up (the tokenizer never joins text across white space), so a text costs one dictionary
lookup per chunk. Memory per task: one Arrow batch and a bounded chunk cache.

Edge cases: a null or empty text is the end id alone. Repeated rows are packed
like any other rows. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from linkrisk.llm.base import batches, kept, store, utf8

#: Chunks that a worker remembers; longer chunks are encoded each time.
CACHE_CHUNKS, CACHE_BYTES = 1_000_000, 40
#: New chunks in one call of the tokenizer, which costs about as much as a chunk.
TOGETHER = 100


class Encoder:
    """Token ids of texts as little-endian uint16/uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = np.dtype(self.dtype).char  # H or I, as struct names them
        self.known: dict[bytes, bytes] = {}
        # a tokenizer that lower-cases gives a chunk and its lower-cased form the same
        # ids, unless a special token is spelt in it
        self.lowers = '"Lowercase"' in self.tok.to_str()
        self.special = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]

    def chunks(self, text: bytes) -> list[bytes]:
        if self.lowers:
            low = text.lower()
            if not any(s in low for s in self.special):
                text = low
        return text.split()  # at ASCII white space

    def encode_many(self, texts: list) -> list[bytes]:
        split = [self.chunks(t) if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE_CHUNKS:
            # the chunks met first are the frequent ones
            for c in list(known)[CACHE_CHUNKS // 2:]:
                del known[c]
        here = dict.fromkeys(itertools.chain.from_iterable(split))  # each chunk of these texts once
        here = dict(zip(here, map(known.get, here)))
        new = [c for c, ids in here.items() if ids is None]
        for lo in range(0, len(new), 10_000):
            some = new[lo:lo + 10_000]
            for c, ids in zip(some, self.encode_chunks(some)):
                here[c] = ids
                if len(c) <= CACHE_BYTES:
                    known[c] = ids
        return [b"".join(map(here.__getitem__, chunks)) for chunks in split]

    def encode_chunks(self, chunks: list[bytes]) -> Iterator[bytes]:
        """Ids of each chunk. Chunks go to the tokenizer ``TOGETHER`` at a time, a space between
        them, and the tokens' offsets tell whose they are; a special token's may take in the
        space, so beside one each chunk goes alone."""
        words = [c.decode() for c in chunks]
        groups = [words[lo:lo + TOGETHER] for lo in range(0, len(words), TOGETHER)]
        texts = [" ".join(g) for g in groups]
        for group, text, e in zip(groups, texts, self.tok.encode_batch(texts, add_special_tokens=False)):
            at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            low = text.lower().encode()
            if any(s in low for s in self.special) or (at[1:] < at[:-1]).any():
                for x in self.tok.encode_batch_fast(group, add_special_tokens=False):
                    yield struct.pack(f"<{len(x.ids)}{self.code}", *x.ids)
                continue
            ids = np.asarray(e.ids, self.dtype).tobytes()
            ends = np.cumsum([len(w) + 1 for w in group])
            cuts = np.searchsorted(at, ends) * np.dtype(self.dtype).itemsize
            lo = 0
            for hi in cuts.tolist():
                yield ids[lo:hi]
                lo = hi

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]


def encoder(path: str) -> Encoder:
    return kept("packing", path, lambda: Encoder(path))


def tokenize(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pass 1: (doc_id, task, start, n, ids), stored. start counts the tokens of
    the task's earlier rows."""
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        task, at, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.asarray([end_id], enc.dtype).tobytes()
        width = np.dtype(enc.dtype).itemsize
        for batch in it:
            for b in batches(batch, "packing"):
                ids = [x + end for x in enc.encode_many(utf8(b.column(1)))]
                n = np.array([len(x) // width for x in ids], np.int64)
                start = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.full(len(n), task, np.int32)), pa.array(start), pa.array(n),
                     pa.array(ids, pa.binary())], names=["doc_id", "task", "start", "n", "ids"])

    return store(slim.mapInArrow(run, f"doc_id {id_type}, task int, start bigint, n bigint, ids binary"), "pack-ids")


def offsets(ids: DataFrame) -> DataFrame:
    """Global offset of each task's first token: one row per task."""
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    return ids.groupBy("task").agg(F.max(F.col("start") + F.col("n")).alias("total")).select(
        "task", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("base"))


def pack(df: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """Pieces of the packed sequences: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, ids (the piece's token ids)."""
    wide = encoder(tokenizer).dtype  # of the vocabulary's size
    ids = tokenize(df, tokenizer, end_id, id_col, text_col)
    placed = ids.join(F.broadcast(offsets(ids)), "task").select(
        "doc_id", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    id_type = placed.schema["doc_id"].dataType.simpleString()
    out = (f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
           "sequence_id bigint, offset bigint, ids array<int>")

    def cut(it: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in it:
            for b in batches(batch, "packing", 500):
                at, n = b.column(1).to_numpy(), b.column(2).to_numpy()
                first, last = at // length, (at + n - 1) // length
                pieces = (last - first + 1).astype(np.int64)
                row = np.repeat(np.arange(len(n)), pieces)
                seq = first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                lo = np.maximum(at[row], seq * length)
                hi = np.minimum((at + n)[row], (seq + 1) * length)
                start, size = lo - at[row], hi - lo
                arrays = [np.frombuffer(x, wide).astype("<u4") for x in b.column(3).to_pylist()]
                parts = [arrays[r][s:s + z] for r, s, z in zip(row, start, size)]
                values = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array(start), pa.array(size),
                     pa.array(np.array([zlib.crc32(p.tobytes()) for p in parts], np.int64)), pa.array(n[row]),
                     pa.array(seq), pa.array(lo - seq * length),
                     pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(cut, out)
