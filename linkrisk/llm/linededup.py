"""Line dedup: deletion-neighbourhood join.

Lines are compared as word sequences (A-Z lowered, white space runs as one
space). Two lines match when they are equal, or differ by one edit of a word
(substitution, insertion or deletion). A line goes when an equal or matching
line comes earlier (order: document id, then line number); the earliest stays.

Method: a line of n words has n deletion variants. Lines that share "word j out
of n deleted, hash of the rest" differ by one substitution; a line whose hash
equals another's variant differs by an insertion. Variants are emitted as hashed
keys, and equal keys are joined; only the earliest line of a key is ever
compared with the others, so no pairs within a group are made. A word edit
distance check on the texts follows.

Because one edit leaves either the first or the last half of the shorter line
unchanged, only lines that share such a half (an equality of hashes) emit
variants; this loses no match.

Scale: exact repeats collapse first, by an aggregate that combines map-side, so a
line that a third of all documents hold is one row afterwards. Joins of lines
with their verdict are plain equi-joins, which the engine can split at a hot key.

Edge cases: lines of fewer than ``min_words`` words are never compared and stay;
lines of fewer than ``near_words`` are compared for equality only. A null text
stays null, an empty one empty. A document is known by its id and a 64-bit hash of its
text: rows that share an id but not the text are documents of their own (in the order of
these hashes), repeated rows count as one document and end up alike. A document may end
up with an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import batches, lower_ascii, mix, name_of, store, utf8, word_hashes

MIN_WORDS, NEAR_WORDS = 4, 8
_GAPS = r"[ \t\x0B\f\r]+"


def words_of(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(lower_ascii(line), _GAPS, " ")), " ")


#: Base of the polynomial hash of a word sequence (odd, so it has an inverse
#: modulo 2^64), and another one for the second half of a line's 128-bit identity.
_BASE, _OTHER = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 1), base, np.uint64))])


class Lines:
    """Hashes of the word sequences of many lines: the hash of words v0 v1 ... is
    the sum of h(vi) * BASE^i, so that of any part follows from running sums."""

    def __init__(self, lines: list[bytes]):
        line, words, _ = word_hashes(lines)
        self.n = np.bincount(line, minlength=len(lines)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        at = np.arange(len(words)) - np.repeat(self.first, self.n)
        top = int(self.n.max()) if len(self.n) else 0
        self.back = _powers(_BACK, top)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, top)[at], dtype=np.uint64)])
        self.other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * _powers(_OTHER, top)[at], dtype=np.uint64)])
        self.at = at

    def part(self, lo: np.ndarray, hi: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Hash of words lo..hi of each line."""
        f = self.first[rows]
        return (self.sums[f + hi] - self.sums[f + lo]) * self.back[lo]

    def identity(self) -> tuple[np.ndarray, np.ndarray]:
        end = self.first + self.n
        return self.part(np.zeros_like(self.n), self.n), mix(self.other[end] - self.other[self.first])

    def halves(self, rows: np.ndarray) -> np.ndarray:
        """Per line the keys of its first and last half, as a line of n words and as
        one that has a word more than its partner."""
        n, keys = self.n[rows], []
        for seed, m in ((1, n), (3, n - 1)):
            h = m // 2
            for k, (lo, hi) in enumerate(((np.zeros_like(h), h), (n - (m - h), n))):
                keys.append(mix(self.part(lo, hi, rows) + mix((2 * m + k).astype(np.uint64))))
        return np.stack(keys, axis=1)

    def variants(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, deleted word, hash of the rest) of every one-word deletion."""
        line, j = np.repeat(np.arange(len(self.n)), self.n), self.at
        f, e = self.first[line], (self.first + self.n)[line]
        rest = (self.sums[f + j] - self.sums[f]) + (self.sums[e] - self.sums[f + j + 1]) * np.uint64(_BACK)
        return line, j, rest


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one edit: the words that agree
    from the front and from the back cover all but one of the longer."""
    def agree(x, y):
        same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
        first = F.array_position(same, False)
        return F.when(first > 0, first - 1).otherwise(F.least(F.size(x), F.size(y)))
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return (longer - shorter <= 1) & (agree(a, b) + agree(F.reverse(a), F.reverse(b)) >= longer - 1)


def line_table(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """(doc_id, i, h1, h2, halves) of every line that is compared, stored."""
    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in it:
            for b in batches(batch, "lines", 500):
                split = [t.split(b"\n") if t is not None else [] for t in utf8(b.column(1))]
                doc = np.repeat(np.arange(len(split)), [len(x) for x in split])
                number = np.concatenate([np.arange(len(x)) for x in split]) if len(doc) else doc
                lines = Lines([x for xs in split for x in xs])
                rows = np.flatnonzero(lines.n >= min_words)
                h1, h2 = (h[rows].view(np.int64) for h in lines.identity())
                near = lines.n[rows] >= near_words
                keys = lines.halves(rows[near]).view(np.int64)
                ends = np.concatenate([[0], np.cumsum(near * keys.shape[1])])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc[rows])), pa.array(number[rows], pa.int32()), pa.array(h1), pa.array(h2),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))],
                    names=["doc_id", "i", "h1", "h2", "halves"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return store(docs.mapInArrow(run, f"doc_id {id_type}, i int, h1 bigint, h2 bigint, halves array<bigint>"), "lines")


def variant_table(texts: DataFrame) -> DataFrame:
    """(k, j, pos): a row per line (j = -1, k its own hash) and per deletion variant
    (k the hash of the line without word j). Equal k: one edit apart if j is equal,
    or if one side is a whole line."""
    pos = texts.schema["pos"].dataType.simpleString()

    def run(it: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in it:
            for b in batches(batch, "lines", 2000):
                lines = Lines(utf8(b.column(1)))
                line, j, rest = lines.variants()
                row = np.concatenate([line, np.arange(b.num_rows)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([rest, lines.identity()[0]]).view(np.int64)),
                     pa.array(np.concatenate([j, np.full(b.num_rows, -1)]), pa.int32()), b.column(0).take(pa.array(row))],
                    names=["k", "j", "pos"])

    return texts.select("pos", "line").mapInArrow(run, f"k bigint, j int, pos {pos}")


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(h1, h2) of the distinct lines that an earlier line within one edit precedes."""
    keys = distinct.select("h1", F.explode("halves").alias("k"))
    shared = keys.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k")
    some = keys.join(shared, "k").select("h1").distinct()
    at = distinct.join(some, "h1").select("first.doc_id", F.col("first.i").alias("i"), "h1", "h2")
    places = at.groupBy("doc_id").agg(F.collect_list(F.struct("i", "h1", "h2")).alias("at"))  # at most a document's lines
    texts = (docs.join(places, docs["doc_id"].eqNullSafe(places["doc_id"]))
             .select(docs["doc_id"], F.split("text", "\n").alias("all"), F.explode("at").alias("a"))
             .select(F.struct("doc_id", "a.i").alias("pos"), F.get("all", F.col("a.i")).alias("line"), "a.h1", "a.h2"))
    texts = store(texts.filter("line is not null"), "near-texts")
    rows = variant_table(texts)
    shared = rows.groupBy("k").agg(F.count("*").alias("c")).filter("c > 1").select("k")
    rows = store(rows.join(shared, "k"), "variants")
    first = rows.groupBy("k", "j").agg(F.min("pos").alias("by"))
    whole = first.filter("j < 0").drop("j")
    part = first.filter("j >= 0").groupBy("k").agg(F.min("by").alias("by"))
    pairs = rows.filter("j >= 0").join(first, ["k", "j"]).select("pos", "by")
    pairs = pairs.unionAll(rows.filter("j >= 0").join(whole, "k").select("pos", "by"))
    pairs = pairs.unionAll(rows.filter("j < 0").join(part, "k").select("pos", "by"))
    pairs = pairs.filter("by < pos").distinct()
    both = (pairs.join(texts.select("pos", "h1", "h2", "line"), "pos")
            .join(texts.select(F.col("pos").alias("by"), F.col("line").alias("other")), "by"))
    return both.filter(within_one(words_of(F.col("line")), words_of(F.col("other")))).select("h1", "h2").distinct()


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc_id, drop): numbers of each document's lines that go."""
    lines = line_table(docs, min_words, near_words)
    distinct = store(lines.groupBy("h1", "h2").agg(
        F.min(F.struct("doc_id", "i")).alias("first"), F.count("*").alias("c"), F.first("halves").alias("halves")), "distinct-lines")
    near = near_lines(docs, distinct).withColumn("near", F.lit(True))
    fate = distinct.join(near, ["h1", "h2"], "left").filter("near or c > 1").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.join(fate, ["h1", "h2"]).filter(F.col("near") | (F.struct("doc_id", "i") > F.col("first")))
    return gone.groupBy("doc_id").agg(F.collect_set("i").alias("drop"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                near_words: int = NEAR_WORDS, dropped_col: str | None = None) -> DataFrame:
    """``df`` with each text freed of later copies of lines; optionally with the
    number of lines that went in ``dropped_col``."""
    gone, of = name_of("drop", df.columns), name_of("of", df.columns)
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"))
    docs = df.select(own.alias("doc_id"), F.col(text_col).alias("text"))
    drop = dropped_lines(docs, min_words, near_words).select(F.col("doc_id").alias(of), F.col("drop").alias(gone))
    same = F.col(id_col).eqNullSafe(F.col(of)["id"]) & (F.xxhash64(text_col) == F.col(of)["text"])
    out = df.join(drop, same, "left").drop(of)
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = out.withColumn(text_col, text)
    if dropped_col:
        out = out.withColumn(dropped_col, F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)))
    return out.drop(gone)
