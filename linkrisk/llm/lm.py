"""LM scoring: stupid backoff, computed relationally.

Words are cut at ASCII white space, A-Z lowered. The n-gram counts of the whole
corpus are held in tables partitioned by the n-gram's hash. A token's score is
c(w1 w2 w3) / c(w1 w2) where the trigram was seen at least ``min_count`` times,
else 0.4 times the bigram's c(w2 w3) / c(w2), else 0.4 squared times c(w3) / N
(Brants et al., 2007). An n-gram that occurs once occurs only in the text being
scored, so ``min_count`` is 2. A document's score is the sum of its tokens' logs.

Three steps, each one shuffle:
1. Texts are dealt to blocks of about ``BLOCK_CHARS`` by a hash. A block emits, for
   each hash partition, its distinct n-grams with their counts.
2. A partition adds up the counts of all blocks (the count tables) and joins them
   back to the n-grams that each block asked for.
3. A block is joined with its answers; tokens look up their n-grams' counts, and
   scores are summed per document.

Scale: n-grams travel as sorted, packed arrays, once per block, however often a
block holds them. So a frequent n-gram costs each partition one entry per block
and never one per occurrence. Both numbers of partitions grow with the corpus;
memory per task is that of one block or one partition.

Edge cases: null, empty and blank texts have no tokens and a score of 0. Repeated
rows are scored alike, and count as often as they occur. An empty table gives no
rows. n-grams are compared by hashes of ``HASH_BITS`` bits: an n-gram's count is
wrong with a probability of the number of distinct n-grams divided by 2^56.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import mix, store, utf8, word_hashes

ORDER, ALPHA, MIN_COUNT = 3, 0.4, 2
#: Characters of text in a block, and in the n-grams of a partition (about); least
#: number of either.
BLOCK_CHARS, PARTITION_CHARS, LEAST = 16_000_000, 16_000_000, 16
#: Bits of an n-gram's hash that travel.
HASH_BITS = 56
#: Largest count of 32 bits.
_MOST = 0xFFFFFFFF


def grams(doc: np.ndarray, words: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """Hash of the n-gram that ends at each token, per n; 0 where the document's
    beginning is nearer."""
    last = words
    yield last
    for n in range(2, order + 1):
        g = np.zeros(len(words), np.uint64)
        if len(words) >= n:
            # hash of the shorter n-gram that ends one token earlier, and the token
            whole = doc[n - 1:] == doc[:len(doc) - n + 1]
            g[n - 1:] = np.where(whole, mix(last[n - 2:-1] * np.uint64(0x9E3779B97F4A7C15) + words[n - 1:] + np.uint64(n)), np.uint64(0))
        last = g
        yield last


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted 64-bit values: their differences, byte plane by byte plane, deflated
    (the high planes are nearly empty)."""
    d = np.diff(x, prepend=np.uint64(0))
    planes = np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T)
    used = 8
    while used > 1 and not planes[used - 1].any():
        used -= 1
    low = max(0, used - 2)  # the two highest used planes are worth deflating
    return bytes([used, low]) + len(x).to_bytes(8, "little") + planes[:low].tobytes() + zlib.compress(planes[low:used].tobytes(), 1)


def unpack_sorted(b: bytes) -> np.ndarray:
    used, low, n = b[0], b[1], int.from_bytes(b[2:10], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[:low] = np.frombuffer(b, np.uint8, low * n, 10).reshape(low, n)
    planes[low:used] = np.frombuffer(zlib.decompress(b[10 + low * n:]), np.uint8).reshape(used - low, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as 32-bit values; the few that need more follow an (index, count) list."""
    large = np.flatnonzero(x > _MOST)
    listed = np.stack([large, x[large]]).astype("<i8").tobytes()
    low = (x & _MOST).astype("<u4")
    return len(large).to_bytes(8, "little") + listed + zlib.compress(low.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_counts(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(zlib.decompress(b[8 + 16 * n:]), np.uint8).reshape(4, -1)
    x = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    large = np.frombuffer(b, "<i8", 2 * n, 8).reshape(2, n)
    x[large[0]] = large[1]
    return x


def narrow(x: np.ndarray) -> np.ndarray:
    """``x`` as 32-bit values where all fit."""
    return x.astype(np.uint32) if not len(x) or x.max() <= _MOST else x


def add_up(hashes: list[bytes], counts: list[bytes]) -> list[bytes]:
    """For each block's packed n-grams, their counts over all blocks."""
    each = [unpack_sorted(x) for x in hashes]
    u, inverse = np.unique(np.concatenate(each), return_inverse=True)
    weights = np.concatenate([unpack_counts(x) for x in counts])
    total = np.bincount(inverse, weights=weights, minlength=len(u)).astype(np.int64)[inverse]  # exact up to 2^53
    return [pack_counts(x) for x in np.split(total, np.cumsum([len(x) for x in each])[:-1])]


def _short(g: np.ndarray) -> np.ndarray:
    """The bits of n-gram hashes that travel; 0 stays 0, nothing else becomes 0."""
    s = g >> np.uint64(64 - HASH_BITS)
    return np.where((g != 0) & (s == 0), np.uint64(1), s)


def _bounds(parts: int) -> np.ndarray:
    """First hash of each partition."""
    return np.array([(p << HASH_BITS) // parts for p in range(parts)], np.uint64)


def score_documents(df: DataFrame, order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tokens, log_score, mean_log_score) of every row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, parts = max(LEAST, -(-chars // BLOCK_CHARS)), max(LEAST, -(-chars // PARTITION_CHARS))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    names = [f"g{n}" for n in range(1, order + 1)]

    def ask(t):
        import pyarrow as pa
        doc, words, _ = word_hashes(utf8(t.column("text")))
        starts = _bounds(parts)
        rows: dict[str, list] = {c: [] for c in ("part", "block", *names, *(f"c{n}" for n in range(1, order + 1)))}
        split = []
        for g in grams(doc, words, order):
            u, c = np.unique(_short(g), return_counts=True)
            u, c = u[u != 0], c[u != 0].astype(np.uint32)
            at = np.searchsorted(u, starts)
            split.append((u, c, at, np.append(at[1:], len(u))))
        block = t.column("block")[0].as_py()
        for p in range(parts):
            if not any(hi[p] > lo[p] for _, _, lo, hi in split):
                continue
            rows["part"].append(p)
            rows["block"].append(block)
            for n, (u, c, lo, hi) in enumerate(split, 1):
                rows[f"g{n}"].append(pack_sorted(u[lo[p]:hi[p]]))
                rows[f"c{n}"].append(pack_counts(c[lo[p]:hi[p]]))
        kinds = {"part": pa.int32(), "block": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})

    packed = ", ".join(f"{n} binary" for n in names)
    counted = ", ".join(f"c{n} binary" for n in range(1, order + 1))
    asked = dealt.groupBy("block").applyInArrow(ask, f"part int, block int, {packed}, {counted}")

    def answer(t):
        import pyarrow as pa
        out = {"block": t.column("block"), "part": t.column("part")}
        for n in range(1, order + 1):
            out[f"c{n}"] = pa.array(add_up(t.column(f"g{n}").to_pylist(), t.column(f"c{n}").to_pylist()), pa.binary())
        return pa.table(out)

    answers = asked.groupBy("part").applyInArrow(answer, f"block int, part int, {counted}")

    def total(docs_t, answers_t):
        import pyarrow as pa
        doc, words, _ = word_hashes(utf8(docs_t.column("text")))
        rows = docs_t.num_rows
        got = answers_t.sort_by("part") if answers_t.num_rows else None
        count = []
        for n, g in enumerate(grams(doc, words, order), 1):
            u, inverse = np.unique(_short(g), return_inverse=True)
            known = u != 0
            c = np.zeros(len(u), np.uint32)
            if got is not None and known.any():
                answered = narrow(np.concatenate([unpack_counts(x) for x in got.column(f"c{n}").to_pylist()]))
                c = c.astype(answered.dtype)
                c[known] = answered
            count.append(c[inverse])
        log, unigram = np.zeros(len(words)), np.ones(len(words), bool)
        for n in range(2, order + 1):  # the longest n-gram seen often enough wins
            seen = count[n - 1] >= min_count
            ctx = np.ones(len(words), count[n - 2].dtype)
            ctx[1:] = count[n - 2][:-1]  # the shorter n-gram that ends one token earlier
            log = np.where(seen, np.log(np.maximum(count[n - 1], 1) / np.maximum(ctx, 1)) + (order - n) * np.log(alpha), log)
            unigram &= ~seen
        log = np.where(unigram, np.log(np.maximum(count[0], 1)) + (order - 1) * np.log(alpha), log)
        return pa.table({
            "doc_id": docs_t.column("doc_id"), "tokens": pa.array(np.bincount(doc, minlength=rows).astype(np.int64)),
            "log_sum": pa.array(np.bincount(doc, weights=log, minlength=rows)),
            "unigrams": pa.array(np.bincount(doc[unigram], minlength=rows).astype(np.int64))})

    sums = store(dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        total, f"doc_id {id_type}, tokens bigint, log_sum double, unigrams bigint"), "lm-sums")
    n = sums.agg(F.sum("tokens")).first()[0] or 1  # N, the corpus's tokens
    score = F.col("log_sum") - F.col("unigrams") * F.log(F.lit(float(n)))
    return sums.select("doc_id", "tokens", score.alias("log_score"),
                       F.when(F.col("tokens") > 0, score / F.col("tokens")).alias("mean_log_score"))
