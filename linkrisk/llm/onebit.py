"""Approximate nearest neighbours: randomly rotated one-bit codes.

Vectors are centred, normalised and turned by one seeded random rotation; the
signs are the code (packed bits). With two scalars per vector (the length of
the centred vector, and the inner product of the code with the rotated vector)
the inner product with any query is estimated without bias, and its error is
bounded (Gao and Long, RaBitQ, 2024). In each block of vectors, every one whose
upper bound reaches the k-th largest lower bound is reranked on the original
vectors in double precision.

Scale: all vectors are indexed. Vectors are dealt to blocks of bounded size by a
hash, so copies of one vector cannot crowd a block, and the stated query set
meets them in bounded blocks of queries; each (query, block) keeps k rows, which
are merged per query. Memory per task: one block of vectors and one of queries.

Edge cases: vectors that are null, zero, of another length than most, or hold a
null or non-finite component take no part. A query's candidates are all rows
with another id; equal rows are ranked by id. Fewer candidates than k: all are
returned. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import store

#: Vectors in a block (about), queries in a block (about).
BLOCK_ROWS, QUERY_ROWS = 2048, 4096
#: Width of the error bound in standard deviations of the estimate.
WIDTH = 3.0
SEED = 20240521


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix (QR of a Gaussian one)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, center: np.ndarray, turn: np.ndarray):
    """Packed codes, centred lengths, and inner products code . rotated vector."""
    r = x - center
    size = np.linalg.norm(r, axis=1)
    u = (r / np.where(size > 0, size, 1)[:, None]) @ turn
    bits = u > 0
    dot = np.where(size > 0, np.abs(u).sum(axis=1) / np.sqrt(x.shape[1]), 1.0)
    return np.packbits(bits, axis=1), size, dot


def estimate(codes: np.ndarray, size: np.ndarray, dot: np.ndarray, q: np.ndarray, center: np.ndarray, turn: np.ndarray):
    """Estimated inner products (queries x vectors) and their error bounds."""
    dim = q.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    turned = (q @ turn).astype(np.float32)
    per = (size / dot / np.sqrt(dim)).astype(np.float32)
    est = (turned @ signs.T) * per + (q @ center).astype(np.float32)[:, None]
    spread = size * np.sqrt(np.maximum(1 - dot ** 2, 0)) / dot / np.sqrt(max(dim - 1, 1))
    return est, np.linalg.norm(q, axis=1).astype(np.float32)[:, None], (WIDTH * spread).astype(np.float32)


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, center, turn):
    """Per query the k best (ids, scores) of one block, best first."""
    codes, size, dot = encode(x, center, turn)
    top = min(k + 1, len(ids))  # the query's own row may be among them
    for lo in range(0, len(qids), 256):
        qs = q[lo:lo + 256]
        est, qn, spread = estimate(codes, size, dot, qs, center, turn)
        err = qn * spread[None, :] + 1e-5 * (np.abs(est) + qn)
        low, high = est - err, est + err
        cut = np.partition(low, len(ids) - top, axis=1)[:, len(ids) - top]
        for i, qid in enumerate(qids[lo:lo + 256]):
            hit = np.flatnonzero((high[i] >= cut[i]) & (ids != qid))
            if len(hit) < min(k, len(ids)):  # repeated rows of the query's own id
                hit = np.flatnonzero(ids != qid)
            score = np.einsum("ij,j->i", x[hit], qs[i])
            order = np.lexsort((ids[hit], -score))[:k]
            yield int(qid), ids[hit][order], score[order]


def neighbours(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
               block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k largest inner products."""
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("v"), is_query.alias("is_query")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda e: e != 0))
    rows = rows.withColumn("d", F.size("v"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.count_if("is_query").alias("q"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    if most is None:
        return empty
    dim, n, nq = most["d"], most["n"], most["q"]
    rows = store(rows.filter(F.col("d") == dim).drop("d"), "ann-rows")
    mean = rows.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)]).first()
    center, turn = np.array(mean, float), rotation(dim)
    blocks, qblocks = max(1, -(-n // block_rows)), max(1, -(-nq // query_rows))
    deal = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    ids = (F.monotonically_increasing_id())
    base = rows.withColumn("row", ids).withColumn("block", F.pmod(F.xxhash64("vec_id", "row"), F.lit(blocks)).cast("int"))
    base = base.select(every(qblocks).alias("qblock"), "block", "vec_id", "v", F.lit(False).alias("asks"))
    asks = rows.filter("is_query").withColumn("qblock", deal(1, qblocks)).select(
        "qblock", every(blocks).alias("block"), "vec_id", "v", F.lit(True).alias("asks"))

    def block(t):
        import pyarrow as pa
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        vid = t.column("vec_id").to_numpy()
        x = t.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        out = [[], [], []]
        if asks.any() and not asks.all():
            qid, first = np.unique(vid[asks], return_index=True)
            for q, got, score in search_block(vid[~asks], x[~asks], qid, x[asks][first], k, center, turn):
                for o, value in zip(out, (q, got, score)):
                    o.append(value)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "ids": pa.array(out[1], pa.list_(pa.int64())),
                         "scores": pa.array(out[2], pa.list_(pa.float64()))})

    found = base.unionByName(asks).groupBy("qblock", "block").applyInArrow(
        block, "query_id long, ids array<long>, scores array<double>")
    hits = F.transform(F.arrays_zip("scores", "ids"), lambda h: F.struct((-h["scores"]).alias("s"), h["ids"].alias("vec_id")))
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(hits))), 1, k).alias("h"))
    return best.select("query_id", F.posexplode("h").alias("rank", "h")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("h.vec_id").alias("vec_id"), (-F.col("h.s")).alias("score"))
