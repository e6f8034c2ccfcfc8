"""Exact, seeded, hash-ordered selection without global sorts.

Rows are ordered by ``md5('<seed>:' || key)`` (hex text: its string order is
its numeric order), which Spark and DuckDB compute identically. Taking "the
first m rows of a group in hash order" must not rank a whole group in one
window partition (a 2-valued label would put half the data into one task).
Instead:

1. count rows per (group, 4-hex-digit prefix): a map-side-combined aggregate
   of at most groups x 65,536 rows;
2. prefix sums over that small table give, per bucket, how many rows of the
   group come before it; it is broadcast back (size bound = groups x 65,536);
3. whole buckets are in or out by those offsets; only rows of the single
   boundary bucket per group are ranked exactly (window per (group, bucket)).

Ranking every row (k-fold assignment) uses the same offsets plus a window per
(group, bucket): 65,536 balanced partitions per group instead of one.

A hot key (one order key shared by many rows) never lands in one task: keys
are placed by combinable per-key counts, and only the rows of the single key
straddling the quota (or of duplicated keys when ranking) get positions, from
per-partition offsets after a reliable checkpoint (``positions_within``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 4  # 16**4 = 65,536 buckets
TOP_N = 20_000  # largest sample that is taken as a top-N


def hash_key(seed: int | str, *cols: str) -> Column:
    parts = [F.lit(f"{seed}:")]
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return F.md5(F.concat(*parts))


def _bucket_offsets(df: DataFrame, group_cols: list[str]) -> DataFrame:
    counts = df.groupBy(*group_cols, "_b").agg(F.count(F.lit(1)).alias("_bn"))
    w = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_bn").over(w), F.lit(0)))


def _key_offsets(df: DataFrame, group_cols: list[str]) -> DataFrame:
    """(group, _k) -> _kn rows with that key, _kb rows of smaller keys in the
    same bucket. A combinable aggregate: a hot key collapses map-side."""
    kc = df.groupBy(*group_cols, "_b", "_k").agg(F.count(F.lit(1)).alias("_kn"))
    w = Window.partitionBy(*group_cols, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    return kc.withColumn("_kb", F.coalesce(F.sum("_kn").over(w), F.lit(0))).drop("_b")


def positions_within(df: DataFrame, part_cols: list[str], out: str = "_p") -> DataFrame:
    """0-based position of each row within its ``part_cols`` group, skew-safe.

    Rows keep the input partition they are in: after a reliable checkpoint
    pins (partition id, row position), per-(group, partition) counts give
    offsets and each row is numbered inside its (group, partition) -- a hot
    group stays spread over its original partitions. Used only for rows that
    tie on the order key, which are interchangeable for the selection.
    """
    from linkrisk.session import cut_lineage
    s = cut_lineage(df.withColumn("_pid", F.spark_partition_id())
                    .withColumn("_pos", F.monotonically_increasing_id()))
    c = s.groupBy(*part_cols, "_pid").agg(F.count(F.lit(1)).alias("_pn"))
    w = Window.partitionBy(*part_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_po", F.coalesce(F.sum("_pn").over(w), F.lit(0)))
    j = s.join(c, part_cols + ["_pid"])
    w2 = Window.partitionBy(*part_cols, "_pid").orderBy("_pos")
    return j.withColumn(out, F.col("_po") + F.row_number().over(w2) - 1).drop("_pid", "_pos", "_pn", "_po")


def first_in_hash_order(df: DataFrame, key: Column, quota: Column, group_cols: list[str],
                        flag: str = "selected") -> DataFrame:
    """Add boolean ``flag``: row is among the first ``quota`` rows of its group
    in ``key`` order (rows with equal keys are interchangeable). ``quota`` is
    an expression over ``group_cols`` columns (a literal or a joined column).
    """
    from linkrisk.session import cut_lineage
    # one reliable checkpoint of the keyed input: every branch below reads it
    d = cut_lineage(df.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, BUCKET_HEX))
                    .withColumn("_q", quota))
    offs = _bucket_offsets(d, group_cols)
    d = d.join(F.broadcast(offs), group_cols + ["_b"], "left")  # <= groups x 65,536 rows
    whole_in = d["_before"] + d["_bn"] <= d["_q"]
    whole_out = d["_before"] >= d["_q"]
    settled = d.filter(whole_in | whole_out).withColumn(flag, whole_in)
    # boundary bucket: whole keys are in or out by their offsets ...
    edge = d.filter(~(whole_in | whole_out))
    e = edge.join(_key_offsets(edge, group_cols), group_cols + ["_k"])
    need = F.col("_q") - F.col("_before") - F.col("_kb")
    placed = e.filter((need >= F.col("_kn")) | (need <= 0)).withColumn(flag, need >= F.col("_kn"))
    # ... except the one key per group that straddles the quota
    strad = e.filter((need > 0) & (need < F.col("_kn")))
    strad = positions_within(strad, group_cols, "_p").withColumn(
        flag, F.col("_p") < F.col("_q") - F.col("_before") - F.col("_kb")).drop("_p")
    cols = [c for c in settled.columns]
    out = settled.unionByName(placed.select(*cols)).unionByName(strad.select(*cols))
    return out.drop("_k", "_b", "_q", "_bn", "_before")


def rank_in_hash_order(df: DataFrame, key: Column, group_cols: list[str], out: str = "rank") -> DataFrame:
    """Exact 1-based rank of each row within its group in ``key`` order (rows
    with equal keys take consecutive ranks in an arbitrary order)."""
    from linkrisk.session import cut_lineage
    d = cut_lineage(df.withColumn("_k", key).withColumn("_b", F.substring("_k", 1, BUCKET_HEX)))
    offs = _bucket_offsets(d, group_cols)
    d = d.join(F.broadcast(offs), group_cols + ["_b"], "left")
    e = d.join(_key_offsets(d, group_cols), group_cols + ["_k"])
    base = F.col("_before") + F.col("_kb") + 1
    single = e.filter(F.col("_kn") == 1).withColumn(out, base)
    dup = positions_within(e.filter(F.col("_kn") > 1), group_cols + ["_k"], "_p").withColumn(
        out, base + F.col("_p")).drop("_p")
    cols = single.columns
    return single.unionByName(dup.select(*cols)).drop("_k", "_b", "_bn", "_before", "_kn", "_kb")


def holdout_quota(n: Column, frac: float = 0.2) -> Column:
    """round(frac * n) with integer arithmetic (frac given in tenths)."""
    tenths = int(round(frac * 10))
    return F.floor((F.lit(2 * tenths) * n + F.lit(10)) / F.lit(20)).cast("long")


def stratified_split(df: DataFrame, label: str = "label", frac: float = 0.2, seed: int = 42,
                     key_cols: tuple[str, ...] = ("url",)) -> DataFrame:
    """Add ``is_test``: the first round(frac*n_label) rows of each label in
    hash order of (seed, key)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    d = df.join(F.broadcast(n), label)  # one row per label: bounded
    out = first_in_hash_order(d, hash_key(seed, *key_cols), holdout_quota(F.col("_n"), frac), [label], "is_test")
    return out.drop("_n")


def stratified_folds(df: DataFrame, label: str = "label", k: int = 5, seed: int = 42,
                     key_cols: tuple[str, ...] = ("url",)) -> DataFrame:
    """``fold = (rank - 1) % k`` within each label, rank in hash order."""
    r = rank_in_hash_order(df, hash_key(f"fold{seed}", *key_cols), [label], "_r")
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


def seeded_sample(df: DataFrame, n: int, seed: int = 42, key_cols: tuple[str, ...] = ("url",)) -> DataFrame:
    """exactly min(n, count) rows, the first ones in hash order (deterministic). Up to
    TOP_N rows are a top-N (each task keeps its own first n); more use the bucket offsets."""
    if n <= TOP_N:
        return df.withColumn("_k", hash_key(f"sample{seed}", *key_cols)).orderBy("_k").limit(n).drop("_k")
    d = df.withColumn("_g", F.lit(0))
    out = first_in_hash_order(d, hash_key(f"sample{seed}", *key_cols), F.lit(n), ["_g"], "_in")
    return out.filter("_in").drop("_in", "_g")


def holdout_rows(features: DataFrame, split: DataFrame, key: str = "url") -> DataFrame:
    """The rows of a persisted split marked as test, by key (equi-join)."""
    return features.join(split.filter(F.col("is_test")).select(key), key, "left_semi")


def with_shuffle_key(df: DataFrame, seed: int = 42, key_cols: tuple[str, ...] = ("url",)) -> DataFrame:
    """a seeded order key for readers that want a shuffled order."""
    return df.withColumn("shuffle_key", hash_key(f"shuffle{seed}", *key_cols))
