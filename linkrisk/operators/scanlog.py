"""The scan log.

The log is an append-only Parquet table (one row per scan, partitioned by
verdict so verdict filters prune files). Lookups are filters that reach the
Parquet reader; "newest N" is ``orderBy(desc).limit(n)`` which Spark plans
as a top-N (TakeOrderedAndProject, per-partition heaps), not a full sort.
Campaign listings never collect a campaign's whole scan list: they return
its size and its first ids via a window group limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkrisk.functions.rules import campaign_tags, minute_text

PHISHING_VERDICTS = ["Dangerous", "Suspicious"]


def clamp_limit(n: int | None, default: int = 50, lo: int = 1, hi: int = 500) -> int:
    """history size clamped to 1..500 (default 50)."""
    try:
        n = int(n) if n is not None else default
    except (TypeError, ValueError):
        n = default
    return max(lo, min(hi, n))


def rounded_scores(df: DataFrame) -> DataFrame:
    """Scores as the log keeps them: rounded to 4."""
    from linkrisk.functions.features import round_even
    return df.withColumns({c: round_even(F.col(c), 4) for c in ("score", "raw_score", "rf_score", "other_score") if c in df.columns})


def append_scans(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append scan rows; scores rounded to 4, nested fields kept native."""
    rounded_scores(df).write.mode(mode).partitionBy("verdict").parquet(path)


def write_batch(df: DataFrame, path: str) -> None:
    """A12 for one micro-batch (rows with ``batch``): a replayed batch replaces its own
    partitions of the log."""
    (rounded_scores(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "verdict").parquet(path))


def replace_campaigns(campaigns: DataFrame, path: str) -> None:
    """Replace-all write of the campaigns table."""
    campaigns.write.mode("overwrite").parquet(path)


def history(scans: DataFrame, limit: int | None = 50) -> DataFrame:
    """newest scans by id."""
    return scans.orderBy(F.desc("scan_id")).limit(clamp_limit(limit))


def timeline(scans: DataFrame, n: int = 10) -> DataFrame:
    """last ``n`` (verdict, time) pairs, time shown to the minute."""
    return scans.orderBy(F.desc("scan_id")).limit(n).select("scan_id", "verdict",
                                                           minute_text(F.col("scanned_at")).alias("time"))


def scan_lookup(scans: DataFrame, scan_id: int) -> DataFrame:
    """Point lookup (pushed to the Parquet reader)."""
    return scans.filter(F.col("scan_id") == F.lit(scan_id))


def dashboard(scans: DataFrame) -> DataFrame:
    """Total and per-verdict counts in a single conditional aggregate."""
    v = F.col("verdict")
    return scans.agg(F.count(F.lit(1)).alias("total_scans"), F.count_if(v == "Dangerous").alias("dangerous"),
                     F.count_if(v == "Suspicious").alias("suspicious"), F.count_if(v == "Safe").alias("safe"))


def phishing_scans(scans: DataFrame) -> DataFrame:
    """Scans with a phishing verdict."""
    return scans.filter(F.col("verdict").isin(PHISHING_VERDICTS))


def phishing_scan_count(scans: DataFrame) -> DataFrame:
    """D17."""
    return phishing_scans(scans).agg(F.count(F.lit(1)).alias("n"))


FEATURE_MAP = T.MapType(T.StringType(), T.DoubleType())


def decode_features(df: DataFrame, col: str = "features_json", out: str = "features") -> DataFrame:
    """Safe JSON decode; malformed or NULL text -> empty map."""
    parsed = F.from_json(F.col(col), FEATURE_MAP, {"mode": "PERMISSIVE"})
    return df.withColumn(out, F.coalesce(parsed, F.create_map().cast(FEATURE_MAP)))


def phishing_scans_with_features(scans: DataFrame) -> DataFrame:
    """Phishing scans whose decoded feature payload is non-empty."""
    d = decode_features(phishing_scans(scans).select("scan_id", "features_json"))
    return d.filter(F.size("features") > 0).select("scan_id", "features")


def campaign_scans(campaigns: DataFrame, scans: DataFrame, first_n: int = 5) -> DataFrame:
    """C1 + F4: each campaign's scan count, its first ``first_n`` scan ids and
    how many more there are; campaigns without scans get 0 (left join)."""
    s = scans.filter(F.col("campaign_id").isNotNull()).select(F.col("campaign_id").alias("name"), "scan_id")
    sizes = s.groupBy("name").agg(F.count(F.lit(1)).alias("n_scans"))
    w = Window.partitionBy("name").orderBy("scan_id")
    first = (s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= first_n)
             .groupBy("name").agg(F.sort_array(F.collect_list("scan_id")).alias("first_ids")))
    c = campaigns.select("name").join(sizes, "name", "left").join(first, "name", "left")
    n = F.coalesce(F.col("n_scans"), F.lit(0))
    return c.select("name", n.alias("n_scans"),
                    F.coalesce(F.col("first_ids"), F.array().cast("array<bigint>")).alias("first_ids"),
                    F.greatest(n - first_n, F.lit(0)).alias("more"))


def campaign_members(campaigns: DataFrame, scans: DataFrame) -> DataFrame:
    """C1 in full: every scan of each given campaign (campaign, scan_id, created_at), newest
    first within a campaign; a campaign without scans keeps one row of nulls. A range sort by
    (campaign, scan id) splits a large campaign over many tasks."""
    s = scans.select(F.col("campaign_id").alias("campaign"), "scan_id", F.col("scanned_at").alias("created_at"))
    out = campaigns.select(F.col("name").alias("campaign")).join(s, "campaign", "left")
    return out.orderBy("campaign", F.desc("scan_id"))


def write_sorted_log(scans: DataFrame, path: str, partitions: int | None = None) -> None:
    """A copy of the log for point lookups (B4) and campaign listings (C1): range-partitioned
    and sorted by scan id, so files and row groups have disjoint id ranges, with a Parquet
    Bloom filter on the campaign."""
    args = [partitions] if partitions else []
    (scans.repartitionByRange(*args, "scan_id").sortWithinPartitions("scan_id").write.mode("overwrite")
     .option("parquet.bloom.filter.enabled#campaign_id", "true").parquet(path))


def update_assignments(scans: DataFrame, assignments: DataFrame) -> DataFrame:
    """New campaign ids win over old ones, by scan id (a new table version)."""
    a = assignments.select("scan_id", F.col("campaign_id").alias("_new"))
    j = scans.join(a, "scan_id", "left")
    return j.withColumn("campaign_id", F.coalesce(F.col("_new"), F.col("campaign_id"))).drop("_new")


def campaign_cards(sizes: DataFrame, name: str = "name", n: str = "n", top: int | None = None) -> DataFrame:
    """Cards sorted by size with bar width ``round(100*n/max)``
    (denominator 0 -> 1) and tags; optionally only the ``top`` largest."""
    mx = sizes.agg(F.max(n).alias("_mx"))
    j = sizes.crossJoin(F.broadcast(mx))  # one row
    den = F.when(F.coalesce(F.col("_mx"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("_mx"))
    cards = j.select(name, n, F.floor(F.col(n) * 100.0 / den + 0.5).cast("int").alias("bar_pct"),
                     F.concat_ws(",", campaign_tags(F.col(n))).alias("tags"))
    if top is not None:
        cards = cards.orderBy(F.desc(n), name).limit(top)
    return cards
