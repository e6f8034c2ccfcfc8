"""Dataset assembly and exploration.

Every operator is one or two aggregations; none collects rows to the driver
(only scalar counts used as parameters, e.g. the legit cap).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import FEATURE_COLS, LEGIT_CAP_RATIO, SEED
from linkrisk.functions.urlparts import with_url_parts
from linkrisk.operators.split import first_in_hash_order, hash_key


class MissingColumnsError(ValueError):
    pass


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Raise before any job starts when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise MissingColumnsError(f"Missing columns: {missing}")


def require_nonempty(df: DataFrame, what: str = "input") -> None:
    """Fail fast on an empty input (``limit(1)``: no full count)."""
    if not df.limit(1).take(1):
        raise ValueError(f"{what} has no rows")


def require_rows(df: DataFrame, n: int, what: str = "rows") -> int:
    """Count gate (e.g. >= 2 phishing rows, >= 50 scans); returns the count."""
    c = df.count()
    if c < n:
        raise ValueError(f"Need at least {n} {what}, got {c}")
    return c


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    """G1 + G2: union of one class's feeds, distinct URLs."""
    parts = [f.select(F.col("url").cast("string").alias("url")) for f in feeds]
    return reduce(lambda a, b: a.unionByName(b), parts).filter(F.col("url").isNotNull()).dropDuplicates(["url"])


def balance_cap(phish: DataFrame, legit: DataFrame, cap_ratio: float = LEGIT_CAP_RATIO,
                seed: int = SEED) -> DataFrame:
    """Legit capped at ``int(cap_ratio * n_phish)`` rows, picked in hash order.

    Inputs are already distinct by URL (G2).
    """
    n_phish = phish.count()
    cap = int(cap_ratio * n_phish)
    legit = legit.withColumn("_g", F.lit(0))
    kept = first_in_hash_order(legit, hash_key(seed, "url"), F.lit(cap), ["_g"], "_in")
    return kept.filter("_in").select("url")


def merge_feeds(phish: DataFrame, legit: DataFrame, cap_ratio: float = LEGIT_CAP_RATIO,
                seed: int = SEED) -> DataFrame:
    """(url, label) with phishing winning a URL present in both classes.

    ``phish``/``legit`` are single-class URL tables (any feeds already
    unioned and de-duplicated with ``union_feeds``). The cap is applied to the
    legit class *before* the cross-class de-duplication, as in the original.
    """
    p = phish.select("url").withColumn("label", F.lit(1))
    lg = balance_cap(phish, legit, cap_ratio, seed).withColumn("label", F.lit(0))
    return p.unionByName(lg).groupBy("url").agg(F.max("label").alias("label"))


def class_stats(df: DataFrame, label: str = "label", url: str = "url") -> DataFrame:
    """D1 + D2: per class count, share of total and average URL length."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(url)).alias("avg_url_length"))
    tot = df.agg(F.count(F.lit(1)).alias("_t"))
    return g.crossJoin(F.broadcast(tot)).select(label, "n", (F.col("n") / F.col("_t")).alias("share"),
                                                "avg_url_length")


def dataset_totals(df: DataFrame, url: str = "url") -> DataFrame:
    """D2 over all classes: number of URLs and their average length."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.length(url)).alias("avg_url_length"))


def length_histogram(df: DataFrame, label: str = "label", url: str = "url", bins: int = 50) -> DataFrame:
    """D3: equal-width URL-length histogram per class, last bin closed.

    Bin index uses exact integer arithmetic; a constant class spans
    [v-0.5, v+0.5] so every value lands in the middle bin.
    """
    d = df.select(label, F.length(url).alias("len"))
    st = d.groupBy(label).agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    j = d.join(F.broadcast(st), label)  # one row per class: bounded
    span = F.col("hi") - F.col("lo")
    b = F.when(span == 0, F.lit(bins // 2)).otherwise(
        F.least(F.floor((F.col("len") - F.col("lo")) * F.lit(bins) / span), F.lit(bins - 1))).cast("int")
    counts = j.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = st.select(label, "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    lo = F.when(F.col("hi") == F.col("lo"), F.col("lo") - 0.5).otherwise(F.col("lo").cast("double"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")).cast("double"))
    return (grid.join(counts, [label, "bin"], "left")
            .select(label, "bin",
                    (lo + width * F.col("bin") / F.lit(bins)).alias("bin_start"),
                    (lo + width * (F.col("bin") + 1) / F.lit(bins)).alias("bin_end"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def url_tld(df: DataFrame, url: str = "url", out: str = "tld") -> DataFrame:
    """Last host label of the URL parsed as is (no scheme prefix); '' without
    a host, '?' when the URL cannot be split."""
    d = with_url_parts(df, url, add_scheme=False, prefix="t_")
    tld = F.when(F.col("t_bad_netloc") | F.col(url).isNull(), F.lit("?")).otherwise(
        F.substring_index(F.col("t_host"), ".", -1))
    return d.withColumn(out, tld).drop(*[c for c in d.columns if c.startswith("t_")])


def top_tlds(df: DataFrame, n: int = 5, label: str = "label", url: str = "url") -> DataFrame:
    """Most frequent TLDs among phishing URLs (count desc, TLD asc)."""
    ph = url_tld(df.filter(F.col(label) == 1).select(url))
    return ph.groupBy("tld").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tld").limit(n)


def label_correlation(df: DataFrame, cols: list[str] = FEATURE_COLS, label: str = "label") -> DataFrame:
    """Pearson r of each feature with the label in one pass, sorted by |r|.

    A constant column has no correlation: NULL.
    """
    aggs = []
    y = F.col(label).cast("double")
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"r_{c}"))
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', r_{c}" for c in cols)
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, corr)").withColumn(
        "abs_corr", F.abs("corr")).orderBy(F.desc_nulls_last("abs_corr"), "feature")


def validate_urls(df: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """Trim; empty or NULL -> rejected with a reason."""
    t = df.withColumn(url, F.trim(F.col(url)))
    ok = t.filter(F.col(url).isNotNull() & (F.col(url) != ""))
    bad = t.filter(F.col(url).isNull() | (F.col(url) == "")).withColumn("reason", F.lit("No URL provided"))
    return ok, bad


def source_counts(feeds: dict[str, DataFrame]) -> DataFrame:
    """Rows per feed."""
    parts = [f.select(F.lit(name).alias("source")) for name, f in feeds.items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
