"""Public-suffix split of a host into (domain label, suffix length).

The suffix list is an input table (one column ``rule`` in public-suffix-list
syntax: ``com``, ``co.uk``, ``*.ck``, ``!www.ck``). It is turned into one
lookup table keyed by a dotted suffix with three flags, and joined once per
label depth (the list is at most a few labels deep). The lookup table is
broadcast only after its row count is checked against a bound; beyond it the
joins stay ordinary equi-joins that Spark plans itself.

Matching follows the list's rules: scanning from the longest candidate, an
exception rule ``!x`` makes the suffix ``x`` minus its first label, a normal
rule ``x`` or a wildcard ``*.y`` (matching ``<label>.y``) makes the suffix the
candidate itself. No match -> no suffix (``suffix_len = 0``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.constants import PUBLIC_SUFFIX_SAMPLE

BROADCAST_MAX_RULES = 200_000


def sample_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in PUBLIC_SUFFIX_SAMPLE], "rule string")


def suffix_lookup(rules: DataFrame) -> DataFrame:
    """(key, is_rule, is_wild, is_exc); ``is_wild`` on key ``y`` means ``*.y``."""
    r = rules.select(F.lower(F.trim(F.col("rule"))).alias("rule")).filter(
        (F.col("rule") != "") & ~F.col("rule").startswith("//"))
    kind = (F.when(F.col("rule").startswith("!"), F.lit("exc"))
            .when(F.col("rule").startswith("*."), F.lit("wild")).otherwise(F.lit("rule")))
    key = (F.when(F.col("rule").startswith("!"), F.expr("substring(rule, 2)"))
           .when(F.col("rule").startswith("*."), F.expr("substring(rule, 3)")).otherwise(F.col("rule")))
    return (r.select(key.alias("key"), kind.alias("kind"))
            .groupBy("key")
            .agg(F.max((F.col("kind") == "rule").cast("int")).alias("is_rule"),
                 F.max((F.col("kind") == "wild").cast("int")).alias("is_wild"),
                 F.max((F.col("kind") == "exc").cast("int")).alias("is_exc")))


def _last_labels(h: Column, k: int) -> Column:
    return F.regexp_extract(h, r"(?s)((?:[^.]*\.){" + str(k - 1) + r"}[^.]*)$", 1)


def with_registered_domain(df: DataFrame, host_col: str, rules: DataFrame | None = None,
                           prefix: str = "") -> DataFrame:
    """Append ``{prefix}domain`` (label left of the suffix) and
    ``{prefix}suffix_len`` (labels in the suffix, 0 = none)."""
    spark = df.sparkSession
    if rules is None:  # bundled sample: depth and size known without a job
        rules = sample_rules(spark)
        depth = max(len(r.lstrip("!").split(".")) for r in PUBLIC_SUFFIX_SAMPLE)
        n_rules = len(PUBLIC_SUFFIX_SAMPLE)
    else:
        depth_row = rules.select(F.max(F.size(F.split(F.regexp_replace("rule", "^!", ""), r"\."))).alias("d")).first()
        depth = int(depth_row["d"] or 1)
        n_rules = rules.count()
    lookup = suffix_lookup(rules)
    lk = F.broadcast(lookup) if n_rules <= BROADCAST_MAX_RULES else lookup

    h = F.col(host_col)
    n_labels = F.when(h == "", F.lit(0)).otherwise(F.size(F.split(h, r"\.")))
    p = prefix
    df = df.select("*", n_labels.alias(p + "nl"))
    flags = []
    for k in range(1, depth + 1):
        # candidate of k labels; for wildcards the parent (k-1 labels) is looked up
        df = df.withColumn(p + f"c{k}", F.when(F.col(p + "nl") >= k, _last_labels(h, k)))
        l1 = lk.select(F.col("key").alias(p + f"k{k}"), F.col("is_rule").alias(p + f"r{k}"),
                       F.col("is_exc").alias(p + f"e{k}"))
        df = df.join(l1, F.col(p + f"c{k}") == F.col(p + f"k{k}"), "left").drop(p + f"k{k}")
        if k >= 2:
            df = df.withColumn(p + f"pc{k}", F.when(F.col(p + "nl") >= k, _last_labels(h, k - 1)))
            l2 = lk.select(F.col("key").alias(p + f"wk{k}"), F.col("is_wild").alias(p + f"w{k}"))
            df = df.join(l2, F.col(p + f"pc{k}") == F.col(p + f"wk{k}"), "left").drop(p + f"wk{k}", p + f"pc{k}")
        flags.append(k)
    # longest candidate first; an exception at a depth beats a rule there
    slen = F.lit(0)
    for k in flags:  # built inside-out so the largest k is tested first
        e = F.coalesce(F.col(p + f"e{k}"), F.lit(0)) == 1
        r = F.coalesce(F.col(p + f"r{k}"), F.lit(0)) == 1
        w = (F.coalesce(F.col(p + f"w{k}"), F.lit(0)) == 1) if k >= 2 else F.lit(False)
        slen = F.when(e, F.lit(k - 1)).when(r | w, F.lit(k)).otherwise(slen)
    df = df.withColumn(p + "suffix_len", slen)
    domain = F.when(
        (F.col(p + "suffix_len") > 0) & (F.col(p + "nl") > F.col(p + "suffix_len")),
        F.element_at(F.split(h, r"\."), F.col(p + "nl") - F.col(p + "suffix_len")),
    ).otherwise(F.lit(""))
    df = df.withColumn(p + "domain", domain)
    drop = [p + "nl"] + [p + f"{x}{k}" for k in flags for x in ("c", "r", "e", "w")]
    return df.drop(*drop)
