"""Score blending, rule boosts, verdicts and display columns.

All ``CASE`` arithmetic on columns, so scoring is one narrow projection that
runs unchanged in batch and streaming. Boosts are added in the original order
so the doubles are bit-identical (x + 0.0 == x for the terms that do not fire).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import (
    OTHER_WEIGHT, RF_WEIGHT, RULE_ALERT_TEXTS, THRESHOLD_DANGEROUS, THRESHOLD_SUSPICIOUS,
)


def blend(df: DataFrame, rf: str = "rf_score", other: str = "other_score", out: str = "raw_score") -> DataFrame:
    """``0.6*rf + 0.4*other``; the model score alone when ``other`` is NULL."""
    r, o = F.col(rf), F.col(other)
    return df.withColumn(out, F.when(o.isNull(), r).otherwise(F.lit(RF_WEIGHT) * r + F.lit(OTHER_WEIGHT) * o))


def external_prob(label: Column, score: Column) -> Column:
    """A text classifier's (label, score) -> P(phishing); NULL on failure."""
    up = F.upper(label)
    phish = up.contains("1") | up.contains("PHISH")
    return F.when(label.isNull() | score.isNull(), F.lit(None).cast("double")) \
        .when(phish, score.cast("double")).otherwise(F.lit(1.0) - score.cast("double"))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) != 0


def with_rule_score(df: DataFrame, raw: str = "raw_score", out: str = "score") -> DataFrame:
    """Rule boosts on top of the model score -> ``score`` and ``rule_alerts``.

    Needs the feature columns of ``with_url_features``.
    """
    typo, ip, brand = _flag("is_typosquat"), _flag("has_ip"), _flag("brand_in_subdomain")
    tld, at, https = _flag("tld_suspicious"), _flag("has_at_in_url"), _flag("has_https")
    subs = F.coalesce(F.col("num_subdomains"), F.lit(0))
    ent = F.coalesce(F.col("hostname_entropy"), F.lit(0.0))
    words = F.coalesce(F.col("num_suspicious_words"), F.lit(0))
    lev = F.coalesce(F.col("min_levenshtein"), F.lit(99))
    r = F.col(raw)

    terms = [(typo, 0.15), (ip, 0.15), (brand, 0.15), (tld, 0.10), (at, 0.10), (subs > 3, 0.05), (ent > 4.0, 0.05)]
    boost = F.lit(0.0)
    for cond, w in terms:
        boost = boost + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    boost = F.least(boost, F.lit(0.30))
    hard = ip | brand | at | (subs > 2) | (tld & typo)
    dang = F.lit(THRESHOLD_DANGEROUS)
    raw_adj = F.when((r >= dang) & ~hard, dang - F.lit(0.05)).otherwise(r)
    boost_adj = (F.when(r >= dang, F.lit(0.0))
                 .when(r < 0.40, boost * F.lit(0.30))
                 .when(r < 0.65, boost * F.lit(0.60))
                 .otherwise(boost))
    clean = https & ~tld & (words == 0) & ~ip & ~typo & ~brand & ~at
    raw_fin = F.when(clean, raw_adj * F.lit(0.40)).otherwise(raw_adj)
    score = F.least(raw_fin + boost_adj, F.lit(1.0))

    t = RULE_ALERT_TEXTS
    alerts = F.array(
        F.when(typo, F.format_string(t["typosquat"].replace("{lev}", "%d"), lev)),
        F.when(ip, F.lit(t["has_ip"])),
        F.when(brand, F.lit(t["brand_in_subdomain"])),
        F.when(tld, F.lit(t["tld_suspicious"])),
        F.when(at, F.lit(t["has_at"])),
        F.when(subs > 3, F.format_string(t["subdomains"].replace("{n}", "%d"), subs)),
        F.when(ent > 4.0, F.format_string(t["entropy"].replace("{e}", "%.2f"), ent)),
    )
    return df.withColumn(out, score).withColumn("rule_alerts", F.filter(alerts, lambda a: a.isNotNull()))


def verdict(score: Column) -> Column:
    """Verdict from the unrounded score."""
    return (F.when(score >= THRESHOLD_DANGEROUS, F.lit("Dangerous"))
            .when(score >= THRESHOLD_SUSPICIOUS, F.lit("Suspicious"))
            .otherwise(F.lit("Safe")))


def result_rows(df: DataFrame, score: str = "score", raw: str = "raw_score", rf: str = "rf_score") -> DataFrame:
    """Rounded result columns (4 decimals; percent to 1 decimal)."""
    from linkrisk.functions.features import round_even
    cols = [round_even(F.col(score), 4).alias("score_r"), round_even(F.col(raw), 4).alias("raw_r"),
            round_even(F.col(score) * 100, 1).alias("percent")]
    if rf in df.columns:
        cols.append(round_even(F.col(rf), 4).alias("rf_r"))
    return df.select("*", *cols)


def campaign_name(cluster: Column) -> Column:
    """``campaign_%03d``."""
    return F.format_string("campaign_%03d", cluster.cast("int"))


def minute_text(ts: Column) -> Column:
    """Minute-resolution display of a timestamp."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def metric_text(v: Column) -> Column:
    """``round(100*v, 1)%``; NULL or <= 0 -> a dash."""
    return F.when(v.isNull() | (v <= 0), F.lit("—")).otherwise(
        F.concat(F.format_string("%.1f", F.round(v * 100, 1)), F.lit("%")))


def campaign_tags(n: Column) -> Column:
    """``large-cluster`` when n >= 10, ``active`` when n > 0."""
    return F.filter(F.array(F.when(n >= 10, F.lit("large-cluster")), F.when(n > 0, F.lit("active"))),
                    lambda x: x.isNotNull())


def direction(contribution: Column) -> Column:
    """Contribution > 0 -> increases, else decreases."""
    return F.when(contribution > 0, F.lit("increases")).otherwise(F.lit("decreases"))
