"""URL filters [native]: empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each
level gets a beta-binomial prior whose mean is the posterior mean one level up
and whose strength is fitted to the level's own spread (moments). A host is
blocked when the lower posterior bound of its share of bad pages is above a
limit: few bad pages on a new host do not block it, many do. Fixed rules on
(host, path) come first.

Scale: one narrow pass over urls, one aggregate per level (combined map-side),
then one join of the pages with the hosts' table, which the engine can split
when one host holds a third of the pages.

Edge cases: a null url, or one without ``://``, has an empty host and path; it is
judged as the host ``''``. A host without labels falls back on its domain's, its
suffix's or the overall prior. Null outcomes count as unlabelled. Without any
label every host is allowed. Repeated pages are judged alike, row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.llm.base import lower_ascii, store

#: Suffixes of two labels under which names are registered (parameter default).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.nz", "com.mx", "co.in")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Limits:
    """z: width of the posterior bound in standard deviations; max_bad: the
    share of bad pages a host may have."""
    z: float = 1.645
    max_bad: float = 0.5


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value`` of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def suffix_of(host: Column, two: tuple[str, ...]) -> Column:
    name = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    return F.when(F.substring_index(name, ".", -2).isin(*two), F.substring_index(name, ".", -2)).otherwise(
        F.substring_index(name, ".", -1))


def domain_of(host: Column, two: tuple[str, ...]) -> Column:
    name = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    return F.when(F.substring_index(name, ".", -2).isin(*two), F.substring_index(name, ".", -3)).otherwise(
        F.substring_index(name, ".", -2))


def _mean(m: float, parent: Column) -> Column:
    return (F.lit(m) * parent + F.col("bad")) / (F.lit(m) + F.col("n"))


def _strength(level: DataFrame, parent: str) -> float:
    """Prior strength from the excess of the children's spread over binomial
    noise: with S = sum n (p - mu)^2 / (mu (1 - mu)) over k children,
    E[S] = k + rho * sum(n - 1), and the strength is 1 / rho - 1."""
    mu = F.least(F.greatest(F.col(parent), F.lit(1e-3)), F.lit(1 - 1e-3))
    p = F.col("bad") / F.col("n")
    s, k, m = level.filter("n > 0").agg(
        F.sum(F.col("n") * (p - mu) * (p - mu) / (mu * (1 - mu))), F.count("*"), F.sum(F.col("n") - 1)).first()
    if not k or not m:
        return 10.0
    rho = min(max((s - k) / m, 1e-3), 0.5)
    return 1 / rho - 1


def host_reputation(outcomes: DataFrame, two: tuple[str, ...] = TWO_LABEL_SUFFIXES,
                    limits: Limits = Limits()) -> DataFrame:
    """(host, n, bad, bad_mean, bad_lower, blocked) of every host of ``outcomes``
    (host string, bad 0/1 or null for unlabelled pages)."""
    hosts = store(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
                  .withColumns({"domain": domain_of(F.col("host"), two), "suffix": suffix_of(F.col("host"), two)}), "hosts")
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    suffixes = domains.groupBy("suffix").agg(*add)
    n, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    mu = (bad + 1) / (n + 2) if n else 0.0
    suffixes = suffixes.withColumn("up", F.lit(float(mu)))
    m0 = _strength(suffixes, "up")
    suffixes = suffixes.select("suffix", _mean(m0, F.col("up")).alias("suffix_bad"))
    domains = domains.join(suffixes, "suffix")
    m1 = _strength(domains, "suffix_bad")
    domains = domains.select("domain", "suffix", _mean(m1, F.col("suffix_bad")).alias("domain_bad"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    m2 = _strength(hosts, "domain_bad")
    mean = _mean(m2, F.col("domain_bad"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("n") + F.lit(m2 + 1)))
    return (hosts.withColumns({"bad_mean": mean, "bad_lower": mean - F.lit(limits.z) * sd})
            .select("host", "n", "bad", "bad_mean", "bad_lower", (F.col("bad_lower") > limits.max_bad).alias("blocked")))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], two: tuple[str, ...] = TWO_LABEL_SUFFIXES,
               limits: Limits = Limits(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, labelled, bad_mean, bad_lower) of every page.

    labels: (url_key string, bad 0/1). A page's key is the number that ends its
    path (the document behind the page); pages without one are unlabelled.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    keyed = urls.select("host", F.nullif(F.regexp_extract("path", "/([0-9]+)(?:[.]html|/)?$", 1), F.lit("")).alias("url_key"))
    known = labels.filter("bad is not null").groupBy("url_key").agg(F.max("bad").alias("bad"))
    table = host_reputation(keyed.join(known, "url_key", "left").select("host", "bad"), two, limits)
    table = table.select("host", F.col("n").alias("labelled"), "bad_mean", "bad_lower", "blocked")
    host, path = F.col("host"), F.col("path")
    by_rule = rule_of(host, path, rules, lambda r: r.verdict)
    by_host = F.when(F.col("blocked"), "block").otherwise("allow")
    return urls.join(table, "host", "left").select(
        "page_id", "host", "path", rule_of(host, path, rules, lambda r: r.text).alias("rule"),
        F.coalesce(by_rule, by_host).alias("verdict"), "labelled",
        F.round("bad_mean", 6).alias("bad_mean"), F.round("bad_lower", 6).alias("bad_lower"))
