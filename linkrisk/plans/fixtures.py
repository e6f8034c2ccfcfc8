"""Derived input views over the given parquet tables.

``url_corpus`` turns every ``lineitem`` row into one URL of ten shapes (six
risky) with a noisy label; ``scored_urls`` adds a score correlated with the
label; ``scan_log`` stands in for the scan table (from ``events``);
``labelled_pages`` joins ``pages`` to ``labels``. All are lazy projections of
the source scans, so column pruning and filter pushdown reach the parquet
reader and the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.session import read_table, spread_scan


def _s(c: str):
    return F.col(c).cast("string")


def url_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return corpus_from_lineitem(spread_scan(li))


def corpus_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The url_corpus projection of a (batch or streaming) lineitem frame."""
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    shape = F.col("l_orderkey") % 10
    url = (
        F.when(shape == 0, F.concat(F.lit("https://www.google.com/search?q="), _s("l_partkey")))
        .when(shape == 1, F.concat(F.lit("https://docs.example.org/en/"), _s("l_suppkey"), F.lit("/"), _s("l_partkey")))
        .when(shape == 2, F.concat(F.lit("https://shop.example.com/item/"), _s("l_partkey"), F.lit("?ref="),
                                   _s("l_linenumber"), F.lit("&page="), _s("l_suppkey")))
        .when(shape == 3, F.concat(F.lit("https://github.com/org"), _s("l_suppkey"), F.lit("/repo/issues/"),
                                   _s("l_orderkey")))
        .when(shape == 4, F.concat(F.lit("http://192.168."), (F.col("l_suppkey") % 256).cast("string"), F.lit("."),
                                   _s("l_linenumber"), F.lit("/secure-login")))
        .when(shape == 5, F.concat(F.lit("http://paypa1.com/account/update?id="), _s("l_orderkey")))
        .when(shape == 6, F.concat(F.lit("http://paypal-verify.xyz/"), _s("l_suppkey"), F.lit("/confirm")))
        .when(shape == 7, F.concat(F.lit("https://google.login"), _s("l_suppkey"), F.lit(".evil.com/signin")))
        .when(shape == 8, F.concat(F.lit("http://user"), _s("l_suppkey"), F.lit("@evil.top:8080/a//b")))
        .otherwise(F.concat(F.lit("evil"), _s("l_suppkey"), F.lit(".tk/webscr?cmd="), _s("l_partkey"), F.lit("&x=%20")))
    )
    label = F.when((shape >= 4) != (F.col("l_partkey") % 40 == 0), F.lit(1)).otherwise(F.lit(0))
    u = ((F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 10000).cast(
        "double") / F.lit(10000.0)
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("url_id"),
        url.alias("url"),
        label.cast("int").alias("label"),
        u.alias("u"),
    )


def scored_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = url_corpus(spark, sf_dir)
    return c.select("url_id", "url", "label",
                    (F.lit(0.5) * F.col("label") + F.lit(0.5) * F.col("u")).alias("raw_score"))


def scan_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    v = F.col("value")
    return ev.select(
        F.col("event_id").alias("scan_id"),
        F.col("ts").alias("scanned_at"),
        "user_id",
        F.least(v / F.lit(100.0), F.lit(1.0)).alias("score"),
        F.when(v >= 75, "Dangerous").when(v >= 45, "Suspicious").otherwise("Safe").alias("verdict"),
        F.when(v >= 45, F.concat(F.lit("campaign_"), F.lpad((F.col("user_id") % 7).cast("string"), 3, "0")))
        .alias("campaign_id"),
        F.col("props").alias("features_json"),
    )


def labelled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    lb = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return p.join(lb, p.page_id == lb.doc_id).select("page_id", "url", F.col("toxic").alias("label"))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_scan(read_table(spark, sf_dir, "pages").select("page_id", "url"))


def hard_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One URL per ``part`` row in shapes that are hard to split: missing, blank, bracketed,
    bad ports, other schemes, user info, parameters, non-ASCII text, trailing dots."""
    p = read_table(spark, sf_dir, "part").select("p_partkey")
    k, shape = _s("p_partkey"), F.col("p_partkey") % 18
    url = F.when(shape == 0, F.lit(None).cast("string"))
    for i, (before, after) in enumerate(HARD_SHAPES, 1):
        url = url.when(shape == i, F.concat(F.lit(before), k, F.lit(after)) if after is not None else F.lit(before))
    return spread_scan(p).select(F.col("p_partkey").alias("url_id"), url.otherwise(F.concat(F.lit("http:///"), k)).alias("url"))


#: Text before and after the key of each shape of ``hard_urls`` (None: no key).
HARD_SHAPES = [
    ("", None), ("   ", None), ("http://[::1]:80", "/a//b"), ("http://[fe80::1%25eth", "]/x"), ("http://[1:2:3", "/x"),
    ("http://host.tk:abc", "/login"), ("http://host.tk:99999/", ""), ("http://münchen", ".de/straße?q=ü&r"),
    ("HTTPS://User:Pw@ExAmple.CO.UK:443/A;b/", ";d?x=1&y=2#frag"), ("//paypal.com/", "/x"), ("javascript:alert(", ")"),
    ("http://1.2.3.4:0/", "/"), ("http://secure-paypal.a.b", ".gov.uk./x"), ("ftp://google.com/", ";type=a"),
    ("http://x٣", ".top/٤٥"), ("https://a@b@paypa1.com/", "%20%zz"), ("http://shop.kobe", ".jp:/p"),
]
