"""Registered checks of the feed readers and the sinks.

The feed files are written from the URL corpus in every format that the readers take, with
the flaws that feeds have (other statuses, blanks, lines that are no URL, malformed CSV
lines, unverified entries), then read back; missing sources are skipped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.operators import dataset as D
from linkrisk.operators import scanlog as L
from linkrisk.plans import oracle_sql as O
from linkrisk.plans.dataset_queries import MERGED_SQL, merged
from linkrisk.plans.fixtures import scan_log, url_corpus
from linkrisk.session import ensure_checkpoint_dir
from linkrisk.sources import feeds

#: Feed entries per JSON array file.
ARRAYS = 16
BAD_CSV = "url,target\nhttp://bad.tk/,bank,more,fields\nhttp://good.tk/ok,bank"


def _folder(spark, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def write_feeds(spark, sf_dir) -> list[tuple[str, str]]:
    """(kind, path) of feeds written from the URL corpus, and of one that does not exist."""
    base = _folder(spark, "feeds")
    at = {k: os.path.join(base, k) for k in ("phishing_csv", "url_lines", "verified_csv", "feed_json", "feed_json_split", "ranked_domains")}
    c = url_corpus(spark, sf_dir).select("url_id", "url", "label")
    bad = lambda *shares: c.filter((F.col("label") == 1) & (F.col("url_id") % 8).isin(*shares))
    status = F.when(F.col("url_id") % 3 == 0, "offline").otherwise("phishing")
    bad(0, 4).select(F.col("url_id").alias("id"), F.col("url").alias("phish_url"), status.alias("status")).write.option("header", True).csv(at["phishing_csv"])
    line = F.when(F.col("url_id") % 5 == 0, F.concat(F.lit("no url "), "url_id")).otherwise(F.concat(F.lit(" \t"), "url", F.lit("  ")))
    bad(1, 5).select(line.alias("value")).write.text(at["url_lines"])
    bad(2, 6).select("url", F.lit("bank").alias("target")).write.option("header", True).csv(at["verified_csv"])
    spark.createDataFrame([(BAD_CSV,)], "value string").write.mode("append").text(at["verified_csv"])
    yes = lambda by: F.when(F.col("url_id") % by == 0, "no").otherwise("yes")
    for kind, share in (("feed_json", 3), ("feed_json_split", 7)):
        entry = F.struct("url", yes(3).alias("verified"), yes(7).alias("online"))
        arrays = bad(share).groupBy((F.col("url_id") % ARRAYS).alias("file")).agg(F.to_json(F.collect_list(entry)).alias("value"))
        arrays.repartition(ARRAYS, "file").select("value").write.option("lineSep", "\n").text(at[kind])
    ranked = c.filter("label = 0").select("url_id", F.concat(F.lit("site"), (F.col("url_id") % 1000).cast("string"), F.lit(".org")))
    ranked.write.csv(at["ranked_domains"])
    return [*at.items(), ("phishing_csv", os.path.join(base, "missing"))]


def _read(spark, sf_dir):
    curated = url_corpus(spark, sf_dir).filter("label = 0").select("url")
    return feeds.read_all(spark, write_feeds(spark, sf_dir), curated)


def q_feed_urls(spark, sf_dir):
    """Every URL that the readers accept, by class."""
    phish, legit, _ = _read(spark, sf_dir)
    return phish.select("url", F.lit(1).alias("label")).unionByName(legit.select("url", F.lit(0).alias("label")))


def q_feed_counts(spark, sf_dir):
    """Rows per source read."""
    return _read(spark, sf_dir)[2].select(F.substring_index("source", ":", 1).alias("source"), "n")


FEEDS_SQL = """feeds AS (
 SELECT 'phishing_csv' AS source, url, 1 AS label FROM url_corpus WHERE label = 1 AND url_id % 8 IN (0, 4) AND url_id % 3 <> 0
 UNION ALL SELECT 'url_lines', url, 1 FROM url_corpus WHERE label = 1 AND url_id % 8 IN (1, 5) AND url_id % 5 <> 0 AND starts_with(url, 'http')
 UNION ALL SELECT 'verified_csv', url, 1 FROM url_corpus WHERE label = 1 AND url_id % 8 IN (2, 6)
 UNION ALL SELECT 'verified_csv', 'http://good.tk/ok', 1
 UNION ALL SELECT 'feed_json', url, 1 FROM url_corpus WHERE label = 1 AND url_id % 8 = 3 AND url_id % 3 <> 0 AND url_id % 7 <> 0
 UNION ALL SELECT 'feed_json_split', url, 1 FROM url_corpus WHERE label = 1 AND url_id % 8 = 7 AND url_id % 3 <> 0 AND url_id % 7 <> 0
 UNION ALL SELECT 'ranked_domains', concat('https://site', CAST(url_id % 1000 AS VARCHAR), '.org'), 0 FROM url_corpus WHERE label = 0
 UNION ALL SELECT DISTINCT 'curated_legit', url, 0 FROM url_corpus WHERE label = 0)"""

SQL_FEED_URLS = O.with_ctes(O.URL_CORPUS, FEEDS_SQL) + "SELECT url, label FROM feeds"
SQL_FEED_COUNTS = O.with_ctes(O.URL_CORPUS, FEEDS_SQL) + """SELECT source, count(*) AS n FROM feeds WHERE source <> 'curated_legit' GROUP BY 1
UNION ALL SELECT 'curated_legit', count(*) FROM url_corpus WHERE label = 0"""


def q_sink_round_trip(spark, sf_dir):
    """The dataset (Parquet by label), class statistics (JSON) and error samples (CSV) as
    written and read again."""
    base = _folder(spark, "sinks")
    path = lambda x: os.path.join(base, x)
    data = merged(spark, sf_dir)
    feeds.write_table(data, path("dataset"), partition_by=["label"])
    data = spark.read.parquet(path("dataset"))
    feeds.write_table(D.class_stats(data), path("stats"), fmt="json")
    feeds.write_table(data.filter(F.length("url") % 50 == 0).select("url", "label"), path("errors"), fmt="csv")
    stats = spark.read.schema("label int, n long").json(path("stats"))
    errors = spark.read.schema("url string, label int").option("header", True).csv(path("errors"))
    out = data.select(F.lit("dataset").alias("sink"), F.col("url").alias("item"), F.col("label").cast("long").alias("value"))
    out = out.unionByName(stats.select(F.lit("stats").alias("sink"), F.col("label").cast("string").alias("item"), F.col("n").alias("value")))
    return out.unionByName(errors.select(F.lit("errors").alias("sink"), F.col("url").alias("item"), F.col("label").cast("long").alias("value")))


SQL_SINKS = O.with_ctes(O.URL_CORPUS, *MERGED_SQL) + """SELECT 'dataset' AS sink, url AS item, CAST(label AS BIGINT) AS value FROM merged
UNION ALL SELECT 'stats', CAST(label AS VARCHAR), count(*) FROM merged GROUP BY label
UNION ALL SELECT 'errors', url, CAST(label AS BIGINT) FROM merged WHERE length(url) % 50 = 0"""


def q_append_and_replace(spark, sf_dir) -> DataFrame:
    """A12 + A13: scans appended in two parts with rounded scores; the campaign table replaced."""
    base = _folder(spark, "append")
    log, camp = os.path.join(base, "log"), os.path.join(base, "campaigns")
    s = scan_log(spark, sf_dir).select("scan_id", "verdict", "score", "campaign_id")
    for part in (0, 1):
        L.append_scans(s.filter(F.col("scan_id") % 2 == part), log)
    stored = spark.read.parquet(log)
    sizes = stored.filter("campaign_id is not null").groupBy(F.col("campaign_id").alias("name")).agg(F.count("*").alias("size"))
    L.replace_campaigns(sizes.withColumn("size", F.lit(0).cast("long")), camp)
    L.replace_campaigns(sizes, camp)
    kept = spark.read.parquet(camp)
    return stored.join(kept, stored["campaign_id"] == kept["name"], "left").select("scan_id", "verdict", "score", "campaign_id", "size")


SQL_APPEND = O.with_ctes(O.SCAN_LOG) + f"""SELECT s.scan_id, s.verdict, {O.round_even_sql('s.score')} AS score, s.campaign_id, c.size
FROM scan_log s LEFT JOIN (SELECT campaign_id AS name, count(*) AS size FROM scan_log WHERE campaign_id IS NOT NULL GROUP BY 1) c
ON c.name = s.campaign_id"""


def register(qs: dict, sql: dict) -> None:
    for name, fn, s in [("feed_urls", q_feed_urls, SQL_FEED_URLS), ("feed_counts", q_feed_counts, SQL_FEED_COUNTS),
                        ("sink_round_trip", q_sink_round_trip, SQL_SINKS), ("append_and_replace", q_append_and_replace, SQL_APPEND)]:
        qs[name] = fn
        sql[name] = s
