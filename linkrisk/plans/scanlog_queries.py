"""Registered scan-log queries (Spark side + DuckDB oracle)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from linkrisk.functions.rules import metric_text
from linkrisk.operators import scanlog as L
from linkrisk.plans import oracle_sql as O
from linkrisk.plans.fixtures import scan_log
from linkrisk.session import ensure_checkpoint_dir

TS = "yyyy-MM-dd HH:mm:ss"
DTS = "%Y-%m-%d %H:%M:%S"


def _ssql(body: str, *extra: str) -> str:
    return O.with_ctes(O.SCAN_LOG, *extra) + body


def q_history(spark, sf_dir):
    h = L.history(scan_log(spark, sf_dir), 50)
    return h.select("scan_id", "verdict", "score", "campaign_id",
                    F.date_format("scanned_at", TS).alias("scanned_at"))


SQL_HISTORY = _ssql(f"""SELECT scan_id, verdict, score, campaign_id, strftime(scanned_at, '{DTS}') AS scanned_at
FROM scan_log ORDER BY scan_id DESC LIMIT 50""")


def q_timeline(spark, sf_dir):
    return L.timeline(scan_log(spark, sf_dir))


SQL_TIMELINE = _ssql("""SELECT scan_id, verdict, strftime(scanned_at, '%Y-%m-%d %H:%M') AS time
FROM scan_log ORDER BY scan_id DESC LIMIT 10""")


def q_scan_lookup(spark, sf_dir):
    s = L.scan_lookup(scan_log(spark, sf_dir), 42)
    return s.select("scan_id", "user_id", "verdict", "score", "campaign_id",
                    F.date_format("scanned_at", TS).alias("scanned_at"))


SQL_SCAN_LOOKUP = _ssql(f"""SELECT scan_id, user_id, verdict, score, campaign_id, strftime(scanned_at, '{DTS}') AS scanned_at
FROM scan_log WHERE scan_id = 42""")


def q_dashboard(spark, sf_dir):
    return L.dashboard(scan_log(spark, sf_dir))


SQL_DASHBOARD = _ssql("""SELECT count(*) AS total_scans, CAST(count_if(verdict = 'Dangerous') AS BIGINT) AS dangerous,
 CAST(count_if(verdict = 'Suspicious') AS BIGINT) AS suspicious, CAST(count_if(verdict = 'Safe') AS BIGINT) AS safe
FROM scan_log""")


def q_phishing_scan_count(spark, sf_dir):
    return L.phishing_scan_count(scan_log(spark, sf_dir))


SQL_PHISHING_COUNT = _ssql("SELECT count(*) AS n FROM scan_log WHERE verdict IN ('Dangerous', 'Suspicious')")


def q_json_features(spark, sf_dir):
    p = L.phishing_scans_with_features(scan_log(spark, sf_dir))
    return p.select("scan_id", F.col("features")["k"].alias("k"), F.size("features").alias("n_features"))


SQL_JSON_FEATURES = _ssql("""SELECT scan_id, TRY_CAST(json_extract(features_json, '$.k') AS DOUBLE) AS k,
 CAST(len(json_keys(features_json)) AS INTEGER) AS n_features
FROM scan_log WHERE verdict IN ('Dangerous', 'Suspicious') AND json_valid(features_json) AND len(json_keys(features_json)) > 0""")


def _campaign_names(spark, sf_dir):
    s = scan_log(spark, sf_dir)
    return s.select(F.concat(F.lit("campaign_"), F.lpad((F.col("user_id") % 9).cast("string"), 3, "0")).alias("name")).distinct()


def q_campaign_scans(spark, sf_dir):
    c = L.campaign_scans(_campaign_names(spark, sf_dir), scan_log(spark, sf_dir))
    return c.select("name", "n_scans", F.concat_ws(",", F.col("first_ids").cast("array<string>")).alias("first_ids"), "more")


SQL_CAMPAIGN_SCANS = _ssql("""SELECT c.name, coalesce(n_scans, 0) AS n_scans, coalesce(first_ids, '') AS first_ids,
 greatest(coalesce(n_scans, 0) - 5, 0) AS more
FROM (SELECT DISTINCT concat('campaign_', lpad(CAST(user_id % 9 AS VARCHAR), 3, '0')) AS name FROM scan_log) c
LEFT JOIN (SELECT campaign_id AS name, count(*) AS n_scans FROM scan_log WHERE campaign_id IS NOT NULL GROUP BY 1) s ON s.name = c.name
LEFT JOIN (SELECT name, string_agg(CAST(scan_id AS VARCHAR), ',' ORDER BY scan_id) AS first_ids FROM (
   SELECT campaign_id AS name, scan_id, row_number() OVER (PARTITION BY campaign_id ORDER BY scan_id) AS rn
   FROM scan_log WHERE campaign_id IS NOT NULL) t WHERE rn <= 5 GROUP BY name) f ON f.name = c.name""")


def q_campaign_members(spark, sf_dir):
    m = L.campaign_members(_campaign_names(spark, sf_dir), scan_log(spark, sf_dir))
    return m.select("campaign", "scan_id", F.date_format("created_at", TS).alias("created_at"))


SQL_CAMPAIGN_MEMBERS = _ssql(f"""SELECT c.name AS campaign, s.scan_id, strftime(s.scanned_at, '{DTS}') AS created_at
FROM (SELECT DISTINCT concat('campaign_', lpad(CAST(user_id % 9 AS VARCHAR), 3, '0')) AS name FROM scan_log) c
LEFT JOIN scan_log s ON s.campaign_id = c.name""")


def q_sorted_lookup(spark, sf_dir):
    """B4 on the sorted copy of the log: one scan in a thousand by id, through the reader."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"sorted-log-{uuid.uuid4().hex}")
    scans = scan_log(spark, sf_dir)
    L.write_sorted_log(scans, path)
    ids = scans.filter(F.col("scan_id") % 1000 == 0).select("scan_id")
    log = spark.read.parquet(path)
    return log.join(ids, "scan_id").select("scan_id", "user_id", "verdict", "campaign_id")


SQL_SORTED_LOOKUP = _ssql("SELECT scan_id, user_id, verdict, campaign_id FROM scan_log WHERE scan_id % 1000 = 0")


def broken_payloads(spark, sf_dir):
    """The scan log with a cut, an empty, a null or a non-JSON payload in four scans of seven."""
    s = scan_log(spark, sf_dir)
    k, text = F.col("scan_id") % 7, F.col("features_json")
    return s.withColumn("features_json", F.when(k == 0, F.expr("left(features_json, length(features_json) - 1)")).when(k == 1, "")
                        .when(k == 2, F.lit(None)).when(k == 3, "not json").otherwise(text))


def q_broken_json_features(spark, sf_dir):
    """H35 + B5 on payloads that are partly unreadable."""
    p = L.phishing_scans_with_features(broken_payloads(spark, sf_dir))
    return p.select("scan_id", F.col("features")["k"].alias("k"), F.size("features").alias("n_features"))


SQL_BROKEN_JSON = _ssql("""SELECT scan_id, TRY_CAST(json_extract(j, '$.k') AS DOUBLE) AS k, CAST(len(json_keys(j)) AS INTEGER) AS n_features
FROM (SELECT scan_id, verdict, CASE scan_id % 7 WHEN 0 THEN left(features_json, length(features_json) - 1) WHEN 1 THEN ''
   WHEN 2 THEN NULL WHEN 3 THEN 'not json' ELSE features_json END AS j FROM scan_log) t
WHERE verdict IN ('Dangerous', 'Suspicious') AND CASE WHEN json_valid(j) THEN len(json_keys(j)) > 0 ELSE FALSE END""")


def q_assign_update(spark, sf_dir):
    s = scan_log(spark, sf_dir)
    a = s.filter(F.col("verdict") == "Dangerous").select(
        "scan_id", F.concat(F.lit("campaign_"), F.lpad(((F.col("user_id") * 3) % 5).cast("string"), 3, "0")).alias("campaign_id"))
    return L.update_assignments(s, a).select("scan_id", "campaign_id")


SQL_ASSIGN_UPDATE = _ssql("""SELECT s.scan_id, coalesce(a.cid, s.campaign_id) AS campaign_id FROM scan_log s
LEFT JOIN (SELECT scan_id, concat('campaign_', lpad(CAST((user_id * 3) % 5 AS VARCHAR), 3, '0')) AS cid
           FROM scan_log WHERE verdict = 'Dangerous') a ON a.scan_id = s.scan_id""")


def q_campaign_cards(spark, sf_dir):
    s = scan_log(spark, sf_dir).filter(F.col("campaign_id").isNotNull())
    sizes = s.groupBy(F.col("campaign_id").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return L.campaign_cards(sizes, top=10)


SQL_CAMPAIGN_CARDS = _ssql("""SELECT name, n, CAST(floor(n * 100.0E0 / CASE WHEN mx = 0 THEN 1 ELSE mx END + 0.5E0) AS INTEGER) AS bar_pct,
 concat_ws(',', CASE WHEN n >= 10 THEN 'large-cluster' END, CASE WHEN n > 0 THEN 'active' END) AS tags
FROM (SELECT name, n, max(n) OVER () AS mx FROM (SELECT campaign_id AS name, count(*) AS n FROM scan_log
      WHERE campaign_id IS NOT NULL GROUP BY 1) g) t ORDER BY n DESC, name LIMIT 10""")


def q_verdict_metric_text(spark, sf_dir):
    """H39 over the dashboard shares: a verdict's share of all scans as text."""
    d = L.dashboard(scan_log(spark, sf_dir))
    t = F.col("total_scans")
    return d.select(metric_text(F.col("dangerous") / t).alias("dangerous_pct"),
                    metric_text(F.col("suspicious") / t).alias("suspicious_pct"),
                    metric_text(F.col("safe") / t).alias("safe_pct"))


def _mt(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN '—' ELSE printf('%.1f', round({x} * 100, 1)) || '%' END"


SQL_VERDICT_METRIC_TEXT = _ssql(f"""SELECT {_mt('d')} AS dangerous_pct, {_mt('s')} AS suspicious_pct, {_mt('f')} AS safe_pct FROM (
 SELECT count_if(verdict = 'Dangerous') / count(*) AS d, count_if(verdict = 'Suspicious') / count(*) AS s,
        count_if(verdict = 'Safe') / count(*) AS f FROM scan_log) t""")


def register(qs: dict, sql: dict) -> None:
    for name, fn, s in [
        ("history", q_history, SQL_HISTORY),
        ("timeline", q_timeline, SQL_TIMELINE),
        ("scan_lookup", q_scan_lookup, SQL_SCAN_LOOKUP),
        ("dashboard", q_dashboard, SQL_DASHBOARD),
        ("phishing_scan_count", q_phishing_scan_count, SQL_PHISHING_COUNT),
        ("json_features", q_json_features, SQL_JSON_FEATURES),
        ("campaign_scans", q_campaign_scans, SQL_CAMPAIGN_SCANS),
        ("campaign_members", q_campaign_members, SQL_CAMPAIGN_MEMBERS),
        ("sorted_lookup", q_sorted_lookup, SQL_SORTED_LOOKUP),
        ("broken_json_features", q_broken_json_features, SQL_BROKEN_JSON),
        ("assign_update", q_assign_update, SQL_ASSIGN_UPDATE),
        ("campaign_cards", q_campaign_cards, SQL_CAMPAIGN_CARDS),
        ("verdict_metric_text", q_verdict_metric_text, SQL_VERDICT_METRIC_TEXT),
    ]:
        qs[name] = fn
        sql[name] = s
