"""Registered dataset / split / metric queries (Spark side + DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import FEATURE_COLS
from linkrisk.functions.features import round_even, with_url_features
from linkrisk.operators import dataset as D
from linkrisk.operators import metrics as M
from linkrisk.operators import split as S
from linkrisk.plans import oracle_sql as O
from linkrisk.plans.fixtures import scored_urls, url_corpus
from linkrisk.session import cut_lineage

# ------------------------------------------------------------------ dataset


def merged(spark, sf_dir) -> DataFrame:
    c = url_corpus(spark, sf_dir).select("url", "label")
    ph = cut_lineage(D.union_feeds([c.filter("label = 1")]))  # counted for the cap, then merged
    lg = D.union_feeds([c.filter("label = 0")])
    return D.merge_feeds(ph, lg)


MERGED_SQL = [
    "ph AS (SELECT DISTINCT url FROM url_corpus WHERE label = 1 AND url IS NOT NULL)",
    "lg AS (SELECT DISTINCT url FROM url_corpus WHERE label = 0 AND url IS NOT NULL)",
    "cap AS (SELECT CAST(floor(1.2E0 * count(*)) AS BIGINT) AS c FROM ph)",
    "lgc AS (SELECT url FROM (SELECT url, row_number() OVER (ORDER BY md5('42:' || url)) AS rn FROM lg) t, cap WHERE rn <= cap.c)",
    "merged AS (SELECT url, max(label) AS label FROM (SELECT url, 1 AS label FROM ph UNION ALL SELECT url, 0 AS label FROM lgc) u GROUP BY url)",
]


def _msql(body: str, *extra: str) -> str:
    return O.with_ctes(O.URL_CORPUS, *MERGED_SQL, *extra) + body


def q_merge_feeds(spark, sf_dir):
    return merged(spark, sf_dir)


def q_balance_cap(spark, sf_dir):
    c = url_corpus(spark, sf_dir).select("url", "label")
    return D.balance_cap(D.union_feeds([c.filter("label = 1")]), D.union_feeds([c.filter("label = 0")]))


def q_class_stats(spark, sf_dir):
    return D.class_stats(merged(spark, sf_dir))


def q_dataset_totals(spark, sf_dir):
    return D.dataset_totals(merged(spark, sf_dir))


def q_length_histogram(spark, sf_dir):
    return D.length_histogram(merged(spark, sf_dir))


SQL_LENGTH_HISTOGRAM = _msql("""SELECT s.label, CAST(b.bin AS INTEGER) AS bin,
 CASE WHEN hi = lo THEN lo - 0.5E0 ELSE CAST(lo AS DOUBLE) END
   + CASE WHEN hi = lo THEN 1.0E0 ELSE CAST(hi - lo AS DOUBLE) END * b.bin / 50 AS bin_start,
 CASE WHEN hi = lo THEN lo - 0.5E0 ELSE CAST(lo AS DOUBLE) END
   + CASE WHEN hi = lo THEN 1.0E0 ELSE CAST(hi - lo AS DOUBLE) END * (b.bin + 1) / 50 AS bin_end,
 CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM st s CROSS JOIN (SELECT range AS bin FROM range(50)) b
LEFT JOIN cnt c ON c.label = s.label AND c.bin = b.bin""",
                              "d AS (SELECT label, length(url) AS len FROM merged)",
                              "st AS (SELECT label, min(len) AS lo, max(len) AS hi FROM d GROUP BY label)",
                              """cnt AS (SELECT d.label, CAST(CASE WHEN hi = lo THEN 25 ELSE least(floor((len - lo) * 50 / (hi - lo)), 49) END AS INTEGER) AS bin,
 count(*) AS n FROM d JOIN st ON d.label = st.label GROUP BY 1, 2)""")


def q_top_tlds(spark, sf_dir):
    return D.top_tlds(merged(spark, sf_dir))


def _tld_sql() -> str:
    ctes, last = O.parts_ctes("phm", "t_", False)
    return O.with_ctes(O.URL_CORPUS, *MERGED_SQL, "phm AS (SELECT url FROM merged WHERE label = 1)", *ctes) + f"""
SELECT tld, count(*) AS n FROM (SELECT CASE WHEN t_bad_netloc OR url IS NULL THEN '?' ELSE split_part(t_host, '.', -1) END AS tld FROM {last}) t
GROUP BY tld ORDER BY n DESC, tld LIMIT 5"""


def merged_features(spark, sf_dir) -> DataFrame:
    return with_url_features(merged(spark, sf_dir))


def _merged_feat_sql() -> tuple[list[str], str]:
    ctes, last = O.feature_ctes("merged", ["url", "label"], extras=False)
    return [O.URL_CORPUS, *MERGED_SQL, *ctes], last


def q_feature_label_corr(spark, sf_dir):
    c = D.label_correlation(merged_features(spark, sf_dir))
    return c.select("feature", round_even(F.col("corr"), 9).alias("corr"), round_even(F.col("abs_corr"), 9).alias("abs_corr"))


def _corr_sql() -> str:
    ctes, last = _merged_feat_sql()
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) = 0 OR isnan(corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE))) "
        f"THEN NULL ELSE corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE)) END AS r FROM {last}" for c in FEATURE_COLS)
    return O.with_ctes(*ctes, f"cr AS ({sel})") + """SELECT feature, round_even(r * 1e9, 0) / 1e9 AS corr,
 round_even(abs(r) * 1e9, 0) / 1e9 AS abs_corr FROM cr"""


def q_scaler_stats(spark, sf_dir):
    from linkrisk.operators.models import fit_scaler
    s = fit_scaler(merged_features(spark, sf_dir), FEATURE_COLS)
    return s.select("feature", round_even(F.col("mean"), 9).alias("mean"), round_even(F.col("std"), 9).alias("std"))


def _scaler_sql() -> str:
    ctes, last = _merged_feat_sql()
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(CAST({c} AS DOUBLE)) AS m, stddev_pop(CAST({c} AS DOUBLE)) AS s FROM {last}"
        for c in FEATURE_COLS)
    return O.with_ctes(*ctes, f"ss AS ({sel})") + """SELECT feature, round_even(m * 1e9, 0) / 1e9 AS mean,
 round_even(CASE WHEN s = 0 THEN 1.0E0 ELSE s END * 1e9, 0) / 1e9 AS std FROM ss"""


def q_stratified_split(spark, sf_dir):
    return S.stratified_split(merged(spark, sf_dir))


SQL_STRATIFIED_SPLIT = _msql("""SELECT url, label, rn <= floor((4 * n + 10) / 20) AS is_test FROM (
 SELECT url, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || url)) AS rn,
        count(*) OVER (PARTITION BY label) AS n FROM merged) t""")


def q_kfold_assign(spark, sf_dir):
    return S.stratified_folds(merged(spark, sf_dir))


SQL_KFOLD = _msql("""SELECT url, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('fold42:' || url)) - 1) % 5 AS INTEGER) AS fold
FROM merged""")


def q_source_counts(spark, sf_dir):
    c = url_corpus(spark, sf_dir).select("url", "label")
    return D.source_counts({"phishing_feed": c.filter("label = 1"), "legit_feed": c.filter("label = 0")})


SQL_SOURCE_COUNTS = O.with_ctes(O.URL_CORPUS) + """SELECT CASE WHEN label = 1 THEN 'phishing_feed' ELSE 'legit_feed' END AS source,
 count(*) AS n FROM url_corpus GROUP BY 1"""


def q_validate_urls(spark, sf_dir):
    c = url_corpus(spark, sf_dir).select("url_id", "url")
    ok, bad = D.validate_urls(c)
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


SQL_VALIDATE = O.with_ctes(O.URL_CORPUS) + """SELECT url_id, trim(url) AS url,
 CASE WHEN url IS NULL OR trim(url) = '' THEN 'No URL provided' END AS reason FROM url_corpus"""


def q_holdout_rows(spark, sf_dir):
    """Feature rows of the persisted split's test side (semi-join by url)."""
    split = cut_lineage(S.stratified_split(merged(spark, sf_dir)))  # the persisted split; features follow from its rows
    f = with_url_features(split.select("url", "label")).select("url", "label", "url_length", "num_dots", "has_https")
    return S.holdout_rows(f, split)


def _holdout_sql() -> str:
    ctes, last = O.feature_ctes("merged", ["url", "label"], extras=False)
    split = """sp AS (SELECT url FROM (SELECT url, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || url)) AS rn,
 count(*) OVER (PARTITION BY label) AS n FROM merged) t WHERE rn <= floor((4 * n + 10) / 20))"""
    return O.with_ctes(O.URL_CORPUS, *MERGED_SQL, *ctes, split) + f"""SELECT f.url, f.label, f.url_length, f.num_dots, f.has_https
FROM {last} f WHERE f.url IN (SELECT url FROM sp)"""


def q_shuffle_keys(spark, sf_dir):
    """a seeded shuffle key per dataset row."""
    return S.with_shuffle_key(merged(spark, sf_dir))


def q_seeded_sample(spark, sf_dir):
    return S.seeded_sample(merged(spark, sf_dir), 3000, seed=42)


SQL_SEEDED_SAMPLE = _msql("""SELECT url, label FROM merged ORDER BY md5('sample42:' || url) LIMIT 3000""")

# ------------------------------------------------------------------ metrics

# Predictions of a noisy model: the 0.5 cut of raw_score, flipped where u < 0.05.
PRED = "CAST((raw_score >= 0.5E0) <> (u < 0.05E0) AS INTEGER)"


def _scored(spark, sf_dir) -> DataFrame:
    c = url_corpus(spark, sf_dir)
    raw = F.lit(0.5) * F.col("label") + F.lit(0.5) * F.col("u")
    return c.select("url_id", "url", "label", raw.alias("raw_score"),
                    ((raw >= 0.5) != (F.col("u") < 0.05)).cast("int").alias("pred"))


def _ssql(body: str, *extra: str) -> str:
    sc = (f"sc AS (SELECT url_id, url, label, raw_score, {PRED} AS pred FROM "
          "(SELECT url_id, url, label, u, 0.5E0 * label + 0.5E0 * u AS raw_score FROM url_corpus) t)")
    return O.with_ctes(O.URL_CORPUS, sc, *extra) + body


COUNTS = """cnt AS (SELECT count_if(label = 1 AND pred = 1) AS tp, count_if(label = 0 AND pred = 1) AS fp,
 count_if(label = 1 AND pred = 0) AS fn, count_if(label = 0 AND pred = 0) AS tn FROM sc)"""


def _rates(src: str, extra_cols: str = "") -> str:
    return f"""SELECT {extra_cols} tp, fp, fn, tn,
 CASE WHEN tp + fp + fn + tn = 0 THEN 0.0E0 ELSE CAST(tp + tn AS DOUBLE) / CAST(tp + fp + fn + tn AS DOUBLE) END AS accuracy,
 CASE WHEN tp + fp = 0 THEN 0.0E0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
 CASE WHEN tp + fn = 0 THEN 0.0E0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
 CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0E0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1,
 CAST(fp AS DOUBLE) / CAST(greatest(fp + tn, 1) AS DOUBLE) AS fpr FROM {src}"""


def q_confusion(spark, sf_dir):
    return M.confusion(_scored(spark, sf_dir))


SQL_CONFUSION = _ssql("""SELECT c.label, c.pred, coalesce(n, 0) AS n FROM
 (SELECT a.x AS label, b.x AS pred FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(x)) c
 LEFT JOIN (SELECT label, pred, count(*) AS n FROM sc GROUP BY 1, 2) g ON g.label = c.label AND g.pred = c.pred""")


def q_binary_metrics(spark, sf_dir):
    return M.binary_metrics(_scored(spark, sf_dir))


def q_class_report(spark, sf_dir):
    return M.class_report(_scored(spark, sf_dir)).select(
        "cls", *[round_even(F.col(c), 12).alias(c) for c in ("precision", "recall", "f1")], "support")


SQL_CLASS_REPORT = _ssql("""SELECT cls, round_even(precision * 1e12, 0) / 1e12 AS precision, round_even(recall * 1e12, 0) / 1e12 AS recall,
 round_even(f1 * 1e12, 0) / 1e12 AS f1, support FROM (
 SELECT cls, precision, recall, f1, support FROM per
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM per
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
   sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM per) t""", COUNTS, """per AS (
 SELECT cls, CASE WHEN a + b = 0 THEN 0.0E0 ELSE a / (a + b) END AS precision,
        CASE WHEN a + c = 0 THEN 0.0E0 ELSE a / (a + c) END AS recall,
        CASE WHEN 2 * a + b + c = 0 THEN 0.0E0 ELSE 2 * a / (2 * a + b + c) END AS f1, CAST(a + c AS BIGINT) AS support
 FROM (SELECT '0' AS cls, CAST(tn AS DOUBLE) a, CAST(fn AS DOUBLE) b, CAST(fp AS DOUBLE) c FROM cnt
       UNION ALL SELECT '1', CAST(tp AS DOUBLE), CAST(fp AS DOUBLE), CAST(fn AS DOUBLE) FROM cnt) x)""")


def q_roc_points(spark, sf_dir):
    return M.roc_points(scored_urls(spark, sf_dir), "label", "raw_score")


SQL_ROC_POINTS = _ssql("""SELECT score AS threshold,
 CASE WHEN N = 0 THEN 0.0E0 ELSE CAST(cn AS DOUBLE) / CAST(N AS DOUBLE) END AS fpr,
 CASE WHEN P = 0 THEN 0.0E0 ELSE CAST(cp AS DOUBLE) / CAST(P AS DOUBLE) END AS tpr
FROM (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn FROM g) t,
 (SELECT count_if(label = 1) AS P, count_if(label = 0) AS N FROM sc) tot""",
                       "g AS (SELECT raw_score AS score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM sc GROUP BY 1)")


def q_roc_auc(spark, sf_dir):
    a = M.roc_auc(scored_urls(spark, sf_dir), "label", "raw_score")
    return a.select(round_even(F.col("auc"), 12).alias("auc"))


def _auc_sql() -> str:
    # Mann-Whitney with average ranks (independent of the Spark formulation)
    return _ssql("""SELECT round_even((sum(CASE WHEN label = 1 THEN rk END) - P * (P + 1) / 2.0E0) / (P * N) * 1e12, 0) / 1e12 AS auc
FROM (SELECT label, rank() OVER (ORDER BY raw_score) + (count(*) OVER (PARTITION BY raw_score) - 1) / 2.0E0 AS rk FROM sc) r,
 (SELECT CAST(count_if(label = 1) AS DOUBLE) AS P, CAST(count_if(label = 0) AS DOUBLE) AS N FROM sc) t
GROUP BY P, N""")


def _sweep(spark, sf_dir) -> DataFrame:
    return M.threshold_sweep(scored_urls(spark, sf_dir), "label", "raw_score")


def q_threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "fpr", "cost")


def _grid_sql() -> str:
    vals = ", ".join(f"({i}, {t!r}::DOUBLE)" for i, t in enumerate(M.default_thresholds()))
    return f"grid AS (SELECT * FROM (VALUES {vals}) g(ti, threshold))"


def _sweep_sql_ctes() -> list[str]:
    return [_grid_sql(), """sw AS (SELECT threshold, CAST(count_if(label = 1 AND raw_score >= threshold) AS BIGINT) AS tp,
 CAST(count_if(label = 0 AND raw_score >= threshold) AS BIGINT) AS fp,
 CAST(count_if(label = 1 AND raw_score < threshold) AS BIGINT) AS fn,
 CAST(count_if(label = 0 AND raw_score < threshold) AS BIGINT) AS tn FROM grid CROSS JOIN sc GROUP BY threshold)"""]


def sql_threshold_sweep() -> str:
    return _ssql(f"""SELECT threshold, tp, fp, fn, tn, precision, recall, f1, fpr, fn * 100 + fp AS cost FROM ({_rates('sw', 'threshold,')}) r""",
                 *_sweep_sql_ctes())


def q_cost_threshold(spark, sf_dir):
    return M.cost_threshold(_sweep(spark, sf_dir))


def sql_cost_threshold() -> str:
    return _ssql("SELECT threshold, fn * 100 + fp AS cost FROM sw ORDER BY cost, threshold LIMIT 1", *_sweep_sql_ctes())


def q_model_select(spark, sf_dir):
    s = _sweep(spark, sf_dir)
    return M.select_best(s, "ti").select("threshold", "f1", "fpr", "selection_score")


def sql_model_select() -> str:
    return _ssql(f"""SELECT threshold, f1, fpr, f1 * (1.0E0 - fpr) AS selection_score FROM ({_rates('sw', 'threshold,')}) r
ORDER BY selection_score DESC, threshold LIMIT 1""", *_sweep_sql_ctes())


def q_error_samples(spark, sf_dir):
    e = M.error_samples(_scored(spark, sf_dir))
    return e.select("error_type", "url_id", "url", "label", "pred", "raw_score")


SQL_ERROR_SAMPLES = _ssql("""SELECT error_type, url_id, url, label, pred, raw_score FROM (
 SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY url_id, url) AS rn FROM (
  SELECT *, CASE WHEN pred = 1 THEN 'False Positive' ELSE 'False Negative' END AS error_type FROM sc WHERE label <> pred) e) t
WHERE rn <= 20""")


def register(qs: dict, sql: dict) -> None:
    qs["merge_feeds"] = q_merge_feeds
    sql["merge_feeds"] = _msql("SELECT url, label FROM merged")
    qs["balance_cap"] = q_balance_cap
    sql["balance_cap"] = _msql("SELECT url FROM lgc")
    qs["class_stats"] = q_class_stats
    sql["class_stats"] = _msql("""SELECT label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share,
 avg(length(url)) AS avg_url_length FROM merged GROUP BY label""")
    qs["dataset_totals"] = q_dataset_totals
    sql["dataset_totals"] = _msql("SELECT count(*) AS n, avg(length(url)) AS avg_url_length FROM merged")
    qs["length_histogram"] = q_length_histogram
    sql["length_histogram"] = SQL_LENGTH_HISTOGRAM
    qs["top_tlds"] = q_top_tlds
    sql["top_tlds"] = _tld_sql()
    qs["feature_label_corr"] = q_feature_label_corr
    sql["feature_label_corr"] = _corr_sql()
    qs["scaler_stats"] = q_scaler_stats
    sql["scaler_stats"] = _scaler_sql()
    qs["stratified_split"] = q_stratified_split
    sql["stratified_split"] = SQL_STRATIFIED_SPLIT
    qs["kfold_assign"] = q_kfold_assign
    sql["kfold_assign"] = SQL_KFOLD
    qs["source_counts"] = q_source_counts
    sql["source_counts"] = SQL_SOURCE_COUNTS
    qs["validate_urls"] = q_validate_urls
    sql["validate_urls"] = SQL_VALIDATE
    qs["holdout_rows"] = q_holdout_rows
    sql["holdout_rows"] = _holdout_sql()
    qs["shuffle_keys"] = q_shuffle_keys
    sql["shuffle_keys"] = _msql("SELECT url, label, md5('shuffle42:' || url) AS shuffle_key FROM merged")
    qs["seeded_sample"] = q_seeded_sample
    sql["seeded_sample"] = SQL_SEEDED_SAMPLE
    qs["confusion"] = q_confusion
    sql["confusion"] = SQL_CONFUSION
    qs["binary_metrics"] = q_binary_metrics
    sql["binary_metrics"] = _ssql(_rates("cnt"), COUNTS)
    qs["class_report"] = q_class_report
    sql["class_report"] = SQL_CLASS_REPORT
    qs["roc_points"] = q_roc_points
    sql["roc_points"] = SQL_ROC_POINTS
    qs["roc_auc"] = q_roc_auc
    sql["roc_auc"] = _auc_sql()
    qs["threshold_sweep"] = q_threshold_sweep
    sql["threshold_sweep"] = sql_threshold_sweep()
    qs["cost_threshold"] = q_cost_threshold
    sql["cost_threshold"] = sql_cost_threshold()
    qs["model_select"] = q_model_select
    sql["model_select"] = sql_model_select()
    qs["error_samples"] = q_error_samples
    sql["error_samples"] = SQL_ERROR_SAMPLES
