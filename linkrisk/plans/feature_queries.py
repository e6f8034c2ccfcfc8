"""Registered feature and scoring queries (Spark side + DuckDB oracle)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrisk.constants import ALL_FEATURE_COLS, BASE_FEATURE_COLS, BRAND_NAMES, EXTRA_FEATURE_COLS, FEATURE_EXPLANATIONS, FLAG_RULES
from linkrisk.functions.features import round_even, feature_report, flagged_features, report_flags, with_all_features, with_url_features
from linkrisk.functions.rules import blend, external_prob, result_rows, verdict, with_rule_score
from linkrisk.functions.urlparts import with_url_parts
from linkrisk.plans import oracle_sql as O
from linkrisk.operators.dataset import validate_urls
from linkrisk.plans.fixtures import hard_urls, page_urls, scored_urls, url_corpus

ID = ["url_id", "url"]

# feature query name -> output feature columns (besides url_id, url)
FEATURE_SUBSETS = {
    "url_char_counts": ["url_length", "num_dots", "num_hyphens", "num_underscores", "num_at",
                        "num_question", "num_equals", "num_percent", "has_at_in_url"],
    "path_features": ["num_slashes", "path_length", "double_slash", "last_path_segment_is_integer",
                      "num_digits_in_path"],
    "query_features": ["query_length", "num_params"],
    "host_features": ["has_ip", "has_https", "num_subdomains", "hostname_length", "num_digits_in_domain",
                      "digit_ratio_hostname", "has_port", "parse_error"],
    "suspicious_words": ["num_suspicious_words"],
    "min_brand_distance": ["min_levenshtein"],
    "typosquat": ["is_typosquat", "min_levenshtein"],
    "host_entropy": ["hostname_entropy"],
    "tld_flags": ["tld_suspicious"],
    "brand_in_subdomain": ["brand_in_subdomain"],
}
EXTRA_SUBSETS = {
    "url_entropy": ["url_entropy"],
    "brand_impersonation": ["brand_impersonation"],
    "path_depth": ["path_depth"],
}


def _feature_query(cols: list[str], extras: bool):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = url_corpus(spark, sf_dir).select(*ID)
        f = with_all_features(c) if extras else with_url_features(c)
        return f.select(*ID, *cols)
    return run


def _feature_sql(cols: list[str], extras: bool) -> str:
    ctes, last = O.feature_ctes("url_corpus", ID, extras=extras)
    return O.with_ctes(O.URL_CORPUS, *ctes) + f"SELECT {', '.join(ID + cols)} FROM {last}"


def q_url_parts(spark, sf_dir):
    c = url_corpus(spark, sf_dir).select(*ID)
    p = with_url_parts(c, "url", add_scheme=True, prefix="")
    return p.select(*ID, "scheme", "netloc", "host", "port", "path", "query", "fragment", "bad_netloc")


SQL_URL_PARTS = (lambda: (lambda ctes_last: O.with_ctes(O.URL_CORPUS, *ctes_last[0])
                          + f"SELECT url_id, url, p_scheme AS scheme, p_netloc AS netloc, p_host AS host, p_port AS port, "
                            f"p_path AS path, p_query AS query, p_fragment AS fragment, p_bad_netloc AS bad_netloc FROM {ctes_last[1]}")
                 (O.parts_ctes("url_corpus", "p_", True)))()


def q_page_features(spark, sf_dir):
    return with_all_features(page_urls(spark, sf_dir)).select("page_id", "url", *ALL_FEATURE_COLS)


def sql_page_features() -> str:
    ctes, last = O.feature_ctes("pages", ["page_id", "url"], extras=True)
    return O.with_ctes(*ctes) + f"SELECT page_id, url, {', '.join(ALL_FEATURE_COLS)} FROM {last}"


def q_feature_report(spark, sf_dir):
    return feature_report(page_urls(spark, sf_dir), ["page_id", "url"])


def sql_feature_report() -> str:
    ctes, last = O.feature_ctes("pages", ["page_id", "url"], extras=True)
    rows = []
    for name in ALL_FEATURE_COLS:
        rows.append(f"SELECT page_id, url, {O._q(name)} AS feature, CAST({name} AS DOUBLE) AS value, "
                    f"{O._q(FEATURE_EXPLANATIONS[name])} AS explanation, {'true' if name in EXTRA_FEATURE_COLS else 'false'} AS is_extra FROM {last}")
    return O.with_ctes(*ctes) + "\nUNION ALL\n".join(rows)


def q_flagged_features(spark, sf_dir):
    return flagged_features(page_urls(spark, sf_dir), ["page_id", "url"])


def sql_flagged_features() -> str:
    ctes, last = O.feature_ctes("pages", ["page_id", "url"], extras=False)
    ops = {">": ">", ">=": ">=", "==": "=", "!=": "<>"}
    rows = [f"SELECT page_id, url, {O._q(n)} AS feature, {n} AS value, CAST({n} {ops[op]} {v} AS INTEGER) AS flagged FROM {last}"
            for n, op, v in FLAG_RULES]
    return O.with_ctes(*ctes) + "\nUNION ALL\n".join(rows)


def q_report_flags(spark, sf_dir):
    return report_flags(page_urls(spark, sf_dir), ["page_id", "url"])


def sql_report_flags() -> str:
    ctes, last = O.feature_ctes("pages", ["page_id", "url"], extras=False)
    risk = {"has_ip": "<> 0", "num_suspicious_words": ">= 1", "has_at_in_url": "<> 0", "double_slash": "<> 0", "num_subdomains": ">= 3",
            "num_hyphens": ">= 2", "url_length": "> 75"}
    state = lambda c: f"CASE WHEN {c} {risk[c]} THEN 'risk' ELSE 'neutral' END" if c in risk else (
        "CASE WHEN has_https <> 0 THEN 'good' ELSE 'neutral' END" if c == "has_https" else "'neutral'")
    return O.with_ctes(*ctes) + "\nUNION ALL\n".join(
        f"SELECT page_id, url, {O._q(c)} AS feature, CAST({c} AS DOUBLE) AS value, {state(c)} AS state FROM {last}" for c in BASE_FEATURE_COLS)


# ---------------------------------------------------------------- scoring

def _scored_features(spark, sf_dir) -> DataFrame:
    return with_url_features(scored_urls(spark, sf_dir))


def q_score_blend(spark, sf_dir):
    c = url_corpus(spark, sf_dir)
    c = c.select("url_id", "url", (F.lit(0.5) * F.col("label") + F.lit(0.5) * F.col("u")).alias("rf_score"),
                 F.when(F.col("url_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("u")).alias("other_score"))
    return blend(c, "rf_score", "other_score", "raw_score").select("url_id", "url", "raw_score")


SQL_SCORE_BLEND = O.with_ctes(O.URL_CORPUS) + """SELECT url_id, url,
 CASE WHEN other IS NULL THEN rf ELSE 0.6E0 * rf + 0.4E0 * other END AS raw_score
FROM (SELECT url_id, url, 0.5E0 * label + 0.5E0 * u AS rf, CASE WHEN url_id % 3 = 0 THEN NULL ELSE u END AS other FROM url_corpus) t"""


def q_external_label_prob(spark, sf_dir):
    c = url_corpus(spark, sf_dir)
    lab = F.when(F.col("label") == 1, F.lit("Phishing")).otherwise(F.lit("LABEL_0"))
    return c.select("url_id", "url", external_prob(lab, F.col("u")).alias("other_score"))


SQL_EXTERNAL_LABEL_PROB = O.with_ctes(O.URL_CORPUS) + """SELECT url_id, url,
 CASE WHEN contains(upper(lab), '1') OR contains(upper(lab), 'PHISH') THEN u ELSE 1E0 - u END AS other_score
FROM (SELECT url_id, url, u, CASE WHEN label = 1 THEN 'Phishing' ELSE 'LABEL_0' END AS lab FROM url_corpus) t"""


def _rule_sql_body(src: str) -> str:
    """DuckDB rule score over a feature CTE ``src`` with ``raw_score``."""
    return f"""rb AS (SELECT *,
 least(0.0E0 + CASE WHEN is_typosquat=1 THEN 0.15E0 ELSE 0.0E0 END + CASE WHEN has_ip=1 THEN 0.15E0 ELSE 0.0E0 END
  + CASE WHEN brand_in_subdomain=1 THEN 0.15E0 ELSE 0.0E0 END + CASE WHEN tld_suspicious=1 THEN 0.10E0 ELSE 0.0E0 END
  + CASE WHEN has_at_in_url=1 THEN 0.10E0 ELSE 0.0E0 END + CASE WHEN num_subdomains>3 THEN 0.05E0 ELSE 0.0E0 END
  + CASE WHEN hostname_entropy>4.0 THEN 0.05E0 ELSE 0.0E0 END, 0.30E0) AS boost,
 (has_ip=1 OR brand_in_subdomain=1 OR has_at_in_url=1 OR num_subdomains>2 OR (tld_suspicious=1 AND is_typosquat=1)) AS hard,
 (has_https=1 AND tld_suspicious=0 AND num_suspicious_words=0 AND has_ip=0 AND is_typosquat=0 AND brand_in_subdomain=0 AND has_at_in_url=0) AS clean
 FROM {src}),
rc AS (SELECT *,
 CASE WHEN raw_score >= 0.75E0 AND NOT hard THEN 0.75E0 - 0.05E0 ELSE raw_score END AS raw_adj,
 CASE WHEN raw_score >= 0.75E0 THEN 0.0E0 WHEN raw_score < 0.40E0 THEN boost * 0.30E0
      WHEN raw_score < 0.65E0 THEN boost * 0.60E0 ELSE boost END AS boost_adj FROM rb),
rd AS (SELECT *, least(CASE WHEN clean THEN raw_adj * 0.40E0 ELSE raw_adj END + boost_adj, 1.0E0) AS score FROM rc),
re AS (SELECT *, CASE WHEN score >= 0.75E0 THEN 'Dangerous' WHEN score >= 0.45E0 THEN 'Suspicious' ELSE 'Safe' END AS verdict FROM rd)"""


def _scored_sql_ctes() -> list[str]:
    ctes, last = O.feature_ctes("scored_urls", ["url_id", "url", "label", "raw_score"], extras=False)
    return [O.URL_CORPUS, O.SCORED_URLS, *ctes, _rule_sql_body(last)]


def _ruled(spark, sf_dir) -> DataFrame:
    return with_rule_score(_scored_features(spark, sf_dir))


def q_rule_score(spark, sf_dir):
    return _ruled(spark, sf_dir).select("url_id", "url", "raw_score", "score")


def sql_rule_score() -> str:
    return O.with_ctes(*_scored_sql_ctes()) + "SELECT url_id, url, raw_score, score FROM re"


ALERT_CODES = [("typosquat", "is_typosquat = 1"), ("ip", "has_ip = 1"), ("brand", "brand_in_subdomain = 1"),
               ("tld", "tld_suspicious = 1"), ("at", "has_at_in_url = 1"), ("subdomains", "num_subdomains > 3"),
               ("entropy", "hostname_entropy > 4.0")]


def q_rule_alerts(spark, sf_dir):
    r = _ruled(spark, sf_dir)
    codes = F.concat_ws(",", F.array(*[F.when(F.expr(cond), F.lit(code)) for code, cond in ALERT_CODES]))
    return r.select("url_id", "url", F.size("rule_alerts").alias("n_alerts"), codes.alias("alert_codes"))


def sql_rule_alerts() -> str:
    parts = " || ".join(f"CASE WHEN {cond} THEN '{code},' ELSE '' END" for code, cond in ALERT_CODES)
    return O.with_ctes(*_scored_sql_ctes()) + f"""SELECT url_id, url,
 CAST({' + '.join(f'CAST({cond} AS INTEGER)' for _, cond in ALERT_CODES)} AS INTEGER) AS n_alerts,
 regexp_replace({parts}, ',$', '') AS alert_codes FROM re"""


def q_verdicts(spark, sf_dir):
    r = _ruled(spark, sf_dir)
    return r.groupBy(verdict(F.col("score")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def sql_verdicts() -> str:
    return O.with_ctes(*_scored_sql_ctes()) + "SELECT verdict, count(*) AS n FROM re GROUP BY verdict"


def q_result_rows(spark, sf_dir):
    r = _ruled(spark, sf_dir)
    return r.select("url_id", "url", verdict(F.col("score")).alias("verdict"),
                    round_even(F.col("score"), 4).alias("score_r"), round_even(F.col("raw_score"), 4).alias("raw_r"),
                    round_even(F.col("score") * 100, 1).alias("percent"))


def sql_result_rows() -> str:
    return O.with_ctes(*_scored_sql_ctes()) + f"""SELECT url_id, url, verdict,
 {O.round_even_sql('score', 4)} AS score_r,
 {O.round_even_sql('raw_score', 4)} AS raw_r,
 {O.round_even_sql('(score * 100)', 1)} AS percent FROM re"""


def q_blended_result_rows(spark, sf_dir):
    """H30 -> H32-H34: both scores blended, rules on top, and the result row with every score."""
    c = url_corpus(spark, sf_dir)
    c = c.select("url_id", "url", (F.lit(0.5) * F.col("label") + F.lit(0.5) * F.col("u")).alias("rf_score"),
                 F.when(F.col("url_id") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("u")).alias("other_score"))
    r = result_rows(with_rule_score(with_url_features(blend(c))))
    return r.select("url_id", "url", verdict(F.col("score")).alias("verdict"), "score_r", "raw_r", "rf_r", "percent")


def sql_blended_result_rows() -> str:
    bl = """bl AS (SELECT url_id, url, rf AS rf_score,
 CASE WHEN other IS NULL THEN rf ELSE 0.6E0 * rf + 0.4E0 * other END AS raw_score
 FROM (SELECT url_id, url, 0.5E0 * label + 0.5E0 * u AS rf, CASE WHEN url_id % 3 = 0 THEN NULL ELSE u END AS other FROM url_corpus) t)"""
    ctes, last = O.feature_ctes("bl", ["url_id", "url", "rf_score", "raw_score"], extras=False)
    return O.with_ctes(O.URL_CORPUS, bl, *ctes, _rule_sql_body(last)) + f"""SELECT url_id, url, verdict,
 {O.round_even_sql('score', 4)} AS score_r, {O.round_even_sql('raw_score', 4)} AS raw_r, {O.round_even_sql('rf_score', 4)} AS rf_r,
 {O.round_even_sql('(score * 100)', 1)} AS percent FROM re"""


def q_rule_scores_pages(spark, sf_dir):
    """Labelled page URLs scored with their label as the model score."""
    from linkrisk.plans.fixtures import labelled_pages
    lp = labelled_pages(spark, sf_dir).withColumn("raw_score", F.col("label").cast("double"))
    r = with_rule_score(with_url_features(lp))
    return r.select("page_id", "url", "label", "score", verdict(F.col("score")).alias("verdict"))


def sql_rule_scores_pages() -> str:
    ctes, last = O.feature_ctes("lp", ["page_id", "url", "label", "raw_score"], extras=False)
    lp = "lp AS (SELECT page_id, url, label, CAST(label AS DOUBLE) AS raw_score FROM labelled_pages)"
    return O.with_ctes(O.LABELLED_PAGES, lp, *ctes, _rule_sql_body(last)) + "SELECT page_id, url, label, score, verdict FROM re"


HARD_COLS = [*ALL_FEATURE_COLS, "parse_error"]


def q_hard_url_features(spark, sf_dir):
    """H1-H25 (zeros where a URL cannot be split) on missing, blank, bracketed, bad-port,
    non-ASCII and other hard URLs."""
    return with_all_features(hard_urls(spark, sf_dir)).select(*ID, *HARD_COLS)


def sql_hard_url_features() -> str:
    ctes, last = O.feature_ctes("hard_urls", ID, extras=True)
    return O.with_ctes(O.hard_urls_cte(), *ctes) + f"SELECT {', '.join(ID + HARD_COLS)} FROM {last}"


def q_hard_url_checks(spark, sf_dir):
    """B6 on URLs that are missing or blank: accepted rows trimmed, rejected ones with a reason."""
    ok, bad = validate_urls(hard_urls(spark, sf_dir))
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


SQL_HARD_URL_CHECKS = """SELECT url_id, trim(url) AS url, CASE WHEN url IS NULL OR trim(url) = '' THEN 'No URL provided' END AS reason
FROM hard_urls"""


def register(qs: dict, sql: dict) -> None:
    qs["hard_url_features"] = q_hard_url_features
    sql["hard_url_features"] = sql_hard_url_features()
    qs["hard_url_checks"] = q_hard_url_checks
    sql["hard_url_checks"] = O.with_ctes(O.hard_urls_cte()) + SQL_HARD_URL_CHECKS
    for name, cols in FEATURE_SUBSETS.items():
        qs[name] = _feature_query(cols, False)
        sql[name] = _feature_sql(cols, False)
    for name, cols in EXTRA_SUBSETS.items():
        qs[name] = _feature_query(cols, True)
        sql[name] = _feature_sql(cols, True)
    qs["url_parts"] = q_url_parts
    sql["url_parts"] = SQL_URL_PARTS
    qs["page_features"] = q_page_features
    sql["page_features"] = sql_page_features()
    qs["feature_report"] = q_feature_report
    sql["feature_report"] = sql_feature_report()
    qs["flagged_features"] = q_flagged_features
    sql["flagged_features"] = sql_flagged_features()
    qs["score_blend"] = q_score_blend
    sql["score_blend"] = SQL_SCORE_BLEND
    qs["external_label_prob"] = q_external_label_prob
    sql["external_label_prob"] = SQL_EXTERNAL_LABEL_PROB
    qs["rule_score"] = q_rule_score
    sql["rule_score"] = sql_rule_score()
    qs["rule_alerts"] = q_rule_alerts
    sql["rule_alerts"] = sql_rule_alerts()
    qs["verdicts"] = q_verdicts
    sql["verdicts"] = sql_verdicts()
    qs["blended_result_rows"] = q_blended_result_rows
    sql["blended_result_rows"] = sql_blended_result_rows()
    qs["report_flags"] = q_report_flags
    sql["report_flags"] = sql_report_flags()
    qs["result_rows"] = q_result_rows
    sql["result_rows"] = sql_result_rows()
    qs["page_verdicts"] = q_rule_scores_pages
    sql["page_verdicts"] = sql_rule_scores_pages()
