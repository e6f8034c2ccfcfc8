"""Registered checks of explanations, with a linear model whose coefficients are given.

A fitted model's numbers are unknown to SQL; the same operators with fixed coefficients and
background means are checked value by value: contributions, top reasons with bars,
global importance, error table and reason counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import FEATURE_COLS, SHAP_TEXT
from linkrisk.functions.features import round_even
from linkrisk.operators import explain as X
from linkrisk.operators import metrics as M
from linkrisk.operators import models as Mo
from linkrisk.plans import oracle_sql as O
from linkrisk.plans.dataset_queries import _merged_feat_sql, merged_features
from linkrisk.plans.model_queries import _MEMO, _memo_key
from linkrisk.session import cut_lineage

#: Coefficients and background means of the given model, by a rule.
COEF = [((7 * j + 8) % 11 - 5) / 50 for j in range(len(FEATURE_COLS))]
MEAN = [30.0 if c.endswith("_length") else (j % 5) / 2 for j, c in enumerate(FEATURE_COLS)]


def contributions(spark, sf_dir) -> DataFrame:
    """I6 on every dataset row, with the model's 0.5-cut; stored once, as many expressions
    read the contributions."""
    key = _memo_key("linear", spark, sf_dir)
    if key not in _MEMO:
        f = merged_features(spark, sf_dir).select("url", "label", *FEATURE_COLS)
        phi = cut_lineage(X.linear_shap(f, COEF, MEAN))
        total = sum((F.col(f"phi_{c}") for c in FEATURE_COLS), F.lit(0.0))
        _MEMO[key] = phi.withColumn("margin", total).withColumn("pred", (F.col("margin") > 0).cast("int"))
    return _MEMO[key]


def _phi_sql() -> str:
    """CTEs up to ``phi`` (url, label, p_<feature>, margin)."""
    ctes, last = _merged_feat_sql()
    parts = [f"{w!r}::DOUBLE * (CAST({c} AS DOUBLE) - {m!r}::DOUBLE) AS p_{c}" for c, w, m in zip(FEATURE_COLS, COEF, MEAN)]
    total = "0.0::DOUBLE" + "".join(f" + p_{c}" for c in FEATURE_COLS)
    text = ", ".join(f"({j}, {O._q(c)}, {O._q(SHAP_TEXT.get(c, c))})" for j, c in enumerate(FEATURE_COLS))
    values = "[" + ", ".join(f"p_{c}" for c in FEATURE_COLS) + "]"
    return O.with_ctes(*ctes, f"phi0 AS (SELECT url, label, {', '.join(parts)} FROM {last})",
                       f"phi AS (SELECT *, {total} AS margin FROM phi0)", f"names(j, feature, text_en) AS (VALUES {text})",
                       f"""ranked AS (SELECT url, label, margin, feature, text_en, c, row_number() OVER (PARTITION BY url ORDER BY abs(c) DESC, j DESC) AS rank
 FROM (SELECT url, label, margin, j, feature, text_en, ({values})[j + 1] AS c FROM phi, names) t)""",
                       f"top AS (SELECT url, rank, feature, text_en, {O.round_even_sql('c')} AS contribution, c > 0 AS up FROM ranked WHERE rank <= 5)")


def q_linear_contributions(spark, sf_dir):
    """The sum of contributions per row."""
    return contributions(spark, sf_dir).select("url", "label", round_even(F.col("margin"), 9).alias("margin"), "pred")


def sql_linear_contributions() -> str:
    return _phi_sql() + f"SELECT url, label, {O.round_even_sql('margin', 9)} AS margin, CAST(margin > 0 AS INTEGER) AS pred FROM phi"


def q_linear_reasons(spark, sf_dir):
    """E4 + E7 + H29: top five reasons with direction and bar."""
    r = X.top_reasons(contributions(spark, sf_dir), 5).withColumn("bar", X.bar_shares("reasons"))
    z = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("reasons")).alias("rank"), F.col("reasons").alias("r"), F.col("bar").alias("b"))).alias("z")
    return r.select("url", z).select("url", "z.rank", "z.r.feature", "z.r.text_en", "z.r.contribution", "z.r.direction",
                                     round_even(F.col("z.b"), 6).alias("bar_pct"))


def sql_linear_reasons() -> str:
    share = "least(100.0::DOUBLE, abs(contribution) / greatest(max(abs(contribution)) OVER (PARTITION BY url), 0.001::DOUBLE) * 100.0::DOUBLE)"
    return _phi_sql() + f"""SELECT url, CAST(rank AS INTEGER) AS rank, feature, text_en, contribution,
 CASE WHEN up THEN 'increases' ELSE 'decreases' END AS direction, {O.round_even_sql('b', 6)} AS bar_pct
FROM (SELECT *, {share} AS b FROM top) t"""


def q_linear_importance(spark, sf_dir):
    """Mean absolute contribution per feature, ranked."""
    g = X.global_importance(contributions(spark, sf_dir))
    return g.select("feature", round_even(F.col("mean_abs_shap"), 9).alias("mean_abs_shap"), "rank")


def sql_linear_importance() -> str:
    return _phi_sql() + f"""SELECT feature, {O.round_even_sql('m', 9)} AS mean_abs_shap, CAST(row_number() OVER (ORDER BY m DESC, feature) AS INTEGER) AS rank
FROM (SELECT feature, avg(abs(c)) AS m FROM ranked GROUP BY feature) t"""


def _errors(spark, sf_dir) -> DataFrame:
    e = M.error_samples(contributions(spark, sf_dir), "label", "pred", 20, ["url"])
    return X.error_reasons(e)


def q_linear_error_table(spark, sf_dir):
    """I15 + E3: the first 20 errors of each type with their top two contributions."""
    return _errors(spark, sf_dir).select("error_type", "url", "label", "pred", "top_shap_reasons")


ERRORS_SQL = """err AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY url) AS rn FROM (
  SELECT url, label, CAST(margin > 0 AS INTEGER) AS pred, CASE WHEN margin > 0 THEN 'False Positive' ELSE 'False Negative' END AS error_type
  FROM phi WHERE label <> CAST(margin > 0 AS INTEGER)) t),
two AS (SELECT url, string_agg(concat(feature, '(', printf('%+.3f', {r3}), ')'), ' | ' ORDER BY rank) AS reasons FROM top WHERE rank <= 2 GROUP BY url),
tab AS (SELECT e.error_type, e.url, e.label, e.pred, r.reasons AS top_shap_reasons FROM err e JOIN two r ON r.url = e.url WHERE e.rn <= 20)
"""


def _error_sql() -> str:
    return _phi_sql().rstrip() + ",\n" + ERRORS_SQL.replace("{r3}", O.round_even_sql("contribution", 3))


def q_linear_error_reasons(spark, sf_dir):
    """The most frequent reason texts of each error type."""
    return X.reason_counts(_errors(spark, sf_dir))


def q_scaled_features(spark, sf_dir):
    """B1 + D21: features scaled by means and population deviations of all dataset rows."""
    f = contributions(spark, sf_dir).select("url", *FEATURE_COLS)
    z = cut_lineage(Mo.scale_columns(f, Mo.fit_scaler(f)).select("url", *SCALED))
    return z.select("url", *[round_even(F.col(c), 6).alias(c) for c in SCALED])


SCALED = ["url_length", "num_dots", "has_https", "num_suspicious_words"]


def sql_scaled_features() -> str:
    ctes, last = _merged_feat_sql()
    z = lambda c: (f"((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0::DOUBLE "  # noqa: E731
                   f"ELSE stddev_pop({c}) OVER () END)")
    inner = ", ".join(f"{z(c)} AS {c}" for c in SCALED)
    return O.with_ctes(*ctes) + f"""SELECT url, {', '.join(f"{O.round_even_sql(c, 6)} AS {c}" for c in SCALED)}
FROM (SELECT url, {inner} FROM {last}) t"""


def register(qs: dict, sql: dict) -> None:
    for name, fn, s in [
        ("linear_contributions", q_linear_contributions, sql_linear_contributions()),
        ("linear_reasons", q_linear_reasons, sql_linear_reasons()),
        ("linear_importance", q_linear_importance, sql_linear_importance()),
        ("linear_error_table", q_linear_error_table, _error_sql() + "SELECT * FROM tab"),
        ("linear_error_reasons", q_linear_error_reasons, _error_sql() + """SELECT error_type, top_shap_reasons, n FROM (
 SELECT error_type, top_shap_reasons, count(*) AS n, row_number() OVER (PARTITION BY error_type ORDER BY count(*) DESC, top_shap_reasons) AS r
 FROM tab GROUP BY 1, 2) t WHERE r <= 3"""),
        ("scaled_features", q_scaled_features, sql_scaled_features()),
    ]:
        qs[name] = fn
        sql[name] = s
