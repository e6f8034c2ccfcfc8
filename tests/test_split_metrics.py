"""Exact hash-ordered selection and metrics against brute force."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkrisk.operators import metrics as M
from linkrisk.operators import split as S


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(7)
    n = 3000
    lab = (rng.random(n) < 0.35).astype(int)
    score = np.clip(0.35 * lab + rng.random(n) * 0.7, 0, 1).round(3)
    pdf = pd.DataFrame({"url": [f"http://h{i}.example/{i}" for i in range(n)], "label": lab, "score": score})
    return pdf, spark.createDataFrame(pdf)


def test_stratified_split_exact(labelled):
    pdf, df = labelled
    got = S.stratified_split(df).toPandas()
    for lab, g in pdf.groupby("label"):
        m = (4 * len(g) + 10) // 20
        want = set(g.assign(k=g.url.map(lambda u: _md5("42:" + u))).sort_values("k").url.head(m))
        assert set(got[(got.label == lab) & got.is_test].url) == want


def test_folds_disjoint_and_balanced(labelled):
    _, df = labelled
    f = S.stratified_folds(df).toPandas()
    assert len(f) == 3000 and f.url.is_unique
    for _, g in f.groupby("label"):
        c = g.fold.value_counts()
        assert c.max() - c.min() <= 1 and len(c) == 5


def test_seeded_sample(labelled):
    pdf, df = labelled
    a = S.seeded_sample(df, 250).toPandas()
    want = set(pdf.assign(k=pdf.url.map(lambda u: _md5("sample42:" + u))).sort_values("k").url.head(250))
    assert set(a.url) == want and len(a) == 250
    assert len(S.seeded_sample(df, 10_000).toPandas()) == 3000


def test_binary_metrics_and_confusion(labelled):
    pdf, df = labelled
    d = df.withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    r = M.binary_metrics(d).first()
    y, p = pdf.label.values, (pdf.score.values >= 0.5).astype(int)
    tp, fp, fn = ((y == 1) & (p == 1)).sum(), ((y == 0) & (p == 1)).sum(), ((y == 1) & (p == 0)).sum()
    assert r["tp"] == tp and r["fp"] == fp and r["fn"] == fn
    assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    assert r["fpr"] == pytest.approx(fp / max((y == 0).sum(), 1))
    cm = {(x["label"], x["pred"]): x["n"] for x in M.confusion(d).collect()}
    assert len(cm) == 4 and cm[(0, 1)] == fp


def test_auc_matches_rank_statistic_and_evaluator(labelled, spark):
    pdf, df = labelled
    auc = M.roc_auc(df, "label", "score").first()["auc"]
    ranks = pd.Series(pdf.score).rank()
    pos = pdf.label == 1
    npos, nneg = pos.sum(), (~pos).sum()
    want = (ranks[pos].sum() - npos * (npos + 1) / 2) / (npos * nneg)
    assert auc == pytest.approx(want, abs=1e-12)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    v = df.select(F.col("label").cast("double").alias("label"),
                  array_to_vector(F.array(1 - F.col("score"), F.col("score"))).alias("rawPrediction"))
    ev = BinaryClassificationEvaluator(numBins=0).evaluate(v)
    assert auc == pytest.approx(ev, abs=1e-9)


def test_roc_points_monotone(labelled):
    _, df = labelled
    r = M.roc_points(df, "label", "score").orderBy(F.desc("threshold")).toPandas()
    assert r.fpr.is_monotonic_increasing and r.tpr.is_monotonic_increasing
    assert r.fpr.iloc[-1] == 1.0 and r.tpr.iloc[-1] == 1.0


def test_threshold_sweep_brute_force(labelled):
    pdf, df = labelled
    sw = M.threshold_sweep(df, "label", "score").orderBy("threshold").toPandas()
    ts = np.linspace(0.05, 0.95, 50)
    assert np.allclose(sw.threshold.values, ts, rtol=0, atol=0)
    for t, row in zip(ts, sw.itertuples()):
        p = pdf.score.values >= t
        y = pdf.label.values == 1
        assert row.tp == (p & y).sum() and row.fp == (p & ~y).sum()
        assert row.cost == 100 * (~p & y).sum() + (p & ~y).sum()
    best = M.cost_threshold(M.threshold_sweep(df, "label", "score")).first()
    costs = sw.cost.values
    assert best["threshold"] == sw.threshold.values[int(np.argmin(costs))]


def test_error_samples_first_n(labelled):
    pdf, df = labelled
    d = df.withColumn("pred", (F.col("score") >= 0.5).cast("int")).withColumn("url_id", F.lit(0))
    e = M.error_samples(d, n=20, order_cols=["url"]).toPandas()
    assert (e.error_type.value_counts() <= 20).all()
    fp = pdf[(pdf.label == 0) & (pdf.score >= 0.5)].sort_values("url").url.head(20)
    assert set(e[e.error_type == "False Positive"].url) == set(fp)


def test_hot_key_selection_is_exact(spark):
    """One key holds a third of the rows and straddles the quota."""
    rows = [(f"http://u{i}.example/", i % 2) for i in range(2000)] + [("http://hot.example/", 0)] * 1000
    df = spark.createDataFrame(rows, "url string, label int").repartition(6)
    hot_key = _md5("sample42:http://hot.example/")
    keys = sorted([_md5("sample42:" + u) for u, _ in rows])
    n = keys.index(hot_key) + 400  # the cut falls inside the hot key's 1,000 rows
    got = S.seeded_sample(df, n).toPandas()
    assert len(got) == n
    assert (got.url == "http://hot.example/").sum() == 400
    assert set(got.url) - {"http://hot.example/"} == {u for u, _ in rows if _md5("sample42:" + u) < hot_key}
    r = S.rank_in_hash_order(df, S.hash_key(1, "url"), ["label"], "rank").toPandas()
    for _, g in r.groupby("label"):
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))


def test_guards(spark):
    from linkrisk.operators.dataset import MissingColumnsError, require_columns, require_nonempty, require_rows
    df = spark.createDataFrame([(1, "a")], "x int, url string")
    with pytest.raises(MissingColumnsError):
        require_columns(df, ["x", "label"])
    require_columns(df, ["x"])
    with pytest.raises(ValueError):
        require_nonempty(df.filter("x > 5"))
    with pytest.raises(ValueError):
        require_rows(df, 2, "phishing rows")
    assert require_rows(df, 1) == 1


def test_cross_validation_covers_every_family_and_row(spark):
    """One score per (model, fold), recomputed here from the stored out-of-fold predictions;
    every row is predicted once per family by a model that did not see its fold."""
    import numpy as np

    from linkrisk.constants import FEATURE_COLS
    from linkrisk.operators import models as Mo
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        x = rng.normal(size=len(FEATURE_COLS))
        rows.append((f"u{i}", int(x[0] + x[1] > 0.5), *[float(v) for v in x]))
    df = spark.createDataFrame(rows, "url string, label int, " + ", ".join(f"{c} double" for c in FEATURE_COLS))
    few = lambda n: {k: v for k, v in Mo.estimators(n, fast=True).items() if k != "gradient_boosting"}
    s = Mo.out_of_fold_scores(df, few, k=3).toPandas()
    assert len(s) == 2 * 240 and s.groupby("model").url.nunique().tolist() == [240, 240]
    got = {(r["model"], r["fold"]): r["f1"] for r in Mo.cross_validate(df, few, k=3).collect()}
    assert len(got) == 6
    for (m, f), g in s.groupby(["model", "fold"]):
        tp, fp, fn = ((g.label == y) & (g.pred == p) for y, p in ((1, 1), (0, 1), (1, 0)))
        assert got[m, f] == 2 * tp.sum() / (2 * tp.sum() + fp.sum() + fn.sum())
    assert min(got.values()) > 0.6


def test_models_score_after_the_session_has_observed_a_query(spark):
    from pyspark.sql import Observation

    from linkrisk.constants import FEATURE_COLS
    from linkrisk.operators import models as Mo
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    rng = np.random.default_rng(3)
    rows = [(f"u{i}", i % 2, *[float(v) for v in rng.normal(size=len(FEATURE_COLS)) + i % 2]) for i in range(120)]
    df = spark.createDataFrame(rows, "url string, label int, " + ", ".join(f"{c} double" for c in FEATURE_COLS))
    fitted, metrics = Mo.train_compare(df, df, fast=True)
    assert metrics.count() == 3 and metrics.agg(F.min("f1")).first()[0] > 0.9
    few = lambda n: {"logistic_regression": Mo.estimators(n, fast=True)["logistic_regression"]}
    assert Mo.out_of_fold_scores(df, few, k=2).count() == 120


def test_only_keys_go_through_the_split(spark, monkeypatch):
    from linkrisk.operators import split
    from linkrisk.plans import model_queries as MQ
    given, real = [], split.stratified_split
    monkeypatch.setattr(split, "stratified_split", lambda df, *a, **k: given.append(df.columns) or real(df, *a, **k))
    monkeypatch.setattr(MQ, "_MEMO", {})
    p = MQ.prepared(spark, "/root/testdata/sf0.001")
    assert [sorted(c) for c in given] == [["label", "url"]]
    assert p["train"].count() + p["test"].count() == p["features"].count() > 0


def test_a_query_fits_the_families_it_reads_once(spark, monkeypatch):
    import numpy as np

    from linkrisk.constants import FEATURE_COLS
    from linkrisk.operators import models as Mo
    from linkrisk.plans import model_queries as MQ
    rng = np.random.default_rng(2)
    rows = []
    for i in range(200):
        x = rng.normal(size=len(FEATURE_COLS))
        rows.append((f"u{i}", int(x[0] > 0), i % 5 == 0, *[float(v) for v in x]))
    df = spark.createDataFrame(rows, "url string, label int, is_test boolean, " + ", ".join(f"{c} double" for c in FEATURE_COLS))
    p = {"features": df, "scaled": df, "train": df.filter("not is_test").drop("is_test"), "test": df.filter("is_test").drop("is_test")}
    given, compare, families = [], Mo.train_compare, Mo.estimators
    monkeypatch.setattr(MQ, "_MEMO", {})
    monkeypatch.setattr(MQ, "prepared", lambda *a: p)
    monkeypatch.setattr(Mo, "estimators", lambda n: families(n, fast=True))
    monkeypatch.setattr(Mo, "train_compare", lambda *a, **k: given.append(list(k["models"])) or compare(*a, **k))
    assert MQ.q_linear_shap(spark, "x").count() == 40
    assert given == [["logistic_regression"]]
    assert MQ.q_feature_importance(spark, "x").count() == len(FEATURE_COLS)
    assert given == [["logistic_regression"], ["random_forest"]]
    one_by_one = MQ.q_train_compare(spark, "x").orderBy("ordinal").collect()
    assert given == [[f] for f in Mo.FAMILIES]
    assert one_by_one == compare(p["train"], p["test"], models=families(160, fast=True))[1].orderBy("ordinal").collect()


def test_error_table_scores_the_test_rows_once(spark, monkeypatch):
    from linkrisk.constants import FEATURE_COLS
    from linkrisk.operators import models as Mo
    from linkrisk.plans import model_queries as MQ
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        x = rng.normal(size=len(FEATURE_COLS))
        rows.append((f"u{i}", int(x[0] + 2 * rng.normal() > 0), i % 2 == 0, *[float(v) for v in x]))
    z = spark.createDataFrame(rows, "url string, label int, is_test boolean, " + ", ".join(f"{c} double" for c in FEATURE_COLS))
    raw = z.select("url", "label", "is_test", *[(F.col(c) + 100).alias(c) for c in FEATURE_COLS])
    p = {"features": raw, "scaled": z, "train": z.filter("not is_test").drop("is_test"), "test": z.filter("is_test").drop("is_test")}
    scored, score = [], Mo.score
    monkeypatch.setattr(MQ, "_MEMO", {})
    monkeypatch.setattr(MQ, "prepared", lambda *a: p)
    monkeypatch.setattr(MQ, "best_model", lambda *a: "logistic_regression")
    model = MQ.fitted_model(spark, "x", "logistic_regression")
    monkeypatch.setattr(Mo, "score", lambda *a: scored.append(a[2:]) or score(*a))
    t = MQ.q_error_table(spark, "x")
    assert scored == [("rf_score", "pred")]
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in plan  # the model does not run again in what reads the errors
    monkeypatch.undo()
    s = score(Mo.assemble(p["test"]), model, "rf_score", "pred").toPandas()
    wrong = s[s.label != s.pred].sort_values("url")
    want = {u for _, g in wrong.groupby("pred") for u in g.url[:20]}
    got = t.toPandas()
    assert set(got.url) == want and len(got) == len(want) > 20
    z0 = s.set_index("url")[FEATURE_COLS[0]]
    assert all(r[FEATURE_COLS[0]] == pytest.approx(z0[r.url] + 100) for _, r in got.iterrows())
    assert set(got.error_type) == {"False Positive", "False Negative"} and got.top_shap_reasons.str.contains(r"\(").all()
