"""TreeSHAP against exhaustive Shapley values; ensemble invariants."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkrisk.operators.explain import expected_value, top_reasons, tree_shap_batch

# a small tree: root splits f0 <= 0.5; left leaf; right splits f1 <= 0.3
TREE = {
    "left": np.array([1, -1, 3, -1, -1]), "right": np.array([2, -1, 4, -1, -1]),
    "feat": np.array([0, -1, 1, -1, -1]), "thr": np.array([0.5, 0, 0.3, 0, 0]),
    "value": np.array([0.0, 0.2, 0.0, 0.9, 0.4]), "cover": np.array([10.0, 6.0, 4.0, 1.0, 3.0]),
}


def _cond_exp(tree, x, s, j=0):
    if tree["left"][j] < 0:
        return tree["value"][j]
    f, a, b = tree["feat"][j], tree["left"][j], tree["right"][j]
    if f in s:
        return _cond_exp(tree, x, s, a if x[f] <= tree["thr"][j] else b)
    c = tree["cover"]
    return (c[a] * _cond_exp(tree, x, s, a) + c[b] * _cond_exp(tree, x, s, b)) / c[j]


def _brute(tree, x, m):
    phi = np.zeros(m)
    for i in range(m):
        rest = [k for k in range(m) if k != i]
        for r in range(len(rest) + 1):
            for s in combinations(rest, r):
                w = factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m)
                phi[i] += w * (_cond_exp(tree, x, set(s) | {i}) - _cond_exp(tree, x, set(s)))
    return phi


@pytest.mark.parametrize("x", [[0.2, 0.1, 5.0], [0.9, 0.1, 0.0], [0.9, 0.8, 1.0], [0.5, 0.3, 0.0]])
def test_tree_shap_equals_brute_force(x):
    x = np.array([x])
    got = tree_shap_batch(x, TREE, 3)[0]
    assert np.allclose(got, _brute(TREE, x[0], 3), atol=1e-12)
    assert got.sum() + expected_value(TREE) == pytest.approx(_cond_exp(TREE, x[0], {0, 1, 2}))


def _random_tree(rng, depth, m):
    """A random tree whose paths use features again; covers add up."""
    t = {k: [] for k in ("left", "right", "feat", "thr", "value", "cover")}

    def grow(level, cover):
        j = len(t["left"])
        leaf = level == 0 or rng.random() < 0.15
        for k, v in (("left", -1), ("right", -1), ("feat", -1 if leaf else int(rng.integers(m))), ("thr", float(rng.normal())),
                     ("value", float(rng.normal())), ("cover", cover)):
            t[k].append(v)
        if not leaf:
            part = float(rng.uniform(0.1, 0.9)) * cover
            t["left"][j] = grow(level - 1, part)
            t["right"][j] = grow(level - 1, cover - part)
        return j

    grow(depth, 100.0)
    return {k: np.array(v) for k, v in t.items()}


@pytest.mark.parametrize("seed", range(6))
def test_leaf_tables_equal_brute_force_on_random_trees(seed):
    rng = np.random.default_rng(seed)
    tree = _random_tree(rng, 6, 5)
    x = rng.normal(size=(12, 5)).round(1)
    x[3] = x[5]
    x[7, 2] = np.nan  # a missing value fails every condition, so it goes right
    got = tree_shap_batch(x, tree, 5)
    for row, phi in zip(x, got):
        assert np.allclose(phi, _brute(tree, row, 5), atol=1e-12)


def test_single_leaf_tree():
    tree = {k: np.array([v]) for k, v in (("left", -1), ("right", -1), ("feat", -1), ("thr", 0.0), ("value", 0.7), ("cover", 3.0))}
    assert (tree_shap_batch(np.zeros((2, 3)), tree, 3) == 0).all() and expected_value(tree) == pytest.approx(0.7)


def test_model_in_several_parts(spark, monkeypatch):
    """A model split into parts gives the same contributions."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    from linkrisk.operators import explain as X
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(a), float(b), int(a > b)) for i, (a, b) in enumerate(rng.random((200, 2)))],
                               "id int, a double, b double, label int")
    m = RandomForestClassifier(numTrees=7, maxDepth=4, seed=1).fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    whole = {r["id"]: (r["phi_a"], r["phi_b"]) for r in X.tree_shap(df, m, ["id"], ["a", "b"]).collect()}
    monkeypatch.setattr(X, "PART_CELLS", 20)
    assert len(X.shap_parts(m)[0]) > 2
    for r in X.tree_shap(df, m, ["id"], ["a", "b"]).collect():
        assert (r["phi_a"], r["phi_b"]) == pytest.approx(whole[r["id"]], abs=1e-12)


def test_forest_and_boosting_invariants(spark):
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from linkrisk.operators.explain import tree_shap
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), float(c), int(a + 0.5 * b > 0.8)) for i, (a, b, c) in
            enumerate(rng.random((400, 3)))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label int")
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    for est, out in [(RandomForestClassifier(numTrees=15, maxDepth=5, seed=1), "probability"),
                     (GBTClassifier(maxIter=8, maxDepth=3, seed=1), "rawPrediction")]:
        m = est.fit(v)
        sh = tree_shap(df, m, ["id"], ["a", "b", "c"])
        ref = m.transform(v).select("id", vector_to_array(out)[1].alias("ref"))
        err = sh.join(ref, "id").select(F.max(F.abs(F.col("model_output") - F.col("ref")))).first()[0]
        assert err < 1e-9


def test_top_reasons_order(spark):
    df = spark.createDataFrame([(0.1, -0.5, 0.3)], "phi_a double, phi_b double, phi_c double")
    r = top_reasons(df, 2, ["a", "b", "c"]).first()["reasons"]
    assert [x["feature"] for x in r] == ["b", "c"]
    assert r[0]["direction"] == "decreases" and r[1]["direction"] == "increases"
