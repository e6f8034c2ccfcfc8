"""Score explanations (SHAP values).

* Linear models: ``coef_j * (x_j - mean_j)`` per feature, a plain column
  expression (JVM, no Python).
* Tree ensembles (random forest probability, boosted-tree margin): exact
  path-dependent TreeSHAP values (Lundberg, Erion & Lee, arXiv:1802.03888). The
  fitted model's node table is read back from its saved form and turned into
  leaf-path tables: per leaf its features, their intervals and cover shares.
  An Arrow UDF compares each batch with the intervals and adds up the leaves'
  Shapley values, one evaluation per distinct pattern of met conditions. It is
  a narrow projection, so it explains every row, in batch and in streams.
  Invariant: sum(phi) + base = model output.
* Reasons: the top-k features by |contribution| per row, via ``sort_array``
  over an array of structs -- per row, no shuffle.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import FEATURE_COLS, SHAP_TEXT
from linkrisk.functions.rules import direction
from linkrisk.session import ensure_checkpoint_dir

#: Path entries (leaf x feature, about 32 bytes) that travel to the tasks in one part.
PART_CELLS = 4_000_000


# ------------------------------------------------------------------ linear

def linear_shap(df: DataFrame, coef: list[float], background_mean: list[float],
                cols: list[str] = FEATURE_COLS, prefix: str = "phi_") -> DataFrame:
    """Per-feature contribution ``coef * (x - background mean)`` (log-odds)."""
    return df.select("*", *[(F.lit(float(w)) * (F.col(c).cast("double") - F.lit(float(m)))).alias(prefix + c)
                            for c, w, m in zip(cols, coef, background_mean)])


def background_mean(df: DataFrame, cols: list[str] = FEATURE_COLS) -> list[float]:
    r = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [float(r[c]) if r[c] is not None else 0.0 for c in cols]


# ------------------------------------------------------------------ trees

def tree_table(model) -> tuple[list[dict], list[float]]:
    """Read the fitted ensemble's nodes back (from its saved form in the
    session's checkpoint folder) -> per-tree arrays, tree weights."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data"))
    pdf = nodes.select(
        "treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("prediction"),
        F.col("nodeData.impurityStats").alias("stats"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feat"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr")).toPandas()  # as large as the model, which the driver holds
    weights = [1.0] * (int(pdf["treeID"].max()) + 1 if len(pdf) else 0)
    if not type(model).__name__.startswith("RandomForest"):  # boosted trees carry weights
        wm = spark.read.parquet(os.path.join(path, "treesMetadata")).selectExpr("_1 AS treeID", "_3 AS weights").toPandas()
        for t, w in zip(wm["treeID"], wm["weights"]):
            weights[int(t)] = float(w)
    classification = hasattr(model, "numClasses") and type(model).__name__.startswith("RandomForest")
    trees = []
    for t, g in pdf.groupby("treeID"):
        g = g.sort_values("id")
        size = int(g["id"].max()) + 1
        left = np.full(size, -1, dtype=np.int64)
        right = np.full(size, -1, dtype=np.int64)
        feat = np.full(size, -1, dtype=np.int64)
        thr = np.zeros(size)
        value = np.zeros(size)
        cover = np.zeros(size)
        for r in g.itertuples(index=False):
            i = int(r.id)
            st = np.asarray(r.stats, dtype=np.float64)
            left[i], right[i] = int(r.left), int(r.right)
            if left[i] >= 0:
                feat[i] = int(r.feat)
                thr[i] = float(r.thr[0])
            if classification:
                cover[i] = st.sum()
                value[i] = st[1] / st.sum() if st.sum() > 0 else 0.0
            else:
                cover[i] = st[0]
                value[i] = float(r.prediction)
        trees.append({"left": left, "right": right, "feat": feat, "thr": thr, "value": value, "cover": cover})
    return trees, weights


def leaf_paths(tree: dict, scale: float = 1.0) -> list[tuple]:
    """Per leaf with at least one split above it: its distinct features, the interval
    (lo, hi] that each must lie in (NaN: no bound), the share of each one's splits'
    cover that reaches the leaf, and the scaled leaf value."""
    left, right, feat, thr, cover = (tree[c] for c in ("left", "right", "feat", "thr", "cover"))
    out, todo = [], [(0, {})]
    while todo:
        j, path = todo.pop()
        if left[j] < 0:
            if path:
                lo, hi, share = zip(*path.values())
                out.append((list(path), lo, hi, share, scale * tree["value"][j]))
            continue
        f = int(feat[j])
        lo, hi, share = path.get(f, (np.nan, np.nan, 1.0))
        for child, bounds in ((int(left[j]), (lo, np.fmin(hi, thr[j]))), (int(right[j]), (np.fmax(lo, thr[j]), hi))):
            todo.append((child, path | {f: (*bounds, share * cover[child] / cover[j])}))
    return out


class LeafTable:
    """The leaves of some trees, by path length d, as arrays: features, lo, hi and share
    (leaves x d) and value."""

    def __init__(self, leaves: list[tuple]):
        by_length: dict[int, list] = {}
        for leaf in leaves:
            by_length.setdefault(len(leaf[0]), []).append(leaf)
        self.groups = [(np.array([x[0] for x in g], np.int64), *(np.array([x[i] for x in g], float) for i in (1, 2, 3, 4)))
                       for _, g in sorted(by_length.items())]

    def shap(self, x: np.ndarray, n_features: int, cells: int = 1 << 21) -> np.ndarray:
        """SHAP values (rows x features). Equal rows are worked out once; so are equal
        patterns of met conditions at a leaf."""
        x, back = np.unique(x, axis=0, return_inverse=True)
        phi = np.zeros(len(x) * n_features)
        row = np.arange(len(x))[:, None, None] * n_features
        for feat, lo, hi, share, value in self.groups:
            d = feat.shape[1]
            step = max(1, cells // max(1, len(x) * d))
            for a in range(0, len(feat), step):
                f = feat[a:a + step]
                v = x[:, f]  # rows x leaves x d
                met = ~(v <= lo[a:a + step]) & ((v <= hi[a:a + step]) | np.isnan(hi[a:a + step]))
                key = (met << np.arange(d)).sum(axis=2) + (np.arange(len(f)) << d)
                keys, at = np.unique(key, return_inverse=True)
                leaf = a + (keys >> d)
                part = path_shap((keys[:, None] >> np.arange(d)) & 1 == 1, share[leaf], value[leaf])
                phi += np.bincount((row + f).ravel(), part[at.reshape(key.shape)].ravel(), len(phi))
        return phi.reshape(len(x), n_features)[back.reshape(-1)]


def path_shap(met: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values of the path game of leaves (n x d): a coalition's worth is the leaf
    value times, for each feature, whether its condition is met (inside the coalition)
    or its cover share (outside).

    The weight of a coalition of size s, s! (d-1-s)! / d!, is the integral of
    t^s (1-t)^(d-1-s) over 0..1, so feature i gets value * (met_i - share_i) times the
    integral of the product, over the others, of met_j t + share_j (1-t): a polynomial of
    degree d - 1, for which Gauss-Legendre quadrature with d/2 nodes is exact.
    """
    n, d = met.shape
    node, weight = np.polynomial.legendre.leggauss((d + 1) // 2)
    t, weight = (node + 1) / 2, weight / 2
    factor = met[:, :, None] * t + share[:, :, None] * (1 - t)  # n x d x nodes
    before = np.ones_like(factor)
    after = np.ones_like(factor)
    for j in range(1, d):
        before[:, j] = before[:, j - 1] * factor[:, j - 1]
        after[:, d - 1 - j] = after[:, d - j] * factor[:, d - j]
    return value[:, None] * (met - share) * ((before * after) @ weight)


def tree_shap_batch(x: np.ndarray, tree: dict, n_features: int) -> np.ndarray:
    """Path-dependent TreeSHAP of one tree for all rows of ``x``."""
    return LeafTable(leaf_paths(tree)).shap(x, n_features)


def expected_value(tree: dict) -> float:
    """I8: cover-weighted mean of the leaf values."""
    leaves = tree["left"] < 0
    c = tree["cover"][leaves]
    return float((c * tree["value"][leaves]).sum() / c.sum()) if c.sum() > 0 else 0.0


def shap_base(model) -> float:
    """I8: the ensemble's base value."""
    return shap_parts(model)[1]


def shap_parts(model) -> tuple[list[LeafTable], float]:
    """The ensemble's leaf tables, in parts of at most PART_CELLS path entries (or one
    tree), and its base value."""
    trees, weights = tree_table(model)
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    parts, held, cells = [], [], 0
    for t, s in zip(trees, weights):
        leaves = leaf_paths(t, s)
        size = sum(len(x[0]) for x in leaves)
        if held and cells + size > PART_CELLS:
            parts.append(LeafTable(held))
            held, cells = [], 0
        held, cells = held + leaves, cells + size
    return parts + [LeafTable(held)], float(sum(s * expected_value(t) for s, t in zip(weights, trees)))


def with_tree_shap(df: DataFrame, model, cols: list[str] = FEATURE_COLS, out: str = "phi", base: str = "base") -> DataFrame:
    """I7 + I8 for every row, batch or stream: ``out`` (array, in the order of ``cols``) and
    ``base``. ``cols`` are the columns as the model saw them; the others stay in the JVM.
    A model beyond PART_CELLS travels to the tasks in several parts."""
    parts, expected = shap_parts(model)
    m = len(cols)

    def explainer(table: LeafTable):
        @F.pandas_udf("array<double>")
        def explain(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, m))
            return pd.Series(list(table.shap(rows, m)))
        return explain

    x = F.array(*[F.col(c).cast("double") for c in cols])
    sums = [explainer(p)(x) for p in parts]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), sums)
    return df.withColumn(out, total).withColumn(base, F.lit(expected))


def tree_shap(df: DataFrame, model, id_cols: list[str], cols: list[str] = FEATURE_COLS,
              prefix: str = "phi_") -> DataFrame:
    """SHAP values of a tree ensemble for each row of ``df`` (``cols`` as
    the model saw them). Adds ``base`` and ``model_output`` (= base + sum phi):
    the class-1 probability for a random forest, the raw margin for boosting.
    """
    from linkrisk.operators.dataset import require_columns
    require_columns(df, list(id_cols) + list(cols))
    out = with_tree_shap(df.select(*id_cols, *cols), model, cols, "_phi", "_base")
    total = F.aggregate("_phi", F.lit(0.0), lambda a, b: a + b)
    return out.select(*id_cols, *[F.col("_phi")[i].alias(prefix + c) for i, c in enumerate(cols)],
                      F.col("_base").alias("base"), (F.col("_base") + total).alias("model_output"))


# ------------------------------------------------------------------ reasons

def top_reasons(df: DataFrame, k: int = 5, cols: list[str] = FEATURE_COLS, prefix: str = "phi_",
                out: str = "reasons") -> DataFrame:
    """E4 + H29: top-k features by |contribution| per row as
    array<struct<feature, text_en, contribution, direction>> (contribution
    rounded to 4); ties: higher feature index first."""
    return df.withColumn(out, reasons_of([F.col(prefix + c) for c in cols], k, cols))


def reasons_of(contributions: list[Column], k: int = 5, cols: list[str] = FEATURE_COLS) -> Column:
    """The E4 array from one contribution column per feature."""
    from linkrisk.functions.features import round_even
    items = [F.struct((-F.abs(v)).alias("neg_abs"), F.lit(-i).alias("neg_idx"), F.lit(c).alias("feature"),
                      F.lit(SHAP_TEXT.get(c, c)).alias("text_en"), v.alias("c")) for i, (c, v) in enumerate(zip(cols, contributions))]
    top = F.slice(F.sort_array(F.array(*items)), 1, k)
    return F.transform(top, lambda s: F.struct(s["feature"].alias("feature"), s["text_en"].alias("text_en"),
                                               round_even(s["c"], 4).alias("contribution"),
                                               direction(s["c"]).alias("direction")))


def bar_shares(reasons: str = "reasons") -> F.Column:
    """Bar width per reason, ``min(100, 100*|c|/max|c|)`` with max floor 0.001."""
    mx = F.greatest(F.array_max(F.transform(F.col(reasons), lambda r: F.abs(r["contribution"]))), F.lit(0.001))
    return F.transform(F.col(reasons), lambda r: F.least(F.lit(100.0), F.abs(r["contribution"]) / mx * 100.0))


def global_importance(phi: DataFrame, cols: list[str] = FEATURE_COLS, prefix: str = "phi_") -> DataFrame:
    """Mean |SHAP| per feature, ranked (one aggregate + unpivot)."""
    row = phi.agg(*[F.avg(F.abs(F.col(prefix + c))).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    u = row.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, mean_abs_shap)")
    from pyspark.sql import Window
    return u.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_abs_shap"), "feature")))


def error_reasons(df: DataFrame, cols: list[str] = FEATURE_COLS, prefix: str = "phi_", k: int = 2) -> DataFrame:
    """``name(+0.123) | name(-0.045)``: the top-k contributions per row."""
    from linkrisk.functions.features import round_even
    r = top_reasons(df, k, cols, prefix, "_top")
    # rounded before it is printed: Java prints halves up, Python the nearest to the binary value
    text = F.concat_ws(" | ", F.transform(F.col("_top"), lambda s: F.format_string(
        "%s(%+.3f)", s["feature"], round_even(s["contribution"], 3))))
    return r.withColumn("top_shap_reasons", text).drop("_top")


def reason_counts(errors: DataFrame, n: int = 3) -> DataFrame:
    """Most frequent reason strings per error type (top n by count)."""
    from pyspark.sql import Window
    c = errors.groupBy("error_type", "top_shap_reasons").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("error_type").orderBy(F.desc("n"), "top_shap_reasons")
    return c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
