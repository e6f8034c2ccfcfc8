"""Scaling, training, scoring, model reports.

Training uses ``pyspark.ml`` estimators (distributed fits); scaling uses the
population standard deviation like the original scaler (``ml.feature.
StandardScaler`` uses the sample one and maps constant columns to 0).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrisk.constants import FEATURE_COLS

#: The model families in the order of their metrics.
FAMILIES = ("logistic_regression", "random_forest", "gradient_boosting")


def fit_scaler(df: DataFrame, cols: list[str] = FEATURE_COLS) -> DataFrame:
    """(feature, ordinal, mean, std) with population std; 0 -> 1. One pass."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m_{c}"), F.stddev_pop(x).alias(f"s_{c}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{c}', {i}, m_{c}, CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0D ELSE s_{c} END"
                      for i, c in enumerate(cols))
    return row.selectExpr(f"stack({len(cols)}, {stack}) AS (feature, ordinal, mean, std)")


def scale_columns(df: DataFrame, scaler: DataFrame, cols: list[str] = FEATURE_COLS,
                  suffix: str = "") -> DataFrame:
    """B1: standardise ``cols`` with a fitted scaler table (one row, broadcast).

    Missing feature values count as 0 (as when assigning new rows).
    """
    wide = scaler.groupBy().pivot("feature", cols).agg(F.first(F.struct("mean", "std")))
    j = df.crossJoin(F.broadcast(wide.select([F.col(c).alias(f"_sc_{c}") for c in cols])))
    out = j.select("*", *[((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_sc_{c}.mean"))
                           / F.col(f"_sc_{c}.std")).alias(c + suffix) for c in cols])
    if not suffix:
        out = j.select(*[c for c in df.columns if c not in cols],
                       *[((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_sc_{c}.mean"))
                          / F.col(f"_sc_{c}.std")).alias(c) for c in cols])
        return out
    return out.drop(*[f"_sc_{c}" for c in cols])


# ---------------------------------------------------------------- training

def assemble(df: DataFrame, cols: list[str] = FEATURE_COLS, out: str = "features") -> DataFrame:
    """B1: fixed-order feature vector."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Balanced weights n / (2 * n_class): the weights sum to n."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = df.agg(F.count(F.lit(1)).alias("_n"))
    w = c.crossJoin(tot).select(label, (F.col("_n") / (F.lit(2.0) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


def estimators(n_rows: int, label: str = "label", features: str = "features", weight: str = "weight",
               seed: int = 42, fast: bool = False) -> dict:
    """The three model families with the original hyper-parameters.

    ``fast`` shrinks the ensembles (for smoke tests only).
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    c = 0.1
    lr = LogisticRegression(featuresCol=features, labelCol=label, weightCol=weight, maxIter=1000, tol=1e-4,
                            regParam=1.0 / (c * max(n_rows, 1)), elasticNetParam=0.0, standardization=False)
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, weightCol=weight,
                                numTrees=20 if fast else 200, maxDepth=8 if fast else 15,
                                minInstancesPerNode=5, maxBins=256, seed=seed)
    gbt = GBTClassifier(featuresCol=features, labelCol=label, weightCol=weight, maxIter=10 if fast else 100,
                        maxDepth=4, stepSize=0.05, subsamplingRate=0.7, featureSubsetStrategy="0.8", seed=seed)
    return {"logistic_regression": lr, "random_forest": rf, "gradient_boosting": gbt}


def score(df: DataFrame, model, out: str = "rf_score", pred: str = "pred") -> DataFrame:
    """P(phishing) and the 0.5-cut prediction as plain columns."""
    from pyspark.ml.functions import vector_to_array
    t = model.transform(df)
    t = t.withColumn(out, vector_to_array("probability")[1]).withColumn(pred, F.col("prediction").cast("int"))
    return t.drop("rawPrediction", "probability", "prediction")


def without_summary(model):
    """A fitted model as it is read back from its saved form. Fresh from a fit it holds its
    training summary, and with it the session, which cannot be sent to tasks once the session
    has observed a query, as streams do."""
    if not getattr(model, "hasSummary", False):
        return model
    import os
    import uuid

    from pyspark.sql import SparkSession

    from linkrisk.session import ensure_checkpoint_dir
    path = os.path.join(ensure_checkpoint_dir(SparkSession.active()), f"model-{uuid.uuid4().hex}")
    model.write().save(path)
    return type(model).load(path)


def training_frame(train: DataFrame, label: str = "label") -> tuple[DataFrame, int]:
    """What the fits read, stored: label, feature vector and class weight; and its rows."""
    from linkrisk.session import cut_lineage
    # a tree fit sends statistics per partition, so more of them than cores cost more than they spread
    cores = train.sparkSession.sparkContext.defaultParallelism
    tr = cut_lineage(with_class_weights(assemble(train), label).select(label, "features", "weight").coalesce(2 * cores))
    return tr, tr.count()


def train_compare(train: DataFrame, test: DataFrame, label: str = "label", models: dict | None = None,
                  fast: bool = False, frame: tuple[DataFrame, int] | None = None):
    """I4: fit every estimator on the cached training frame, evaluate on the
    holdout (D7 + D9 exact), return (fitted models, metrics DataFrame). ``frame``
    is the ``training_frame`` of ``train`` where it is stored already."""
    from linkrisk.operators.dataset import require_columns, require_nonempty
    from linkrisk.operators.metrics import binary_metrics, roc_auc
    require_columns(train, FEATURE_COLS + [label])
    require_columns(test, FEATURE_COLS + [label])
    require_nonempty(train, "training frame")
    spark = train.sparkSession
    tr, n = frame or training_frame(train, label)
    te = assemble(test)
    models = models or estimators(n, label, fast=fast)
    fitted, rows = {}, []
    for i, (name, est) in enumerate(models.items()):
        m = without_summary(est.fit(tr))
        fitted[name] = m
        s = score(te, m, "p1", "pred").select(label, "p1", "pred").cache()
        bm = binary_metrics(s, label, "pred").first().asDict()
        auc = roc_auc(s, label, "p1").first()["auc"]
        s.unpersist()
        rows.append((FAMILIES.index(name) if name in FAMILIES else i, name, bm["accuracy"], bm["precision"], bm["recall"], bm["f1"], bm["fpr"],
                     int(bm["fp"]), int(bm["fn"]), float(auc) if auc is not None else None))
    metrics = spark.createDataFrame(rows, "ordinal int, model string, accuracy double, precision double, "
                                          "recall double, f1 double, fpr double, fp long, fn long, auc double")
    return fitted, metrics


def out_of_fold_scores(df: DataFrame, families: Callable[[int], dict] = estimators, k: int = 5, label: str = "label",
                       key: str = "url", parallelism: int = 4) -> DataFrame:
    """Stored (key, fold, model, label, pred) of every row under the models that did not
    see its fold (E2). Class weights and regularisation are those of a fold's training part.
    ``families`` gives the estimators by name for a number of training rows; fits of different
    folds and families run side by side."""
    from linkrisk.operators.split import stratified_folds
    from linkrisk.session import cut_lineage
    f = cut_lineage(stratified_folds(df, label, k).select(key, label, "fold", *FEATURE_COLS))
    parts = []
    for i in range(k):
        train, n = training_frame(f.filter(F.col("fold") != i), label)
        parts.append((i, train, families(n)))
    jobs = [(i, train, name, est) for i, train, by_name in parts for name, est in by_name.items()]

    def fit(job):
        i, train, name, est = job
        held = assemble(f.filter(F.col("fold") == i))
        return score(held, without_summary(est.fit(train)), "p1", "pred").select(key, "fold", F.lit(name).alias("model"), label, "pred")

    with ThreadPoolExecutor(parallelism) as pool:
        return cut_lineage(reduce(lambda a, b: a.unionByName(b), pool.map(fit, jobs)))


def cross_validate(df: DataFrame, families: Callable[[int], dict] = estimators, k: int = 5, label: str = "label") -> DataFrame:
    """F1 per (model, fold), from the stored out-of-fold predictions in one aggregate."""
    s = out_of_fold_scores(df, families, k, label)
    hit = lambda y, p: F.count_if((F.col(label) == y) & (F.col("pred") == p))
    c = s.groupBy("model", "fold").agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return c.select("model", "fold", F.when(den > 0, 2 * F.col("tp") / den).otherwise(0.0).alias("f1"))


def importances(model, cols: list[str] = FEATURE_COLS, spark=None) -> DataFrame:
    """Tree feature importances, sorted descending."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame([(c, float(v)) for c, v in zip(cols, imp)], "feature string, importance double") \
        .orderBy(F.desc("importance"), "feature")


def evaluation_report(metrics: DataFrame, best: str, thresholds: tuple[float, float], cost_t: float | None,
                      n_fp: int, n_fn: int) -> DataFrame:
    """I16: the evaluation report as (section, metric, value) rows."""
    spark = metrics.sparkSession
    rows = [("best", "model", best)]
    b = metrics.filter(F.col("model") == best).first()
    if b is not None:
        for k in ("accuracy", "precision", "recall", "f1", "auc", "fpr"):
            rows.append(("best", k, f"{b[k]:.4f}" if b[k] is not None else ""))
    rows += [("thresholds", "dangerous", str(thresholds[0])), ("thresholds", "suspicious", str(thresholds[1])),
             ("thresholds", "cost_optimal", f"{cost_t:.2f}" if cost_t is not None else "")]
    for r in metrics.orderBy("ordinal").collect():  # one row per model
        rows.append(("models", r["model"], f"F1={r['f1']:.4f} AUC={(r['auc'] or 0):.4f} FPR={r['fpr']:.4f}"))
    rows += [("errors", "false_positives", str(n_fp)), ("errors", "false_negatives", str(n_fn))]
    return spark.createDataFrame(rows, "section string, metric string, value string")


def save_model(model, path: str) -> None:
    """Persist a fitted model (overwrite)."""
    model.write().overwrite().save(path)
