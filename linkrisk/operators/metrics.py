"""Exact classification metrics on a scored table.

Every metric is an aggregation over (label, score/pred) that Spark combines
map-side. Curves and sweeps first group rows by score (or by threshold
bucket), so their windows run over a small table, never over raw rows; the
ROC prefix sums additionally cut that table at approximate quantiles into
ranges with broadcast offsets, so even millions of distinct scores crowded
into a narrow interval are not ranked in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkrisk.constants import FN_COST, FP_COST
from linkrisk.session import cut_lineage


def _div0(a: Column, b: Column) -> Column:
    """a / b, 0 when b = 0 (zero-division -> 0)."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def counts(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def with_rates(c: DataFrame) -> DataFrame:
    """D7 formulas over a (tp, fp, fn, tn) table; FPR denominator max(neg, 1)."""
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(
        "*",
        _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _div0(tp, tp + fp).alias("precision"),
        _div0(tp, tp + fn).alias("recall"),
        _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (fp.cast("double") / F.greatest(fp + tn, F.lit(1)).cast("double")).alias("fpr"),
    )


def binary_metrics(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """D7 (+B7): accuracy, precision, recall, F1, FPR, FP, FN in one pass."""
    return with_rates(counts(df, label, pred))


def confusion(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """2x2 confusion counts, zero-filled."""
    spark = df.sparkSession
    cells = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "label int, pred int")
    got = df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))
    return cells.join(got, ["label", "pred"], "left").select("label", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Per-class precision / recall / F1 / support, macro and weighted avg."""
    c = counts(df, label, pred)
    rows = c.select(
        F.explode(F.array(
            F.struct(F.lit("0").alias("cls"), F.col("tn").alias("tp_c"), F.col("fn").alias("fp_c"),
                     F.col("fp").alias("fn_c")),
            F.struct(F.lit("1").alias("cls"), F.col("tp").alias("tp_c"), F.col("fp").alias("fp_c"),
                     F.col("fn").alias("fn_c")),
        )).alias("r")).select("r.*")
    per = rows.select(
        "cls", _div0(F.col("tp_c"), F.col("tp_c") + F.col("fp_c")).alias("precision"),
        _div0(F.col("tp_c"), F.col("tp_c") + F.col("fn_c")).alias("recall"),
        _div0(2 * F.col("tp_c"), 2 * F.col("tp_c") + F.col("fp_c") + F.col("fn_c")).alias("f1"),
        (F.col("tp_c") + F.col("fn_c")).alias("support"))
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("cls"),
                       _div0(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
                       _div0(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
                       _div0(F.sum(F.col("f1") * F.col("support")), tot).alias("f1"), tot.alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def _score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _prefix_sums_desc(g: DataFrame, buckets: int = 1024) -> DataFrame:
    """Add pos_above / neg_above: totals over strictly higher scores.

    ``g`` has one row per distinct score. Its scores are cut at approximate
    quantiles (``buckets`` split points, a bounded list) into ranges of about
    equal numbers of distinct scores, so no range task is hot even when the
    scores crowd into a narrow interval. Range totals get offsets from a small
    window; rows within a range from a window per range. Exact: the quantiles
    only choose where to cut.
    """
    from pyspark.ml.feature import Bucketizer
    probs = [i / buckets for i in range(1, buckets)]
    qs = sorted({q for q in g.approxQuantile("score", probs, 1.0 / (4 * buckets)) if q == q})
    splits = [float("-inf")] + qs + [float("inf")]
    g = Bucketizer(splits=splits, inputCol="score", outputCol="_rbd", handleInvalid="keep").transform(g)
    g = g.withColumn("_rb", F.col("_rbd").cast("int")).drop("_rbd")
    bt = g.groupBy("_rb").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    wb = Window.orderBy(F.desc("_rb")).rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select("_rb", F.coalesce(F.sum("_bp").over(wb), F.lit(0)).alias("_op"),
                   F.coalesce(F.sum("_bn").over(wb), F.lit(0)).alias("_on"))
    g = g.join(F.broadcast(bt), "_rb")  # <= buckets + 1 rows
    w = Window.partitionBy("_rb").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return g.select("score", "pos", "neg",
                    (F.col("_op") + F.coalesce(F.sum("pos").over(w), F.lit(0))).alias("pos_above"),
                    (F.col("_on") + F.coalesce(F.sum("neg").over(w), F.lit(0))).alias("neg_above"))


def roc_points(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One ROC point per distinct score (threshold = score, >=). The input is read
    once; what follows works on the stored groups."""
    groups = cut_lineage(_score_groups(df, label, score))
    g = _prefix_sums_desc(groups)
    tot = groups.agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("P"), F.coalesce(F.sum("neg"), F.lit(0)).alias("N"))
    j = g.crossJoin(F.broadcast(tot))  # one row
    return j.select(F.col("score").alias("threshold"),
                    _div0(F.col("neg_above") + F.col("neg"), F.col("N")).alias("fpr"),
                    _div0(F.col("pos_above") + F.col("pos"), F.col("P")).alias("tpr"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve (trapezoid = tie-corrected rank statistic)."""
    g = _prefix_sums_desc(cut_lineage(_score_groups(df, label, score)))
    a = g.agg(F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)).alias("_s"),
              F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return a.select(F.when((F.col("_p") == 0) | (F.col("_n") == 0), F.lit(None).cast("double"))
                    .otherwise(F.col("_s") / (F.col("_p") * F.col("_n"))).alias("auc"))


def default_thresholds(lo: float = 0.05, hi: float = 0.95, n: int = 50) -> list[float]:
    """The 50-point threshold grid (same doubles as numpy.linspace)."""
    return [float(x) for x in np.linspace(lo, hi, n)]


def threshold_sweep(df: DataFrame, label: str = "label", score: str = "score",
                    thresholds: list[float] | None = None) -> DataFrame:
    """P/R/F1/FPR and cost at every grid threshold (``score >= t``).

    Rows are bucketed to the grid (CASE chain, exact comparisons) and counted:
    one pass, at most 2 x (grid + 1) groups; no score x threshold product.
    """
    ts = thresholds or default_thresholds()
    s = F.col(score)
    idx = F.lit(-1)
    for i, t in enumerate(ts):  # largest i with t_i <= score
        idx = F.when(s >= F.lit(t), F.lit(i)).otherwise(idx)
    b = df.groupBy(idx.alias("bi")).agg(F.count_if(F.col(label) == 1).alias("pos"),
                                        F.count_if(F.col(label) == 0).alias("neg"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "ti int, threshold double")
    tot = b.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    above = grid.join(F.broadcast(b), F.col("bi") >= F.col("ti"), "left").groupBy("ti", "threshold").agg(
        F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg"), F.lit(0)).alias("fp"))
    c = above.crossJoin(F.broadcast(tot)).select(
        "ti", "threshold", "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    return with_rates(c).withColumn("cost", F.col("fn") * FN_COST + F.col("fp") * FP_COST).drop("accuracy")


def cost_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold of least cost ``100*FN + FP``; lowest threshold on ties."""
    return sweep.orderBy("cost", "threshold").limit(1).select("threshold", "cost")


def select_best(metrics: DataFrame, order_col: str = "ordinal") -> DataFrame:
    """Highest ``f1 * (1 - fpr)``; the first candidate wins ties."""
    return (metrics.withColumn("selection_score", F.col("f1") * (F.lit(1.0) - F.col("fpr")))
            .orderBy(F.desc("selection_score"), order_col).limit(1))


def error_samples(df: DataFrame, label: str = "label", pred: str = "pred", n: int = 20,
                  order_cols: list[str] | None = None) -> DataFrame:
    """The first ``n`` false positives and first ``n`` false negatives.

    ``row_number() <= n`` over a 2-valued partition is planned by Spark as a
    window group limit: each map task keeps only its local top ``n`` per type
    before the shuffle.
    """
    order_cols = order_cols or ["url_id", "url"]
    e = df.filter(F.col(label) != F.col(pred)).withColumn(
        "error_type", F.when(F.col(pred) == 1, F.lit("False Positive")).otherwise(F.lit("False Negative")))
    w = Window.partitionBy("error_type").orderBy(*order_cols)
    return e.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def cv_summary(fold_scores: DataFrame, score: str = "f1", by: list[str] | None = None) -> DataFrame:
    """Mean and population std of per-fold scores (per ``by``)."""
    return fold_scores.groupBy(*(by or [])).agg(F.avg(score).alias("cv_mean"), F.stddev_pop(score).alias("cv_std"))
