"""Accuracy of ranked predictions and of binary decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topk_accuracy(ranks: DataFrame, ks: list[int], n_classes: int | None = None) -> DataFrame:
    """(k, correct, total, accuracy) from (image_id, rank of the true name or null). Images without a prediction count as wrong;
    with n_classes, ks beyond the number of classes are left out."""
    ks = [k for k in ks if n_classes is None or k <= n_classes]
    hits = [F.count(F.when(F.col("rank") <= k, 1)).alias(str(k)) for k in ks]
    one = ranks.agg(F.count(F.lit(1)).alias("total"), *hits)
    rows = one.select("total", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("correct")) for k in ks))).alias("r"))
    return rows.select("r.k", "r.correct", "total", F.try_divide(F.col("r.correct").cast("double"), F.col("total")).alias("accuracy"))


def topk_accuracy_predicted_only(ranks: DataFrame, predicted: DataFrame, ks: list[int]) -> DataFrame:
    """topk_accuracy over the images that have a prediction at all."""
    return topk_accuracy(ranks.join(predicted.select("image_id").distinct(), "image_id", "left_semi"), ks)


def accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    return df.agg(F.avg((F.col(predicted) == F.col(truth)).cast("int")).alias("accuracy"))


def precision_recall_f1(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall, f1; ratios without a denominator are 0. Rows with a null are left out."""
    p, t = F.col(predicted).cast("boolean"), F.col(truth).cast("boolean")
    n = df.agg(F.count(F.when(p & t, 1)).alias("tp"), F.count(F.when(p & ~t, 1)).alias("fp"), F.count(F.when(~p & t, 1)).alias("fn"), F.count(F.when(~p & ~t, 1)).alias("tn"))
    tp = F.col("tp").cast("double")

    def share(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = n.withColumn("precision", share(tp, F.col("tp") + F.col("fp"))).withColumn("recall", share(tp, F.col("tp") + F.col("fn")))
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def results_table(metrics: DataFrame, ks: list[int]) -> DataFrame:
    """(config, top_<k>...) from (config, k, accuracy); text with one decimal, N/A where a k was not measured."""
    wide = metrics.groupBy("config").pivot("k", ks).agg(F.first("accuracy"))
    return wide.select("config", *(F.when(F.col(str(k)).isNotNull(), F.format_string("%.1f", F.col(str(k)) * 100)).otherwise("N/A").alias(f"top_{k}") for k in ks))
