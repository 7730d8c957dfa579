"""Fusion of two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keeps logarithms of zero probabilities finite.
EPSILON = 1e-12


def log_opinion_pool(df: DataFrame, w1: float, w2: float) -> DataFrame:
    """(sample_id, class_id, p) from (sample_id, class_id, p1, p2): weighted sum of logarithms, normalised within a sample by log-sum-exp."""
    a, b = w1 / (w1 + w2), w2 / (w1 + w2)
    lp = df.withColumn("lp", a * F.log(F.col("p1") + EPSILON) + b * F.log(F.col("p2") + EPSILON))
    w = Window.partitionBy("sample_id")
    e = lp.withColumn("e", F.exp(F.col("lp") - F.max("lp").over(w)))
    return e.select("sample_id", "class_id", (F.col("e") / F.sum("e").over(w)).alias("p"))
