"""Detections of several models for an image: pairs, consensus, triage, best box."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions.boxes import iou, triage

# Weight of each detector version, confidence a box needs, penalty of a version with several boxes, digits.
WEIGHTS = {12: 0.2, 13: 1.0, 14: 0.3, 15: 0.4, 16: 0.95}
LEAST_CONFIDENCE, SEVERAL_PENALTY, LEAST_MODELS = 0.5, 0.2, 3

_CORNERS = ("x1", "y1", "x2", "y2")


def first_boxes(boxes: DataFrame, least: float = LEAST_CONFIDENCE) -> DataFrame:
    """(image_id, version, n, box) of the boxes (image_id, version, det_idx, confidence, x1..y2) that are sure enough; box is the first."""
    some = boxes.filter(F.col("confidence") >= least)
    return some.groupBy("image_id", "version").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct(*_CORNERS), F.col("det_idx")).alias("box"))


def version_pairs(first: DataFrame) -> DataFrame:
    """(image_id, v1, v2, iou) for the versions of an image, each pair once: a self-join within an image's few versions."""
    a = first.select("image_id", F.col("version").alias("v1"), F.col("box").alias("a"))
    b = first.select("image_id", F.col("version").alias("v2"), F.col("box").alias("b"))
    pairs = a.join(b, "image_id").filter("v1 < v2")
    return pairs.select("image_id", "v1", "v2", iou([F.col(f"a.{c}") for c in _CORNERS], [F.col(f"b.{c}") for c in _CORNERS]).alias("iou"))


def _pair_weights(spark, weights: dict[int, float]) -> DataFrame:
    """Mean weight of two versions to two digits: a row for each pair of a fixed handful of versions."""
    rows = [(a, b, round((weights[a] + weights[b]) / 2, 2)) for a in weights for b in weights if a < b]
    return spark.createDataFrame(rows, "v1 int, v2 int, w double")


def consensus_score(boxes: DataFrame, weights: dict[int, float] = WEIGHTS) -> DataFrame:
    """(image_id, score) of each image of boxes: weighted agreement of the versions, -1 with too few of them."""
    first = first_boxes(boxes)
    agree = version_pairs(first).join(_pair_weights(boxes.sparkSession, weights), ["v1", "v2"])
    agree = agree.groupBy("image_id").agg(F.sum(F.col("iou") * F.col("w")).alias("agreement"))
    flags = first.groupBy("image_id").agg(F.count(F.lit(1)).alias("models"), F.count(F.when(F.col("n") >= 2, 1)).alias("flags"))
    every = boxes.select("image_id").distinct().join(flags, "image_id", "left").join(agree, "image_id", "left")
    score = F.coalesce("agreement", F.lit(0.0)) - F.lit(SEVERAL_PENALTY) * F.col("flags")
    total = sum(weights.values()) * 2
    return every.select("image_id", F.when(F.coalesce("models", F.lit(0)) < LEAST_MODELS, F.lit(-1.0)).otherwise(F.bround(score / F.lit(total), 4)).alias("score"))


def triage_labels(boxes: DataFrame) -> DataFrame:
    """(image_id, label) from (image_id, confidence, area)."""
    all_boxes = boxes.groupBy("image_id").agg(F.collect_list(F.struct("confidence", "area")).alias("boxes"))
    return all_boxes.select("image_id", triage(F.col("boxes")).alias("label"))


def best_box(boxes: DataFrame) -> DataFrame:
    """(image_id, det_idx, confidence) of the surest box, the first on ties."""
    key = F.struct((-F.col("confidence")).alias("c"), F.col("det_idx"))
    best = F.min_by(F.struct("det_idx", "confidence"), key).alias("b")
    return boxes.groupBy("image_id").agg(best).select("image_id", "b.*")
