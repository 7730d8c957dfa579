"""Contours, one row per point: (contour_id, pos, x, y), pos from 0 without gaps.

A contour is a bounded object (one image's outline), so windows over it hold one contour at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _by_pos():
    return Window.partitionBy("contour_id").orderBy("pos")


def _whole():
    return Window.partitionBy("contour_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _next(c: str):
    """The following point's coordinate, the first one's at the end."""
    return F.coalesce(F.lead(c).over(_by_pos()), F.first(c).over(_by_pos()))


def polygon_area(points: DataFrame) -> DataFrame:
    """(contour_id, area) by the shoelace formula."""
    cross = points.withColumn("c", F.col("x") * _next("y") - F.col("y") * _next("x"))
    return cross.groupBy("contour_id").agg((F.abs(F.sum("c")) / 2).alias("area"))


def extent(points: DataFrame) -> DataFrame:
    """(contour_id, x_min, y_min, w, h)."""
    box = points.groupBy("contour_id").agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), F.max("x").alias("x_max"), F.max("y").alias("y_max"))
    return box.select("contour_id", "x_min", "y_min", (F.col("x_max") - F.col("x_min")).alias("w"), (F.col("y_max") - F.col("y_min")).alias("h"))


def orient(points: DataFrame) -> DataFrame:
    """Points in an order that ends below its start (larger y); a contour that does not, equal ends included, is reversed."""
    ends = points.groupBy("contour_id").agg(F.min_by("y", "pos").alias("y0"), F.max_by("y", "pos").alias("y1"), F.max("pos").alias("last"))
    turned = F.when(F.col("y1") - F.col("y0") > 0, F.col("pos")).otherwise(F.col("last") - F.col("pos"))
    return points.join(ends, "contour_id").select("contour_id", turned.alias("pos"), "x", "y")


def nearest_anchor(contours: DataFrame, anchors: DataFrame) -> DataFrame:
    """(image_id, contour_id, anchor_idx): the anchor whose centre is nearest to the contour's, the first on ties.

    contours: (image_id, contour_id, cx, cy); anchors: (image_id, anchor_idx, ax, ay). An anchor may serve several.
    """
    pairs = contours.join(anchors, "image_id")
    d = F.pow(F.col("cx") - F.col("ax"), F.lit(2)) + F.pow(F.col("cy") - F.col("ay"), F.lit(2))
    return pairs.groupBy("image_id", "contour_id").agg(F.min_by("anchor_idx", F.struct(d.alias("d"), "anchor_idx")).alias("anchor_idx"))


def nearest_vertex(points: DataFrame, anchors: DataFrame) -> DataFrame:
    """(contour_id, anchor_idx, pos) of the contour point nearest to each anchor (contour_id, anchor_idx, ax, ay), the first on ties."""
    d = F.pow(F.col("x") - F.col("ax"), F.lit(2)) + F.pow(F.col("y") - F.col("ay"), F.lit(2))
    return points.join(anchors, "contour_id").groupBy("contour_id", "anchor_idx").agg(F.min_by("pos", F.struct(d.alias("d"), "pos")).alias("pos"))


def view_label(contours: DataFrame) -> DataFrame:
    """right if the midpoint of the two anchors lies right of the contour's centre, else left: (contour_id, cx, ax0, ax1)."""
    return contours.select("contour_id", F.when((F.col("ax0") + F.col("ax1")) / 2 > F.col("cx"), "right").otherwise("left").alias("view"))


def cut_longer(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """The longer of the two arcs between positions i and j (contour_id, i, j); of equal arcs the one that wraps around.

    The inner arc holds positions i..j; the other one j.. to the end and on from the start to i. Positions count anew.
    """
    lo, hi = F.least("i", "j"), F.greatest("i", "j")
    n = points.groupBy("contour_id").agg(F.count(F.lit(1)).alias("n"))
    p = points.join(cuts.select("contour_id", lo.alias("lo"), hi.alias("hi")), "contour_id").join(n, "contour_id")
    inner = F.col("hi") - F.col("lo") + 1
    outer = F.col("n") - F.col("hi") + F.col("lo") + 1
    p = p.withColumn("inside", inner > outer)
    kept = p.filter("(inside and pos between lo and hi) or (not inside and (pos >= hi or pos <= lo))")
    pos = F.when(F.col("inside"), F.col("pos") - F.col("lo")).when(F.col("pos") >= F.col("hi"), F.col("pos") - F.col("hi")).otherwise(F.col("n") - F.col("hi") + F.col("pos"))
    return kept.select("contour_id", pos.alias("pos"), "x", "y")


def densify(points: DataFrame, spacing: float = 2.0) -> DataFrame:
    """Points at equal steps along each edge, from its start, without its end; the edge from the last point to the first comes first.
    Edges without length give nothing. (contour_id, edge, step, x, y)"""
    px = F.coalesce(F.lag("x").over(_by_pos()), F.last("x").over(_whole()))
    py = F.coalesce(F.lag("y").over(_by_pos()), F.last("y").over(_whole()))
    e = points.withColumn("px", px).withColumn("py", py)
    e = e.withColumn("len", F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2)) + F.pow(F.col("y") - F.col("py"), F.lit(2)))).filter("len > 0")
    e = e.withColumn("step", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / spacing).cast("int"))))
    t = F.col("step") * F.lit(float(spacing)) / F.col("len")
    return e.select("contour_id", F.col("pos").alias("edge"), "step", (F.col("px") + t * (F.col("x") - F.col("px"))).alias("x"), (F.col("py") + t * (F.col("y") - F.col("py"))).alias("y"))


def select_by_weight(predictions: DataFrame, mode: str = "auto") -> DataFrame:
    """(image_id, idx, weight, rank) of the predictions that an image keeps, by area times confidence.

    side keeps one, front two; auto keeps one if the first outweighs the second more than three times (or is alone).
    """
    w = Window.partitionBy("image_id").orderBy(F.col("weight").desc(), "idx")
    p = predictions.withColumn("weight", F.col("area") * F.col("confidence"))
    p = p.withColumn("rank", F.row_number().over(w))
    second = F.max(F.when(F.col("rank") == 2, F.col("weight"))).over(Window.partitionBy("image_id"))
    first = F.max(F.when(F.col("rank") == 1, F.col("weight"))).over(Window.partitionBy("image_id"))
    keep = {"side": F.lit(1), "front": F.lit(2), "auto": F.when(second.isNull() | (first > 3 * second), 1).otherwise(2)}[mode]
    return p.withColumn("keep", keep).filter("rank <= keep").select("image_id", "idx", "weight", "rank")


def rotated(points: DataFrame, angles: DataFrame) -> DataFrame:
    """Points turned by the angle of their contour, angles (contour_id, angle, cx, cy) in radians, about its center:
    x' = c*dx + s*dy, y' = -s*dx + c*dy, seen from the center."""
    c, s = F.cos("angle"), F.sin("angle")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return points.join(angles, "contour_id").select("contour_id", "pos", (c * dx + s * dy).alias("x"), (c * dy - s * dx).alias("y"))


def reoriented(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Points seen from a center (contour_id, cx, cy), turned so that the chord from the first to the last is level."""
    chord = points.groupBy("contour_id").agg((F.max_by("y", "pos") - F.min_by("y", "pos")).alias("dy"), (F.max_by("x", "pos") - F.min_by("x", "pos")).alias("dx"))
    return rotated(points, chord.join(centers, "contour_id").select("contour_id", F.atan2("dy", "dx").alias("angle"), "cx", "cy"))


def mirrored(points: DataFrame, widths: DataFrame) -> DataFrame:
    """Points of pictures mirrored left to right: x becomes width - 1 - x. widths: (contour_id, width)."""
    return points.join(widths, "contour_id").select("contour_id", "pos", (F.col("width") - 1 - F.col("x")).alias("x"), "y")


def radii(points: DataFrame, scales: list[float]) -> DataFrame:
    """(contour_id, scale_idx, radius): shares of the larger side of a contour's extent."""
    r = F.array(*(F.greatest("w", "h") * F.lit(s) for s in scales))
    return extent(points).select("contour_id", F.posexplode(r).alias("scale_idx", "radius"))
