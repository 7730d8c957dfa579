"""Integral curvature of contours: one contour at a time as array operations (pairs of its points do not fit relational form)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.operators.numbering import many_parts

#: Radii as shares of the larger side of a contour's extent.
SCALES = (0.02, 0.04, 0.06, 0.08)
#: Distances that are held at a time.
BLOCK_CELLS = 1 << 20


def curvature_at(points: np.ndarray, i: int, radius: float) -> float:
    """Share of the box around point i that lies under the points within the radius, their chord turned level.

    0.5 for a point alone; NaN for a box without width.
    """
    p = points[i]
    near = points[((points - p) ** 2).sum(1) <= radius * radius]
    if len(near) == 1:
        return 0.5
    chord = near[-1] - near[0]
    angle = np.arctan2(chord[1], chord[0])
    c, s = np.cos(angle), np.sin(angle)
    d = near - p
    x, y = c * d[:, 0] + s * d[:, 1], -s * d[:, 0] + c * d[:, 1]
    left, right = max(x.min(), -radius), min(x.max(), radius)
    box = (right - left) * 2 * radius
    if box <= 0:
        return float("nan")
    h = y + radius
    return float(((h[1:] + h[:-1]) / 2 * np.diff(x)).sum() / box)


def curvatures(points: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """curvature_at of every point (rows) and radius (columns): one block of distances for all radii, sums by segments."""
    n = len(points)
    out = np.full((n, len(radii)), np.nan)
    for start in range(0, n, max(1, BLOCK_CELLS // n)):
        d = points[None, :, :] - points[start : start + max(1, BLOCK_CELLS // n), None, :]
        square = (d**2).sum(2)
        for k, radius in enumerate(radii.tolist()):
            i, j = np.nonzero(square <= radius * radius)
            dx, dy = d[i, j, 0], d[i, j, 1]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            last = np.append(first[1:], len(i)) - 1
            size = last - first + 1
            angle = np.arctan2(dy[last] - dy[first], dx[last] - dx[first])
            c, s = np.repeat(np.cos(angle), size), np.repeat(np.sin(angle), size)
            x, y = c * dx + s * dy, c * dy - s * dx
            left, right = np.maximum(np.minimum.reduceat(x, first), -radius), np.minimum(np.maximum.reduceat(x, first), radius)
            box = (right - left) * 2 * radius
            strip = np.append(((y[1:] + y[:-1]) / 2 + radius) * np.diff(x), 0.0)
            strip[last] = 0.0  # between two points' segments
            area = np.add.reduceat(strip, first)
            own = np.full(len(first), np.nan)
            np.divide(area, box, out=own, where=box > 0)
            out[start : start + len(first), k] = np.where(size == 1, 0.5, own)
    return out


def integral_curvature(points: DataFrame, scales: tuple[float, ...] = SCALES) -> DataFrame:
    """(contour_id, pos, scale_idx, curv) from (contour_id, pos, x, y); null where it has no value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        xy = pdf[["x", "y"]].to_numpy(float)
        reach = float((xy.max(0) - xy.min(0)).max())
        curv = curvatures(xy, reach * np.array(scales))
        n, k = curv.shape
        return pd.DataFrame({"contour_id": np.repeat(pdf.contour_id.to_numpy(), k), "pos": np.repeat(pdf.pos.to_numpy(), k), "scale_idx": np.tile(np.arange(k), n), "curv": curv.ravel()})

    dealt = points.repartition(many_parts(points), "contour_id")
    out = dealt.groupBy("contour_id").applyInPandas(run, "contour_id long, pos int, scale_idx int, curv double")
    return out.withColumn("curv", F.when(~F.isnan("curv"), F.col("curv")))


def neighbours_within(points: DataFrame, share: float) -> DataFrame:
    """(contour_id, pos, other) of points of one contour whose distance is at most `share` of the larger side of its extent.

    A range join by cells as wide as that distance: a point meets the points of its own cell and of the eight around it,
    so the work follows the matches and not the pairs of a contour's points. Each contour and cell is a key of an inner
    join, which Spark splits where one has very many points.
    """
    reach = points.groupBy("contour_id").agg((F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) * F.lit(share)).alias("r"))
    wide = F.col("r") * (1 + 1e-9)  # what rounding may move over a cell's edge
    cell = [F.coalesce(F.floor(F.try_divide(F.col(c), wide)), F.lit(0)) for c in ("x", "y")]  # without an extent all points share one
    placed = points.join(reach, "contour_id").select("contour_id", "pos", "x", "y", "r", cell[0].alias("cx"), cell[1].alias("cy"))
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    around = placed.select("contour_id", F.col("pos").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy", F.explode(steps).alias("i"))
    around = around.select("*", F.explode(steps).alias("j")).select("contour_id", "other", "ox", "oy", (F.col("cx") + F.col("i")).alias("cx"), (F.col("cy") + F.col("j")).alias("cy"))
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    return placed.join(around, ["contour_id", "cx", "cy"]).filter(dx * dx + dy * dy <= F.col("r") * F.col("r")).select("contour_id", "pos", "other")
