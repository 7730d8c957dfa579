"""Signals, one row per sample: (series_id, pos, value), pos from 0 without gaps."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspark.operators.numbering import many_parts


def _by_pos():
    return Window.partitionBy("series_id").orderBy("pos")


def _whole():
    return Window.partitionBy("series_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def resample_linear(series: DataFrame, length: int) -> DataFrame:
    """(series_id, i, value), i = 0..length-1: the samples spread evenly over 0..length, read at whole numbers (so never at the last)."""
    arrays = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("a"))
    arrays = arrays.select("series_id", F.col("a.value").alias("v"), F.size("a").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    at = F.col("i") * (F.col("n") - 1) / F.lit(float(length))
    lo = F.floor(at).cast("int")
    a, b = F.get("v", lo), F.get("v", F.least(lo + 1, F.col("n") - 1))
    return arrays.select("series_id", "i", (a + (b - a) * (at - lo)).alias("value"))


def resample_polyline(points: DataFrame, length: int) -> DataFrame:
    """(contour_id, i, x, y): `length` points at equal arc lengths from the first to the last point of (contour_id, pos, x, y)."""
    w = Window.partitionBy("contour_id").orderBy("pos")
    step = F.coalesce(F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), F.lit(2)) + F.pow(F.col("y") - F.lag("y").over(w), F.lit(2))), F.lit(0.0))
    p = points.withColumn("step", step).withColumn("s", F.sum("step").over(w))
    p = p.withColumn("s1", F.lead("s").over(w)).withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).withColumn("total", F.max("s").over(Window.partitionBy("contour_id")))
    d = F.col("total") / (length - 1)
    first, last = F.ceil(F.try_divide(F.col("s"), d) - 1e-9).cast("int"), F.ceil(F.try_divide(F.col("s1"), d) - 1e-9).cast("int") - 1
    seg = p.filter("s1 > s").withColumn("first", first).withColumn("last", F.when(F.col("s1") >= F.col("total"), length - 1).otherwise(last)).filter("last >= first")
    seg = seg.withColumn("d", d).withColumn("i", F.explode(F.sequence("first", "last")))
    t = F.least(F.lit(1.0), (F.col("i") * F.col("d") - F.col("s")) / (F.col("s1") - F.col("s")))
    return seg.select("contour_id", "i", (F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))


def gaussian_smooth(series: DataFrame, sigma: float = 2.0, truncate: float = 4.0) -> DataFrame:
    """(series_id, pos, value) smoothed; beyond the ends the signal is mirrored with the end sample repeated."""
    radius = int(truncate * sigma + 0.5)
    weights = _weights(sigma, truncate)
    arrays = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("a"))
    arrays = arrays.select("series_id", F.col("a.value").alias("v"), F.size("a").alias("n"))

    def mirrored(i: Column) -> Column:
        m = F.pmod(i, 2 * F.col("n"))
        return F.get("v", F.when(m < F.col("n"), m).otherwise(2 * F.col("n") - 1 - m))

    rows = arrays.withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    value = sum((mirrored(F.col("pos") + k) * w for k, w in zip(range(-radius, radius + 1), weights, strict=True)), F.lit(0.0))
    return rows.select("series_id", "pos", value.alias("value"))


def local_extrema(series: DataFrame, order: int = 3) -> DataFrame:
    """(series_id, pos, value, kind): strictly above (max) or below (min) the `order` samples on either side.
    Beyond an end the end sample itself stands for them, so an end is never an extremum."""
    ends = series.withColumn("lo", F.first("value").over(_by_pos())).withColumn("hi", F.last("value").over(_whole()))
    around = [F.coalesce(F.lag("value", k).over(_by_pos()), F.col("lo")) for k in range(1, order + 1)] + [F.coalesce(F.lead("value", k).over(_by_pos()), F.col("hi")) for k in range(1, order + 1)]
    s = ends.withColumn("top", F.greatest(*around)).withColumn("low", F.least(*around))
    kind = F.when(F.col("value") > F.col("top"), "max").when(F.col("value") < F.col("low"), "min")
    return s.withColumn("kind", kind).filter("kind is not null").select("series_id", "pos", "value", "kind")


def keypoints(extrema: DataFrame, smooth: DataFrame, length: int, number: int) -> DataFrame:
    """(series_id, pos): at most `number` keypoints of each series with extrema, the ends of the list always among them.

    The list is the maxima and then the minima. Position 0 comes before it if the first maximum lies beyond 1, and the
    last position after it if the last minimum lies before length - 2. The others are chosen by distance from 0.5.
    """
    listed = extrema.groupBy("series_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "max", F.col("pos")))).alias("tops"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "min", F.col("pos")))).alias("lows"),
    )
    both = F.concat("tops", "lows")
    listed = listed.withColumn("p", both).withColumn("p", F.when(F.element_at("p", 1) > 1, F.concat(F.array(F.lit(0)), "p")).otherwise(F.col("p")))
    listed = listed.withColumn("p", F.when(F.element_at("p", -1) < length - 2, F.concat("p", F.array(F.lit(length - 1)))).otherwise(F.col("p")))
    rows = listed.select("series_id", F.size("p").alias("m"), F.posexplode("p").alias("at", "pos"))
    rows = rows.join(smooth.select("series_id", "pos", "value"), ["series_id", "pos"])
    forced = (F.col("at") == 0) | (F.col("at") == F.col("m") - 1)
    weight = F.when(forced, F.lit(float("inf"))).otherwise(F.abs(F.col("value") - 0.5))
    rk = F.row_number().over(Window.partitionBy("series_id").orderBy(weight.desc(), "pos"))
    return rows.withColumn("rk", rk).filter(F.col("rk") <= number).select("series_id", "pos").distinct()


def keypoint_pairs(points: DataFrame) -> DataFrame:
    """(series_id, kp0, kp1) for all kp0 < kp1 of a series; bounded by the number of keypoints."""
    a, b = points.select("series_id", F.col("pos").alias("kp0")), points.select("series_id", F.col("pos").alias("kp1"))
    return a.join(b, "series_id").filter("kp0 < kp1")


def descriptors(series: DataFrame, length: int = 1024, dim: int = 32, number: int = 32) -> DataFrame:
    """(series_id, kp0, kp1, feature) of each pair of keypoints: the resampled, unsmoothed signal between them in `dim` samples, at unit length.

    A series is one row, its samples never rows of their own: resampled, smoothed and cut as arrays, with the rules of
    the functions above. All is computed in double precision; a feature is rounded once, at the end, to numbers of four
    bytes, as the reference keeps its descriptors: features are nearly all that a series takes on disk.
    """
    arrays = series.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("a")).select("series_id", F.col("a.value").cast("array<double>").alias("v"))
    kind = series.schema["series_id"].dataType
    schema = T.StructType([T.StructField("series_id", kind), T.StructField("kp0", T.IntegerType()), T.StructField("kp1", T.IntegerType()), T.StructField("feature", T.ArrayType(T.FloatType()))])
    weights = _weights(2.0, 4.0)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows, pairs, cut = [], [], []
                for at, v in enumerate(part.column(1)):
                    kp, features = _of_series(v.values, length, dim, number, weights)
                    i, j = np.triu_indices(len(kp), 1)
                    rows.append(np.full(len(i), at))
                    pairs.append(np.stack([kp[i], kp[j]]))
                    cut.append(features(kp[i], kp[j]))
                made, (kp0, kp1), row = np.ma.concatenate(cut), np.concatenate(pairs, 1), np.concatenate(rows)
                flat = pa.array(made.data.ravel().astype(np.float32), mask=np.ma.getmaskarray(made).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(made) + 1, dtype=np.int32) * dim), flat)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(kp0.astype(np.int32)), pa.array(kp1.astype(np.int32)), lists], names=schema.names)

    return arrays.repartition(many_parts(series), "series_id").mapInArrow(run, schema)


def _of_series(v: pa.Array, length: int, dim: int, number: int, weights: list[float]):
    """Keypoints of a series, and a function of pairs of them that cuts their features."""
    plain = v.to_numpy(zero_copy_only=False)
    if not v.null_count and np.isfinite(plain).all():
        even = _even(plain, length)
        return _keypoints(_smoothed(even, weights), length, number), lambda a, b: _features(even, a, b, dim)
    odd = _odd_read(v.to_pylist(), 0, len(v) - 1, length)
    return _odd_keypoints(odd, weights, length, number), lambda a, b: _odd_features(odd, a.tolist(), b.tolist(), dim)


def _weights(sigma: float, truncate: float) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(weights) for w in weights]


def _even(v: np.ndarray, length: int) -> np.ndarray:
    """resample_linear() of one series."""
    return _read(v, np.arange(length) * (len(v) - 1) / float(length), len(v) - 1)


def _read(v: np.ndarray, at: np.ndarray, last, first=0) -> np.ndarray:
    """v at places that need not be whole, counted from first."""
    lo = np.floor(at).astype(np.int64)
    a, b = v[first + lo], v[first + np.minimum(lo + 1, last)]
    return a + (b - a) * (at - lo)


def _smoothed(v: np.ndarray, weights: list[float]) -> np.ndarray:
    """gaussian_smooth() of one series."""
    n, radius = len(v), len(weights) // 2
    m = np.arange(-radius, n + radius) % (2 * n)
    wide = v[np.where(m < n, m, 2 * n - 1 - m)]
    out = np.zeros(n)
    for k, w in enumerate(weights):
        out = out + wide[k : k + n] * w
    return out


def _keypoints(smooth: np.ndarray, length: int, number: int, order: int = 3) -> np.ndarray:
    """keypoints() of local_extrema() of one series, in order."""
    n = len(smooth)
    wide = np.concatenate([np.full(order, smooth[0]), smooth, np.full(order, smooth[-1])])
    around = np.stack([wide[order + k : order + k + n] for k in range(-order, order + 1) if k])
    tops, lows = np.flatnonzero(smooth > around.max(0)), np.flatnonzero(smooth < around.min(0))
    listed = np.concatenate([tops, lows])
    if not len(listed):
        return listed
    if listed[0] > 1:
        listed = np.append(0, listed)
    if listed[-1] < length - 2:
        listed = np.append(listed, length - 1)
    weight = np.abs(smooth[listed] - 0.5)
    weight[[0, -1]] = np.inf
    return np.unique(listed[np.lexsort((listed, -weight))[:number]])


def _features(even: np.ndarray, kp0: np.ndarray, kp1: np.ndarray, dim: int) -> np.ndarray:
    last = (kp1 - kp0)[:, None]
    f = _read(even, np.arange(dim) * last / float(dim), last, kp0[:, None])
    square = np.zeros(len(f))
    for i in range(dim):
        square = square + f[:, i] * f[:, i]
    norm = np.broadcast_to(np.sqrt(square)[:, None], f.shape)
    return np.ma.array(np.divide(f, norm, out=np.zeros(f.shape), where=norm != 0), mask=norm == 0)


def _odd_read(v: list, first: int, last: int, n: int) -> list:
    """_read() at n places between first and last, where values may be null or no finite numbers."""
    out = []
    for i in range(n):
        at = i * (last - first) / float(n)
        a, b = v[first + int(at)], v[first + min(int(at) + 1, last - first)]
        out.append(None if a is None or b is None else a + (b - a) * (at - int(at)))
    return out


def _odd_keypoints(even: list, weights: list[float], length: int, number: int, order: int = 3) -> np.ndarray:
    """_keypoints() by Spark's rules: NaN is the largest number, greatest and least pass over nulls, null is no extremum."""
    n, radius, smooth = len(even), len(weights) // 2, []
    for i in range(n):
        total = 0.0
        for k, w in enumerate(weights):
            m = (i + k - radius) % (2 * n)
            x = even[m if m < n else 2 * n - 1 - m]
            total = None if total is None or x is None else total + x * w
        smooth.append(total)
    rank = [None if x is None else (x != x, 0.0 if x != x else x) for x in smooth]
    tops, lows = [], []
    for i, own in enumerate(rank):
        before = [x if x is not None else rank[0] for x in (rank[i - k] if i >= k else None for k in range(1, order + 1))]
        after = [x if x is not None else rank[-1] for x in (rank[i + k] if i + k < n else None for k in range(1, order + 1))]
        around = [x for x in before + after if x is not None]
        if own is not None and around:
            if own > max(around):
                tops.append(i)
            elif own < min(around):
                lows.append(i)
    listed = tops + lows
    if not listed:
        return np.zeros(0, np.int64)
    listed = [0] * (listed[0] > 1) + listed
    listed += [length - 1] * (listed[-1] < length - 2)
    forced = {0, len(listed) - 1}
    weighed = [(float("inf") if at in forced else abs(smooth[p] - 0.5), p) for at, p in enumerate(listed)]
    weighed.sort(key=lambda x: (x[0] == x[0], 0.0 if x[0] != x[0] else -x[0], x[1]))
    return np.unique(np.array([p for _, p in weighed[:number]], np.int64))


def _odd_features(even: list, kp0: list[int], kp1: list[int], dim: int) -> np.ma.MaskedArray:
    out = np.ma.array(np.zeros((len(kp0), dim)), mask=np.zeros((len(kp0), dim), bool))
    for row, (a, b) in enumerate(zip(kp0, kp1, strict=True)):
        f, square = _odd_read(even, a, b, dim), 0.0
        for x in f:
            square = None if square is None or x is None else square + x * x
        norm = square and math.sqrt(square)
        for i, x in enumerate(f):
            out[row, i] = np.ma.masked if x is None or not norm else x / norm
    return out


def _descriptors_by_rows(series: DataFrame, length: int, dim: int, number: int) -> DataFrame:
    even = resample_linear(series, length).select("series_id", F.col("i").alias("pos"), "value")
    smooth = gaussian_smooth(even)
    pairs = keypoint_pairs(keypoints(local_extrema(smooth), smooth, length, number))
    arrays = even.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("a")).select("series_id", F.col("a.value").alias("v"))
    cut = pairs.join(arrays, "series_id").select("series_id", "kp0", "kp1", F.slice("v", F.col("kp0") + 1, F.col("kp1") - F.col("kp0") + 1).alias("c"))
    last = F.size("c") - 1

    def read(i: Column) -> Column:
        at = i * last / F.lit(float(dim))
        lo = F.floor(at).cast("int")
        a, b = F.get("c", lo), F.get("c", F.least(lo + 1, last))
        return a + (b - a) * (at - lo)

    f = cut.select("series_id", "kp0", "kp1", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), read).alias("f"))
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x))
    return f.select("series_id", "kp0", "kp1", F.transform("f", lambda x: F.try_divide(x, norm)).cast("array<float>").alias("feature"))
