"""Feature scaling, projection and linear classification."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions.names import layer_size
from kinspark.operators.matrices import matrices
from kinspark.operators.pairwise import FOLDS, class_vectors, coupled, coupled_rows, held_out_scores, ranked, sigmoids
from kinspark.operators.principal import PopulationScaler, PrincipalAxes, principal_axes

#: Size up to which a matrix of weights is broadcast; bytes of features that a task of a fit takes.
HEAD_BYTES, TASK_BYTES = 128 << 20, 64 << 20


def pca(df: DataFrame, column: str, components: int, out: str = "projected", seed: int = 42) -> DataFrame:
    """df with the scores on the principal components of the scaled column, as many as rows and dimensions allow."""
    return principal_axes(df, column, components, seed).project(df, column, out)


@dataclass(frozen=True)
class LinearHead:
    """Margins of classes as one matrix: weights (classes by dimensions of the raw vector) and an intercept for each class.

    sigmoids: matrices (A, B) of pairs of classes, for probabilities by pairwise coupling.
    """

    weights: np.ndarray
    intercepts: np.ndarray
    sigmoids: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def folded(cls, scaler: PopulationScaler, weights: np.ndarray, intercepts: np.ndarray, axes: PrincipalAxes | None = None, sigmoids: tuple[np.ndarray, np.ndarray] | None = None) -> LinearHead:
        """Scaling, projection and classifier as one step."""
        w = (weights if axes is None else axes.fold(weights)) / scaler.std
        return cls(w, intercepts - w @ scaler.mean, sigmoids)

    def probabilities(self, df: DataFrame, column: str, id_col: str) -> DataFrame:
        """(id_col, class_idx, p, rank) of each row and class: coupled pairs, without sigmoids the softmax of the margins;
        ties to the smaller class.

        A null vector gives no rows. The matrix is broadcast up to HEAD_BYTES; beyond, its classes are taken in parts,
        a pass over df for each.
        """
        rows = max(1, HEAD_BYTES // max(1, 8 * self.weights.shape[1]))
        parts = [self._margins(df, column, id_col, a, min(a + rows, len(self.weights))) for a in range(0, len(self.weights), rows)]
        margins = functools.reduce(DataFrame.unionByName, parts)
        if len(parts) == 1:
            return margins
        if self.sigmoids is not None:
            scores = margins.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("class_idx", "p"))).alias("s"))
            return coupled_rows(scores.select(id_col, F.col("s.p").alias("scores")), id_col, *self.sigmoids)
        w = Window.partitionBy(id_col)
        e = margins.withColumn("e", F.exp(F.col("p") - F.max("p").over(w)))
        p = e.select(id_col, "class_idx", (F.col("e") / F.sum("e").over(w)).alias("p"))
        return p.withColumn("rank", F.row_number().over(w.orderBy(F.desc("p"), "class_idx")))

    def _margins(self, df: DataFrame, column: str, id_col: str, first: int, last: int) -> DataFrame:
        """Of a part of the classes margins in the place of p; of all of them the result."""
        whole = last - first == len(self.weights)
        shared = df.sparkSession.sparkContext.broadcast((self.weights[first:last], self.intercepts[first:last], self.sigmoids if whole else None))
        names = [id_col, "class_idx", "p", "rank"] if whole else [id_col, "class_idx", "p"]

        def run(batches):
            weights, intercepts, sigmoids = shared.value
            for part, v in matrices(batches, at=1):
                m = v @ weights.T + intercepts
                if not whole:
                    each = pa.array(np.repeat(np.arange(len(m)), m.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(each), pa.array(np.tile(np.arange(first, last, dtype=np.int32), len(m))), pa.array(m.ravel())], names=names)
                    continue
                if sigmoids is None:
                    e = np.exp(m - m.max(1, keepdims=True))
                    m = e / e.sum(1, keepdims=True)
                else:
                    m = coupled(m, *sigmoids)
                yield ranked(part.column(0), m, names)

        kind = dict(df.dtypes)[id_col]
        ddl = f"`{id_col}` {kind}, class_idx int, p double" + (", rank int" if whole else "")
        return df.filter(F.col(column).isNotNull()).select(id_col, F.col(column).cast("array<double>").alias("v")).mapInArrow(run, ddl)


def linear_classifier(train: DataFrame, column: str, label: str, iterations: int = 50, components: int | None = None, seed: int = 42, folds: int = FOLDS) -> LinearHead:
    """A linear support vector classifier on scaled and, with `components`, projected features; classes are 0, 1, ...

    Its probabilities are calibrated on scores of rows held out in folds, which a hash of seed and vector deals; with
    folds = 0 they are the softmax of the margins. Of train a null vector teaches nothing.
    """
    known = train.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"), F.col(label).cast("int").alias("class_idx"))
    axes = None if components is None else principal_axes(known, "v", components, seed)
    scaler = PopulationScaler.fit(known, "v") if axes is None else axes.scaler
    dims = len(scaler.mean) if axes is None else len(axes.variances)
    ready = scaler.transform(known, "v", "features") if axes is None else axes.project(known, "v", "features")
    fold = F.pmod(F.xxhash64(F.lit(seed), "v"), F.lit(max(1, folds))).cast("int")
    tasks = max(1, -(-8 * scaler.rows * dims // TASK_BYTES))
    rows = ready.select("features", "class_idx", fold.alias("fold")).coalesce(tasks).persist()
    try:
        classes = (rows.agg(F.max("class_idx").alias("c")).first().c or 0) + 1
        own, *without = class_vectors(rows, classes, dims, iterations, folds, tasks)
        pairs = None
        if folds and classes > 1:
            scores = held_out_scores(rows, without).persist()
            pairs = sigmoids(scores, classes, tasks)
            scores.unpersist()
    finally:
        rows.unpersist()
    return LinearHead.folded(scaler, own[:, :-1], own[:, -1], axes, pairs)


def one_vs_rest_classifier(train: DataFrame, column: str, label: str, iterations: int = 20) -> LinearHead:
    """Spark's linear support vector machine of each class against the rest, on scaled features, with the softmax of its
    margins: a fit for each class, so for few classes."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.functions import array_to_vector

    scaler = PopulationScaler.fit(train, column)
    rows = scaler.transform(train, column, "__scaled").select(array_to_vector("__scaled").alias("features"), F.col(label).cast("double").alias("label"))
    models = OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.01), parallelism=4).fit(rows).models
    return LinearHead.folded(scaler, np.array([m.coefficients.toArray() for m in models]), np.array([m.intercept for m in models]))


def centroid_classifier(train: DataFrame, column: str, label: str) -> LinearHead:
    """The linear classifier of the nearest class mean: weights are the means, intercepts half their squared lengths below 0."""
    sums = train.select(F.col(label).alias("c"), F.posexplode(F.col(column).cast("array<double>")).alias("dim", "x")).groupBy("c", "dim").agg(F.avg("x").alias("m"))
    means: dict[int, dict[int, float]] = {}
    for r in sums.collect():  # classes by dimensions, as large as the model
        means.setdefault(r.c, {})[r.dim] = r.m
    dims = max(map(len, means.values()), default=0)
    weights = np.array([[means.get(c, {}).get(d, 0.0) for d in range(dims)] for c in range(max(means, default=-1) + 1)])
    return LinearHead(weights, -(weights**2).sum(1) / 2)


def config_grid(layers: DataFrame, pools: list[int]) -> DataFrame:
    """(layer, spatial, pool) of all combinations whose pool is not larger than the layer's output. layers: (layer)."""
    rows = layers.select("layer", layer_size(F.col("layer")).alias("spatial"), F.explode(F.array(*map(F.lit, pools))).alias("pool"))
    return rows.filter("pool <= spatial")
