"""Principal components of scaled vectors, without a dimensions x dimensions matrix on one machine.

Three ways, by the shape of the data, to the same components:

- few dimensions (DIMS): the covariance, summed over tasks, and its eigenvectors;
- few rows (ROWS_MOST): the dual form. The rows x rows matrix of products is summed over blocks of dimensions; its
  eigenvectors U and the data give the axes, S'U/s, which are never stored: a product with them is a pass over the rows;
- else: a randomised range finder. A seeded random basis of (components + OVER) axes goes through POWERS rounds of one
  pass each (every task sums S'(S Q) of its rows) with an orthonormalisation between, and the eigenvectors of the small
  projected matrix turn it into the axes. The basis has SKETCH_BYTES at most; more components are refused.

An axis points so that its largest loading is positive (of equal ones the first), so fits agree.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.operators import matrices as mx

#: Dimensions up to which the covariance is formed, rows up to which the dual is, bytes of the random basis.
DIMS, ROWS_MOST, SKETCH_BYTES = 2048, 4096, 256 << 20
#: Additional axes of the random basis, rounds of the range finder, bytes of a block of dimensions in the dual form.
OVER, POWERS, BLOCK_BYTES = 16, 6, 32 << 20


@dataclass(frozen=True)
class PopulationScaler:
    """Means and population deviations of each dimension; a dimension without spread keeps its centred values."""

    mean: np.ndarray
    std: np.ndarray
    rows: int = 0

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> PopulationScaler:
        """One pass; null vectors do not count."""
        from pyspark.ml.functions import array_to_vector
        from pyspark.ml.stat import Summarizer

        known = df.filter(F.col(column).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
        s = known.groupBy(F.lit(1)).agg(Summarizer.metrics("mean", "variance", "count").summary(F.col("v")).alias("s")).select("s.*").first()
        if s is None:
            raise ValueError("no vectors to scale by")
        n = s["count"]
        std = np.sqrt(s["variance"].toArray() * (n - 1) / n)  # the variance is that of a sample
        return cls(s["mean"].toArray(), np.where(std > 0, std, 1.0), n)

    def scaled(self, v: np.ndarray) -> np.ndarray:
        return (v - self.mean) / self.std

    def transform(self, df: DataFrame, column: str, out: str) -> DataFrame:
        return mx.appended(df, column, out, self, PopulationScaler.scaled)


@dataclass(frozen=True)
class PrincipalAxes:
    """variances of the components, the largest first, and fold(weights): weights (rows by components) times the axes."""

    scaler: PopulationScaler
    variances: np.ndarray
    fold: Callable[[np.ndarray], np.ndarray]

    def project(self, df: DataFrame, column: str, out: str, part_bytes: int = 128 << 20) -> DataFrame:
        """df with the scores of column on all components. The axes are broadcast, in parts of part_bytes, one Python stage each."""
        k, d = len(self.variances), len(self.scaler.mean)
        step = max(1, part_bytes // (8 * max(1, d)))
        starts = list(range(0, k, step)) or [0]
        for i, a in enumerate(starts):
            w = self.fold(np.eye(k)[a : a + step]) / self.scaler.std
            df = mx.appended(df, column, f"__scores{i}" if len(starts) > 1 else out, (w, w @ self.scaler.mean), lambda x, v: v @ x[0].T - x[1])
        if len(starts) == 1:
            return df
        names = [f"__scores{i}" for i in range(len(starts))]
        return df.withColumn(out, F.concat(*names)).drop(*names)


def _signs(axes: np.ndarray) -> np.ndarray:
    return np.where(np.take_along_axis(axes, np.abs(axes).argmax(1)[:, None], 1)[:, 0] < 0, -1.0, 1.0)


def principal_axes(df: DataFrame, column: str, components: int, seed: int = 42, way: str | None = None) -> PrincipalAxes:
    """The components of the scaled column, as many as asked for or as rows and dimensions allow. df is read two to POWERS + 2 times.

    way: covariance, dual or random; by default from the shape.
    """
    known = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("array<double>").alias("v"))
    scaler = PopulationScaler.fit(known, "v")
    k = min(components, scaler.rows, len(scaler.mean))
    way = way or ("covariance" if len(scaler.mean) <= DIMS else "dual" if scaler.rows <= ROWS_MOST else "random")
    return {"covariance": _by_covariance, "dual": _by_dual, "random": _by_random}[way](known, scaler, k, seed)


def _ready(scaler: PopulationScaler, variances: np.ndarray, axes: np.ndarray) -> PrincipalAxes:
    axes = axes * _signs(axes)[:, None] if len(axes) else axes
    return PrincipalAxes(scaler, np.maximum(variances, 0.0), lambda w: w @ axes)


def _by_covariance(df: DataFrame, scaler: PopulationScaler, k: int, seed: int) -> PrincipalAxes:
    shared, d = df.sparkSession.sparkContext.broadcast(scaler), len(scaler.mean)

    def run(batches):
        acc = np.zeros((d, d))
        for _, v in mx.matrices(batches):
            s = shared.value.scaled(v)
            acc += s.T @ s
        return acc

    values, vectors = np.linalg.eigh(mx.total(df, run).reshape(d, d) / scaler.rows)
    return _ready(scaler, values[::-1][:k], vectors.T[::-1][:k])


def _by_random(df: DataFrame, scaler: PopulationScaler, k: int, seed: int) -> PrincipalAxes:
    d = len(scaler.mean)
    wide = min(k + OVER, d, scaler.rows)
    if 8 * d * wide > SKETCH_BYTES:
        raise ValueError(f"{k} components of {d} dimensions need a basis of more than {SKETCH_BYTES} bytes")
    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
    for left in range(POWERS, -1, -1):
        shared = df.sparkSession.sparkContext.broadcast((scaler, basis))

        def run(batches):
            scaler, basis = shared.value
            acc = np.zeros(basis.shape)
            for _, v in mx.matrices(batches, rows=max(16, min(mx.ROWS, mx.BATCH_BYTES // (8 * d)))):
                s = scaler.scaled(v)
                acc += s.T @ (s @ basis)
            return acc

        image = mx.total(df, run).reshape(d, wide) / scaler.rows
        shared.unpersist()
        if left:
            basis = np.linalg.qr(image)[0]
    small = basis.T @ image  # the covariance in the basis
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return _ready(scaler, values[::-1][:k], (basis @ vectors[:, ::-1][:, :k]).T)


def _by_dual(df: DataFrame, scaler: PopulationScaler, k: int, seed: int) -> PrincipalAxes:
    """Rows go in the order of their hashes; equal hashes are equal vectors, so their order among themselves does not matter."""
    spark, n, d = df.sparkSession, scaler.rows, len(scaler.mean)
    width = int(max(64, min(d, BLOCK_BYTES // (8 * n))))
    starts = F.sequence(F.lit(0), F.lit(d - 1), F.lit(width))
    cut = df.select(F.xxhash64("v").alias("row"), F.posexplode(F.transform(starts, lambda s: F.slice("v", s + 1, F.lit(width)))).alias("block", "part"))

    def block(table: pa.Table) -> tuple[int, np.ndarray]:
        """(first dimension, scaled rows in order) of a group."""
        scaler, at = shared.value, table.column("block")[0].as_py() * width
        part = table.sort_by("row").column("part").combine_chunks()
        end = min(at + width, d)
        return at, (mx.matrix(part) - scaler.mean[at:end]) / scaler.std[at:end]

    def products(table: pa.Table) -> pa.Table:
        _, s = block(table)
        return pa.Table.from_batches([mx._slots((s @ s.T).ravel())])

    def summed(batches):
        acc = np.zeros(0)
        for batch in batches:
            for slot, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not len(acc):
                    acc = np.zeros(n * n)
                x = values.values.to_numpy(zero_copy_only=False)
                acc[slot * mx.SLOT : slot * mx.SLOT + len(x)] += x
        return acc if len(acc) else None

    shared = spark.sparkContext.broadcast(scaler)
    with mx.modest_batches(spark):
        gram = mx.total(cut.groupBy("block").applyInArrow(products, mx._DDL), summed).reshape(n, n)
    values, u = np.linalg.eigh(gram)
    values, u = values[::-1][:k], u[:, ::-1][:, :k]
    lengths = np.sqrt(np.maximum(values, 0.0))
    turned = u / np.where(lengths > 1e-9 * lengths[:1].max(initial=0.0), lengths, np.inf)  # a component without variance has no axis

    def product(left: np.ndarray, digest: bool = False) -> np.ndarray:
        """left (rows by n) times the scaled rows, block by block; of digest for each row and block the largest entry."""
        sent = spark.sparkContext.broadcast(left)

        def run(table: pa.Table) -> pa.Table:
            at, s = block(table)
            made = sent.value @ s
            if digest:
                made = np.take_along_axis(made, np.abs(made).argmax(1)[:, None], 1)
            return pa.table([[at], pa.ListArray.from_arrays(pa.array([0, made.size], pa.int32()), pa.array(made.ravel()))], schema=mx._PARTS)

        with mx.modest_batches(spark):
            found = cut.groupBy("block").applyInArrow(run, mx._DDL).toArrow().sort_by("slot").column("values").combine_chunks()
        return np.concatenate([v.values.to_numpy(zero_copy_only=False).reshape(len(left), -1) for v in found], axis=1)

    signs = _signs(product(np.ascontiguousarray(turned.T), digest=True))
    return PrincipalAxes(scaler, np.maximum(values, 0.0) / n, lambda w: product(w @ (turned * signs).T))
