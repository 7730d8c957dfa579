"""Matrix work over the rows of a table: columns of vectors as matrices, and sums over all tasks.

A sum is made in the tasks (one array each), cut into slots, and added up slot by slot in two levels, so no task gets the
arrays of all others at once and the driver gets each slot once. Batches that go to Python are bounded by bytes while a
sum is made: a batch of ten thousand wide vectors would not fit.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Doubles of a slot; tasks whose slots are added up together in the first level; rows of a matrix taken from a batch.
SLOT, FAN, ROWS = 8192, 32, 1024
#: Bytes of a batch on its way to Python, and of all tasks' arrays that the driver may add up itself.
BATCH_BYTES, FEW_BYTES = 32 << 20, 32 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_PARTS = pa.schema([("slot", pa.int32()), ("values", pa.list_(pa.float64()))])
_DDL = "slot int, values array<double>"


@contextlib.contextmanager
def modest_batches(spark: SparkSession):
    """Batches bounded by bytes for what runs inside; the session's own bound is put back."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before) if before is not None else spark.conf.unset(_SETTING)


def matrix(column: pa.ListArray) -> np.ndarray:
    """A column of vectors of one length, without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def matrices(batches: Iterator[pa.RecordBatch], at: int = 0, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches, each with its at-th column as a matrix."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, matrix(part.column(at))


def _slots(values: np.ndarray) -> pa.RecordBatch:
    cut = [values[s : s + SLOT] for s in range(0, len(values), SLOT)]
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(c) for c in cut])).astype(np.int32)), pa.array(values))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), lists], schema=_PARTS)


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(0)
    for chunk in table.column("values").chunks:
        for v in chunk:
            x = v.values.to_numpy(zero_copy_only=False)
            total = total + x if len(total) else x.copy()
    return pa.table([table.column("slot").slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))], schema=_PARTS)


def total(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int = 0, tasks: int = 0) -> np.ndarray:
    """The sum over all tasks of the arrays that run makes of the rows of each (None: no rows); empty if there were none.

    Where it is known that so few tasks make arrays of so few doubles that FEW_BYTES hold all of them, the driver adds them up.
    """

    def parts(batches):
        made = run(batches)
        if made is not None:
            yield _slots(np.ravel(made))

    with modest_batches(df.sparkSession):
        cut = df.mapInArrow(parts, _DDL)
        if 0 < 8 * size * tasks <= FEW_BYTES:
            acc = np.zeros(size)
            found = cut.toArrow()
            for slot, v in zip(found.column("slot").to_pylist(), (v for c in found.column("values").chunks for v in c), strict=True):
                x = v.values.to_numpy(zero_copy_only=False)
                acc[slot * SLOT : slot * SLOT + len(x)] += x
            return acc if found.num_rows else np.zeros(0)
        cut = cut.withColumn("few", F.floor(F.spark_partition_id() / FAN))
        found = cut.groupBy("slot", "few").applyInArrow(_add, _DDL).groupBy("slot").applyInArrow(_add, _DDL).toArrow().sort_by("slot")
    return np.concatenate([v.values.to_numpy(zero_copy_only=False) for v in found.column("values").combine_chunks()] or [np.zeros(0)])


def appended(df: DataFrame, column: str, out: str, value, make: Callable[[object, np.ndarray], np.ndarray]) -> DataFrame:
    """df with `out`, an array of doubles: make(value, matrix of column). value is broadcast; a null vector gives null."""
    shared = df.sparkSession.sparkContext.broadcast(value)
    names = [c for c in df.columns if c != out]
    fields = [df.schema[c] for c in names]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                v = part.column(len(names))
                known = v.is_valid().to_numpy(zero_copy_only=False)
                made = make(shared.value, matrix(v.filter(pa.array(known)))) if known.any() else np.zeros((0, 0))
                ends = np.append(0, np.cumsum(known * made.shape[1])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(made).ravel()), mask=pa.array(~known))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), lists], names=[*names, out])

    picked = df.select(*(f"`{c}`" for c in names), F.col(column).cast("array<double>").alias("__vector"))
    return picked.mapInArrow(run, T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
