"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text after which an Arrow operator hands a batch back, so memory does not follow the input batch.
ROWS_OUT, BYTES_OUT = 2000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; on one machine, where none is set, a folder of our own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="kinspark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def thin(run: Callable) -> Callable:
    """run, an Arrow operator, giving what it has freed back to the system: Python workers live on and serve other stages."""

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
                ctypes.CDLL(None).malloc_trim(0)

    return lean


def slices_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[list, ...]]:
    """Columns of an Arrow batch as lists, a slice at a time."""
    for start in range(0, batch.num_rows, ROWS_OUT):
        part = batch.slice(start, ROWS_OUT)
        yield tuple(part.column(part.schema.get_field_index(n)).to_pylist() for n in names)


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows of an Arrow batch as tuples, a slice at a time."""
    for columns in slices_of(batch, *names):
        yield from zip(*columns, strict=True)


def arrow_rows(rows: Iterable[tuple], schema: pa.Schema, weigh: Callable[[tuple], int] = lambda r: 64) -> Iterator[pa.RecordBatch]:
    """Collect rows into record batches of bounded size."""
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if len(held) >= ROWS_OUT or weight >= BYTES_OUT:
            yield _batch(held, schema)
            held, weight = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
