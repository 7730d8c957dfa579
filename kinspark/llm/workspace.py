"""Intermediate tables in the shared folder: written once, read by later jobs, dropped when no longer needed."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from kinspark.llm.common import ensure_checkpoint_dir


#: Bytes of an Arrow batch that goes to a Python worker while an intermediate table is written.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def _modest_batches(spark: SparkSession):
    """Batches bounded by bytes, so their memory does not follow the length of texts; the session's own bound is put back."""
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before) if before is not None else spark.conf.unset(_SETTING)


def bound_batches(spark: SparkSession) -> None:
    """The same bound for all that the session runs from now on, unless it has one of its own."""
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, str(BATCH_BYTES))


class Workspace:
    """Tables of one operator's run. What its result still reads lives until the driver's end, all else until it is dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kinspark-{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.live: list[str] = []
        atexit.register(self.clear)

    def save(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and read it again: cuts the lineage."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}"
        with _modest_batches(self.spark):
            df.write.parquet(path)
        self.live.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.saved_at = path
        return out

    def result(self, df: DataFrame) -> DataFrame:
        """save(), and drop all other tables."""
        out = self.save(df)
        for path in self.live[:-1]:
            self._delete(path)
        self.live = [out.saved_at]
        return out

    def drop(self, *saved: DataFrame) -> None:
        for df in saved:
            if df.saved_at in self.live:
                self.live.remove(df.saved_at)
                self._delete(df.saved_at)

    def clear(self) -> None:
        """Delete what is left, if the session still lives."""
        with contextlib.suppress(Exception):
            self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
