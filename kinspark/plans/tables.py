"""The driver's tables in the roles of the engine's inputs."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; on one machine, where none is set, a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="kinspark-")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted at the driver's end if the session then still lives."""
    folder = f"{shared_folder(spark)}/kinspark-{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        with contextlib.suppress(Exception):
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(clear)
    return folder


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as descriptors: label is the individual; view, scale and image come from the id; a fifth of all are queries."""
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("desc_id"), F.col("embedding").alias("vec"), F.col("label").cast("string").alias("name"), (v % 2).cast("int").alias("view"),
        (F.floor(v / 2) % 4).cast("int").alias("scale_idx"), F.floor(v / 40).alias("image_id"), (v % 5 == 0).alias("is_query"),
    )


def queries_and_database(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = descriptors(spark, sf_dir)
    q = d.filter("is_query").select(F.col("desc_id").alias("query_id"), F.col("vec").alias("query_vec"), F.col("name").alias("truth"), "view", "scale_idx", "image_id")
    return q, d.filter("not is_query").select("desc_id", "vec", "name", "view", "scale_idx")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as labelled images."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("individual"), F.col("o_orderkey").alias("filepath"), F.col("o_orderstatus").alias("view"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as detections of an order's image. Line numbers repeat within an order, so part, supplier and quantity make the index unique up to equal boxes."""
    x, y = F.col("l_partkey") % 100, F.col("l_suppkey") % 100
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("image_id"), (((F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey")) * 100000 + F.col("l_suppkey")) * 100 + F.col("l_quantity").cast("long")).alias("det_idx"), (11 + F.col("l_linenumber") % 6).alias("version"),
        (1.0 - 5 * F.col("l_discount")).alias("confidence"), (F.col("l_quantity") * (1 + F.col("l_tax"))).alias("area"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + 20 + F.col("l_quantity")).alias("x2"), (y + 30 + F.col("l_quantity")).alias("y2"),
    )


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as points of a user's contour: position in time and value.

    The window is over the column that goes on, so Spark knows that a contour's points lie together and does not shuffle
    them again for what comes by contour.
    """
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("contour_id"), "ts", "event_id", F.col("value").alias("y"))
    rn = F.row_number().over(Window.partitionBy("contour_id").orderBy("ts", "event_id")) - 1
    return events.select("contour_id", rn.cast("int").alias("pos"), rn.cast("double").alias("x"), "y")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polylines(spark, sf_dir).select(F.col("contour_id").alias("series_id"), "pos", F.col("y").alias("value"))
