"""Hyper-parameter grid of the appearance classifier: models that are there are read, others fitted and kept."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.functions.names import layer_size, model_name
from kinspark.models.appearance import AppearanceIdentifier, AppearanceModel
from kinspark.operators import evaluation as ev
from kinspark.operators.features import config_grid

# The layers, pools and components of the tuning grid.
LAYERS = ["conv3_block4_2_relu", "conv4_block6_out", "conv5_block1_out"]
POOLS = [2, 4, 6, 7, 8, 10]
COMPONENTS = [10000]


@dataclass(frozen=True)
class Data:
    """What a model's name tells of the data it was fitted on."""

    ratio: float = 0.67
    least: int = 9
    rembg: bool = True


def grid(spark: SparkSession, layers: list[str] = LAYERS, pools: list[int] = POOLS, components: list[int] = COMPONENTS, data: Data = Data()) -> DataFrame:
    """(layer, spatial, pool, components, model) of all valid configurations."""
    rows = config_grid(spark.createDataFrame([(x,) for x in layers], "layer string"), pools).withColumn("components", F.explode(F.array(*map(F.lit, components))))
    name = model_name(F.lit(data.ratio), F.lit(data.rembg), F.lit(data.least), F.col("layer"), F.col("pool"), F.col("components"))
    return rows.withColumn("model", name)


def asked_for(requests: DataFrame, data: Data = Data()) -> DataFrame:
    """requests (layer, pool, components, other columns) that are valid, each with `spatial` and the `model` that serves it."""
    rows = requests.withColumn("spatial", layer_size(F.col("layer"))).filter("pool <= spatial")
    return rows.withColumn("model", model_name(F.lit(data.ratio), F.lit(data.rembg), F.lit(data.least), F.col("layer"), F.col("pool"), F.col("components")))


def tune(features: Callable[[str, int], tuple[DataFrame, DataFrame]], classes: DataFrame, folder: str, ks: list[int], configurations: DataFrame, iterations: int = 50) -> DataFrame:
    """(config, k, accuracy) of every configuration; features gives (train, test) for a layer and a pool.

    The grid is a handful of rows; each configuration is one distributed fit and one evaluation.
    """
    spark = classes.sparkSession
    out = None
    for c in configurations.orderBy("model").collect():
        train, test = features(c.layer, c.pool)
        path = f"{folder}/{c.model}"
        model = _saved(spark, path)
        if model is None:
            model = AppearanceIdentifier(c.layer, c.pool, c.components, iterations).fit(train, classes)
            model.save(spark, path)
        rows = model.evaluate(test, ks).select(F.lit(c.model).alias("config"), "k", "accuracy")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "config string, k int, accuracy double")


def _saved(spark: SparkSession, folder: str) -> AppearanceModel | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/settings")
    return AppearanceModel.load(spark, folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def results(measured: DataFrame, ks: list[int]) -> DataFrame:
    """One row a configuration, a column for each k."""
    return ev.results_table(measured, ks)
