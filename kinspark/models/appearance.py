"""Identification by appearance: scaled features, principal components, a linear classifier, ranked probabilities.

Features come as a table (image_id, vec), a null vector where a picture could not be read. Fitted, the three steps are
folded into one matrix, which is all a model holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.operators import evaluation as ev
from kinspark.operators.features import LinearHead, linear_classifier
from kinspark.operators.matrices import matrix
from kinspark.sources.scans import not_done
from kinspark.sources.sinks import read_record, write_record

#: Name that a prediction of an unknown class has.
UNKNOWN = "UNKNOWN"


def cached_features(images: DataFrame, extract: Callable[[list[bytes]], list], folder: str, key: str = "path", force: bool = False) -> DataFrame:
    """(key, vec) of images (key, content): read from the cache in folder, or extracted in batches and added to it.

    extract gets the contents of a batch and gives a list of numbers for each, None for one it cannot read; such an
    image has a row with a null vector and is not tried again unless force.
    """
    spark = images.sparkSession
    schema = f"`{key}` string, vec array<float>"
    done = None if force else _cached(spark, folder, schema)
    todo = images if done is None else not_done(images, done, key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "vec": extract(list(pdf["content"]))})

    todo.select(F.col(key).cast("string").alias(key), "content").mapInPandas(run, schema).write.mode("overwrite" if force else "append").parquet(folder)
    return spark.read.schema(schema).parquet(folder).join(images.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")


def _cached(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(schema).parquet(folder)


@dataclass(frozen=True)
class AppearanceIdentifier:
    """Settings: the layer and pool that features were taken with (for the record), principal components, most steps of
    the classifier, seed of the folds that its probabilities are calibrated on."""

    layer: str = "conv3_block4_2_relu"
    pool: int = 6
    components: int = 10000
    iterations: int = 50
    seed: int = 42

    def fit(self, train: DataFrame, classes: DataFrame) -> AppearanceModel:
        """A model of train (image_id, name, vec); classes: (name, class_idx) from 0. A row without a vector is an error."""
        rows = train.join(classes.select("name", "class_idx"), "name").cache()
        try:
            n = train.agg(F.count(F.lit(1)).alias("n"), F.count("vec").alias("known")).first()
            if n.n != n.known or n.n != rows.count():
                raise ValueError(f"{n.n} rows to train with, {n.known} with features, {rows.count()} with a class")
            head = linear_classifier(rows, "vec", "class_idx", self.iterations, self.components, self.seed)
        finally:
            rows.unpersist()
        names = [r["name"] for r in sorted(classes.collect(), key=lambda r: r.class_idx)]  # as large as the model
        return AppearanceModel(self, head, names)


@dataclass(frozen=True)
class AppearanceModel:
    settings: AppearanceIdentifier
    head: LinearHead
    names: list[str]

    def save(self, spark: SparkSession, folder: str) -> None:
        weights, c = self.head.weights, len(self.names)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(c + 1, dtype=np.int32) * weights.shape[1]), pa.array(weights.ravel()))
        classes = pa.table({"class_idx": pa.array(range(c), pa.int32()), "name": pa.array(self.names, pa.string()), "weights": lists, "intercept": self.head.intercepts})
        spark.createDataFrame(classes).write.mode("overwrite").parquet(f"{folder}/classes")
        i, j = np.triu_indices(c if self.head.sigmoids else 0, 1)
        a, b = (m[i, j] for m in self.head.sigmoids or np.zeros((2, 0, 0)))
        spark.createDataFrame(pa.table({"i": i.astype(np.int32), "j": j.astype(np.int32), "a": a, "b": b})).write.mode("overwrite").parquet(f"{folder}/pairs")
        write_record(spark, f"{folder}/settings", {"kind": "appearance", **self.settings.__dict__})

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> AppearanceModel:
        record = read_record(spark, f"{folder}/settings")
        if record.pop("kind", None) != "appearance":
            raise ValueError(f"no appearance model in {folder}")
        rows = spark.read.parquet(f"{folder}/classes").toArrow().sort_by("class_idx")
        pairs = spark.read.parquet(f"{folder}/pairs").toArrow()
        c, sigmoids = rows.num_rows, None
        if pairs.num_rows:
            i, j, x, y = (pairs.column(n).to_numpy() for n in ("i", "j", "a", "b"))
            sigmoids = np.zeros((c, c)), np.zeros((c, c))
            sigmoids[0][i, j] = sigmoids[0][j, i] = x
            sigmoids[1][i, j], sigmoids[1][j, i] = y, -y
        head = LinearHead(matrix(rows.column("weights").combine_chunks()), rows.column("intercept").to_numpy(), sigmoids)
        return cls(AppearanceIdentifier(**record), head, rows.column("name").to_pylist())

    def summary(self) -> str:
        s = self.settings
        return f"AppearanceModel(layer={s.layer}, pool={s.pool}, components={s.components}, classes={len(self.names)}, dimensions={self.head.weights.shape[1]})"

    def classes(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.names)), "class_idx int, name string")

    def predict(self, features: DataFrame, top: int | None = None, id_col: str = "image_id", column: str = "vec") -> DataFrame:
        """(id_col, name, p, rank), the most probable first; a null vector has no rows."""
        p = self.head.probabilities(features, column, id_col)
        p = p if top is None else p.filter(F.col("rank") <= top)
        named = p.join(self.classes(features.sparkSession), "class_idx", "left")  # the names' size is known, so Spark broadcasts them where they are few
        return named.select(id_col, F.coalesce("name", F.lit(UNKNOWN)).alias("name"), "p", "rank")

    def evaluate(self, test: DataFrame, ks: list[int], id_col: str = "image_id", column: str = "vec") -> DataFrame:
        """(k, correct, total, accuracy) over all rows of test (id_col, name, vec); a name that the model does not know
        counts as wrong, a k beyond the classes is left out."""
        found = self.predict(test, None, id_col, column)
        ranks = test.select(id_col, F.col("name").cast("string").alias("name")).join(found.select(id_col, "name", "rank"), [id_col, "name"], "left")
        return ev.topk_accuracy(ranks, ks, len(self.names))
