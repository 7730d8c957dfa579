"""Identification by contours: descriptors of curvature, a database by view and scale, LNBNN scores.

A contour is a picture of one ear: (image_id, view, pos, x, y), image_id a number. What a fitted model holds is an index
of descriptors, kept by view, scale and cell, and a JSON record of its settings; of the descriptors nothing is in the
driver's memory.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark.operators import evaluation as ev
from kinspark.operators import matching as mt
from kinspark.operators import signal as sg
from kinspark.operators.ann import AnnIndex
from kinspark.operators.curvature import SCALES, integral_curvature
from kinspark.sources.sinks import read_record, write_record

VIEWS = ("left", "right")
#: What a descriptor is searched among, and neighbours that the index is set for.
KEYS, INDEXED = ["view", "scale_idx"], 3


@dataclass(frozen=True)
class ContourIdentifier:
    """Settings of the descriptors: scales of the curvature, its resampled length, dimensions of a descriptor, keypoints."""

    scales: tuple[float, ...] = SCALES
    length: int = 1024
    dim: int = 32
    number: int = 32

    def describe(self, contours: DataFrame) -> DataFrame:
        """(image_id, view, scale_idx, desc_id, vec) of contours; pictures with another view, or without extrema, give none.

        desc_id numbers the descriptors of all pictures alike: image, scale and pair of keypoints make it.
        """
        known = contours.filter(F.col("view").isin(*VIEWS))
        views = known.groupBy("image_id").agg(F.min("view").alias("view"))
        curves = integral_curvature(known.select(F.col("image_id").cast("long").alias("contour_id"), F.col("pos").cast("int").alias("pos"), "x", "y"), self.scales)
        series = curves.select((F.col("contour_id") * len(self.scales) + F.col("scale_idx")).alias("series_id"), "pos", F.coalesce("curv", F.lit(0.5)).alias("value"))
        found = sg.descriptors(series, self.length, self.dim, self.number)
        one = found.select(
            F.floor(F.col("series_id") / len(self.scales)).cast("long").alias("image_id"), F.pmod("series_id", F.lit(len(self.scales))).cast("int").alias("scale_idx"),
            ((F.col("series_id") * self.length + F.col("kp0")) * self.length + F.col("kp1")).alias("desc_id"), F.col("feature").alias("vec"),
        )
        return one.join(views, "image_id").select("image_id", "view", "scale_idx", "desc_id", "vec")

    def fit(self, contours: DataFrame, names: DataFrame, folder: str) -> ContourModel:
        """A model of the pictures named in names (image_id, name), kept in folder."""
        return self.fit_descriptors(stacked(self.describe(contours), names), folder)

    def fit_descriptors(self, rows: DataFrame, folder: str) -> ContourModel:
        """A model of ready-made descriptors (view, scale_idx, desc_id, name, vec)."""
        AnnIndex.fit(rows.select("desc_id", "name", "vec", "view", "scale_idx"), f"{folder}/descriptors", INDEXED, keys=KEYS)
        write_record(rows.sparkSession, f"{folder}/settings", {"kind": "contour", **asdict(self)})
        return ContourModel.load(rows.sparkSession, folder)


def stacked(descriptors: DataFrame, names: DataFrame) -> DataFrame:
    """Descriptors of all pictures by view and scale, each with the individual's name; pictures without a name go."""
    return descriptors.join(names.select("image_id", F.col("name").cast("string").alias("name")), "image_id").select("view", "scale_idx", "desc_id", "name", "vec")


@dataclass(frozen=True)
class ContourModel:
    settings: ContourIdentifier
    index: AnnIndex

    @property
    def database(self) -> DataFrame:
        return self.index.rows.drop("cell")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ContourModel:
        record = read_record(spark, f"{folder}/settings")
        if record.pop("kind", None) != "contour":
            raise ValueError(f"no contour model in {folder}")
        return cls(ContourIdentifier(**record | {"scales": tuple(record["scales"])}), AnnIndex.load(spark, f"{folder}/descriptors"))

    def save(self, folder: str) -> None:
        """Another copy of the model."""
        self.settings.fit_descriptors(self.database, folder)

    def summary(self) -> DataFrame:
        """(view, scale_idx, descriptors, individuals)."""
        return self.database.groupBy("view", "scale_idx").agg(F.count(F.lit(1)).alias("descriptors"), F.countDistinct("name").alias("individuals"))

    def hits(self, queries: DataFrame, k: int = 2, exact: bool = False) -> DataFrame:
        """(image_id, view, name, score) of the names met by descriptors (image_id, view, scale_idx, desc_id, vec), more negative is better.

        Search is among descriptors of the same view and scale, in the cells nearest to each; exact, in all cells that
        may hold a neighbour. Scores are summed over scales.
        """
        asked = queries.select(F.col("desc_id").alias("query_id"), F.col("vec").alias("query_vec"), *KEYS)
        near = self.index.search(asked, k + 1, exact=exact)
        owners = queries.select(F.col("desc_id").alias("query_id"), "image_id", "view")
        c = mt.lnbnn_contributions(near, KEYS)
        return c.join(owners, ["query_id", "view"]).groupBy("image_id", "view", "name").agg(F.sum("contribution").alias("score"))

    def predict_descriptors(self, queries: DataFrame, k: int = 2, top: int | None = None, exact: bool = False) -> DataFrame:
        """(image_id, view, name, score, rank) of the first `top` names of the view, or all of them; a picture without
        descriptors, or of a view that the model does not have, has no rows."""
        asked, names, hits = queries.select("image_id", "view").distinct(), self.database.select("view", "name"), self.hits(queries, k, exact)
        if top is not None:
            return mt.top_names(hits, asked, names, top, ["view"])
        every = mt.with_names(asked.select(F.struct("image_id", "view").alias("image_id"), "view"), names, ["view"])
        hits = hits.select(F.struct("image_id", "view").alias("image_id"), "name", "score")
        scores = every.join(hits, ["image_id", "name"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return mt.rank_names(scores.select("image_id", "name", F.round("score", 9).alias("score"))).select("image_id.image_id", "image_id.view", "name", "score", "rank")

    def predict(self, contours: DataFrame, k: int = 2, top: int | None = None, exact: bool = False) -> DataFrame:
        """predict_descriptors() of contours, as many as there are."""
        return self.predict_descriptors(self.settings.describe(contours), k, top, exact)

    def evaluate(self, predictions: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
        """(k, correct, total, accuracy) over the pictures of truth (image_id, name) that have predictions."""
        ranks = truth.select("image_id", F.col("name").cast("string").alias("name")).join(predictions.select("image_id", "name", "rank"), ["image_id", "name"], "left")
        return ev.topk_accuracy_predicted_only(ranks.select("image_id", "rank"), predictions, ks)


def identify(contours: DataFrame, names: DataFrame, queries: DataFrame, folder: str, top: int = 5, settings: ContourIdentifier = ContourIdentifier()) -> DataFrame:
    """From contours to names in one step: fit on named pictures, then the first names of each query picture and view.

    The queries' descriptors are kept in folder, too: they are read several times.
    """
    model = settings.fit(contours, names, folder)
    settings.describe(queries).write.mode("overwrite").parquet(f"{folder}/queries")
    return model.predict_descriptors(contours.sparkSession.read.parquet(f"{folder}/queries"), top=top)
