"""From listed pictures to a saved model in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.functions.names import base_name, individual, view_strict
from kinspark.models.appearance import AppearanceIdentifier, AppearanceModel
from kinspark.models.contour import ContourIdentifier, ContourModel
from kinspark.operators.numbering import numbered


def pictures_of(paths: DataFrame) -> DataFrame:
    """(image_id, filepath, name, view) of preprocessed pictures (filepath), each listed once: name and view are in the
    file's name, image_id numbers them by path. A path that tells no view goes."""
    rows = paths.select("filepath").distinct().select("filepath", individual(F.col("filepath")).alias("name"), view_strict(base_name(F.col("filepath"))).alias("view"))
    return numbered(rows.filter("view is not null"), ["filepath"], "image_id")


def train_contours(paths: DataFrame, contours: DataFrame, folder: str, settings: ContourIdentifier = ContourIdentifier()) -> ContourModel:
    """A contour model of the listed pictures (filepath), saved in folder. contours: (filepath, pos, x, y) as found in them."""
    pictures = pictures_of(paths)
    points = contours.join(pictures.select("image_id", "filepath", "view"), "filepath").select("image_id", "view", "pos", "x", "y")
    return settings.fit(points, pictures.select("image_id", "name"), folder)


def train_appearance(train: DataFrame, features: DataFrame, classes: DataFrame, folder: str, settings: AppearanceIdentifier = AppearanceIdentifier()) -> AppearanceModel:
    """An appearance model of the training list (filepath, name), saved in folder. features: (filepath, vec), as cached.

    A picture of the list without features is an error.
    """
    rows = train.select("filepath", "name").join(features.select("filepath", "vec"), "filepath", "left")
    model = settings.fit(rows.withColumnRenamed("filepath", "image_id"), classes)
    model.save(train.sparkSession, folder)
    return AppearanceModel.load(train.sparkSession, folder)
