"""From listed pictures to crops and splits: the steps before a model is fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.functions import boxes as bx
from kinspark.functions.names import base_name, individual, stem, view_strict
from kinspark.operators import curation as cu
from kinspark.operators.numbering import dealt
from kinspark.sources.sinks import write_class_map, write_split_files


def face_crops(images: DataFrame, faces: DataFrame, done: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(crops, rejects). images: (path, width, height); faces: (path, predictions), as cached; done: (file_name) of crops that are there.

    A crop is (name, filepath, original_path, x0, y0, x1, y1, cached): the most confident face, padded and held within
    the picture, or, cached, one that is there already. Rejects (path, reason) could not be read or show no face.
    """
    rows = images.withColumn("file_name", F.concat(stem(F.col("path")), F.lit(".jpg"))).join(faces.select("path", "predictions"), "path", "left")
    best = F.array_max(F.transform("predictions", lambda p, i: F.struct(F.coalesce(p.confidence, F.lit(0.0)).alias("c"), (-i).alias("i"), p.alias("p"))))["p"]
    rows = rows.withColumn("face", best)
    box = bx.face_crop(*(F.col(f"face.{c}") for c in ("x", "y", "width", "height")), F.col("width"), F.col("height"))
    return _crops(rows, F.col("predictions").isNull() | (F.size("predictions") == 0), "no face", box, done, folder, [])


def ear_crops(images: DataFrame, contours: DataFrame, done: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(crops, rejects) of ears. contours: (path, view, points array<struct<x, y>>), a row for each ear found.

    Padding and clamping as for faces, but of the contour's box; a crop's file name ends with its view.
    """
    named = contours.withColumn("file_name", F.concat(stem(F.col("path")), F.lit("_"), "view", F.lit(".jpg")))
    x, y = F.col("points.x"), F.col("points.y")
    box = bx.ear_crop(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y), F.col("width"), F.col("height"))
    return _crops(images.join(named, "path", "left"), F.col("points").isNull() | (F.size("points") == 0), "no contour", box, done, folder, ["view"])


def _crops(rows: DataFrame, none: Column, why: str, box: tuple[Column, ...], done: DataFrame, folder: str, more: list[str]) -> tuple[DataFrame, DataFrame]:
    """(crops, rejects) of rows (path, width, height, file_name, *more); one join tells which crops are there already."""
    there = done.filter("file_name is not null").select(F.col("file_name").alias("__key")).distinct().withColumn("__there", F.lit(True))
    # a picture without a contour has no file name: its own path, which no file name is, keeps such rows out of one task
    key = F.coalesce("file_name", F.concat(F.lit("/"), "path"))
    reason = F.when(F.col("width").isNull() | F.col("height").isNull(), "unreadable").when(none, why)
    judged = rows.withColumn("__key", key).join(there, "__key", "left").withColumns({"cached": F.col("__there").isNotNull(), "reason": reason})
    shared = [individual(F.col("path")).alias("name"), *more, F.concat(F.lit(folder.rstrip("/") + "/"), "file_name").alias("filepath"), F.col("path").alias("original_path")]
    corners = [F.when(~F.col("cached"), c.cast("int")).alias(n) for n, c in zip(("x0", "y0", "x1", "y1"), box, strict=True)]
    return judged.filter("cached or reason is null").select(*shared, *corners, "cached"), judged.filter("not cached and reason is not null").select("path", "reason")


def appearance_splits(crops: DataFrame, folder: str | None = None, least: int = cu.MIN_IMAGES, ratio: float = cu.RATIO, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, classes) of crops (name, filepath, original_path); with a folder train.csv, test.csv and the class map are written."""
    enough = cu.min_count(crops, least, "name")
    if enough.isEmpty():
        raise ValueError(f"no individual has {least} images")
    classes = cu.class_index(enough, "name", seed)
    split = cu.stratified_split(enough, ratio, seed, ["name"])
    train, test = split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")
    if folder:
        write_split_files({"train": train, "test": test}, folder)
        write_class_map(classes, f"{folder}/class_mapping", "name")
    return train, test, classes


def contour_splits(paths: DataFrame, folder: str | None = None, least: int = cu.MIN_PER_EAR, ratio: float = cu.RATIO, seed: int = 42) -> dict[str, DataFrame]:
    """left_train, left_test, right_train, right_test, train and test of ear pictures (filepath); with a folder, six CSV tables.

    Names that tell no view go. Individuals need `least` pictures of either ear. Each view is dealt by itself.
    """
    rows = paths.select(individual(F.col("filepath")).alias("individual"), "filepath", view_strict(base_name(F.col("filepath"))).alias("view")).filter("view is not null")
    # dealt by individual once and sorted once: the split's order serves the counts of both ears, which choose whole individuals
    split = cu.min_per_ear(cu.stratified_split(dealt(rows, "individual"), ratio, seed, ["individual", "view"]), least)
    if cu.valid_in_both(rows, least, ("left", "right")).isEmpty():
        raise ValueError(f"no individual has {least} images of both ears")
    out = {f"{v}_{s}": split.filter((F.col("view") == v) & (F.col("split") == s)).drop("split") for v in ("left", "right") for s in ("train", "test")}
    out |= {s: split.filter(F.col("split") == s).drop("split") for s in ("train", "test")}
    if folder:
        write_split_files(out, folder)
    return out


def checked_split(df: DataFrame, ratio: float = cu.RATIO, seed: int = 42, by: str = "individual") -> DataFrame:
    """The older split, in which a single picture trains; an empty table or an empty side is an error."""
    split = cu.stratified_split(df, ratio, seed, [by], single_trains=True)
    sides = {r.split for r in split.select("split").distinct().collect()}
    if sides != {"train", "test"}:
        raise ValueError(f"sides with rows: {sorted(sides)}")
    return split
