"""Sinks: splits, class maps, caches, result files, models' records and annotation documents."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinspark.operators.numbering import numbered


def write_splits(split: DataFrame, folder: str) -> None:
    """CSV files in a folder for each view and split."""
    split.write.mode("overwrite").partitionBy("view", "split").option("header", True).csv(folder)


def write_split_files(tables: dict[str, DataFrame], folder: str) -> None:
    """A CSV table for each name: left_train, left_test, right_train, right_test, train, test, or some of them."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")


def write_class_map(classes: DataFrame, folder: str, by: str = "individual") -> None:
    """A JSON object of names and indices in the order of the indices; its entries are written by many tasks."""
    pair = F.to_json(F.struct(F.col(by).cast("string").alias("k")))  # {"k":"name"}: the name as JSON stands from the sixth character
    entry = F.concat(F.when(F.col("class_idx") == 0, "").otherwise(","), F.substr(pair, F.lit(6), F.length(pair) - 6), F.lit(":"), F.col("class_idx").cast("string"))
    lines = classes.select("class_idx", entry.alias("value")).repartitionByRange(F.col("class_idx")).sortWithinPartitions("class_idx")
    _assembled(classes.sparkSession, folder, [(lines.select("value"), "{", "}")])


def write_json(df: DataFrame, folder: str) -> None:
    """Result rows, a JSON object each."""
    df.write.mode("overwrite").json(folder)


def write_cache(df: DataFrame, folder: str, mode: str = "append") -> None:
    """Cached predictions (path, cached), cached a struct of one of the cache schemas: a JSON line for each picture."""
    df.select("path", F.to_json("cached").alias("cached")).write.mode(mode).json(folder)


def write_record(spark: SparkSession, folder: str, record: dict) -> None:
    """A model's settings."""
    spark.createDataFrame([(json.dumps(record),)], "value string").write.mode("overwrite").text(folder)


def read_record(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(folder).first().value)


def write_database(descriptors: DataFrame, folder: str) -> None:
    """Descriptors by view and scale, so that a search reads its own part only."""
    descriptors.write.mode("overwrite").partitionBy("view", "scale_idx").parquet(folder)


def read_database(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def contour_json(points: DataFrame) -> DataFrame:
    """(image_id, value) of contours (image_id, contour_id, pos, x, y): a JSON list of a picture's contours, each a list of [x, y]."""
    one = points.groupBy("image_id", "contour_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.array("x", "y").alias("p")))).alias("a"))
    return one.groupBy("image_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("contour_id", F.col("a.p").alias("ps")))), lambda c: c.ps)).alias("value"))


def coco_ids(files: DataFrame, name: str = "file_name") -> DataFrame:
    """files with image_id, from 0 in order of the names."""
    return numbered(files, [name], "image_id")


def coco_annotations(points: DataFrame) -> DataFrame:
    """(contour_id, bbox, area, keypoints) of contours (contour_id, pos, x, y) of two points or more."""
    g = points.groupBy("contour_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min_by(F.struct("x", "y"), "pos").alias("first"), F.max_by(F.struct("x", "y"), "pos").alias("last"),
    )
    w, h, two = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(2.0)
    keys = F.array(F.col("first.x"), F.col("first.y"), two, F.col("last.x"), F.col("last.y"), two)
    return g.filter("n >= 2").select("contour_id", F.array("x0", "y0", w, h).alias("bbox"), (w * h).alias("area"), keys.alias("keypoints"))


def coco_detections(detections: DataFrame) -> DataFrame:
    """(file_name, det_idx, bbox, area, keypoints) of detections (file_name, det_idx, x, y, width, height, keypoints
    array<struct<x, y>>): center boxes as top-left ones; fewer than two keypoints are none, each is visible."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    keys = F.flatten(F.transform("keypoints", lambda k: F.array(k.x, k.y, F.lit(2.0))))
    keys = F.when(F.size("keypoints") >= 2, keys).otherwise(F.array().cast("array<double>"))
    return detections.select("file_name", "det_idx", F.array(x - w / 2, y - h / 2, w, h).alias("bbox"), (w * h).alias("area"), keys.alias("keypoints"))


def coco_images_with(files: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of the files (file_name, ...) that have an annotation: others consume no id.

    Images are numbered from 0 by name, annotations (file_name, det_idx, ...) from 1 by image and index: an image's begin
    after those of the images before, whose counts are summed with the images' numbers, so annotations are not put in one order.
    """
    counted = annotations.groupBy("file_name").agg(F.count(F.lit(1)).alias("__n"))
    images = numbered(files.join(counted, "file_name"), ["file_name"], "image_id", sums={"__before": "__n"})
    within = F.row_number().over(Window.partitionBy("file_name").orderBy("det_idx"))
    notes = annotations.withColumn("__rn", within).join(images.select("file_name", "image_id", "__before"), "file_name")
    return images.drop("__n", "__before"), notes.withColumn("id", (F.col("__before") + F.col("__rn")).cast("long")).drop("__before", "__rn")


def flat_polygons(polygons: Column) -> Column:
    """Polygons (array<array<struct<x, y>>>) of three points or more as flat lists of coordinates."""
    kept = F.filter(polygons, lambda p: F.size(p) >= 3)
    return F.transform(kept, lambda p: F.flatten(F.transform(p, lambda q: F.array(q.x, q.y))))


def rle_masks(predictions: Column) -> Column:
    """The masks of predictions (array<struct<rle_mask>>) that have one."""
    return F.transform(F.filter(predictions, lambda p: p.rle_mask.isNotNull()), lambda p: p.rle_mask)


#: The categories of ear contours and of detections.
EAR = [{"id": 1, "name": "ear"}]


def write_coco(images: DataFrame, annotations: DataFrame, folder: str, description: str = "", categories: list[dict] | None = None) -> None:
    """One annotation document, folder/document.json.

    images: (image_id from 0, file_name, height, width); annotations: (id from 1, image_id, bbox, area, keypoints). Rows
    are written by many tasks, in order; the document is put together from their files.
    """
    spark = images.sparkSession
    i = images.select(F.col("image_id").alias("id"), F.lit(1).alias("license"), "file_name", "height", "width")
    a = annotations.select("id", "image_id", F.lit(1).alias("category_id"), "bbox", "area", F.array().cast("array<array<double>>").alias("segmentation"), F.lit(0).alias("iscrowd"), "keypoints")
    head = json.dumps({"info": {"description": description}, "licenses": [], "categories": EAR if categories is None else categories})[:-1]

    def lines(df: DataFrame, first: int) -> DataFrame:
        text = F.concat(F.when(F.col("id") == first, "").otherwise(","), F.to_json(F.struct(*df.columns)))
        return df.select("id", text.alias("value")).repartitionByRange(F.col("id")).sortWithinPartitions("id").select("value")

    _assembled(spark, folder, [(lines(i, 0), head + ',"images":[', "]"), (lines(a, 1), ',"annotations":[', "]}")])


def _assembled(spark: SparkSession, folder: str, parts: list[tuple[DataFrame, str, str]]) -> None:
    """folder/document.json: for each part its head, its lines and its tail.

    Lines are written by many tasks. Where the file system can put files together itself (concat, as HDFS does), no byte
    of them goes through the driver; elsewhere it copies them as a stream.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    target = path(f"{folder}/document.json")
    fs = target.getFileSystem(conf)
    pieces = []

    def mark(text: str) -> None:
        pieces.append(path(f"{folder}/_rows/mark-{len(pieces)}"))
        out = fs.create(pieces[-1], True)
        out.write(bytearray(text.encode()))
        out.close()

    for n, (df, head, tail) in enumerate(parts):
        df.write.mode("overwrite").text(f"{folder}/_rows/{n}")
        mark(head)
        files = sorted(s.getPath().toString() for s in fs.listStatus(path(f"{folder}/_rows/{n}")))
        pieces += [path(f) for f in files if f.rsplit("/", 1)[1].startswith("part-")]
        mark(tail)
    fs.delete(target, False)
    rest = spark.sparkContext._gateway.new_array(path, len(pieces) - 1)
    for i, p in enumerate(pieces[1:]):
        rest[i] = p
    try:
        fs.concat(pieces[0], rest)
        fs.rename(pieces[0], target)
    except (Py4JJavaError, UnsupportedOperationException):  # a file system without it; nothing was moved
        out = fs.create(target, True)
        try:
            for p in pieces:
                source = fs.open(p)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
                source.close()
        finally:
            out.close()
    fs.delete(path(f"{folder}/_rows"), True)
