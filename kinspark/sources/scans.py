"""Scans of images, listings and cached predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinspark import schemas
from kinspark.functions.names import base_name, individual, is_image, stem, view_strict
from kinspark.operators.numbering import numbered
from kinspark.sources.documents import records


def images(spark: SparkSession, folder: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """Image files below a folder: (path, file_name, individual, view, length, content?). Files without a byte are not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    out = files.filter(is_image(F.col("path"))).select("path", base_name(F.col("path")).alias("file_name"), "length", *(["content"] if content else []))
    return out.withColumn("individual", individual(F.col("path"))).withColumn("view", view_strict(F.col("path")))


def samples_csv(spark: SparkSession, path: str, schema=schemas.SAMPLE) -> DataFrame:
    """Samples with a declared schema, so that a name such as 007 stays text."""
    return spark.read.schema(schema).csv(path, header=True)


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, class_idx) from a JSON object of names and indices."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("name", "class_idx"))


def json_cache(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(path, cached) of cached predictions, one JSON document a file; malformed ones are null."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").text(folder).withColumn("path", F.col("_metadata.file_path"))
    return text.select("path", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("cached"))


def coco_images(spark: SparkSession, path: str) -> DataFrame:
    """Pictures of an annotation document of any size."""
    return records(spark, path, "images", schemas.COCO_IMAGE)


def coco_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with their image, joined by id whatever their order."""
    notes = records(spark, path, "annotations", schemas.COCO_ANNOTATION)
    return notes.join(coco_images(spark, path).select(F.col("id").alias("image_id"), "file_name", "height", "width"), "image_id")


def contour_files(contours: DataFrame, files: DataFrame) -> DataFrame:
    """Contours (path) with the image of the same stem, an exact .jpg before another case of the suffix."""
    left = contours.withColumn("stem", stem(F.col("path")))
    right = files.filter(F.lower("path").endswith(".jpg")).select(stem(F.col("path")).alias("stem"), F.col("path").alias("image_path"))
    best = right.groupBy("stem").agg(F.min_by("image_path", F.struct((~F.endswith("image_path", F.lit(".jpg"))).alias("c"), "image_path")).alias("image_path"))
    return left.join(best, "stem", "left").drop("stem")


def not_done(todo: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What a cache or an earlier run does not have yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def cached_lines(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(path, cached) of a cache that write_cache keeps; what does not fit the schema is null."""
    lines = spark.read.schema("path string, cached string").json(folder)
    return lines.select("path", F.from_json("cached", schema, {"mode": "PERMISSIVE"}).alias("cached"))


def read_through(todo: DataFrame, spark: SparkSession, folder: str, schema: str, detect, write, key: str = "path") -> DataFrame:
    """(key, cached) of the rows of todo: from the cache, or else by detect, a function of the rows that are not in it.

    What detect gives, (key, cached), is added to the cache by write(df, folder).
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    write(detect(not_done(todo, cached_lines(spark, folder, schema), key) if there else todo), folder)
    return cached_lines(spark, folder, schema).join(todo.select(key).distinct(), key, "left_semi")


def contour_predictions(raw: Column, least: float = 0.0) -> Column:
    """Answers of the contour model (POINT_PREDICTIONS) as [(points in whole pixels, confidence)], from a least confidence."""
    return _rounded(raw, "points", least)


def anchor_predictions(raw: Column, least: float = 0.05) -> Column:
    """The same of the anchor model's keypoints."""
    return _rounded(raw, "keypoints", least)


def _rounded(raw: Column, field: str, least: float) -> Column:
    def whole(points: Column) -> Column:
        return F.transform(points, lambda p: F.struct(F.rint(p.x).cast("int").alias("x"), F.rint(p.y).cast("int").alias("y")))

    kept = F.filter(raw.getField("predictions"), lambda p: p.confidence >= least)
    return F.transform(kept, lambda p: F.struct(whole(p.getField(field)).alias("points"), p.confidence.alias("confidence")))


def paired(a: DataFrame, b: DataFrame, at: str, rank: str) -> DataFrame:
    """Rows of two lists that stand at the same place; a list is in the order of its column, and both have equal lengths.

    Places are numbers, not the order of files; lists of unequal lengths are an error when the rows are read.
    """
    left, right = numbered(a, [at], "place"), numbered(b, [rank], "place")
    both = left.join(right, "place", "full")
    missing = F.col(at).isNull() | F.col(rank).isNull()
    return both.withColumn("place", F.when(missing, F.raise_error(F.lit("lists of unequal lengths")).cast("long")).otherwise(F.col("place")))


def last_as_queries(df: DataFrame, order: str, queries: int = 2) -> DataFrame:
    """df with is_query, true for the last rows in the order of a column."""
    last = df.select(order).orderBy(F.col(order).desc()).limit(queries).withColumn("is_query", F.lit(True))
    return df.join(last, order, "left").withColumn("is_query", F.coalesce("is_query", F.lit(False)))


def search_photos(pages: DataFrame, wanted: int, size: str = "large") -> DataFrame:
    """(id, url) of the first `wanted` well-formed photos of search results (page, body), in page order; url of one size."""
    rows = pages.select("page", F.posexplode(F.from_json("body", "struct<photos:array<struct<id:bigint,src:map<string,string>>>>").getField("photos")).alias("pos", "p"))
    return rows.filter("p.id is not null and p.src is not null").orderBy("page", "pos").limit(wanted).select(F.col("p.id").alias("id"), F.try_element_at("p.src", F.lit(size)).alias("url"))


def photo_by_id(bodies: DataFrame, size: str = "large") -> DataFrame:
    """(id, url) of single photos, bodies (body); malformed ones go."""
    p = F.from_json("body", "id bigint, src map<string,string>")
    return bodies.select(p.alias("p")).filter("p.id is not null and p.src is not null").select("p.id", F.try_element_at("p.src", F.lit(size)).alias("url"))
