"""What grows with the input, and what may not: memory of tasks, searches and their recall."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinspark.models import prepare
from kinspark.operators import ann
from kinspark.operators import curvature as cv
from kinspark.operators import masks as mk
from kinspark.operators import matching as mt
from kinspark.operators import numbering
from kinspark.operators import signal as sg
from kinspark.operators.ann import MOST_CELLS, AnnIndex
from kinspark.plans import geometry
from kinspark.sources import sinks
from tests.conftest import DATA


def test_a_block_is_compared_in_bounded_memory():
    rng = np.random.default_rng(0)
    rows, asked = 60_000, 512
    v = rng.normal(size=(rows + asked, 8)).astype(np.float32)
    table = pa.table({"id": pa.array(np.arange(rows + asked)), "name": pa.array(["a"] * (rows + asked)), "vec": pa.FixedSizeListArray.from_arrays(v.ravel(), 8).cast(pa.list_(pa.float32())), "side": pa.array(np.arange(rows + asked) >= rows)})
    schema = pa.schema([("query_id", pa.int64()), ("desc_id", pa.int64()), ("name", pa.string()), ("dist", pa.float64())])
    tracemalloc.start()
    found = mt._best_of_block(3, False, schema)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    for q in (0, 511):
        d = np.sqrt(((v[rows + q].astype(float) - v[:rows]) ** 2).sum(1))
        own = found.filter(pa.array(found.column("query_id").to_numpy() == rows + q))
        assert own.column("desc_id").to_pylist() == np.argsort(d, kind="stable")[:3].tolist()


def _vectors(spark, n, seed):
    v = np.random.default_rng(seed).normal(size=(n, 16))
    return spark.createDataFrame([(i, "n", x.tolist()) for i, x in enumerate(v)], "desc_id long, name string, vec array<float>")


def test_probes_reach_the_target_among_all_rows(spark, tmp_path, monkeypatch):
    """Of a small sample the nearest lie farther away than among all rows, so it tells nothing about these."""
    monkeypatch.setattr(ann, "SAMPLE", 48)
    monkeypatch.setattr(ann, "SAMPLE_PER_CELL", 1)
    db = _vectors(spark, 6000, 1)
    queries = _vectors(spark, 500, 2).selectExpr("desc_id as query_id", "vec as query_vec")
    index = AnnIndex.fit(db, str(tmp_path / "i"), 3)
    assert mt.recall_at(mt.knn_join(queries, db, 3), index.search(queries, 3)).first()[0] >= 0.95


def test_a_search_of_all_cells_sends_a_query_once_for_a_block(spark, tmp_path):
    db = _vectors(spark, 3000, 3)
    queries = _vectors(spark, 50, 4).selectExpr("desc_id as query_id", "vec as query_vec")
    index = AnnIndex.fit(db, str(tmp_path / "i"), 3)
    assert len(index.centers) > 4 and set(index.books[""].units(MOST_CELLS)) == {0}
    assert index.books[""].units(1) is None
    found = index.search(queries, 3, probe=MOST_CELLS).select("query_id", "desc_id", "rk").collect()
    assert sorted(found) == sorted(mt.knn_join(queries, db, 3).select("query_id", "desc_id", "rk").collect())


def test_descriptors_of_arrays_are_those_of_rows_and_make_no_row_of_a_sample(spark):
    rng = np.random.default_rng(7)
    rows = [(s, i, float(x)) for s, n in enumerate((1, 2, 40, 60, 60, 60, 60)) for i, x in enumerate(rng.normal(size=n))]
    value = F.when((F.col("series_id") == 3) & (F.col("pos") == 5), None).when((F.col("series_id") == 4) & (F.col("pos") == 5), float("nan")).when(F.col("series_id") == 5, 0.0).otherwise(F.col("value"))
    series = spark.createDataFrame(rows, "series_id long, pos int, value double").withColumn("value", value)
    found = sg.descriptors(series, 128, 8, 6)
    assert sorted(map(str, found.collect())) == sorted(map(str, sg._descriptors_by_rows(series, 128, 8, 6).collect()))
    plain = sg.descriptors(series.filter("series_id = 6"), 128, 8, 6)
    assert "MapInArrow" in plain._jdf.queryExecution().executedPlan().toString()


def test_descriptors_take_four_bytes_a_number_on_disk(spark, tmp_path):
    """As the reference's do; what is stored is the double precision result, rounded once."""
    rng = np.random.default_rng(8)
    values = {s: rng.normal(size=70) for s in range(20)}
    series = spark.createDataFrame([(s, i, float(x)) for s, v in values.items() for i, x in enumerate(v)], "series_id long, pos int, value double")
    found = sg.descriptors(series)
    assert found.schema["feature"].dataType.simpleString() == "array<float>"
    found.coalesce(1).write.parquet(str(tmp_path / "out"))
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() > 5000 and sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 150 * kept.count()
    own = kept.filter("series_id = 3").collect()
    even = sg._even(values[3], 1024)
    want = sg._features(even, np.array([r.kp0 for r in own]), np.array([r.kp1 for r in own]), 32)
    assert (np.array([r.feature for r in own], np.float32) == want.data.astype(np.float32)).all()


def test_the_descriptor_query_shuffles_points_once(spark):
    """Then only the series, as arrays, are dealt to many tasks."""
    plan = geometry.QUERIES["descriptors"][0](spark, str(DATA / "sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def _python_partitions(spark, df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_contours_and_masks_are_dealt_to_many_tasks(spark):
    points = spark.range(400).selectExpr("id % 40 as contour_id", "cast(id div 40 as int) as pos", "cast(id % 7 as double) as x", "cast(id % 11 as double) as y").coalesce(1)
    assert _python_partitions(spark, cv.integral_curvature(points, (0.1,))) > 4
    masks = spark.range(100).selectExpr("id as mask_id", "4 as height", "4 as width", "array(struct(1L as start, 3L as stop)) as runs").coalesce(1)
    assert _python_partitions(spark, mk.smoothed_masks(masks)) > 4


def test_ear_splits_deal_and_sort_once(spark, monkeypatch):
    paths = spark.range(4000).select(F.format_string("%d_%d_%s.jpg", F.col("id") % 50, "id", F.when(F.floor(F.col("id") / 50) % 2 == 0, "left").otherwise("right")).alias("filepath"))
    train = prepare.contour_splits(paths)["train"]
    plan = train._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and len(re.findall(r"\bSort \[", plan)) == 1
    few = train.rdd.getNumPartitions()
    monkeypatch.setattr(numbering, "PART_BYTES", 1 << 10)  # as if the table were larger
    more = prepare.contour_splits(paths)["train"]
    assert more.rdd.getNumPartitions() > 2 * few and sorted(more.collect()) == sorted(train.collect())
    assert train.count() == 50 * 2 * 27


def test_annotations_are_numbered_without_an_order_of_all(spark):
    files = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "file_name string")  # b is listed twice, c has nothing
    found = spark.createDataFrame([("b", 7), ("a", 2), ("b", 5), ("a", 1), ("x", 1), (None, 1)], "file_name string, det_idx int")
    images, notes = sinks.coco_images_with(files, found)
    assert images.columns == ["file_name", "image_id"] and sorted(map(tuple, images.collect())) == [("a", 0), ("b", 1), ("b", 2)]
    assert sorted((r.id, r.image_id, r.file_name, r.det_idx) for r in notes.collect()) == [(1, 0, "a", 1), (2, 0, "a", 2), (3, 1, "b", 5), (4, 1, "b", 7), (5, 2, "b", 5), (6, 2, "b", 7)]
    # annotations and files are read for the ranges' rows and their starts, annotations once more as rows
    plan = notes.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [row_number()") == 1 and plan.count("LocalTableScan") + plan.count("Scan ExistingRDD") <= 5


@pytest.mark.parametrize("kind", ["string", "double", "timestamp", "date", "int"])
def test_numbers_and_sums_of_any_order(spark, kind):
    rows = spark.range(700).select(F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 701).alias("k"), F.col("id").alias("w")).repartition(3)
    value = {"string": F.concat(F.lit("\u00e9"), F.col("k").cast("string")), "double": F.when(F.col("k") % 90 == 0, float("nan")).otherwise(F.col("k") / 3 - 90), "timestamp": F.timestamp_micros(F.lit(1793485000000000) + F.col("k") * 17000000), "date": F.date_add(F.lit("2020-01-01"), F.col("k").cast("int")), "int": F.col("k").cast("int")}[kind]
    got = numbering.numbered(rows.withColumn("v", value), ["v", "w"], "n", 1, {"s": "w"}).orderBy("v", "w").collect()
    assert [r.n for r in got] == list(range(1, 701))
    assert [r.s for r in got] == [0, *np.cumsum([r.w for r in got])[:-1].tolist()]
    assert numbering.numbered(rows.filter("false"), ["k"], "n", 0, {"s": "w"}).count() == 0
