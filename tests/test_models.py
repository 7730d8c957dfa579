"""Estimators, drivers, caches and exports: round trips and the cases that SQL does not show."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions import boxes as bx
from kinspark.models import prepare, tuning
from kinspark.models.appearance import AppearanceIdentifier, AppearanceModel, cached_features
from kinspark.models.contour import ContourIdentifier, ContourModel, identify
from kinspark.operators import features as ft
from kinspark.operators import matching as mt
from kinspark.operators.ann import AnnIndex
from kinspark.operators.curvature import curvature_at, curvatures
from kinspark.operators.numbering import numbered
from kinspark.schemas import CONTOUR_CACHE, FACE_CACHE, MASK_CACHE
from kinspark.sources import scans, sinks

CONTOURS = "image_id long, view string, pos int, x double, y double"


def outline(kind, noise, seed):
    r = np.random.default_rng(seed)
    t = np.linspace(0, 3, 160)
    x = t * 100 + 8 * np.sin(t * (3 + 2 * kind)) + noise * r.normal(size=len(t))
    y = 60 * np.sin(t * (1 + kind)) + 9 * np.cos(t * (7 + 3 * kind)) + 200 * t / 3 + noise * r.normal(size=len(t))
    return [(float(a), float(b)) for a, b in zip(x, y, strict=True)]


def contours(spark, pictures):
    return spark.createDataFrame([(i, v, p, x, y) for i, v, pts in pictures for p, (x, y) in enumerate(pts)], CONTOURS)


def test_contour_model_round_trip(spark, tmp_path):
    settings = ContourIdentifier(scales=(0.04, 0.08), length=128, dim=16, number=12)
    train = contours(spark, [(10 * k + j, "left", outline(k, 0.2, 10 * k + j)) for k in range(3) for j in range(2)])
    names = spark.createDataFrame([(10 * k + j, f"n{k}") for k in range(3) for j in range(2)], "image_id long, name string")
    query = contours(spark, [(100 + k, "left", outline(k, 0.2, 77 + k)) for k in range(3)] + [(200, "right", outline(0, 0.2, 5)), (201, "front", outline(0, 0.2, 5))])
    model = settings.fit(train, names, str(tmp_path / "m"))
    first = {r.image_id: r for r in model.predict(query, top=1).collect()}
    assert {i: r["name"] for i, r in first.items()} == {100: "n0", 101: "n1", 102: "n2"} and all(r.score < 0 for r in first.values())
    model.save(str(tmp_path / "copy"))
    again = ContourModel.load(spark, str(tmp_path / "copy"))
    assert again.settings == settings and {(r.view, r.scale_idx) for r in again.summary().collect()} == {("left", 0), ("left", 1)}
    truth = spark.createDataFrame([(100, "n0"), (101, "n1"), (102, "n0"), (200, "n0"), (201, "n1")], "image_id long, name string")
    got = {r.k: (r.correct, r.total) for r in again.evaluate(again.predict(query), truth, [1, 3]).collect()}
    assert got == {1: (2, 3), 3: (3, 3)}  # pictures of a view without a database do not count
    assert identify(train, names, query, str(tmp_path / "i"), 1, settings).count() == 3
    with pytest.raises(ValueError):
        AppearanceModel.load(spark, str(tmp_path / "m"))


def test_curvatures_equal_the_plain_form():
    r = np.random.default_rng(0)
    for n in (1, 2, 60):
        p = np.cumsum(r.normal(size=(n, 2)), 0)
        if n == 60:
            p[10], p[20:25, 0] = p[11], p[20, 0]
        radii = np.array([0.02, 0.08, 0.5]) * float((p.max(0) - p.min(0)).max())
        assert np.allclose(curvatures(p, radii), [[curvature_at(p, i, x) for x in radii] for i in range(n)], equal_nan=True)


def labelled(spark, n=90, dims=8):
    r = np.random.default_rng(1)
    rows = [(i, f"n{i % 3}", [float(x) for x in r.normal(size=dims) + 3 * (np.arange(dims) % 3 == i % 3)]) for i in range(n)]
    return spark.createDataFrame(rows, "image_id long, name string, vec array<float>")


def test_appearance_model_round_trip(spark, tmp_path):
    d = labelled(spark)
    train, test = d.filter("image_id < 60"), d.filter("image_id >= 60")
    classes = spark.createDataFrame([(f"n{i}", i) for i in range(3)], "name string, class_idx int")
    model = AppearanceIdentifier(components=5).fit(train, classes)
    assert {r.k: r.accuracy for r in model.evaluate(test, [1, 3, 10]).collect()}[1] > 0.9
    model.save(spark, str(tmp_path / "m"))
    again = AppearanceModel.load(spark, str(tmp_path / "m"))
    assert again.settings == model.settings and again.names == model.names and np.array_equal(again.head.weights, model.head.weights) and "classes=3" in again.summary()
    rows = again.predict(test.union(spark.createDataFrame([(999, "x", None)], test.schema)), 2).collect()
    assert len(rows) == 60 and {r["rank"] for r in rows} == {1, 2} and all(r.image_id != 999 for r in rows)
    unknown = spark.createDataFrame([(1, "nobody", [1.0] * 8)], test.schema)
    assert again.evaluate(unknown, [3]).first().correct == 0
    for wrong in (train.withColumn("vec", F.when(F.col("image_id") > 3, F.col("vec"))), train.withColumn("name", F.lit("n9"))):
        with pytest.raises(ValueError):
            AppearanceIdentifier(components=5).fit(wrong, classes)


def test_head_in_parts_equals_the_whole(spark, monkeypatch):
    d = labelled(spark, 20)
    head = ft.LinearHead(np.random.default_rng(2).normal(size=(7, 8)), np.arange(7.0))
    whole = {(r.image_id, r.class_idx): (round(r.p, 9), r["rank"]) for r in head.probabilities(d, "vec", "image_id").collect()}
    monkeypatch.setattr(ft, "HEAD_BYTES", 200)
    assert {(r.image_id, r.class_idx): (round(r.p, 9), r["rank"]) for r in head.probabilities(d, "vec", "image_id").collect()} == whole and len(whole) == 140


def test_pca_equals_numpy(spark):
    d = labelled(spark, 50)
    v = np.array([r.vec for r in d.orderBy("image_id").collect()], float)
    z = (v - v.mean(0)) / v.std(0)
    _, _, axes = np.linalg.svd(z, full_matrices=False)
    got = np.array([r.projected for r in ft.pca(d, "vec", 3).orderBy("image_id").collect()])
    want = z @ axes[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6) and ft.pca(d.limit(2), "vec", 99).first().projected is not None


def test_features_are_cached(spark, tmp_path):
    images = spark.createDataFrame([(f"p{i}", bytearray([i])) for i in range(5)], "path string, content binary")
    calls = spark.sparkContext.accumulator(0)

    def extract(contents):
        calls.add(len(contents))
        return [None if c[0] == 2 else [float(c[0])] for c in contents]

    folder = str(tmp_path / "f")
    assert {r.path: r.vec for r in cached_features(images.limit(3), extract, folder).collect()} == {"p0": [0.0], "p1": [1.0], "p2": None}
    assert cached_features(images, extract, folder).count() == 5 and calls.value == 5
    assert cached_features(images, extract, folder, force=True).count() == 5 and calls.value == 10


def test_tuning_reuses_models(spark, tmp_path, monkeypatch):
    d = labelled(spark)
    classes = spark.createDataFrame([(f"n{i}", i) for i in range(3)], "name string, class_idx int")
    grid = tuning.grid(spark, ["conv5_block1_out", "conv4_block6_out"], [7, 8], [4])
    assert {(r.layer, r.pool) for r in grid.collect()} == {("conv5_block1_out", 7), ("conv4_block6_out", 7), ("conv4_block6_out", 8)}
    assert "split0.67_rembg_min9_conv5_block1_out_pool7_pca4" in {r.model for r in grid.collect()}

    def features(layer, pool):
        return d.filter("image_id < 60"), d.filter("image_id >= 60")

    measured = tuning.tune(features, classes, str(tmp_path), [1, 3], grid).collect()
    monkeypatch.setattr(tuning.AppearanceIdentifier, "fit", lambda *a: pytest.fail("fitted again"))
    again = tuning.tune(features, classes, str(tmp_path), [1, 3], grid)
    assert sorted(again.collect()) == sorted(measured) and len(measured) == 6
    assert tuning.results(again, [1, 3, 9]).filter("top_9 = 'N/A'").count() == 3


def test_split_drivers(spark, tmp_path):
    paths = spark.createDataFrame([(f"in/{n}_{i}_{v}.jpg",) for n, k in (("a", 5), ("b", 4), ("c", 1)) for v in ("left", "right") for i in range(k)] + [("in/a_x.jpg",)], "filepath string")
    out = prepare.contour_splits(paths, str(tmp_path / "s"), least=4)
    assert {k: v.count() for k, v in out.items()} == {"left_train": 6, "left_test": 3, "right_train": 6, "right_test": 3, "train": 12, "test": 6}
    assert spark.read.option("header", True).csv(str(tmp_path / "s/train.csv")).count() == 12
    with pytest.raises(ValueError):
        prepare.contour_splits(paths, least=9)
    crops = spark.createDataFrame([(n, f"{n}{i}", "o") for n, k in (('x"y', 9), ("z", 10), ("w", 2)) for i in range(k)], "name string, filepath string, original_path string")
    train, test, classes = prepare.appearance_splits(crops, str(tmp_path / "a"))
    assert (train.count(), test.count()) == (13, 6) and {r["name"]: r.class_idx for r in scans.class_map(spark, str(tmp_path / "a/class_mapping")).collect()} == {r["name"]: r.class_idx for r in classes.collect()}
    with pytest.raises(ValueError):
        prepare.appearance_splits(crops.limit(0))
    one = spark.createDataFrame([("a", 1)], "individual string, filepath int")
    with pytest.raises(ValueError):
        prepare.checked_split(one)  # nothing to test with
    with pytest.raises(ValueError):
        prepare.checked_split(one, ratio=1.5)
    assert prepare.checked_split(one.union(spark.createDataFrame([("b", 2), ("b", 3)], one.schema))).filter("split = 'test'").count() == 1


def test_ear_crops(spark):
    images = spark.createDataFrame([("d/a_1.jpg", 100, 90), ("d/b_1.jpg", 100, 90), ("d/c_1.jpg", None, None), ("d/e_1.jpg", 9, 9)], "path string, width int, height int")
    found = spark.createDataFrame([("d/a_1.jpg", "left", [(10.0, 10.0), (50.0, 89.0)]), ("d/a_1.jpg", "right", [(1.0, 1.0), (11.0, 21.0)]), ("d/c_1.jpg", "left", [(1.0, 1.0)]), ("d/e_1.jpg", "left", [(1.0, 1.0)])], "path string, view string, points array<struct<x:double,y:double>>")
    done = spark.createDataFrame([("e_1_left.jpg",)], "file_name string")
    crops, rejects = prepare.ear_crops(images, found, done, "out/")
    got = {r.filepath: (r.x0, r.y0, r.x1, r.y1, r.cached) for r in crops.collect()}
    assert got == {"out/a_1_left.jpg": (6, 2, 54, 90, False), "out/a_1_right.jpg": (0, 0, 12, 23, False), "out/e_1_left.jpg": (None, None, None, None, True)}
    assert {(r.path, r.reason) for r in rejects.collect()} == {("d/b_1.jpg", "no contour"), ("d/c_1.jpg", "unreadable")}


def test_caches_read_through(spark, tmp_path):
    cases = {
        FACE_CACHE: {"predictions": [{"x": 1.0, "y": 2.0, "width": 3.0, "height": 4.0, "confidence": 0.5}]},
        MASK_CACHE: {"crop_bbox": {"x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4}, "image_size": {"width": 5, "height": 6}, "sam_body": {"predictions": [{"rle_mask": "r"}]}, "sam_tusk": {"predictions": []}},
        CONTOUR_CACHE: {"contours": [[[1, 2], [3, 4]]], "views": ["left"]},
    }
    for n, (schema, value) in enumerate(cases.items()):
        folder, todo, asked = str(tmp_path / str(n)), spark.createDataFrame([("a",), ("b",)], "path string"), []

        def detect(rows, schema=schema, value=value, asked=asked):
            asked.append(sorted(r.path for r in rows.collect()))
            return rows.withColumn("cached", F.from_json(F.lit(json.dumps(value)), schema))

        first = scans.read_through(todo.limit(1), spark, folder, schema, detect, sinks.write_cache)
        assert first.first().cached.asDict(True) == value
        assert scans.read_through(todo, spark, folder, schema, detect, sinks.write_cache).count() == 2 and asked[1] == [p for p in ("a", "b") if p not in asked[0]]
        (tmp_path / str(n) / "zz.json").write_text('{"path": "z", "cached": "{oops"}\n')
        assert scans.cached_lines(spark, folder, schema).count() == 3


def test_documents_of_many_parts(spark, tmp_path):
    n = 500
    files = spark.range(n).select(F.format_string("f%04d.jpg", "id").alias("file_name"), F.lit(3).alias("height"), F.lit(4).alias("width")).repartition(7)
    found = spark.range(3 * n).select(F.format_string("f%04d.jpg", (F.col("id") % n).cast("int")).alias("file_name"), F.col("id").alias("det_idx"), *(F.lit(float(i + 1)).alias(c) for i, c in enumerate(("x", "y", "width", "height"))), F.expr("array(named_struct('x', 1D, 'y', 2D), named_struct('x', 3D, 'y', 4D))").alias("keypoints"))
    images, notes = sinks.coco_images_with(files, sinks.coco_detections(found.filter("file_name <> 'f0003.jpg'")))
    sinks.write_coco(images, notes, str(tmp_path / "c"), "d", [{"id": 1, "name": "animal"}])
    doc = json.loads((tmp_path / "c/document.json").read_text())
    assert [i["id"] for i in doc["images"]] == list(range(n - 1)) and [i["file_name"] for i in doc["images"]] == sorted(i["file_name"] for i in doc["images"])
    assert [a["id"] for a in doc["annotations"]] == list(range(1, 3 * (n - 1) + 1)) and [a["image_id"] for a in doc["annotations"]] == [i // 3 for i in range(3 * (n - 1))]
    assert doc["annotations"][0]["bbox"] == [-0.5, 0.0, 3.0, 4.0] and doc["annotations"][0]["keypoints"] == [1, 2, 2, 3, 4, 2] and doc["categories"][0]["name"] == "animal"
    sinks.write_coco(images.limit(0), notes.limit(0), str(tmp_path / "e"))
    assert json.loads((tmp_path / "e/document.json").read_text())["annotations"] == []


def test_numbers_are_consecutive(spark):
    rows = [(None, 0), (None, 1), *((i // 3, i) for i in range(900))]
    got = numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"], "n", 1).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == want and sorted(r.n for r in got) == list(range(1, 903))
    assert numbered(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


def test_lists_of_unequal_lengths(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "path int"), spark.createDataFrame([("x",)], "name string")
    with pytest.raises(Exception, match="unequal"):
        scans.paired(a, b, "path", "name").collect()


def test_boxes_the_wrong_way_round(spark):
    one = [F.lit(float(x)) for x in (10, 10, 0, 0)]
    other = [F.lit(float(x)) for x in (0, 0, 10, 10)]
    r = spark.range(1).select(bx.iou(one, other).alias("a"), bx.iou(one, one).alias("b"), bx.iou(other, other).alias("c")).first()
    assert (r.a, r.b, r.c) == (0, 0, 1)


def test_matches_in_blocks(spark):
    r = np.random.default_rng(5)
    db = [(i, str(i % 4), [float(x) for x in r.integers(0, 3, 4)]) for i in range(300)] + [(999, "z", None)]
    asked = [(i, [float(x) for x in r.integers(0, 3, 4)]) for i in range(40)]
    d, q = spark.createDataFrame(db, "desc_id long, name string, vec array<float>"), spark.createDataFrame(asked, "query_id long, query_vec array<float>")
    for cosine in (False, True):
        want = {}
        for i, v in asked:
            a = np.array(v)
            scored = []
            for j, _, w in db[:-1]:
                b = np.array(w)
                if cosine and not (a.any() and b.any()):
                    continue
                scored.append((round(-(a @ b) / np.sqrt((a @ a) * (b @ b)), 9) if cosine else float(np.sqrt(((a - b) ** 2).sum())), j))
            want[i] = [j for _, j in sorted(scored)[:3]]
        for blocks in ((1, 1), (7, 3)):
            got = {}
            for x in mt.best_matches(q, d, 3, cosine=cosine, blocks=blocks).collect():
                got.setdefault(x.query_id, []).append((x.rk, x.desc_id))
            assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == {i: w for i, w in want.items() if w}
    assert mt.best_matches(q, d.limit(0), 3).count() == 0 and mt.best_matches(q.limit(0), d, 3).count() == 0


def test_ann_index(spark, tmp_path):
    r = np.random.default_rng(7)
    centers = r.normal(size=(40, 16)) * 3
    x = (centers[r.integers(0, 40, 6000)] + r.normal(size=(6000, 16))).astype(np.float32)
    db = spark.createDataFrame([(i, str(i % 9), [float(c) for c in v], i % 2) for i, v in enumerate(x[:5800])] + [(9999, "z", None, 0)], "desc_id long, name string, vec array<float>, view int")
    q = spark.createDataFrame([(i, [float(c) for c in v], i % 2) for i, v in enumerate(x[5800:])], "query_id long, query_vec array<float>, view int")
    AnnIndex.fit(db, str(tmp_path / "i"), 5)
    index = AnnIndex.load(spark, str(tmp_path / "i"))
    assert index.probe < len(index.centers) and index.rows.count() == 5800
    exact = mt.knn_join(q, db, 5, ["view"])
    assert mt.recall_at(exact, index.search(q, 5, ["view"])).first().recall >= 0.9
    same = index.search(q, 5, ["view"], probe=len(index.centers)).select("query_id", "view", "desc_id", "rk")
    assert sorted(same.collect()) == sorted(exact.select("query_id", "view", "desc_id", "rk").collect())
    with pytest.raises(ValueError):
        sinks.write_record(spark, str(tmp_path / "x/index"), {"kind": "contour"})
        AnnIndex.load(spark, str(tmp_path / "x"))


def test_index_by_keys_reads_few_cells_and_misses_nothing(spark, tmp_path):
    r = np.random.default_rng(8)
    centers = r.normal(size=(30, 8)) * 4
    x = np.round(centers[r.integers(0, 30, 4000)] + r.normal(size=(4000, 8)), 2).astype(np.float32)
    x[:900] = x[0]  # a hot cell of equal rows
    kind = "desc_id long, name string, vec array<float>, view string, scale_idx int"
    db = spark.createDataFrame([(i, str(i % 9), v.tolist(), "ab"[i % 2], i % 3) for i, v in enumerate(x[:3900])] + [(5000, "z", None, "a", 0), (5001, "z", [1.0] * 8, None, 0)], kind)
    ask = [(i, v.tolist(), "ab"[i % 2], i % 3) for i, v in enumerate(x[3900:])] + [(900 + i, x[0].tolist(), "a", 0) for i in range(40)] + [(2000, [0.0] * 8, "c", 0), (2001, None, "a", 0)]
    q = spark.createDataFrame(ask, "query_id long, query_vec array<float>, view string, scale_idx int")
    AnnIndex.fit(db, str(tmp_path / "i"), 3, keys=["view", "scale_idx"])
    index = AnnIndex.load(spark, str(tmp_path / "i"))
    assert len(index.books) == 6 and index.rows.count() == 3900 and sum(int(b.rows.sum()) for b in index.books.values()) == 3900
    want = mt.knn_join(q, db.filter("vec is not null and view is not null"), 3, ["view", "scale_idx"])
    columns = ["query_id", "view", "scale_idx", "desc_id", "name", "rk"]
    assert sorted(index.search(q, 3, exact=True).select(columns).collect()) == sorted(want.select(columns).collect())
    assert mt.recall_at(want, index.search(q, 3)).first().recall >= 0.9
    few = index.search(q.filter("query_id = 901"), 3, probe=1)
    plan = few._jdf.queryExecution().executedPlan().toString()
    filters = [f.split("PushedFilters")[0] for f in plan.split("PartitionFilters:")[1:]]
    assert any("cell#" in f and "view#" in f for f in filters)
    assert index.search(q.limit(0), 3).count() == 0 and index.search(q, 3, exact=True, probe=1).count() == want.count()
    empty = AnnIndex.fit(db.limit(0), str(tmp_path / "e"), 3)
    assert empty.search(q, 3).count() == 0 and empty.search(q, 3, exact=True).count() == 0


def test_an_index_has_few_files(spark, tmp_path):
    db = spark.range(2000, numPartitions=20).selectExpr("id as desc_id", "'n' as name", "array(cast(id % 7 as float), cast(id % 11 as float)) as vec")
    AnnIndex.fit(db, str(tmp_path / "i"), 2)
    assert len(list((tmp_path / "i/rows").rglob("*.parquet"))) < 60  # not one for each task and cell


def test_first_names_without_a_row_for_each(spark):
    r = np.random.default_rng(9)
    names = spark.createDataFrame([(v, f"n{i:02}") for v in "ab" for i in range(12) if (v, i) != ("b", 3)] * 2, "view string, name string")
    images = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(30)] + [(99, "c")], "image_id long, view string")
    hits = spark.createDataFrame([(i, "ab"[i % 2], f"n{j:02}", float(-r.integers(0, 3)) - 1e-12) for i in range(28) for j in r.permutation(12)[: r.integers(0, 12)] if (i % 2, j) != (1, 3)], "image_id long, view string, name string, score double")
    every = mt.with_names(images.select(F.struct("image_id", "view").alias("image_id"), "view"), names, ["view"])
    scores = every.join(hits.select(F.struct("image_id", "view").alias("image_id"), "name", "score"), ["image_id", "name"], "left").select("image_id", "name", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    whole = mt.rank_names(scores)
    for n in (1, 5, 50):
        want = sorted((x.image_id.image_id, x.image_id.view, x.name, x.score + 0.0, x.rank) for x in whole.collect() if x.rank <= n)
        assert sorted((x.image_id, x.view, x.name, x.score, x.rank) for x in mt.top_names(hits, images, names, n, ["view"]).collect()) == want


def test_ann_query_reaches_its_recall(spark):
    from kinspark.plans import identification
    from tests.conftest import DATA

    assert identification.QUERIES["ann_recall"][0](spark, str(DATA / "sf0.01")).first().recall >= 0.9


def test_training_in_one_call(spark, tmp_path):
    from kinspark.models.train import pictures_of, train_appearance, train_contours

    paths = [f"d/{k}_{j}_{'left' if k < 2 else 'right'}.jpg" for k in range(3) for j in range(2)] + ["d/9_front.jpg"]
    listed = spark.createDataFrame([(p,) for p in paths * 2], "filepath string")
    assert {(r.image_id, r.filepath, r["name"], r.view) for r in pictures_of(listed).collect()} == {(i, p, p[2], p.rsplit("_", 1)[1][:-4]) for i, p in enumerate(sorted(paths[:6]))}
    drawn = spark.createDataFrame([(p, i, x, y) for k, p in enumerate(paths) for i, (x, y) in enumerate(outline(k // 2, 0.2, k))], "filepath string, pos int, x double, y double")
    settings = ContourIdentifier(scales=(0.06,), length=128, dim=16, number=8)
    model = train_contours(listed, drawn, str(tmp_path / "c"), settings)
    assert {(r.view, r.individuals) for r in model.summary().collect()} == {("left", 2), ("right", 1)}
    first = model.predict(contours(spark, [(100 + k, "left" if k < 2 else "right", outline(k, 0.2, 50 + k)) for k in range(3)]), top=1).collect()
    assert {r.image_id: r["name"] for r in first} == {100: "0", 101: "1", 102: "2"}
    d = labelled(spark).select(F.concat(F.lit("p"), F.col("image_id").cast("string")).alias("filepath"), "name", "vec")
    classes = spark.createDataFrame([(f"n{i}", i) for i in range(3)], "name string, class_idx int")
    fitted = train_appearance(d.select("filepath", "name"), d.select("filepath", "vec"), classes, str(tmp_path / "a"), AppearanceIdentifier(components=4))
    assert fitted.names == ["n0", "n1", "n2"] and AppearanceModel.load(spark, str(tmp_path / "a")).settings.components == 4
    with pytest.raises(ValueError):
        train_appearance(d.select("filepath", "name"), d.filter("filepath <> 'p1'").select("filepath", "vec"), classes, str(tmp_path / "b"))
