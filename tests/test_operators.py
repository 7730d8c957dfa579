"""Ties, edges and invariants by hand."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.functions import boxes as bx
from kinspark.functions import names as nm
from kinspark.functions.vectors import cosine, l2_normalize
from kinspark.operators import contours as ct
from kinspark.operators import curation as cu
from kinspark.operators import detections as dt
from kinspark.operators import evaluation as ev
from kinspark.operators import masks
from kinspark.operators import matching as mt
from kinspark.operators import signal as sg
from kinspark.operators.curvature import curvature_at, integral_curvature
from kinspark.operators.fusion import log_opinion_pool
from kinspark.schemas import CONTOUR_CACHE, require_columns
from kinspark.sources import scans, sinks


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_vectors_without_length(spark):
    r = one(spark, l2_normalize(F.array(F.lit(0.0), F.lit(0.0))).alias("n"), cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"))
    assert all(math.isnan(x) for x in r.n) and r.c is None


def test_iou_bounds_and_symmetry(spark):
    a, b = [F.lit(float(x)) for x in (0, 0, 2, 2)], [F.lit(float(x)) for x in (1, 1, 3, 3)]
    z = [F.lit(0.0)] * 4
    r = one(spark, bx.iou(a, b).alias("ab"), bx.iou(b, a).alias("ba"), bx.iou(a, a).alias("aa"), bx.iou(z, z).alias("zz"))
    assert r.ab == r.ba == pytest.approx(1 / 7) and r.aa == 1 and r.zz == 0


def test_crops_truncate(spark):
    c = bx.face_crop(*(F.lit(x) for x in (10.9, 10.0, 5.0, 30.0)), F.lit(100), F.lit(20))
    assert list(one(spark, *c)) == [8, 0, 13, 20]
    e = bx.ear_crop(*(F.lit(x) for x in (10.0, 10.0, 25.0, 29.0)), F.lit(26), F.lit(100))
    assert list(one(spark, *e)) == [8, 8, 26, 30]


@pytest.mark.parametrize(
    "boxes, label",
    [
        ([(0.85, 8), (0.85, 2)], "Probable"), ([(0.85, 6), (0.85, 2)], "Uncertain"), ([(0.85, 4), (0.85, 2)], "Likely Bad"), ([(0.85, 3), (0.85, 2)], "Rejected"),
        ([(0.95, 1), (0.75, 9)], "Certain"), ([(0.85, 1)], "Probable"), ([(0.75, 8), (0.75, 2)], "Uncertain"), ([(0.75, 4), (0.75, 2)], "Likely Bad"),
        ([(0.75, 3), (0.75, 2)], "Rejected"), ([(0.75, 1)], "Probable"), ([(0.65, 1)], "Uncertain"), ([(0.6, 1)], "Rejected"), ([(0.8, 1)], "Probable"),
    ],
)
def test_triage(spark, boxes, label):
    df = spark.createDataFrame([(1, c, float(a)) for c, a in boxes], "image_id int, confidence double, area double")
    assert dt.triage_labels(df).first().label == label


def test_consensus_needs_three_models(spark):
    rows = [(1, v, 0, 0.9, 0.0, 0.0, 1.0, 1.0) for v in (12, 13)] + [(2, v, 0, 0.9, 0.0, 0.0, 1.0, 1.0) for v in (12, 13, 16)]
    df = spark.createDataFrame(rows, "image_id int, version int, det_idx int, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = {r.image_id: r.score for r in dt.consensus_score(df).collect()}
    w = [round((a + b) / 2, 2) for a, b in ((0.2, 1.0), (0.2, 0.95), (1.0, 0.95))]
    assert got == {1: -1.0, 2: pytest.approx(round(sum(w) / 5.7, 4))}


def test_names(spark):
    p = F.lit("a/b/1002_Cynthia I_7Mar2015_left.jpg")
    r = one(spark, nm.individual(p).alias("i"), nm.view_strict(p).alias("v"), nm.view_strict(F.lit("x_LEFT.JPG")).alias("s"), nm.view_loose(F.lit("x_LEFT.JPG")).alias("l"), nm.view_loose(F.lit("x_right")).alias("e"), nm.reflected(p).alias("m"), nm.cache_name(p).alias("c"), nm.photo_id(F.lit("a.jpg")).alias("q"))
    assert r.asDict() == {"i": "1002", "v": "left", "s": None, "l": "left", "e": "right", "m": "a/b/1002_Cynthia I_7Mar2015_left_reflected.jpg", "c": "1002_Cynthia I_7Mar2015_left.json", "q": None}
    with pytest.raises(Exception, match="no individual"):
        one(spark, nm.individual_strict(F.lit("_x.jpg")))


@pytest.mark.parametrize("n, train, older", [(1, 0, 1), (2, 1, 1), (3, 2, 2), (8, 5, 5), (9, 6, 6)])
def test_split_sizes(spark, n, train, older):
    df = spark.createDataFrame([("a", f"f{i}") for i in range(n)], "individual string, filepath string")
    assert cu.stratified_split(df).filter("split = 'train'").count() == train
    assert cu.stratified_split(df, single_trains=True).filter("split = 'train'").count() == older


def test_split_ratio_is_checked(spark):
    with pytest.raises(ValueError):
        cu.stratified_split(spark.createDataFrame([("a", "f")], "individual string, filepath string"), ratio=1.5)
    with pytest.raises(ValueError):
        require_columns(spark.range(1), "x")


def test_reflections_leak(spark):
    df = spark.createDataFrame([("f1.jpg", "train"), ("f1_reflected.jpg", "test"), ("f2.jpg", "test")], "filepath string, split string")
    assert [r.key for r in cu.leakage(df).collect()] == ["f1.jpg"]


def test_lnbnn_counts_a_name_once_and_keeps_unhit_names(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, query_vec array<double>")
    db = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [2.0, 0.0]), (3, "b", [3.0, 0.0]), (4, "c", [9.0, 0.0])], "desc_id long, name string, vec array<double>")
    c = mt.lnbnn_contributions(mt.knn_join(q, db, 3))
    s = mt.lnbnn_scores(c, spark.createDataFrame([(1, 7)], "query_id long, image_id long"), db.select("name"))
    got = [(r["name"], r.score, r["rank"]) for r in mt.rank_names(s).orderBy("rank").collect()]
    assert got == [("a", -2.0, 1), ("b", 0.0, 2), ("c", 0.0, 3)]
    few = mt.lnbnn_contributions(mt.knn_join(q, db.limit(1), 3))
    assert few.count() == 0  # a single row only sets the background


def test_topk_rules(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "image_id long, rank int")
    got = {r.k: (r.correct, r.total) for r in ev.topk_accuracy(ranks, [1, 3, 50], n_classes=10).collect()}
    assert got == {1: (1, 3), 3: (2, 3)}
    got = {r.k: (r.correct, r.total) for r in ev.topk_accuracy_predicted_only(ranks, ranks.filter("rank is not null"), [1, 50]).collect()}
    assert got == {1: (1, 2), 50: (2, 2)}


def test_prf_without_positives(spark):
    r = ev.precision_recall_f1(spark.createDataFrame([(0, 0)], "p int, t int"), "p", "t").first()
    assert (r.tp, r.tn, r.precision, r.recall, r.f1) == (0, 1, 0, 0, 0)


def test_pool_sums_to_one(spark):
    df = spark.createDataFrame([(1, c, p, q) for c, p, q in ((0, 0.7, 0.0), (1, 0.3, 0.5), (2, 0.0, 0.5))], "sample_id int, class_id int, p1 double, p2 double")
    assert log_opinion_pool(df, 0.3, 0.6).agg(F.sum("p")).first()[0] == pytest.approx(1)


def points(spark, xy):
    return spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "contour_id long, pos int, x double, y double")


def test_contours(spark):
    square = points(spark, [(0, 0), (4, 0), (4, 4), (0, 4)])
    assert ct.polygon_area(square).first().area == 16
    level = [(r.pos, r.x) for r in ct.orient(points(spark, [(0, 1), (1, 5), (2, 1)])).orderBy("pos").collect()]
    assert level == [(0, 2.0), (1, 1.0), (2, 0.0)]  # equal ends: reversed
    up = points(spark, [(0, 0), (1, 1)])
    assert ct.orient(ct.orient(up)).orderBy("pos").collect() == up.orderBy("pos").collect()
    dense = [(r.edge, r.step, r.x, r.y) for r in ct.densify(square, 2.0).orderBy("edge", "step").collect()]
    assert dense[:3] == [(0, 0, 0.0, 4.0), (0, 1, 0.0, 2.0), (0, 2, 0.0, 0.0)] and len(dense) == 12
    cuts = spark.createDataFrame([(1, 0, 2)], "contour_id long, i int, j int")
    tie = [(r.pos, r.x, r.y) for r in ct.cut_longer(square, cuts).orderBy("pos").collect()]
    assert tie == [(0, 4.0, 4.0), (1, 0.0, 4.0), (2, 0.0, 0.0)]  # equal arcs: the one that wraps around


def test_selection_modes(spark):
    p = spark.createDataFrame([(1, 0, 10.0, 1.0), (1, 1, 3.0, 1.0), (1, 2, 1.0, 1.0), (2, 0, 2.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, 1.0, 1.0)], "image_id int, idx int, area double, confidence double")
    n = {m: {r.image_id: r["count"] for r in ct.select_by_weight(p, m).groupBy("image_id").count().collect()} for m in ("auto", "side", "front")}
    assert n == {"auto": {1: 1, 2: 2, 3: 1}, "side": {1: 1, 2: 1, 3: 1}, "front": {1: 2, 2: 2, 3: 1}}


def series(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "series_id long, pos int, value double")


def test_signal_edges(spark):
    assert [r.value for r in sg.resample_linear(series(spark, [0, 1, 2]), 4).orderBy("i").collect()] == [0, 0.5, 1, 1.5]
    flat = [r.value for r in sg.gaussian_smooth(series(spark, [3, 3, 3])).collect()]
    assert flat == pytest.approx([3, 3, 3])
    ends = sg.local_extrema(series(spark, [5, 1, 2, 1, 9, 1, 1]), order=1).orderBy("pos").collect()
    assert [(r.pos, r.kind) for r in ends] == [(1, "min"), (2, "max"), (3, "min"), (4, "max")]
    assert sg.keypoint_pairs(series(spark, [1, 2, 3])).count() == 3


def test_descriptors_have_unit_length(spark):
    d = sg.descriptors(series(spark, [math.sin(i / 5) for i in range(200)]), length=128, dim=8, number=6).collect()
    assert d and len(d) <= 15 and all(sum(x * x for x in r.feature) == pytest.approx(1) and r.kp0 < r.kp1 for r in d)
    assert sg.descriptors(series(spark, range(50)), length=64).count() == 0  # no extrema


def plain_descriptors(values, length=1024, dim=32, number=32):
    even = np.interp(np.arange(length) * (len(values) - 1) / length, np.arange(len(values)), values)
    w = np.exp(-0.5 * (np.arange(-8, 9) / 2.0) ** 2)
    smooth = np.convolve(np.pad(even, 8, "symmetric"), w / w.sum(), "valid")
    held = np.pad(smooth, 3, "edge")
    around = [np.delete(held[i : i + 7], 3) for i in range(length)]
    p = [i for i in range(length) if smooth[i] > max(around[i])] + [i for i in range(length) if smooth[i] < min(around[i])]
    p = ([0] if p[0] > 1 else []) + p
    p += [length - 1] if p[-1] < length - 2 else []
    rank = sorted(range(len(p)), key=lambda k: (-math.inf if k in (0, len(p) - 1) else -abs(smooth[p[k]] - 0.5), p[k]))
    points = sorted({p[k] for k in rank[:number]})
    out = {}
    for i, a in enumerate(points):
        for b in points[i + 1 :]:
            f = np.interp(np.arange(dim) * (b - a) / dim, np.arange(b - a + 1), even[a : b + 1])
            out[a, b] = f / np.linalg.norm(f)
    return out


def test_descriptor_query_has_the_operators_size(spark, monkeypatch):
    from kinspark.plans import geometry

    values = [math.sin(i / 9) + 0.4 * math.sin(i / 2.3 + 1) + 2 for i in range(600)]
    monkeypatch.setattr(geometry, "series", lambda spark, sf_dir: series(spark, values))
    got = {(r.kp0, r.kp1): r.feature for r in geometry.QUERIES["descriptors"][0](spark, "").collect()}
    want = plain_descriptors(values)
    assert set(got) == set(want) and max(k for _, k in got) > 900 and all(got[k] == pytest.approx(want[k]) for k in want)


def plain_margins(train, label, asked, iterations, spark):
    """One-vs-rest margins with every step apart: scaled by hand, the library's machines, dot products."""
    from pyspark.ml.classification import LinearSVC, OneVsRest
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, StructField, StructType

    mean, scale = train.mean(0), train.std(0)
    rows = spark.createDataFrame([(Vectors.dense((v - mean) / scale), float(c)) for v, c in zip(train, label, strict=True)], StructType([StructField("features", VectorUDT()), StructField("label", DoubleType())]))
    models = OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=0.01)).fit(rows).models
    return np.array([[float(m.coefficients.toArray() @ ((v - mean) / scale) + m.intercept) for m in models] for v in asked])


def test_classifier_query_has_the_operators_iterations(spark, monkeypatch):
    from kinspark.plans import identification

    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=6) + 0.6 * (i % 3) * np.arange(6)], str(i % 3), i % 5 == 0) for i in range(120)]
    d = spark.createDataFrame(rows, "desc_id long, vec array<double>, name string, is_query boolean")
    monkeypatch.setattr(identification, "descriptors", lambda spark, sf_dir: d)
    got = {(x.desc_id, x.class_idx): (x.p, x.rank) for x in identification.QUERIES["ovr_svm"][0](spark, "").collect()}
    train = np.array([v for _, v, _, asked in rows if not asked])
    label = [int(n) for _, _, n, asked in rows if not asked]
    asked = [(i, np.array(v)) for i, v, _, q in rows if q]
    for (i, _), margin in zip(asked, plain_margins(train, label, [v for _, v in asked], 20, spark), strict=True):
        p = np.exp(margin - margin.max())
        assert [got[i, c][0] for c in range(3)] == pytest.approx(list(p / p.sum()), rel=1e-3)
        assert [got[i, c][1] for c in range(3)] == [1 + sum(x > y for x in margin) for y in margin]
    assert len(got) == 3 * len(asked)


def test_curvature(spark):
    line = np.array([(float(i), 0.0) for i in range(21)])
    assert curvature_at(line, 10, 3.0) == pytest.approx(0.5) and curvature_at(line, 10, 0.5) == 0.5
    got = integral_curvature(points(spark, [(i, 0) for i in range(21)]), (0.2,)).collect()
    assert len(got) == 21 and all(r.curv == pytest.approx(0.5) for r in got)


def test_masks(spark):
    runs = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 11, 12)], "mask_id int, start long, stop long")
    assert sorted((r.start, r.stop) for r in masks.union_runs(runs).collect()) == [(0, 9), (11, 12)]
    m = spark.createDataFrame([(1, "body", 0, [(0, 5)]), (1, "tusk", 0, [(4, 10)]), (1, "tusk", 1, [(9, 12)]), (1, "tusk", 2, [(20, 21)])], "image_id long, kind string, idx int, runs array<struct<start:bigint,stop:bigint>>")
    assert [(r.start, r.stop) for r in masks.absorb_tusks(m).first().runs] == [(0, 12)]


def test_round_trips(spark, tmp_path):
    (tmp_path / "img/sub").mkdir(parents=True)
    for n in ("1_a_left.jpg", "sub/2_b_right.jpg", "sub/notes.txt"):
        (tmp_path / "img" / n).write_bytes(b"x")
    assert sorted((r.individual, r.view) for r in scans.images(spark, str(tmp_path / "img")).collect()) == [("1", "left"), ("2", "right")]
    (tmp_path / "s.csv").write_text("name,filepath,original_path\n007,a,b\n")
    assert scans.samples_csv(spark, str(tmp_path / "s.csv")).first()["name"] == "007"
    sinks.write_class_map(spark.createDataFrame([("b", 1), ("a", 0)], "individual string, class_idx int"), str(tmp_path / "map"))
    assert {r["name"]: r.class_idx for r in scans.class_map(spark, str(tmp_path / "map")).collect()} == {"a": 0, "b": 1}
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/a.json").write_text(json.dumps({"contours": [[[1, 2]]], "views": ["left"]}))
    (tmp_path / "cache/b.json").write_text("{broken")
    got = {r.path[-6:]: r.cached for r in scans.json_cache(spark, str(tmp_path / "cache"), CONTOUR_CACHE).collect()}
    assert got["a.json"].views == ["left"] and (got["b.json"] is None or got["b.json"].views is None)
    note = sinks.coco_annotations(points(spark, [(0, 0), (2, 3)])).withColumn("image_id", F.lit(0))
    image = spark.createDataFrame([(0, "a.jpg", 5, 6)], "image_id long, file_name string, height int, width int")
    sinks.write_coco(image, note.withColumn("id", F.lit(1)), str(tmp_path / "coco"), "d")
    r = scans.coco_annotations(spark, str(tmp_path / "coco")).first()
    assert (r.id, r.file_name, r.bbox, r.area, r.keypoints) == (1, "a.jpg", [0, 0, 2, 3], 6, [0, 0, 2, 2, 3, 2])
    split = spark.createDataFrame([("a", "f", "left", "train")], "individual string, filepath string, view string, split string")
    sinks.write_splits(split, str(tmp_path / "splits"))
    assert spark.read.option("header", True).csv(str(tmp_path / "splits")).first().filepath == "f"


def test_photo_search_skips_malformed(spark):
    body = json.dumps({"photos": [{"id": 1, "src": {"large": "u1"}}, {"src": {"large": "x"}}, {"id": 2, "src": {"large": "u2"}}]})
    pages = spark.createDataFrame([(1, body), (2, "oops")], "page int, body string")
    assert [(r.id, r.url) for r in scans.search_photos(pages, 5).collect()] == [(1, "u1"), (2, "u2")]


def test_stream_scoring(spark, tmp_path):
    from kinspark.streaming.scoring import score_stream

    db = spark.createDataFrame([(i, str(i % 2), [float(i), 0.0]) for i in range(6)], "desc_id long, name string, vec array<double>")
    spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, query_vec array<double>").write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("query_id long, query_vec array<double>").parquet(str(tmp_path / "in"))
    score_stream(q, db, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {r["name"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"0", "1"}
