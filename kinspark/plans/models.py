"""Queries of the estimators and of the steps before them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinspark.models import prepare
from kinspark.models.appearance import AppearanceIdentifier, AppearanceModel
from kinspark.models.contour import ContourIdentifier, ContourModel, identify, stacked
from kinspark.models.train import train_appearance, train_contours
from kinspark.models.tuning import COMPONENTS, LAYERS, POOLS, asked_for, grid, tune
from kinspark.operators import features as ft
from kinspark.operators.curation import MIN_IMAGES
from kinspark.plans.curating import _CUT
from kinspark.plans.identification import _CONTRIBUTIONS, _PARTS
from kinspark.plans.tables import boxes, catalogue, descriptors, polylines, scratch_folder, table

_KS = [1, 3, 5, 10]


def _contour_model(spark, sf_dir) -> ContourModel:
    """Database descriptors of odd vectors stand for the left view; kept in a folder and read again."""
    d = descriptors(spark, sf_dir).withColumn("view", F.when(F.col("view") == 1, "left").otherwise("right"))
    folder = scratch_folder(spark, "model")
    ContourIdentifier().fit_descriptors(d.filter("not is_query"), folder)
    return ContourModel.load(spark, folder)


def _asked(spark, sf_dir):
    d = descriptors(spark, sf_dir).filter("is_query").withColumn("view", F.when(F.col("view") == 1, "left").otherwise("right"))
    return d.select(F.col("desc_id").alias("image_id"), "view", "scale_idx", "desc_id", "vec", "name")


def contour_model_predict(spark, sf_dir):
    """The first five names, with a search that misses no neighbour."""
    found = _contour_model(spark, sf_dir).predict_descriptors(_asked(spark, sf_dir), top=5, exact=True)
    return found.select("image_id", "view", "name", F.round("score", 6).alias("score"), "rank")


def contour_model_evaluate(spark, sf_dir):
    """Every tenth query also stands for a picture without descriptors, which does not count."""
    asked, model = _asked(spark, sf_dir), _contour_model(spark, sf_dir)
    truth = asked.select("image_id", "name").union(asked.filter("image_id % 50 = 0").select((-F.col("image_id") - 1).alias("image_id"), "name"))
    return model.evaluate(model.predict_descriptors(asked, top=max(_KS), exact=True), truth, _KS)


def contour_model_summary(spark, sf_dir):
    return _contour_model(spark, sf_dir).summary()


def stacked_descriptors(spark, sf_dir):
    """Descriptors with the name of their picture, pictures of forty vectors named by their number, every fourth unnamed."""
    d = descriptors(spark, sf_dir)
    names = d.select("image_id").distinct().filter("image_id % 4 <> 3").withColumn("name", F.concat(F.lit("i"), F.col("image_id").cast("string")))
    return stacked(d.drop("name"), names).groupBy("view", "scale_idx", "name").agg(F.count(F.lit(1)).alias("n"))


_MODEL = f"""with {_PARTS}, {_CONTRIBUTIONS.format(on='q.view = db.view and q.scale_idx = db.scale_idx')},
s as (select q.id as image_id, case when q.view = 1 then 'left' else 'right' end as view, n.name, round(coalesce(sum(c.contribution), 0), 9) as score, q.name as truth
  from q join (select distinct view, name from db) n using (view) left join c on c.query_id = q.id and c.name = n.name group by all),
r as (select *, row_number() over (partition by image_id order by score, name) as rank from s)"""


def _centroids(spark, sf_dir) -> AppearanceModel:
    """A model of class means, kept in a folder and read again."""
    d = descriptors(spark, sf_dir).filter("not is_query").withColumn("class_idx", F.col("name").cast("int"))
    head = ft.centroid_classifier(d, "vec", "class_idx")
    folder = scratch_folder(spark, "model")
    AppearanceModel(AppearanceIdentifier(), head, [str(i) for i in range(len(head.weights))]).save(spark, folder)
    return AppearanceModel.load(spark, folder)


def appearance_model_predict(spark, sf_dir):
    found = _centroids(spark, sf_dir).predict(descriptors(spark, sf_dir).filter("is_query"), None, "desc_id")
    return found.select("desc_id", "name", F.round("p", 6).alias("p"), "rank")


def appearance_model_evaluate(spark, sf_dir):
    """Rows of an individual that the model does not know, every third query once more, count as wrong; k = 100 is left out."""
    d = descriptors(spark, sf_dir).filter("is_query")
    test = d.union(d.filter("desc_id % 15 = 0").withColumns({"name": F.lit("nobody"), "desc_id": -F.col("desc_id") - 1}))
    return _centroids(spark, sf_dir).evaluate(test, [*_KS, 100], "desc_id")


_HEAD = f"""with {_PARTS}, m as (select name, i, avg(v[i]) as m from db, unnest(range(1, 65)) t(i) group by all),
w as (select name, list(m order by i) as w from m group by 1),
p as (select q.id, q.name as truth, w.name, list_dot_product(q.v, w.w) - list_dot_product(w.w, w.w) / 2 as margin from q, w),
e as (select *, exp(margin - max(margin) over (partition by id)) as e, row_number() over (partition by id order by margin desc, name::int) as rank from p),
r as (select id, truth, name, e / sum(e) over (partition by id) as p, rank from e)"""
_HEAD_EVALUATE = _HEAD + """, t as (select rank from r where name = truth), n as (select count(*) as total from (select id from q union all select id from q where id % 15 = 0))
select k::int as k, count(*) filter (rank <= k) as correct, any_value(total) as total, count(*) filter (rank <= k) / any_value(total)::double as accuracy from t, n, unnest([1, 3, 5, 10]) k(k) group by k"""


def _fitted(spark, sf_dir):
    """A model of the database vectors on sixteen components, kept in a folder and read again; the queries."""
    d = descriptors(spark, sf_dir).select(F.col("desc_id").alias("image_id"), "name", "vec", "is_query")
    classes = d.select("name").distinct().select("name", F.col("name").cast("int").alias("class_idx"))
    folder = scratch_folder(spark, "model")
    AppearanceIdentifier(components=16).fit(d.filter("not is_query"), classes).save(spark, folder)
    return AppearanceModel.load(spark, folder), d.filter("is_query")


def appearance_fit_predict(spark, sf_dir):
    """Of each query how many names have a probability, their sum, and how many of them stand in the order of their ranks."""
    model, asked = _fitted(spark, sf_dir)
    p = model.predict(asked)
    after = F.lead("p").over(Window.partitionBy("image_id").orderBy("rank"))
    return p.withColumn("ok", ((F.col("p") > 0) & (F.coalesce(after, F.lit(0.0)) <= F.col("p"))).cast("int")).groupBy("image_id").agg(F.count_distinct("name").alias("names"), F.round(F.sum("p"), 6).alias("total"), F.sum("ok").alias("in_order"), F.max("rank").cast("int").alias("last"))


def model_grid(spark, sf_dir):
    """Configurations that orders ask for, by their keys, and how many ask for each; a pool larger than its layer has no model."""
    def pick(values, key):
        return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))

    asked = table(spark, sf_dir, "orders").select(pick(LAYERS, "o_orderkey").alias("layer"), pick(POOLS, "o_custkey").alias("pool"), F.lit(COMPONENTS[0]).alias("components"))
    counts = asked.groupBy("layer", "pool", "components").agg(F.count(F.lit(1)).alias("n"))
    return asked_for(counts).select("layer", "spatial", "pool", "components", "model", "n")


_SIZES = ", ".join(f"('{x}', {i}, {({'conv3': 28, 'conv4': 14, 'conv5': 7})[x[:5]]})" for i, x in enumerate(LAYERS))
_GRID = f"""with o as (select o_orderkey % {len(LAYERS)} as k, ({POOLS})[o_custkey % {len(POOLS)} + 1] as pool, count(*) as n from orders group by all)
select layer, spatial::int as spatial, pool::int as pool, {COMPONENTS[0]}::int as components, 'split0.67_rembg_min9_' || layer || '_pool' || pool || '_pca' || {COMPONENTS[0]} as model, n
from o join (values {_SIZES}) l(layer, i, spatial) on k = i where pool <= spatial"""


def appearance_tune(spark, sf_dir):
    """Two configurations, tuned twice, the second time from the saved models: accuracies are shares, and among as many
    names as there are every picture has its own."""
    d = descriptors(spark, sf_dir).select(F.col("desc_id").alias("image_id"), "name", "vec", "is_query")
    classes = d.select("name").distinct().select("name", F.col("name").cast("int").alias("class_idx"))
    configurations = grid(spark, [LAYERS[2]], POOLS[:2], [4])
    folder = scratch_folder(spark, "tuned")

    def features(layer, pool):
        return d.filter("not is_query"), d.filter("is_query")

    first = tune(features, classes, folder, [1, 10], configurations, 10)
    again = tune(features, classes, folder, [1, 10], configurations, 10)
    both = first.join(again.withColumnRenamed("accuracy", "again"), ["config", "k"])
    a = F.col("accuracy")
    return both.select("config", "k", ((a >= 0) & (a <= 1) & (a == F.col("again")) & ((F.col("k") < 10) | (a == 1))).alias("right"))


_TUNED = f"select 'split0.67_rembg_min9_{LAYERS[2]}_pool' || p || '_pca4' as config, k::int as k, true as right from unnest({POOLS[:2]}) p(p), unnest([1, 10]) k(k)"


def contour_identify(spark, sf_dir):
    """The first name of each user's contour among all of them, from contours to descriptors, index and scores."""
    p = polylines(spark, sf_dir).select(F.col("contour_id").alias("image_id"), F.when(F.col("contour_id") % 2 == 0, "left").otherwise("right").alias("view"), "pos", "x", "y")
    names = p.select("image_id").distinct().select("image_id", F.concat(F.lit("u"), F.col("image_id").cast("string")).alias("name"))
    settings = ContourIdentifier(scales=(0.06,), length=64, dim=16, number=6)
    return identify(p, names, p, scratch_folder(spark, "model"), 1, settings).select("image_id", "view", "name", "rank")


_IDENTIFIED = "select distinct user_id as image_id, case user_id % 2 when 0 then 'left' else 'right' end as view, 'u' || user_id as name, 1::int as rank from events"


def contour_train(spark, sf_dir):
    """Users' contours as pictures named by user and view, a fifth without a view: individuals of the model that training saves."""
    p = polylines(spark, sf_dir)
    end = F.element_at(F.array(*map(F.lit, ("_left.jpg", "_right.jpg", "_left.jpg", "_right.jpg", ".jpg"))), (F.col("contour_id") % 5 + 1).cast("int"))
    drawn = p.withColumn("filepath", F.concat(F.lit("ears/"), F.floor(F.col("contour_id") / 2).cast("string"), F.lit("_"), F.col("contour_id").cast("string"), end))
    model = train_contours(drawn.select("filepath"), drawn.select("filepath", "pos", "x", "y"), scratch_folder(spark, "model"), ContourIdentifier(scales=(0.06,), length=64, dim=16, number=6))
    return model.summary().select("view", "scale_idx", "individuals")


_TRAINED = "select case user_id % 5 % 2 when 0 then 'left' else 'right' end as view, 0 as scale_idx, count(distinct user_id // 2) as individuals from events where user_id % 5 < 4 group by 1"


def appearance_train(spark, sf_dir):
    """Vectors as pictures of their label: splits, classes and a model in one go, and how many test pictures it judges."""
    d = descriptors(spark, sf_dir).select(F.concat_ws("_", "name", F.concat(F.col("desc_id").cast("string"), F.lit(".jpg"))).alias("filepath"), "name", "vec")
    train, test, classes = prepare.appearance_splits(d.select("name", "filepath"))
    model = train_appearance(train, d.select("filepath", "vec"), classes, scratch_folder(spark, "model"), AppearanceIdentifier(components=8, iterations=10))
    measured = model.evaluate(test.join(d.select("filepath", "vec"), "filepath").withColumnRenamed("filepath", "image_id"), [len(model.names)])
    return measured.select("k", "correct", "total")


_TRAINED_APPEARANCE = f"""with c as (select label::varchar as name, label::varchar || '_' || vec_id || '.jpg' as filepath from embeddings), e as (select *, count(*) over (partition by name) as n from c),
m as (select *, row_number() over (partition by name order by md5('42:' || filepath), filepath) as rn from e where n >= {MIN_IMAGES})
select count(distinct name)::int as k, count(*) filter (rn > {_CUT}) as correct, count(*) filter (rn > {_CUT}) as total from m"""


def _ear_crops(spark, sf_dir):
    """An ear of each order: its line items' points, in pictures of orders."""
    images = _pictures(spark, sf_dir)
    ears = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("filepath")).agg(F.collect_list(F.struct((F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y"))).alias("points"))
    found = images.join(ears, "filepath").filter("filepath % 7 <> 0").select("path", F.when(F.col("filepath") % 2 == 0, "left").otherwise("right").alias("view"), "points")
    done = images.filter("filepath % 10 = 0").select(F.concat(F.regexp_replace("path", "[.]jpg$", ""), F.lit("_left.jpg")).alias("file_name"))
    return prepare.ear_crops(images.drop("filepath"), found, done, "ears")


def ear_crops(spark, sf_dir):
    return _ear_crops(spark, sf_dir)[0]


def ear_rejects(spark, sf_dir):
    return _ear_crops(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_EAR_BOXES = """with b as (select l_orderkey as k, min(l_partkey % 100)::double as x1, min(l_suppkey % 100)::double as y1, max(l_partkey % 100)::double as x2, max(l_suppkey % 100)::double as y2 from lineitem where l_orderkey % 7 <> 0 group by 1),
i as (select o_custkey || '_' || o_orderkey as stem, o_custkey::varchar as name, o_orderkey as k, o_orderstatus as s, case o_orderkey % 2 when 0 then 'left' else 'right' end as view from orders),
a as (select i.*, b.x1, b.y1, b.x2, b.y2, i.k % 10 = 0 and b.k is not null as cached, case when s = 'P' then 'unreadable' when b.k is null then 'no contour' end as reason from i left join b using (k))"""
_EAR_BOX = ", ".join(f"case when not cached then greatest(0, least(trunc({c}{e} {s} 0.1e0 * ({c}2 - {c}1))::int, {m})) end as {n}" for n, c, e, s, m in [("x0", "x", 1, "-", 120), ("y0", "y", 1, "-", 110), ("x1", "x", 2, "+", 120), ("y1", "y", 2, "+", 110)])


def _pictures(spark, sf_dir):
    """Orders as pictures of their customer; those of status P cannot be read."""
    c = catalogue(spark, sf_dir)
    size = F.when(F.col("view") != "P", F.lit(1))
    return c.select(F.concat_ws("_", "individual", F.concat("filepath", F.lit(".jpg"))).alias("path"), (size * 120).alias("width"), (size * 110).alias("height"), "filepath")


def _face_crops(spark, sf_dir):
    b = boxes(spark, sf_dir).groupBy(F.col("image_id").alias("filepath")).agg(F.array_sort(F.collect_list(F.struct("det_idx", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), F.round("confidence", 6).alias("confidence")))).alias("predictions"))
    images = _pictures(spark, sf_dir)
    faces = images.join(b, "filepath").filter("filepath % 7 <> 0").select("path", "predictions")
    done = images.filter("filepath % 10 = 0").select(F.col("path").alias("file_name"))
    return prepare.face_crops(images.drop("filepath"), faces, done, "crops")


def face_crops(spark, sf_dir):
    return _face_crops(spark, sf_dir)[0]


def face_rejects(spark, sf_dir):
    return _face_crops(spark, sf_dir)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_FACES = f"""with b as (select l_orderkey as k, ((l_linenumber::bigint * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity::bigint as det_idx, round(1.0e0 - 5 * l_discount, 6) as confidence,
(l_partkey % 100)::double as x, (l_suppkey % 100)::double as y, 20 + l_quantity as w, 30 + l_quantity as h from lineitem where l_orderkey % 7 <> 0),
f as (select distinct on (k) * from b order by k, confidence desc, det_idx),
i as (select o_custkey || '_' || o_orderkey || '.jpg' as path, o_custkey::varchar as name, o_orderkey as k, o_orderstatus as s from orders),
a as (select i.*, f.x, f.y, f.w, f.h, i.k % 10 = 0 as cached, case when s = 'P' then 'unreadable' when f.k is null then 'no face' end as reason from i left join f using (k))"""
_FACE_BOX = ", ".join(f"case when not cached then greatest(0, least(trunc({c} {s} {d} / 2)::int {s} trunc({d} * 0.05e0)::int, {m})) end as {n}" for n, c, s, d, m in [("x0", "x", "-", "w", 120), ("y0", "y", "-", "h", 110), ("x1", "x", "+", "w", 120), ("y1", "y", "+", "h", 110)])


def contour_splits(spark, sf_dir):
    """Ear pictures of customers, status O the left and F the right ear, at least four of each."""
    c = catalogue(spark, sf_dir)
    side = F.when(F.col("view") == "O", "_left.jpg").when(F.col("view") == "F", "_right.jpg").otherwise(".jpg")
    out = prepare.contour_splits(c.select(F.concat(F.col("individual").cast("string"), F.lit("_"), F.col("filepath").cast("string"), side).alias("filepath")), least=4)
    parts = [out[s].withColumn("split", F.lit(s)) for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).groupBy("view", "split", "individual").agg(F.count(F.lit(1)).alias("n"), F.min("filepath").alias("first_path"))


_EARS = f"""with c as (select o_custkey::varchar as individual, o_custkey || '_' || o_orderkey || case o_orderstatus when 'O' then '_left.jpg' when 'F' then '_right.jpg' else '.jpg' end as filepath, case o_orderstatus when 'O' then 'left' when 'F' then 'right' end as view from orders),
ok as (select individual from c group by 1 having count(*) filter (view = 'left') >= 4 and count(*) filter (view = 'right') >= 4),
m as (select c.*, count(*) over (partition by view, individual) as n, row_number() over (partition by view, individual order by md5('42:' || filepath), filepath) as rn from c semi join ok using (individual) where view is not null),
s as (select *, case when rn <= {_CUT} then 'train' else 'test' end as split from m)
select view, split, individual, count(*) as n, min(filepath) as first_path from s group by all"""


def appearance_splits(spark, sf_dir):
    crops = catalogue(spark, sf_dir).select(F.col("individual").cast("string").alias("name"), F.col("filepath").cast("string").alias("filepath"))
    train, test, classes = prepare.appearance_splits(crops)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return both.join(classes, "name").select("name", "filepath", "split", "class_idx")


_APPEARANCE = f"""with c as (select o_custkey::varchar as name, o_orderkey::varchar as filepath from orders), e as (select *, count(*) over (partition by name) as n from c),
m as (select *, row_number() over (partition by name order by md5('42:' || filepath), filepath) as rn from e where n >= {MIN_IMAGES}),
k as (select name, (row_number() over (order by md5('42:' || name), name) - 1)::int as class_idx from (select distinct name from m))
select name, filepath, case when rn <= {_CUT} then 'train' else 'test' end as split, class_idx from m join k using (name)"""


def pca_variances(spark, sf_dir):
    """Total variance of all 64 components: that of the scaled data, so one for each dimension."""
    p = ft.pca(table(spark, sf_dir, "embeddings"), "embedding", 64).select(F.posexplode("projected").alias("i", "x"))
    return p.groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.count(F.lit(1)).alias("components"), F.round(F.sum("v"), 6).alias("variance"))


QUERIES = {
    "contour_model_predict": (contour_model_predict, _MODEL + " select image_id, view, name, round(score, 6) as score, rank from r where rank <= 5"),
    "contour_model_evaluate": (contour_model_evaluate, _MODEL + ", t as (select rank from r where name = truth), n as (select count(*) as total from q) select k::int as k, count(*) filter (rank <= k) as correct, any_value(total) as total, count(*) filter (rank <= k) / any_value(total)::double as accuracy from t, n, unnest([1, 3, 5, 10]) k(k) group by k"),
    "contour_model_summary": (contour_model_summary, f"with {_PARTS} select case when view = 1 then 'left' else 'right' end as view, scale_idx::int as scale_idx, count(*) as descriptors, count(distinct name) as individuals from db group by all"),
    "stacked_descriptors": (stacked_descriptors, f"with {_PARTS} select view::int as view, scale_idx::int as scale_idx, 'i' || image_id as name, count(*) as n from d where image_id % 4 <> 3 group by all"),
    "appearance_model_predict": (appearance_model_predict, _HEAD + " select id as desc_id, name, round(p, 6) as p, rank from r"),
    "appearance_model_evaluate": (appearance_model_evaluate, _HEAD_EVALUATE),
    "appearance_fit_predict": (appearance_fit_predict, f"with {_PARTS}, n as (select count(distinct name) as n from db) select id as image_id, n as names, 1.0e0 as total, n as in_order, n::int as last from q, n"),
    "model_grid": (model_grid, _GRID),
    "appearance_tune": (appearance_tune, _TUNED),
    "appearance_train": (appearance_train, _TRAINED_APPEARANCE),
    "contour_identify": (contour_identify, _IDENTIFIED),
    "contour_train": (contour_train, _TRAINED),
    "ear_crops": (ear_crops, _EAR_BOXES + f" select name, view, 'ears/' || stem || '_' || view || '.jpg' as filepath, stem || '.jpg' as original_path, {_EAR_BOX}, cached from a where cached or reason is null"),
    "ear_rejects": (ear_rejects, _EAR_BOXES + " select reason, count(*) as n from a where not cached and reason is not null group by 1"),
    "face_crops": (face_crops, _FACES + f" select name, 'crops/' || path as filepath, path as original_path, {_FACE_BOX}, cached from a where cached or reason is null"),
    "face_rejects": (face_rejects, _FACES + " select reason, count(*) as n from a where not cached and reason is not null group by 1"),
    "contour_splits": (contour_splits, _EARS),
    "appearance_splits": (appearance_splits, _APPEARANCE),
    "pca_variances": (pca_variances, "select 64::bigint as components, 64.0e0 as variance"),
}
