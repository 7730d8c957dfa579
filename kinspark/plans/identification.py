"""Queries of identification: matching, evaluation, fusion, features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kinspark.functions.vectors import l2_normalize
from kinspark.operators import evaluation as ev
from kinspark.operators import features as ft
from kinspark.operators import matching as mt
from kinspark.operators.ann import MOST_CELLS, AnnIndex
from kinspark.operators.fusion import log_opinion_pool as pool
from kinspark.operators.matrices import appended
from kinspark.operators.pairwise import coupled_rows, sigmoids
from kinspark.operators.principal import principal_axes
from kinspark.plans.tables import descriptors, queries_and_database, scratch_folder, table
from kinspark.streaming.scoring import arrived_scores, keep_nearest, meet_arrivals

KS = [1, 3, 5, 10]
_PARTS = """
d as (select vec_id as id, embedding::double[] as v, label::varchar as name, vec_id % 2 as view, (vec_id // 2) % 4 as scale_idx, vec_id // 40 as image_id from embeddings),
q as (select * from d where id % 5 = 0), db as (select * from d where id % 5 <> 0)
"""
_CONTRIBUTIONS = """
nn as (select q.id as query_id, q.image_id, q.view, db.id, db.name, list_distance(q.v, db.v) as dist,
         row_number() over (partition by q.id order by list_distance(q.v, db.v), db.id) as rk
       from q join db on {on} qualify rk <= 3),
bg as (select *, max(dist) over (partition by query_id) as b, max(rk) over (partition by query_id) as last from nn),
c as (select query_id, image_id, view, name, min(dist) - max(b) as contribution from bg where rk < last group by all)
"""


def _single(spark, sf_dir):
    q, db = queries_and_database(spark, sf_dir)
    c = mt.lnbnn_contributions(mt.knn_join(q.select("query_id", "query_vec"), db.select("desc_id", "vec", "name"), 3))
    owners = q.select("query_id", F.col("query_id").alias("image_id"))
    return q, mt.lnbnn_scores(c, owners, db.select("name"))


def lnbnn_scores(spark, sf_dir):
    _, s = _single(spark, sf_dir)
    return s.select(F.col("image_id").alias("query_id"), "name", F.round("score", 6).alias("score"))


def _ranks(spark, sf_dir):
    q, s = _single(spark, sf_dir)
    return q, mt.rank_names(s.withColumn("score", F.round("score", 6)))


def lnbnn_rank(spark, sf_dir):
    """The first five names of each query, from those that it met and the list of names."""
    q, db = queries_and_database(spark, sf_dir)
    c = mt.lnbnn_contributions(mt.knn_join(q.select("query_id", "query_vec"), db.select("desc_id", "vec", "name"), 3))
    images = q.select(F.col("query_id").alias("image_id"))
    hits = mt.lnbnn_hits(c, q.select("query_id", F.col("query_id").alias("image_id")))
    return mt.top_names(hits, images, db.select("name"), 5, digits=6).select(F.col("image_id").alias("query_id"), "rank", "name", "score")


_SCORES = f"""with {_PARTS}, {_CONTRIBUTIONS.format(on='true')},
s as (select i.id as query_id, n.name, round(coalesce(sum(c.contribution), 0), 6) as score
      from q i cross join (select distinct name from db) n left join c on c.query_id = i.id and c.name = n.name group by all)"""
_RANKS = _SCORES + ", r as (select *, row_number() over (partition by query_id order by score, name) as rank from s)"


def lnbnn_multi_view_scale(spark, sf_dir):
    """Same-view, same-scale neighbours; scores of an image's view summed over descriptors and scales."""
    q, db = queries_and_database(spark, sf_dir)
    keys = ["view", "scale_idx"]
    c = mt.lnbnn_contributions(mt.knn_join(q.select("query_id", "query_vec", *keys), db, 3, keys), keys)
    owners = q.select("query_id", (F.col("image_id") * 2 + F.col("view")).alias("image_id"))
    s = mt.lnbnn_scores(c.groupBy("query_id", "name").agg(F.sum("contribution").alias("contribution")), owners, db.select("name"))
    ranked = mt.rank_names(s.withColumn("score", F.round("score", 6)))
    return ranked.select(F.floor(F.col("image_id") / 2).alias("image_id"), (F.col("image_id") % 2).alias("view"), "name", "score", "rank")


_MULTI = f"""with {_PARTS}, {_CONTRIBUTIONS.format(on='q.view = db.view and q.scale_idx = db.scale_idx')},
s as (select i.image_id, i.view, n.name, round(coalesce(sum(c.contribution), 0), 6) as score
      from (select distinct image_id, view from q) i cross join (select distinct name from db) n
      left join c on c.image_id = i.image_id and c.view = i.view and c.name = n.name group by all)
select image_id, view, name, score, row_number() over (partition by image_id, view order by score, name) as rank from s"""


def _true_ranks(spark, sf_dir):
    q, r = _ranks(spark, sf_dir)
    truth = q.select(F.col("query_id").alias("image_id"), F.col("truth").alias("name"))
    return truth.join(r, ["image_id", "name"], "left").select("image_id", "rank"), r


def topk_accuracy(spark, sf_dir):
    ranks, _ = _true_ranks(spark, sf_dir)
    return ev.topk_accuracy(ranks, [*KS, 100], n_classes=10)


def topk_accuracy_exclude_empty(spark, sf_dir):
    """Every tenth query also stands for a picture without descriptors: it has no prediction and does not count."""
    ranks, r = _true_ranks(spark, sf_dir)
    empty = ranks.filter("image_id % 50 = 0").select((-F.col("image_id") - 1).alias("image_id"), F.lit(None).cast("int").alias("rank"))
    return ev.topk_accuracy_predicted_only(ranks.union(empty), r, KS)


_TOPK = _RANKS + """, t as (select q.id as query_id, r.rank from q left join r on r.query_id = q.id and r.name = q.name)
select k.k, count(*) filter (rank <= k.k) as correct, count(*) as total, count(*) filter (rank <= k.k) / count(*)::double as accuracy
from t, (select unnest([1, 3, 5, 10]) as k) k group by k.k"""


def cosine_top1(spark, sf_dir):
    q, db = queries_and_database(spark, sf_dir)
    best = mt.cosine_top1(q.select("query_id", "query_vec"), db.select("desc_id", "vec", "name"))
    return best.join(q.select("query_id", "truth"), "query_id").select("query_id", "desc_id", F.round("similarity", 6).alias("similarity"), (F.col("name") == F.col("truth")).alias("correct"))


_COSINE = f"""with {_PARTS}, p as (select q.id as query_id, db.id as desc_id, list_cosine_similarity(q.v, db.v) as s, q.name = db.name as correct from q, db)
select query_id, desc_id, round(s, 6) as similarity, correct from p qualify row_number() over (partition by query_id order by s desc, desc_id) = 1"""


def cosine_accuracy(spark, sf_dir):
    return ev.accuracy(cosine_top1(spark, sf_dir).withColumn("yes", F.lit(True)), "correct", "yes").select(F.round("accuracy", 6).alias("accuracy"))


def l2_normalized(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(l2_normalize(F.col("embedding"))).alias("dim", "x"))
    return d.select("vec_id", "dim", F.round("x", 6).alias("x"))


_NORMALIZED = """with d as (select vec_id, embedding::double[] as v from embeddings)
select vec_id, i::int as dim, round(v[i + 1] / sqrt(list_dot_product(v, v)), 6) as x from d, unnest(range(0, len(v))) t(i)"""


def population_scale(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    out = ft.PopulationScaler.fit(df, "embedding").transform(df, "embedding", "z")
    return out.select("vec_id", F.posexplode("z").alias("dim", "z")).select("vec_id", "dim", F.round("z", 5).alias("z"))


_SCALED = """with x as (select vec_id, i::int as dim, embedding[i + 1]::double as x from embeddings, unnest(range(0, len(embedding))) t(i)),
s as (select dim, avg(x) as m, stddev_pop(x) as s from x group by dim)
select vec_id, x.dim, round((x - m) / (case when s = 0 then 1 else s end), 5) as z from x join s using (dim)"""


def opinion_pool(spark, sf_dir):
    """Event type shares of each user in two halves of the events, pooled with weights 0.3 and 0.6."""
    e = table(spark, sf_dir, "events")
    types = e.select("event_type").distinct()
    per = e.groupBy("user_id", "event_type").agg(F.count(F.when(F.col("event_id") % 2 == 0, 1)).alias("a"), F.count(F.when(F.col("event_id") % 2 == 1, 1)).alias("b"))
    names = F.sort_array(F.collect_set("event_type")).alias("names")
    every = e.select("user_id").distinct().withColumn("k", F.lit(1)).join(types.agg(names).withColumn("k", F.lit(1)), "k").select("user_id", F.explode("names").alias("event_type"))
    full = every.join(per, ["user_id", "event_type"], "left").na.fill(0, ["a", "b"])
    sums = full.groupBy("user_id").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    p = full.join(sums, "user_id").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("class_id"), F.coalesce(F.try_divide("a", "sa"), F.lit(0.0)).alias("p1"), F.coalesce(F.try_divide("b", "sb"), F.lit(0.0)).alias("p2"))
    return pool(p, 0.3, 0.6).select("sample_id", "class_id", F.round("p", 5).alias("p"))


_POOL = """with u as (select distinct user_id from events), t as (select distinct event_type from events),
c as (select u.user_id, t.event_type, count(*) filter (e.event_id % 2 = 0) as a, count(*) filter (e.event_id % 2 = 1) as b
      from u cross join t left join events e on e.user_id = u.user_id and e.event_type = t.event_type group by all),
p as (select *, sum(a) over (partition by user_id) as sa, sum(b) over (partition by user_id) as sb from c),
l as (select user_id, event_type, (0.3e0/0.9e0) * ln(coalesce(a / nullif(sa, 0)::double, 0) + 1e-12) + (0.6e0/0.9e0) * ln(coalesce(b / nullif(sb, 0)::double, 0) + 1e-12) as lp from p),
m as (select *, exp(lp - max(lp) over (partition by user_id)) as e from l)
select user_id as sample_id, event_type as class_id, round(e / sum(e) over (partition by user_id), 5) as p from m"""


def precision_recall(spark, sf_dir):
    out = ev.precision_recall_f1(table(spark, sf_dir, "labels"), "quality", "toxic")
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


_PRF = """with n as (select count(*) filter (quality = 1 and toxic = 1) as tp, count(*) filter (quality = 1 and toxic = 0) as fp,
count(*) filter (quality = 0 and toxic = 1) as fn, count(*) filter (quality = 0 and toxic = 0) as tn from labels),
r as (select *, coalesce(tp / nullif(tp + fp, 0)::double, 0) as p, coalesce(tp / nullif(tp + fn, 0)::double, 0) as r from n)
select tp, fp, fn, tn, round(p, 6) as precision, round(r, 6) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) as f1 from r"""

def results_pivot(spark, sf_dir):
    """Top-k accuracy of each view's queries beside each other; k = 100 exceeds the classes."""
    q, r = _ranks(spark, sf_dir)
    truth = q.select(F.col("query_id").alias("image_id"), F.col("truth").alias("name"), F.concat(F.lit("view"), F.col("view").cast("string")).alias("config"))
    t = truth.join(r, ["image_id", "name"], "left")
    out = t.groupBy("config").agg(*(F.avg((F.coalesce("rank", F.lit(10**6)) <= k).cast("int")).alias(str(k)) for k in (1, 3, 5)))
    rows = out.select("config", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias("accuracy")) for k in (1, 3, 5)))).alias("m")).select("config", "m.*")
    return ev.results_table(rows, [1, 3, 5, 100])


_PIVOT = _RANKS + """, t as (select 'view' || q.view as config, coalesce(r.rank, 1000000) as rank from q left join r on r.query_id = q.id and r.name = q.name)
select config, printf('%.1f', 100 * avg((rank <= 1)::int)) as top_1, printf('%.1f', 100 * avg((rank <= 3)::int)) as top_3,
printf('%.1f', 100 * avg((rank <= 5)::int)) as top_5, 'N/A' as top_100 from t group by config"""


def _index(spark, sf_dir):
    """(queries, database, index of the database), the index kept in a folder and read again."""
    q, db = queries_and_database(spark, sf_dir)
    q, db = q.select("query_id", "query_vec"), db.select("desc_id", "vec", "name")
    folder = scratch_folder(spark, "index")
    AnnIndex.fit(db, folder, 3)
    return q, db, AnnIndex.load(spark, folder)


def ann_search(spark, sf_dir):
    """The neighbours in the cells nearest to each query."""
    q, _, index = _index(spark, sf_dir)
    return index.search(q, 3).select("query_id", "desc_id", "name", "rk")


def ann_recall(spark, sf_dir):
    q, db, index = _index(spark, sf_dir)
    return mt.recall_at(mt.knn_join(q, db, 3), index.search(q, 3))


def ann_recall_reached(spark, sf_dir):
    """How many queries got all their neighbours' places filled, how many pairs have the distance of their vectors, and whether 0.95 of the true neighbours were found."""
    q, db, index = _index(spark, sf_dir)
    found, exact = index.search(q, 3), mt.knn_join(q, db, 3)
    vectors = found.join(q, "query_id").join(db.select("desc_id", "vec"), "desc_id")
    square = F.aggregate(F.zip_with("query_vec", "vec", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    right = vectors.agg(F.count_distinct("query_id").alias("queries"), F.count(F.when(F.abs(F.sqrt(square) - F.col("dist")) < 1e-9, 1)).alias("pairs"))
    return right.crossJoin(mt.recall_at(exact, found).select((F.col("recall") >= 0.95).alias("reached")))  # one row beside one row


def ann_search_exact(spark, sf_dir):
    """The true neighbours, from cells whose reach does not rule them out."""
    q, _, index = _index(spark, sf_dir)
    return index.search(q, 3, exact=True).select("query_id", "desc_id", "name", F.round("dist", 6).alias("dist"), "rk")


def ann_search_all_cells(spark, sf_dir):
    """With every cell probed the index finds what the exact join finds."""
    q, _, index = _index(spark, sf_dir)
    return index.search(q, 3, probe=MOST_CELLS).select("query_id", "desc_id", "name", F.round("dist", 6).alias("dist"), "rk")


_NEAREST = f"with {_PARTS} select q.id as query_id, db.id as desc_id, db.name, round(list_distance(q.v, db.v), 6) as dist, row_number() over (partition by q.id order by list_distance(q.v, db.v), db.id) as rk from q, db qualify rk <= 3"


def _low_rank(spark, sf_dir):
    """Vectors of 24 dimensions and rank 6: sums of the first six numbers of an embedding with whole factors."""
    e = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda j: F.aggregate(F.transform(e, lambda x, i: x * ((i + 1) * (j + 2) % 7 - 3)), F.lit(0.0), lambda a, x: a + x)).alias("vec"))


def pca_project(spark, sf_dir):
    """Scores on six components of vectors of rank six: their squared length is that of the scaled vector, as axes are
    orthonormal and nothing is lost, and the seventh component has none."""
    p = ft.pca(_low_rank(spark, sf_dir), "vec", 7)
    squares = F.aggregate(F.slice("projected", 1, 6), F.lit(0.0), lambda a, x: a + x * x)
    return p.select("vec_id", F.round(squares, 5).alias("squares"), (F.round(F.abs(F.element_at("projected", 7)), 5) + 0.0).alias("beyond"))


_RANK = """with x as (select vec_id, j::int as j, sum(embedding[i]::double * ((i * (j + 2)) % 7 - 3)) as x from embeddings, unnest(range(1, 7)) a(i), unnest(range(0, 24)) b(j) group by all),
s as (select j, avg(x) as m, stddev_pop(x) as s from x group by j), z as (select vec_id, j, (x - m) / (case when s > 0 then s else 1 end) as z from x join s using (j))"""


def pca_spectrum(spark, sf_dir):
    """Sums of powers of the variances, the components found in the randomised way: traces of powers of the correlations."""
    axes = principal_axes(_low_rank(spark, sf_dir), "vec", 6, way="random")
    return spark.createDataFrame([(k, float((axes.variances**k).sum())) for k in (1, 2, 3)], "power int, trace double").select("power", F.round("trace", 4).alias("trace"))


_SPECTRUM = _RANK + """, c as (select a.j as i, b.j as j, avg(a.z * b.z) as c from z a join z b using (vec_id) group by all),
c2 as (select a.i, b.j, sum(a.c * b.c) as c from c a join c b on a.j = b.i group by all)
select 1 as power, round(sum(c), 4) as trace from c where i = j union all select 2, round(sum(c), 4) from c2 where i = j union all select 3, round(sum(a.c * b.c), 4) from c2 a join c b on a.j = b.i and a.i = b.j"""


def _margins(spark, sf_dir):
    """Margins of the ten class means for each query, as an array."""
    d = descriptors(spark, sf_dir).withColumn("class_idx", F.col("name").cast("int"))
    head = ft.centroid_classifier(d.filter("not is_query"), "vec", "class_idx")
    return appended(d.filter("is_query"), "vec", "scores", (head.weights, head.intercepts), lambda h, v: v @ h[0].T + h[1])


def pairwise_coupling(spark, sf_dir):
    """Probabilities of the ten classes from those of their pairs, sigmoids of the differences of margins."""
    a = -np.ones((10, 10)) * 2
    return coupled_rows(_margins(spark, sf_dir), "desc_id", a, np.zeros((10, 10))).select("desc_id", "class_idx", F.round("p", 6).alias("p"))


_MARGINS = f"""{_PARTS}, m as (select name, i, avg(v[i]) as m from db, unnest(range(1, 65)) t(i) group by all), w as (select name, list(m order by i) as w from m group by 1),
g as (select q.id, q.name::int as truth, w.name::int as c, list_dot_product(q.v, w.w) - list_dot_product(w.w, w.w) / 2 as s from q, w)"""
#: A state goes from class to class, 40 times around.
_COUPLED = f"""with recursive {_MARGINS}, r as (select a.id, a.c as i, b.c as j, least(greatest(1 / (1 + exp(-2 * (a.s - b.s))), 1e-7), 1 - 1e-7) as r from g a join g b on a.id = b.id and a.c <> b.c),
dg as (select id, i as j, sum(r.r2) as q from (select id, j as i, r * r as r2 from r) r group by id, i),
e as (select id, i, j, q from (select a.id, a.i, a.j, -a.r * b.r as q from r a join r b on a.id = b.id and a.i = b.j and a.j = b.i) union all select id, j, j, q from dg),
qm as materialized (select id, i, list(q order by j) as q from e group by id, i), qs as materialized (select id, list(q order by i) as q from qm group by id),
f as (select id, 0 as step, q, list_transform(range(0, 10), lambda k: 0.1::double) as p, list_transform(q, lambda x: list_sum(x) / 10) as qp, list_sum(list_transform(q, lambda x: list_sum(x))) / 100 as pqp from qs
  union all select id, step + 1, q, list_transform(p, lambda x, k: (x + (case when k = t + 1 then d else 0 end)) / (1 + d)), list_transform(qp, lambda x, k: (x + d * q[t + 1][k]) / (1 + d)), (pqp + d * (d * q[t + 1][t + 1] + 2 * qp[t + 1])) / (1 + d) / (1 + d)
    from (select *, step % 10 as t, (pqp - qp[step % 10 + 1]) / q[step % 10 + 1][step % 10 + 1] as d from f where step < 400))
select id as desc_id, c::int as class_idx, round(p[c + 1], 6) as p from f, unnest(range(0, 10)) t(c) where step = 400"""


def sigmoid_fit(spark, sf_dir):
    """Sigmoids of all pairs of classes on the queries' margins."""
    rows = _margins(spark, sf_dir).select("scores", F.col("name").cast("int").alias("class_idx"))
    a, b = sigmoids(rows, 10)
    return spark.createDataFrame([(i, j, float(a[i, j]), float(b[i, j])) for i in range(10) for j in range(i + 1, 10)], "i int, j int, a double, b double").select("i", "j", F.round("a", 3).alias("a"), F.round("b", 3).alias("b"))


#: Newton's steps with halving for each pair, its rows in lists; `h` is how often the step in hand was halved.
_SIGMOID = f"""with recursive {_MARGINS.replace('q as', 'q as materialized')},
rows as (select x.c as i, y.c as j, x.s - y.s as f, x.truth = x.c as yes from g x join g y on x.id = y.id and x.c < y.c and x.truth in (x.c, y.c)),
n as (select i, j, count(*) filter (yes) as np, count(*) filter (not yes) as nn from rows group by all),
l as materialized (select i, j, list(f) as f, list(case when yes then (np + 1) / (np + 2)::double else 1 / (nn + 2)::double end) as t, any_value(np) as np, any_value(nn) as nn from rows join n using (i, j) group by i, j),
it as (
  select i, j, 0 as step, f, t, 0::double as a, ln((nn + 1) / (np + 1)::double) as b, 1e300::double as v, 0::double as da, 0::double as db, 0::double as slope, 0::double as s, false as done from l
  union all
  select i, j, step + 1, f, t, case when ok then ta else a end, case when ok then tb else b end, case when ok then nv else v end,
    case when ok then -(h22 * g1 - h21 * g2) / det else da end, case when ok then -(-h21 * g1 + h11 * g2) / det else db end,
    case when ok then g1 * -(h22 * g1 - h21 * g2) / det + g2 * -(-h21 * g1 + h11 * g2) / det else slope end, case when ok then 1 else s / 2 end, ok and abs(g1) < 1e-5 and abs(g2) < 1e-5
  from (select *, h11 * h22 - h21 * h21 as det, nv < v + 1e-4 * s * slope as ok from (
    select *, a + s * da as ta, b + s * db as tb, list_sum(list_transform(z, lambda x, k: (case when x >= 0 then t[k] else t[k] - 1 end) * x + ln(1 + exp(-abs(x))))) as nv,
      list_sum(list_transform(z, lambda x, k: f[k] * (t[k] - 1 / (1 + exp(x))))) as g1, list_sum(list_transform(z, lambda x, k: t[k] - 1 / (1 + exp(x)))) as g2,
      1e-12 + list_sum(list_transform(z, lambda x, k: f[k] * f[k] / (1 + exp(x)) / (1 + exp(-x)))) as h11, 1e-12 + list_sum(list_transform(z, lambda x, k: 1 / (1 + exp(x)) / (1 + exp(-x)))) as h22,
      list_sum(list_transform(z, lambda x, k: f[k] / (1 + exp(x)) / (1 + exp(-x)))) as h21
    from (select *, list_transform(f, lambda x: x * (a + s * da) + b + s * db) as z from it where not done and step < 80))))
select i::int as i, j::int as j, round(a, 3) as a, round(b, 3) as b from it where done"""


def ovr_svm(spark, sf_dir):
    """Classes of the queries, from a classifier of the database, ranked."""
    d = descriptors(spark, sf_dir).withColumn("class_idx", F.col("name").cast("int"))
    return ft.one_vs_rest_classifier(d.filter("not is_query"), "vec", "class_idx").probabilities(d.filter("is_query"), "vec", "desc_id")


def probability_rank(spark, sf_dir):
    """Classes of each user by pooled probability, the most probable first."""
    return mt.rank_names(opinion_pool(spark, sf_dir).select(F.col("sample_id").alias("image_id"), F.col("class_id").alias("name"), "p"), True, "p")


def arriving_database(spark, sf_dir):
    """Scores of the names that images met, as the database arrives in three deliveries and the first of them once more."""
    q, db = queries_and_database(spark, sf_dir)
    folder = scratch_folder(spark, "arrivals")
    arrived = db.select("desc_id", "name", "vec")
    for delivery in (0, 1, 2, 0):
        arrived.filter(F.pmod("desc_id", F.lit(3)) == delivery).write.mode("append").parquet(f"{folder}/in")
        meet_arrivals(spark.readStream.schema(arrived.schema).parquet(f"{folder}/in"), q, f"{folder}/met", f"{folder}/read").awaitTermination()
        keep_nearest(f"{folder}/met", f"{folder}/out", spark, f"{folder}/kept").awaitTermination()
    return arrived_scores(spark, f"{folder}/out").select("image_id", "name", F.round("score", 6).alias("score"))


QUERIES = {
    "arriving_database": (arriving_database, f"with {_PARTS}, {_CONTRIBUTIONS.format(on='true')} select image_id, name, round(sum(contribution), 6) as score from c group by image_id, name"),
    "lnbnn_scores": (lnbnn_scores, _SCORES + " select * from s"),
    "lnbnn_rank": (lnbnn_rank, _RANKS + " select query_id, rank, name, score from r where rank <= 5"),
    "lnbnn_multi_view_scale": (lnbnn_multi_view_scale, _MULTI),
    "topk_accuracy": (topk_accuracy, _TOPK),
    "topk_accuracy_exclude_empty": (topk_accuracy_exclude_empty, _TOPK),
    "cosine_top1": (cosine_top1, _COSINE),
    "cosine_accuracy": (cosine_accuracy, f"select round(avg(correct::int), 6) as accuracy from ({_COSINE})"),
    "l2_normalize": (l2_normalized, _NORMALIZED),
    "population_scale": (population_scale, _SCALED),
    "log_opinion_pool": (opinion_pool, _POOL),
    "probability_rank": (probability_rank, f"select sample_id as image_id, class_id as name, p, row_number() over (partition by sample_id order by p desc, class_id) as rank from ({_POOL})"),
    "precision_recall_f1": (precision_recall, _PRF),
    "results_pivot": (results_pivot, _PIVOT),
    "ann_search": (ann_search, None),
    "ann_recall": (ann_recall, None),
    "ann_recall_reached": (ann_recall_reached, f"with {_PARTS} select count(*) as queries, 3 * count(*) as pairs, true as reached from q"),
    "ann_search_exact": (ann_search_exact, _NEAREST),
    "ann_search_all_cells": (ann_search_all_cells, _NEAREST),
    "pca_project": (pca_project, _RANK + " select vec_id, round(sum(z * z), 5) as squares, 0.0e0 as beyond from z group by vec_id"),
    "pca_spectrum": (pca_spectrum, _SPECTRUM),
    "pairwise_coupling": (pairwise_coupling, _COUPLED),
    "sigmoid_fit": (sigmoid_fit, _SIGMOID),
    "ovr_svm": (ovr_svm, None),
}
