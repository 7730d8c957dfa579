"""Queries of curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinspark.operators import curation as cu
from kinspark.plans.tables import catalogue, table

# Least counts of the sweep.
THRESHOLDS = [1, 5, 6, 7, 8, 9, 10, 11, 12, 15]
_C = "c as (select o_custkey as individual, o_orderkey as filepath, o_orderstatus as view from orders)"
_N = f"{_C}, n as (select individual, count(*) as n from c group by 1)"
_S = f"""{_C}, m as (select *, count(*) over (partition by individual) as n, row_number() over (partition by individual order by md5('42:' || filepath), filepath) as rn from c),
s as (select individual, filepath, view, case when rn <= {{cut}} then 'train' else 'test' end as split from m)"""
_CUT = "(case when greatest(1, round_even(n * 0.67e0, 0)) >= n then n - 1 else greatest(1, round_even(n * 0.67e0, 0)) end)"
SPLIT = _S.format(cut=_CUT)
SINGLE = _S.format(cut=f"(case when n = 1 then 1 else {_CUT} end)")


def _split(spark, sf_dir, **kw):
    return cu.stratified_split(catalogue(spark, sf_dir), **kw)


def min_count_filter(spark, sf_dir):
    return cu.min_count(catalogue(spark, sf_dir), 9)


def both_groups_min(spark, sf_dir):
    return cu.min_per_ear(catalogue(spark, sf_dir), 4, ("O", "F"))


_BOTH = f"with {_C}, ok as (select individual from c where view in ('O', 'F') group by 1 having count(*) filter (view = 'O') >= 4 and count(*) filter (view = 'F') >= 4) select c.* from c semi join ok using (individual) where view in ('O', 'F')"


def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


def stratified_split_single_trains(spark, sf_dir):
    return _split(spark, sf_dir, single_trains=True)


def split_by_view(spark, sf_dir):
    """The older contour split: a least count per view, no need of both, and a deal within individual and view."""
    c = catalogue(spark, sf_dir)
    enough = c.groupBy("individual", "view").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3").select("individual", "view")
    return cu.stratified_split(c.join(enough, ["individual", "view"], "left_semi"), by=["individual", "view"])


_BY_VIEW = f"""with {_C}, m as (select *, count(*) over (partition by individual, view) as n, row_number() over (partition by individual, view order by md5('42:' || filepath), filepath) as rn from c)
select individual, view, filepath, case when rn <= {_CUT} then 'train' else 'test' end as split from m where n >= 3"""


def split_leakage(spark, sf_dir):
    """Sizes of the sides and the keys on both, mirrored copies counted as their originals; every fiftieth training key also tests, mirrored."""
    s = _split(spark, sf_dir)
    named = s.withColumn("filepath", F.concat(F.col("filepath").cast("string"), F.lit(".jpg")))
    leaking = cu.with_reflections(named.filter("split = 'train'").join(s.filter("filepath % 50 = 0").select(F.concat(F.col("filepath").cast("string"), F.lit(".jpg")).alias("filepath")), "filepath", "left_semi")).filter("filepath like '%reflected%'")
    s = cu.with_reflections(named.filter("split = 'train'")).unionByName(named.filter("split = 'test'")).unionByName(leaking.withColumn("split", F.lit("test")).select(named.columns))
    sizes = s.agg(F.count(F.when(F.col("split") == "train", 1)).alias("train"), F.count(F.when(F.col("split") == "test", 1)).alias("test")).withColumn("k", F.lit(1))
    leaked = cu.leakage(s).agg(F.count(F.lit(1)).alias("leaked")).withColumn("k", F.lit(1))
    return sizes.join(leaked, "k").drop("k")


_LEAKAGE = f"""with {SPLIT}, f as (select filepath || '.jpg' as f, split from s union all select filepath || '_reflected.jpg', 'train' from s where split = 'train'
union all select filepath || '_reflected.jpg', 'test' from s where split = 'train' and filepath % 50 = 0), k as (select distinct replace(f, '_reflected', '') as f, split from f)
select (select count(*) from f where split = 'train') as train, (select count(*) from f where split = 'test') as test, (select count(*) from (select f from k group by f having count(*) = 2)) as leaked"""


def split_balance(spark, sf_dir):
    return cu.split_balance(_split(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


def split_sets(spark, sf_dir):
    return cu.split_sets(_split(spark, sf_dir))


def class_index(spark, sf_dir):
    return cu.class_index(catalogue(spark, sf_dir))


def unknown_class(spark, sf_dir):
    """Classes of individuals with nine images or more; rows of all others have class -1."""
    c = catalogue(spark, sf_dir)
    return cu.with_class(c, cu.class_index(cu.min_count(c, 9))).groupBy("class_idx").agg(F.count(F.lit(1)).alias("n"))


_CLASSES = "(select individual, (row_number() over (order by md5('42:' || individual), individual) - 1)::int as class_idx from {names})"


def count_of_counts(spark, sf_dir):
    return cu.count_of_counts(catalogue(spark, sf_dir))


def threshold_sweep(spark, sf_dir):
    return cu.threshold_sweep(catalogue(spark, sf_dir), THRESHOLDS)


def cutoff_totals(spark, sf_dir):
    return cu.cutoff_totals(catalogue(spark, sf_dir), 9)


def union_views(spark, sf_dir):
    """Both views' splits under one another, each individual's share of the training rows by view."""
    s = _split(spark, sf_dir)
    both = s.filter("view = 'O'").unionByName(s.filter("view = 'F'"))
    return both.groupBy("split", "view").agg(F.count(F.lit(1)).alias("n"))


def only_in_train(spark, sf_dir):
    s = _split(spark, sf_dir, single_trains=True)
    return s.filter("split = 'train'").select("individual").subtract(s.filter("split = 'test'").select("individual"))


def exclude_and_sample(spark, sf_dir):
    """A batch of 50 parts, in shuffled order, of those that no large line item returned: the sample is the feature."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("part"))
    return cu.hash_sample(cu.exclude(parts, returned, "part"), 50, "part")


def last_wins(spark, sf_dir):
    """Counts by name from two listings; the second listing's count stays where both have one."""
    c = catalogue(spark, sf_dir)
    a, b = cu.counts(c), cu.counts(c.filter("view = 'O'"))
    return cu.last_wins(a, b, key="individual")


QUERIES = {
    "min_count_filter": (min_count_filter, f"with {_N} select c.* from c join n using (individual) where n >= 9"),
    "both_groups_min": (both_groups_min, _BOTH),
    "stratified_split": (stratified_split, f"with {SPLIT} select * from s"),
    "stratified_split_single_trains": (stratified_split_single_trains, f"with {SINGLE} select * from s"),
    "split_by_view": (split_by_view, _BY_VIEW),
    "split_leakage": (split_leakage, _LEAKAGE),
    "split_balance": (split_balance, f"with {SPLIT} select individual, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) as total, round(count(*) filter (split = 'train') / count(*)::double, 6) as ratio from s group by 1"),
    "split_sets": (split_sets, f"with {SPLIT}, b as (select individual, bool_or(split = 'train') as a, bool_or(split = 'test') as t from s group by 1) select count(*) filter (a and not t) as only_train, count(*) filter (t and not a) as only_test, count(*) filter (a and t) as both from b"),
    "class_index": (class_index, f"with {_N} select * from {_CLASSES.format(names='n')}"),
    "unknown_class": (unknown_class, f"with {_N}, k as (select * from {_CLASSES.format(names='n where n >= 9')}) select coalesce(class_idx, -1) as class_idx, count(*) as n from c left join k using (individual) group by 1"),
    "count_of_counts": (count_of_counts, f"with {_N} select n, count(*) as individuals from n group by 1"),
    "threshold_sweep": (threshold_sweep, f"with {_N} select t::int as threshold, count(*) filter (n >= t) as individuals, coalesce(sum(n) filter (n >= t), 0)::bigint as images from n, unnest({THRESHOLDS}) u(t) group by 1"),
    "cutoff_totals": (cutoff_totals, f"with {_N} select count(*) as individuals, coalesce(sum(n), 0)::bigint as images from n where n >= 9"),
    "union_views": (union_views, f"with {SPLIT} select split, view, count(*) as n from s where view in ('O', 'F') group by all"),
    "only_in_train": (only_in_train, f"with {SINGLE} select individual from s where split = 'train' except select individual from s where split = 'test'"),
    "exclude_and_sample": (exclude_and_sample, "select p_partkey as part, p_name as name from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity >= 48) order by md5('42:' || p_partkey), p_partkey limit 50"),
    "last_wins": (last_wins, f"with {_N}, o as (select individual, count(*) as n from c where view = 'O' group by 1) select individual, coalesce(o.n, n.n) as n from n left join o using (individual)"),
}
