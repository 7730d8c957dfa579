"""Dataset curation: minimum counts, reproducible stratified splits, leakage checks, label encoding.

Shuffles of the data are replaced by an order on md5(seed:key), which does not depend on files or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinspark.functions.names import reflected
from kinspark.schemas import require_columns

# Fixed values.
#: Least images of an individual: whole images, and per ear; share of an individual's images that train.
MIN_IMAGES, MIN_PER_EAR, RATIO = 9, 8, 0.67


def shuffle_key(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def counts(df: DataFrame, by: str = "individual") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def min_count(df: DataFrame, least: int, by: str = "individual") -> DataFrame:
    """Rows whose individual has at least `least` rows."""
    return df.join(counts(df, by).filter(F.col("n") >= least).select(by), by, "left_semi")


def valid_in_both(df: DataFrame, least: int, views: tuple[str, str]) -> DataFrame:
    """Individuals with at least `least` rows in each of two views."""
    per_view = df.groupBy("individual").agg(*(F.count(F.when(F.col("view") == v, 1)).alias(f"n{i}") for i, v in enumerate(views)))
    return per_view.filter((F.col("n0") >= least) & (F.col("n1") >= least)).select("individual")


def min_per_ear(df: DataFrame, least: int, views: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Rows in either view of the individuals valid in both: counted beside the rows, so one shuffle by individual serves, and rows dealt by it stay."""
    each = Window.partitionBy("individual")
    marked = df.filter(F.col("view").isin(*views) & F.col("individual").isNotNull())
    marked = marked.withColumns({f"__n{i}": F.count(F.when(F.col("view") == v, 1)).over(each) for i, v in enumerate(views)})
    return marked.filter((F.col("__n0") >= least) & (F.col("__n1") >= least)).drop("__n0", "__n1")


def stratified_split(df: DataFrame, ratio: float = RATIO, seed: int = 42, by: list[str] | None = None, key: str = "filepath", single_trains: bool = False) -> DataFrame:
    """df with `split` (train or test), dealt within each individual.

    An individual of n rows has max(1, round(n * ratio)) rows to train with, halves rounded to even, and n - 1 if that
    takes all. A single row therefore tests; with single_trains (the older rule) it trains. Keys must be unique.
    """
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be between 0 and 1")
    by = by or ["individual"]
    require_columns(df, key, *by)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(shuffle_key(seed, F.col(key)), F.col(key)))
    cut = F.greatest(F.lit(1), F.bround(F.col("__n") * F.lit(float(ratio)), 0).cast("int"))
    cut = F.when(cut >= F.col("__n"), F.col("__n") - 1).otherwise(cut)
    if single_trains:
        cut = F.when(F.col("__n") == 1, F.lit(1)).otherwise(cut)
    marked = df.withColumn("__rn", rn).withColumn("__n", n)  # in this order one sort serves both
    return marked.withColumn("split", F.when(F.col("__rn") <= cut, "train").otherwise("test")).drop("__n", "__rn")


def class_index(df: DataFrame, by: str = "individual", seed: int = 42) -> DataFrame:
    """(by, class_idx): 0-based in shuffled order of the names. Positions come from counts of ranges, not from one sorted task."""
    names = df.select(by).filter(F.col(by).isNotNull()).distinct().withColumn("h", shuffle_key(seed, F.col(by)))
    names = names.withColumn("bucket", F.substring("h", 1, 2))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = names.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).withColumn("start", F.coalesce(F.sum("c").over(before), F.lit(0)))
    rn = F.row_number().over(Window.partitionBy("bucket").orderBy("h", by)) - 1
    return names.withColumn("rn", rn).join(starts, "bucket").select(by, (F.col("start") + F.col("rn")).cast("int").alias("class_idx"))


def with_class(df: DataFrame, classes: DataFrame, by: str = "individual") -> DataFrame:
    """df with class_idx, -1 for names that have none."""
    return df.join(classes, by, "left").withColumn("class_idx", F.coalesce("class_idx", F.lit(-1)))


def leakage(split: DataFrame, key: str = "filepath") -> DataFrame:
    """Keys on both sides, mirrored copies counted as their originals."""
    plain = split.select(F.regexp_replace(F.col(key).cast("string"), "_reflected", "").alias("key"), "split")
    return plain.filter("split = 'train'").select("key").intersect(plain.filter("split = 'test'").select("key"))


def with_reflections(train: DataFrame, key: str = "filepath") -> DataFrame:
    """Training rows and their mirrored copies."""
    return train.unionByName(train.withColumn(key, reflected(F.col(key).cast("string"))))


def split_balance(split: DataFrame, by: str = "individual") -> DataFrame:
    """(by, train, test, total, ratio) of each individual."""
    out = split.groupBy(by).agg(F.count(F.when(F.col("split") == "train", 1)).alias("train"), F.count(F.when(F.col("split") == "test", 1)).alias("test"))
    return out.withColumn("total", F.col("train") + F.col("test")).withColumn("ratio", F.col("train") / F.col("total"))


def split_sets(split: DataFrame, by: str = "individual") -> DataFrame:
    """One row: individuals only in training, only in test, in both."""
    b = split_balance(split, by)
    return b.agg(F.count(F.when(F.col("test") == 0, 1)).alias("only_train"), F.count(F.when(F.col("train") == 0, 1)).alias("only_test"), F.count(F.when((F.col("train") > 0) & (F.col("test") > 0), 1)).alias("both"))


def count_of_counts(df: DataFrame, by: str = "individual") -> DataFrame:
    return counts(df, by).groupBy("n").agg(F.count(F.lit(1)).alias("individuals"))


def threshold_sweep(df: DataFrame, thresholds: list[int], by: str = "individual") -> DataFrame:
    """(threshold, individuals, images) that survive each least count: one pass, a conditional sum for each threshold."""
    t = counts(df, by)
    sums = [x for k in thresholds for x in (F.count(F.when(F.col("n") >= k, 1)).alias(f"i{k}"), F.coalesce(F.sum(F.when(F.col("n") >= k, F.col("n"))), F.lit(0)).alias(f"s{k}"))]
    rows = F.array(*(F.struct(F.lit(k).alias("threshold"), F.col(f"i{k}").alias("individuals"), F.col(f"s{k}").alias("images")) for k in thresholds))
    return t.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")


def cutoff_totals(df: DataFrame, least: int, by: str = "individual") -> DataFrame:
    return threshold_sweep(df, [least], by).select("individuals", "images")


def hash_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """min(n, available) rows, the first in shuffled order."""
    return df.orderBy(shuffle_key(seed, F.col(key)), key).limit(n)


def exclude(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in another table."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def last_wins(*layers: DataFrame, key: str) -> DataFrame:
    """Merge tables by key; the row of the last table that has a key stays."""
    tagged = None
    for i, layer in enumerate(layers):
        one = layer.withColumn("__layer", F.lit(i))
        tagged = one if tagged is None else tagged.unionByName(one)
    cols = [c for c in tagged.columns if c not in (key, "__layer")]
    best = tagged.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("__layer")).alias("r"))
    return best.select(key, "r.*")
