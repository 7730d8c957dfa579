"""Consecutive numbers in an order, without sorting all rows in one task; how many parts rows are dealt into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

#: Ranges that rows are dealt into, and values that their bounds are picked from (those with the smallest hashes).
RANGES, PICKED = 64, 2048
#: Bytes of a part, as Catalyst estimates them (of files as they are stored), and the most parts.
PART_BYTES, MOST_PARTS = 4 << 20, 4096


def numbered(df: DataFrame, order: list[str], out: str, start: int = 0, sums: dict[str, str] | None = None) -> DataFrame:
    """df with `out`: start, start + 1, ... in the order of the columns, which are to tell all rows apart; for each new
    column of `sums` the sum of a column of whole numbers over the rows before.

    Bounds of ranges of the first column are picked by hash, so they are the same whenever a task is run again; counts
    of the ranges tell where each begins.
    """
    # a timestamp is compared by its microseconds: as a Python value it may lose its place where clocks are set back
    first = F.unix_micros(order[0]) if isinstance(df.schema[order[0]].dataType, TimestampType) else F.col(order[0])
    picked = df.select(first.alias("v")).filter("v is not null").distinct().orderBy(F.xxhash64("v"), "v").limit(PICKED)
    values = [r.v for r in picked.orderBy("v").collect()]  # in Spark's order, NaN last
    bounds = list(dict.fromkeys(values[i * len(values) // RANGES] for i in range(1, RANGES))) if values else []
    marked = df.withColumn("__range", F.when(first.isNull(), -1).otherwise(_range_of(first, bounds, 0)))
    inside, before = Window.partitionBy("__range").orderBy(*order), Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    summed = {out: F.lit(1)} | {new: F.col(c) for new, c in (sums or {}).items()}
    totals = marked.groupBy("__range").agg(*(F.sum(c).alias(f"__c{i}") for i, c in enumerate(summed.values())))
    starts = totals.select("__range", *(F.coalesce(F.sum(f"__c{i}").over(before), F.lit(0)).alias(f"__start{i}") for i in range(len(summed))))
    ranked = marked.withColumns({f"__rn{i}": F.coalesce(F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for i, c in enumerate(summed.values())})
    placed = {new: (F.col(f"__start{i}") + F.col(f"__rn{i}") + (0 if i else start)).cast("long") for i, new in enumerate(summed)}
    return ranked.join(starts, "__range").withColumns(placed).drop("__range", *(f"__{c}{i}" for c in ("rn", "start") for i in range(len(summed))))


def _range_of(value: Column, bounds: list, start: int) -> Column:
    """start + how many of the ascending bounds are not above the value, halving: six comparisons for 63 bounds."""
    if not bounds:
        return F.lit(start)
    half = len(bounds) // 2
    return F.when(value < F.lit(bounds[half]), _range_of(value, bounds[:half], start)).otherwise(_range_of(value, bounds[half + 1 :], start + half + 1))


def many_parts(df: DataFrame) -> int:
    """Partitions for rows whose work their bytes tell little of: Spark would put many of them into one task, as they are small.

    One more than a shuffle has, or Spark would take a shuffle by the same key for this one and join its partitions.
    """
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))) + 1


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into parts that stay of one size as the table grows, so that a task's sorts do, too.

    Spark would join the parts of a shuffle until there are hardly more than cores. Where a size is not known, Spark's
    number of parts stays.
    """
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = -(-size // PART_BYTES) if size < 1 << 60 else 0
    least = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(least, min(known, MOST_PARTS)), *by)
