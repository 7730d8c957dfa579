"""Mixing sources to target weights by capped water-filling.

Each source is to give a share of the mix by its weight, but no more than `epochs` times what it has. The water level is
what a weight of one gets: sources whose cap lies under their share at that level are clamped, and what they leave goes
to the others by weight, until none is above its cap. Each round is one sum over the table of sources, with whole
numbers, so the level is exact; a round is a Newton step on a concave function and clamps sources for good, so there are
few, whatever the number of sources.

A target of 2.4 times a source is two whole repetitions of every document and a seeded sample with 0.4 of its words.
The sample is a range of hash buckets in each size class (documents of 2^k to 2^(k+1)-1 words): class by class, from the
longest documents down, as many buckets as come nearest to that share of the class and what the classes before left
over or took too much. What is left at the end is at most half a bucket (of BUCKETS) of the last class, or half of one
of its documents. A document is taken whole or not, and at most `epochs` times.

Texts are read once, for their sizes; what is written, shuffled and joined are (id, source, size, bucket). Histograms by
source, class and bucket are summed before the shuffle, and a source has BUCKETS * 65 cells at most. Numbers of sources
have no bound: they are ranked in ranges, and the table of targets is broadcast only up to a measured size.

Cases: a null text has no words; a null source is one of its own and ranks last; a document without words takes none; a
source without words has target 0; where all caps together stay under the budget, every source is at its cap; rows that
repeat an id and a size are taken or left together; rows with a null id share a bucket with those of their size; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.lookup import LOOKUP_BYTES, attach
from kinspark.llm.workspace import Workspace
from kinspark.operators.numbering import numbered

#: Hash buckets of a size class.
BUCKETS = 1024
_EXACT = "decimal(19,0)"


def word_count(text: Column) -> Column:
    """Runs of other characters than U+0009 to U+000D and U+0020."""
    return F.size(F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^ \t-\r]+"), F.lit(0))).cast("long")


def cycled(*weights: int) -> Callable[[DataFrame], DataFrame]:
    """Sources by code point, null last, weigh these whole numbers in turn."""

    def weigh(sources: DataFrame) -> DataFrame:
        named, null = sources.filter("source is not null"), sources.filter("source is null")
        ranked = numbered(named, ["source"], "rank").unionByName(null.withColumn("rank", F.lit(named.count()).cast("long")))
        of = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
        return ranked.withColumn("weight", of).drop("rank")

    return weigh


def water_level(sources: DataFrame, budget: int) -> Fraction | None:
    """Words for a weight of one, given (cap, weight) of each source; None if all are clamped."""
    level, clamped = None, -1
    while True:
        under = F.lit(False) if level is None else _product("cap", level.denominator) <= _product("weight", level.numerator)
        row = sources.agg(
            F.sum(F.when(under, F.col("cap"))).alias("caps"), F.sum(F.when(~under, F.col("weight"))).alias("weights"), F.count(F.when(under, 1)).alias("n")
        ).first()
        if not row.weights or row.n == clamped:
            return level if row.weights else None
        level, clamped = Fraction(max(0, budget - (row.caps or 0)), row.weights), row.n


def _product(column: str, factor: int) -> Column:
    return F.col(column).cast(_EXACT) * F.lit(str(factor)).cast(_EXACT)


def targets(sources: DataFrame, epochs: int, budget: int | None = None) -> DataFrame:
    """(source, size, weight) with `target`; weights are whole numbers. The budget is all sizes together unless it is given."""
    capped = sources.withColumn("cap", (F.col("size") * epochs).cast("long"))
    total = budget if budget is not None else capped.agg(F.sum("size").alias("s")).first().s or 0
    level = water_level(capped, total)
    if level is None:
        return capped.withColumn("target", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0)).cast("double")).drop("cap")
    share = F.col("weight").cast("double") * float(level.numerator) / float(level.denominator)
    return capped.withColumn("target", F.least(F.col("cap").cast("double"), share)).drop("cap")


def _chosen(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one source, a row for each class with its buckets in order and their words: the buckets below `upto` are taken once more."""
    frame = frame.sort_values("class", ascending=False)
    carry, upto = 0.0, []
    for buckets, words, part in zip(frame["buckets"], frame["words"], frame["part"], strict=True):
        want, taken, stop = float(part) * float(sum(words)) + carry, 0, 0
        for bucket, w in zip(buckets, words, strict=True):
            if w <= 0 or taken + w - want >= want - taken:  # no words, or no nearer with this bucket than without it
                break
            taken, stop = taken + int(w), int(bucket) + 1
        carry = want - taken
        upto.append(stop)
    return frame.assign(upto=upto)[["source", "class", "source_size", "target", "whole", "upto"]]


def mix_sources(
    df: DataFrame, weights: Callable[[DataFrame], DataFrame], epochs: int = 3, budget: int | None = None, seed: int = 1,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most: int = LOOKUP_BYTES,
) -> DataFrame:
    """(id_col, source, size, source_size, target, copies, taken) of each row: how often the mix takes it, and how many words these are.

    weights gets (source, size) of all sources and adds `weight`, a whole number.
    """
    ws = Workspace(df.sparkSession, "mix")
    draw = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("long")
    docs = ws.save(df.select(F.col(id_col), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), (draw % BUCKETS).cast("int").alias("bucket")))
    docs = docs.withColumn("class", F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(F.lit(0)))  # binary digits of the size
    cells = ws.save(docs.groupBy("source", "class", "bucket").agg(F.sum("size").alias("words")))
    sources = ws.save(weights(cells.groupBy("source").agg(F.sum("words").alias("size"))))
    aims = targets(sources, epochs, budget).withColumnRenamed("size", "source_size")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.withColumn("whole", F.least(F.floor(times), F.lit(epochs)).cast("int")).withColumn("part", F.when(F.col("whole") < epochs, times - F.col("whole")).otherwise(F.lit(0.0)))
    classes = cells.groupBy("source", "class").agg(F.array_sort(F.collect_list(F.struct("bucket", "words"))).alias("c")).select("source", "class", F.col("c.bucket").alias("buckets"), F.col("c.words").alias("words"))
    joined = attach(classes, ws, aims.select("source", "source_size", "target", "whole", "part"), ["source"], most)
    plan = joined.groupBy("source").applyInPandas(_chosen, "source string, class int, source_size long, target double, whole int, upto int")
    out = attach(docs, ws, plan, ["source", "class"], most)
    copies = (F.col("whole") + (F.col("bucket") < F.col("upto")).cast("int")).cast("int")
    return out.select(id_col, "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
