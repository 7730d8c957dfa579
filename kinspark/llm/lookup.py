"""Small tables by key beside large ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.workspace import Workspace

#: Measured bytes up to which a table of one row for each key is broadcast; parts that a key is dealt into beyond that.
LOOKUP_BYTES, SALTS = 4 << 20, 32


def attach(df: DataFrame, ws: Workspace, table: DataFrame, keys: list[str], most: int = LOOKUP_BYTES) -> DataFrame:
    """df with the other columns of table, which has a row for each key (a null is a key like any other); without one they are null.

    table is written once and measured. Up to `most` bytes it is broadcast. Beyond, both sides meet by key and a salt
    that splits each key into SALTS parts, so one that holds a third of all rows is no single task.
    """
    small = ws.save(table)
    width = sum((F.coalesce(F.octet_length(n), F.lit(0)) if t == "string" else F.lit(8) for n, t in small.dtypes), F.lit(16))
    size = small.agg(F.sum(width).alias("b")).first().b or 0
    rest = [c for c in small.columns if c not in keys]
    renamed = small.select(*(F.col(k).alias(f"__{k}") for k in keys), *rest)
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    if size <= most:
        return df.join(F.broadcast(renamed), on, "left").drop(*(f"__{k}" for k in keys))
    dealt = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int"))
    spread = renamed.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
    return dealt.join(spread, [*on, F.col("__part") == F.col("__salt")], "left").drop("__part", "__salt", *(f"__{k}" for k in keys))
