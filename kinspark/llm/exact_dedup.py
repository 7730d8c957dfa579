"""Exact dedup by a 128-bit content hash, with a comparison of the texts inside each group. Native: built-in functions only.

Hashes and ids are grouped first, so a shuffle carries no text. Where two rows share a hash, their texts are compared:
collect_set keeps the different texts of a group and, as it runs before the shuffle too, sends at most one copy of a
text per map task, however large the group. Which rows those are a bitmap of hashes tells, of MARKS bits whatever the
number of rows (a false mark sends a text that nobody needs). A group with a single text is whole; one with more (a
collision) is grouped again by the text itself.

Cases: a null text is an empty one; texts of any length are hashed whole; rows that repeat an id and a text count in
group_size and are kept or dropped alike; a null id loses to any other; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.workspace import Workspace

#: Bits of the bitmap of hashes that two rows have: 8 MB, broadcast in 2,048 parts.
MARKS = 1 << 26

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is. lower() is many times faster and the same where a text is ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", normalise=lower_ascii, hash_of=content_hash) -> DataFrame:
    """One row per row of df: (id_col, keep_id, group_size, kept, text_sha256). keep: "largest" or "smallest" id stays."""
    norm = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    ws = Workspace(df.sparkSession, "groups")
    base = df.select(F.col(id_col).alias("id"), norm.alias("norm")).withColumn("key", hash_of(F.col("norm")))
    best = F.max("id") if keep == "largest" else F.min("id")
    groups = ws.save(base.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best.alias("keep_id")))
    texts = _marked(base, groups.filter("n > 1").select("key"), ws).groupBy("key").agg(F.collect_set("norm").alias("texts"))
    clashes = ws.save(texts.filter(F.size("texts") > 1).select("key"))
    clash = not clashes.isEmpty()
    rows = base.select("id", "key", F.sha2("norm", 256).alias("text_sha256"))
    out = rows.join(groups.join(clashes, "key", "left_anti") if clash else groups, "key")
    if clash:
        own = base.join(clashes, "key", "left_semi").withColumn("text_sha256", F.sha2("norm", 256))
        by_text = own.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n"), best.alias("keep_id"))
        out = out.unionByName(own.join(by_text, ["key", "norm"]).drop("norm"))
    kept = F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), "text_sha256")


def _marked(base: DataFrame, keys: DataFrame, ws: Workspace) -> DataFrame:
    """Rows of base whose key's mark is set by one of keys; the bitmap is broadcast, its size does not depend on the data."""
    at = F.pmod(F.xxhash64("key"), F.lit(MARKS)) + 1  # positions of bitmap functions count from 1
    marks = keys.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("marks"))
    marks = ws.save(marks)
    bit = F.bitmap_bit_position(at)
    rows = base.withColumn("part", F.bitmap_bucket_number(at)).withColumn("bit", bit)
    found = rows.join(F.broadcast(marks), "part")
    byte = F.conv(F.hex(F.substr("marks", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return found.filter(F.getbit(byte, F.pmod("bit", F.lit(8)).cast("int")) == 1).select("key", "norm")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Rows of df that exact_dedup keeps, with all columns: each id once with each of its texts, null ids too."""
    def document(id_: str, sha: Column) -> Column:
        return F.struct(F.col(id_).alias("id"), sha.alias("sha"))  # nulls in a struct are equal; one key, so one shuffle

    kept = exact_dedup(df, id_col, text_col, keep).filter("kept").select(document(id_col, F.col("text_sha256")).alias("__kept")).distinct()
    own = df.withColumn("__own", document(id_col, F.sha2(lower_ascii(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)))
    return own.join(kept, F.col("__own") == F.col("__kept"), "left_semi").dropDuplicates(["__own"]).drop("__own")
