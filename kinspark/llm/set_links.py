"""The links themselves of the n-gram Jaccard join, where components are not enough; answers follow from a similar set's.

Candidates come from the position-ordered blocks of kinspark.llm.set_join. Each set has the hub of its neighbourhood, the
candidate whose hash is smallest. Overlaps are first computed for the hubs alone: these are the hubs' answers. Another
set x differs from its hub h in d = |h - x| and e = |x - h| shingles, so its overlap with any y that h was compared with
lies between |h & y| - d and |h & y| + e: a link that the lower bound proves, or that the upper bound excludes, is taken
over from h's answer, and only what the bounds of both ends leave open is computed from the sets.

Sets are equal for rows with equal shingles: links are between one representative of each (the smallest id), and the
members are given beside them, so copies are not expanded into pairs. No link between different sets is lost. A family
of m different near copies has up to m * m / 2 links, and so many rows: where components are enough, jaccard_components()
looks at some m pairs of it.

Cases: null and empty texts have empty sets, rows with a null id have no name, and neither is a member of anything; short
texts are one shingle; rows that repeat an id and a text count once; an id with several texts is a member for each, and
each (id, text) then is a set of its own; an empty table has no links and no members; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm import set_join as sj
from kinspark.llm.common import thin
from kinspark.llm.workspace import Workspace


def _keyed(df: DataFrame, id_col: str, text_col: str, ws: Workspace) -> DataFrame:
    """(k, t, id): a number for each id, or for each (id, text) where an id has several texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t")).filter("id is not null").withColumn("mark", F.xxhash64("t"))
    several = rows.groupBy("id").agg(F.min("mark").alias("a"), F.max("mark").alias("z")).filter("a <> z")
    if several.isEmpty():
        return rows.select(F.col("id").cast("long").alias("k"), "t", "id")
    rows = rows.withColumn("sha", F.sha2("t", 256))
    names = ws.save(rows.select("id", "sha").distinct().orderBy("id", "sha").withColumn("k", F.monotonically_increasing_id()))
    return ws.save(rows.join(names, ["id", "sha"]).select("k", "t", "id"))


def _candidates(blocks: DataFrame, prints: DataFrame, percent: int) -> DataFrame:
    """(a, b, nx, ny) of different sets that sizes, positions and bitmaps allow to link."""
    x = blocks.filter("indexed").select("token", "cls", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"))
    y = blocks.filter("not indexed").select("token", "cls", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
    pairs = x.join(y, ["token", "cls"]).filter("x <> y and nx <= ny").filter(sj._may_link(percent))
    pairs = sj._different(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    bits_a = prints.select(F.col("doc").alias("a"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    bits_b = prints.select(F.col("doc").alias("b"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    differ = F.aggregate(F.zip_with("bx", "by", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    return pairs.join(bits_a, "a").join(bits_b, "b").filter(differ <= F.col("nx") + F.col("ny") - 2 * sj._overlap(percent)).select("a", "b", "nx", "ny")


def _overlaps(pairs: DataFrame, picked: DataFrame, width: int, ws: Workspace) -> DataFrame:
    """pairs with the overlap o of their sets, which are made from the texts again."""
    sets = sj._sets_of(picked, pairs.select("a").union(pairs.select("b")).distinct(), width).dropDuplicates(["doc"])
    sa, sb = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    return ws.save(pairs.join(sa, "a").join(sb, "b").withColumn("o", F.size(F.array_intersect("sa", "sb"))).drop("sa", "sb"))


def jaccard_links(df: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members). links: (a, b, derived), each pair of linked sets once; derived tells that a similar set's answer
    gave it. members: (id_col, set_id) of the rows of each set."""
    spark = df.sparkSession
    ws = Workspace(spark, "links")
    keyed = _keyed(df, id_col, text_col, ws)
    picked = keyed.select("k", "t")
    run, ddl = sj._describe(width)
    described = ws.save(picked.mapInArrow(thin(run), ddl))
    levels = spark.sparkContext.broadcast(sj._levels(described))
    known = described.filter("chunk is null and n > 0").select("doc", F.col("n").cast("int").alias("n"), "print", "bits")
    classes = ws.save(known.groupBy("print", "n").agg(F.min("doc").alias("rep"), F.first("bits").alias("bits")))
    prints = classes.select(F.col("rep").alias("doc"), "n", "bits")
    member_of = ws.save(known.select("doc", "print", "n").join(classes.select("print", "n", "rep"), ["print", "n"]).select("doc", "rep").distinct())
    members = keyed.select("k", "id").distinct().join(member_of, F.col("k") == F.col("doc")).select(F.col("id").alias(id_col), F.col("rep").alias("set_id"))

    shingles = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(shingles * (100 - percent) / 100 / sj._ENTRIES) + 1)
    run, ddl = sj._heads(width, percent, levels, parts)
    shared, shared_ddl = sj._shared(parts)
    entries = picked.mapInArrow(thin(run), ddl).groupBy("part").applyInArrow(shared, shared_ddl)
    entries = entries.join(member_of, "doc").withColumn("doc", F.col("rep")).groupBy("token", "doc").agg(F.first("n").alias("n"), F.first("pos").alias("pos"))
    blocks = sj._blocks(ws.save(entries), spark.createDataFrame([], "doc long, comp long"), percent)
    found = ws.save(_candidates(blocks, prints, percent))

    both = found.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("ny").alias("n")).union(found.select("b", "a", "nx"))
    rank = F.struct(F.xxhash64("y").alias("r"), F.col("y").alias("h"), F.col("n").alias("nh"))
    own = both.groupBy("x").agg(F.min(rank).alias("hub")).filter(F.struct(F.col("hub.r"), F.col("hub.h")) < F.struct(F.xxhash64("x"), F.col("x")))
    hub_of = ws.save(own.select("x", "hub.h", "hub.nh"))
    hubs = hub_of.select("h").distinct()
    marked = found.join(hubs.select(F.col("h").alias("a"), F.lit(True).alias("ha")), "a", "left").join(hubs.select(F.col("h").alias("b"), F.lit(True).alias("hb")), "b", "left")
    marked = ws.save(marked.select("a", "b", "nx", "ny", F.coalesce("ha", "hb", F.lit(False)).alias("of_hub")))
    answers = _overlaps(marked.filter("of_hub").drop("of_hub"), picked, width, ws)

    needed = sj._overlap(percent)
    sides = answers.select(F.col("a").alias("h"), F.col("b").alias("y"), "o").union(answers.select("b", "a", "o"))
    near = hub_of.join(sides.withColumnRenamed("y", "x"), ["h", "x"]).select("x", "h", (F.col("nh") - F.col("o")).alias("d"), F.col("o").alias("own"))
    rest = marked.filter("not of_hub").drop("of_hub")
    for x, y, n in (("a", "b", "nx"), ("b", "a", "ny")):
        hub = near.select(F.col("x").alias(x), F.col("h").alias(f"h_{x}"), F.col("d").alias("d"), F.col("own").alias("own"))
        seen = sides.select(F.col("h").alias(f"h_{x}"), F.col("y").alias(y), "o")
        rest = rest.join(hub, x, "left").join(seen, [f"h_{x}", y], "left")
        rest = rest.withColumns({f"low_{x}": F.col("o") - F.col("d"), f"high_{x}": F.col("o") + F.col(n) - F.col("own")}).drop("o", "d", "own", f"h_{x}")
    low, high = F.coalesce(F.greatest("low_a", "low_b"), F.lit(0)), F.coalesce(F.least("high_a", "high_b"), F.least("nx", "ny"))
    rest = ws.save(rest.select("a", "b", "nx", "ny", low.alias("low"), high.alias("high")))
    left = _overlaps(rest.filter((F.col("low") < needed) & (F.col("high") >= needed)), picked, width, ws)
    computed = answers.select("a", "b", "nx", "ny", "o").union(left.select("a", "b", "nx", "ny", "o")).filter(F.col("o") >= needed)
    links = computed.select("a", "b", F.lit(False).alias("derived")).union(rest.filter(F.col("low") >= needed).select("a", "b", F.lit(True)))
    return links, members
