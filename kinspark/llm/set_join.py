"""N-gram Jaccard join by set relations: skipping in position-ordered index lists, and answers taken over from similar sets.

Two sets of shingles link when 100 * |x & y| >= percent * |x | y|. The join is exact:

1. A set's shingles are put in one order for all sets, rare first; the order comes from a sketch of counts over all
   documents, of a fixed size, whose errors only cost time. Linked sets share a shingle within a short head of both.
2. An index list of a shingle is cut into blocks by set size, and each entry carries its position. A set visits only
   the blocks of sizes that can link with its own, and skips each entry whose position leaves too few shingles for the
   overlap that the sizes ask for. A bitmap of each set then bounds the difference of a pair from below.
3. Equal sets are one class. Each block first compares its members with a few of them (hubs) only. A set that links
   with a hub takes over the hub's component, the answer of a set highly similar to it, so pairs within a component
   are never looked at: a family of m near copies costs some m comparisons instead of m * m. What remains between
   different components is compared in full; no pair is dropped and no list is capped.

Cases: null and empty texts have empty sets and link with nothing; a text of fewer words than a shingle is one shingle;
texts are read whole; rows that repeat an id and a text give repeated rows; an id with several texts links what any of
them links; a null id links with nothing (component null); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import slices_of, thin
from kinspark.llm.components import connected_components
from kinspark.llm.shingles import mix, shingle_sets
from kinspark.llm.workspace import Workspace

#: Counters of the sketch of shingle counts, as a power of two; its broadcast has a byte for each.
SKETCH_BITS = 22
#: Bits of the filter that tells the scan which documents' sets are asked for, as a power of two: 8 MB.
FILTER_BITS = 26
#: 64-bit words of a set's bitmap.
BITMAP_WORDS = 16
#: Members of a block, on average, that its members of other components are compared with, round by round.
HUBS = (4, 16, 64)
#: Bytes of texts, and index entries, that a task holds at a time; counters in a part of the sketch.
_CHARS, _ENTRIES, _CHUNK = 1 << 18, 250_000, 1 << 16
_U = np.uint64


def _sets(batches: Iterator[pa.RecordBatch], width: int, wanted=None) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, shingle sets), a block of texts at a time."""
    for batch in batches:
        for keys, texts in slices_of(batch, "k", "t"):
            ids, held, size = [], [], 0
            for key, text in zip(keys, texts, strict=True):
                if wanted is not None and not wanted(key):
                    continue
                raw = (text or "").encode("utf-8", "replace")
                ids.append(key)
                held.append(raw)
                size += len(raw)
                if size >= _CHARS:
                    yield ids, shingle_sets(held, width)
                    ids, held, size = [], [], 0
            if ids:
                yield ids, shingle_sets(held, width)


def _bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the set's members on each bit: the bits in which two bitmaps differ are at most the members that differ."""
    bits = BITMAP_WORDS * 64
    odd = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _describe(width: int):
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("bits", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for ids, sets in _sets(batches, width):
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            bits = [_bitmap(s) for s in sets]
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
            for x in sets:
                np.add.at(sketch, x >> _U(64 - SKETCH_BITS), np.uint32(1))
        for c in range(0, len(sketch), _CHUNK):
            part = sketch[c : c + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:4]), pa.array([c // _CHUNK], pa.int32()), pa.array([zlib.compress(part.astype("<u4").tobytes(), 1)])], schema=schema)

    return run, "doc long, n long, print binary, bits array<long>, chunk int, counts binary"


def _levels(described: DataFrame) -> bytes:
    """A byte for each counter of the sketch: its rank among rare and frequent, on a scale of logarithms."""

    def add(key, table):
        total = np.zeros(_CHUNK, np.int64)
        for blob in table.column("counts"):
            total += np.frombuffer(zlib.decompress(blob.as_py()), "<u4")
        level = np.minimum(255, np.log2(total + 1) * 6).astype(np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "level": pa.array([level.tobytes()], pa.binary())})

    out = bytearray(1 << SKETCH_BITS)
    for row in described.filter("chunk is not null").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, level binary").collect():
        out[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = row.level
    return bytes(out)


_ENTRY = np.dtype([("token", "<u8"), ("doc", "<i8"), ("n", "<i4"), ("pos", "<i4")])


def _heads(width: int, percent: int, levels, parts: int):
    """Index entries of the heads of all sets, dealt by shingle.

    Entries of shingles that a task has met twice are certain to be of use and are dealt evenly (part >= parts) with
    one marker (position -1) where the shingle belongs, so no part gets more than an entry per task for a frequent shingle.
    """
    schema = pa.schema([("part", pa.int32()), ("entries", pa.binary())])

    def flush(found: list[np.ndarray], turn: int) -> Iterator[pa.RecordBatch]:
        e = np.concatenate(found)
        e = e[np.argsort(e["token"], kind="stable")]
        token = e["token"]
        same = token[1:] == token[:-1]
        many = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        first = many & ~np.concatenate([[False], same])
        marker = e[first].copy()
        marker["pos"] = -1
        even = e[many]
        alone = np.concatenate([e[~many], marker])
        where = (mix(alone["token"]) % _U(parts)).astype(np.int64)
        spread = parts + (np.arange(len(even)) // 4096 + turn) % parts
        for rows, part in ((alone, where), (even, spread)):
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            if len(cuts):
                blobs = [rows[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(rows)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], schema=schema)

    def run(batches):
        level = np.frombuffer(levels.value, np.uint8)
        found: list[np.ndarray] = []
        size = 0
        met: set[bytes] = set()
        for ids, sets in _sets(batches, width, lambda k: k is not None):
            for doc, s in zip(ids, sets, strict=True):
                n = len(s)
                if not n:
                    continue
                own = xxhash.xxh3_128_digest(s.tobytes())
                if own in met:
                    continue  # an equal set of this task stands for it
                if len(met) < 500_000:
                    met.add(own)
                head = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, level[(s >> _U(64 - SKETCH_BITS)).astype(np.int64)]))[:head]
                e = np.empty(len(order), _ENTRY)
                e["token"], e["doc"], e["n"], e["pos"] = s[order], doc, n, np.arange(len(order))
                found.append(e)
                size += len(e)
            if size >= _ENTRIES:
                yield from flush(found, int(found[0]["token"][0] % _U(parts)))
                found, size = [], 0
        if found:
            yield from flush(found, int(found[0]["token"][0] % _U(parts)))

    return run, "part int, entries binary"


def _shared(parts: int):
    """Entries of shingles that occur in two sets or more."""

    def run(key, table):
        e = np.frombuffer(b"".join(b.as_py() for b in table.column("entries")), _ENTRY)
        if key[0].as_py() < parts:
            e = e[np.argsort(e["token"], kind="stable")]
            same = e["token"][1:] == e["token"][:-1]
            e = e[(np.concatenate([same, [False]]) | np.concatenate([[False], same])) & (e["pos"] >= 0)] if len(e) else e
        return pa.table({"token": e["token"].view("<i8"), "doc": e["doc"], "n": e["n"], "pos": e["pos"]})

    return run, "token long, doc long, n int, pos int"


def _wanted_filter(ids: DataFrame) -> bytes:
    """A bit for the hash of each id, in an array of fixed size; a false hit costs a set that nobody asks for."""

    def run(batches):
        bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for batch in batches:
            h = (mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)) >> _U(64 - FILTER_BITS)).astype(np.int64)
            np.bitwise_or.at(bits, h >> 3, (1 << (h & 7)).astype(np.uint8))
        for c in range(0, len(bits), _CHUNK):
            if bits[c : c + _CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([c // _CHUNK], pa.int32()), pa.array([zlib.compress(bits[c : c + _CHUNK].tobytes(), 1)])], names=["chunk", "bits"])

    def join(key, table):
        total = np.zeros(_CHUNK, np.uint8)
        for blob in table.column("bits"):
            total |= np.frombuffer(zlib.decompress(blob.as_py()), np.uint8)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    out = bytearray(1 << (FILTER_BITS - 3))
    for row in ids.mapInArrow(thin(run), "chunk int, bits binary").groupBy("chunk").applyInArrow(join, "chunk int, bits binary").collect():
        out[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = zlib.decompress(row.bits)
    return bytes(out)


def _sets_of(picked: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, shingles) of the documents among ids, from a scan of the texts."""
    wanted = picked.sparkSession.sparkContext.broadcast(_wanted_filter(ids))

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)

        def hit(k) -> bool:
            if k is None:
                return False
            h = int(mix(np.array([k], np.int64).view(_U))[0]) >> (64 - FILTER_BITS)
            return bool(bits[h >> 3] >> (h & 7) & 1)

        for found, sets in _sets(batches, width, hit):
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc", "shingles"])

    return picked.mapInArrow(thin(run), "doc long, shingles array<long>")


def _overlap(percent: int):
    """The least overlap with which sets of nx and ny shingles link."""
    total = F.col("nx") + F.col("ny")
    return F.ceil(total * percent / F.lit(100.0 + percent) - 1e-9)


def _may_link(percent: int):
    """By size and by position: what stands at or behind the shared shingle must suffice."""
    small, large = F.least("nx", "ny"), F.greatest("nx", "ny")
    rest = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py"))
    return (small * 100 >= large * percent) & (rest >= _overlap(percent))


def _blocks(entries: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Entries by block (shingle, size class), in the roles they play there; comp is the component so far."""
    step = math.log(100 / (percent - 1))  # a little wide, so that sizes that may link are one class apart at most
    size_class = F.floor(F.log("n") / step).cast("int")
    index_head = F.col("n") - F.ceil(F.col("n") * 2 * percent / F.lit(100.0 + percent) - 1e-9) + 1
    # what stands at or behind the position bounds the size of a set that it may link with: blocks of larger sets are skipped
    largest = (F.col("n") - F.col("pos")) * F.lit((100.0 + percent) / percent) - F.col("n")
    roles = F.array(
        F.when(F.exp(size_class * F.lit(step)) <= largest + 1, F.struct(size_class.alias("cls"), F.lit(False).alias("indexed"))),
        F.struct((size_class - 1).alias("cls"), F.lit(False).alias("indexed")),
        F.when(F.col("pos") < index_head, F.struct(size_class.alias("cls"), F.lit(True).alias("indexed"))),
    )
    e = entries.join(labels, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    return e.select("token", "doc", "n", "pos", "comp", F.explode(F.filter(roles, lambda r: r.isNotNull())).alias("r")).select("token", "r.cls", "r.indexed", "doc", "n", "pos", "comp")


def _mixed(blocks: DataFrame, above: int) -> DataFrame:
    """Blocks of more than `above` members that hold several components, with the number m of their members."""
    sizes = blocks.filter("not indexed").groupBy("token", "cls").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("m"))
    return sizes.filter((F.col("c0") != F.col("c1")) & (F.col("m") > above)).select("token", "cls", "m")


def _hub_pairs(blocks: DataFrame, mixed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Members of mixed blocks with hubs of other components; a member is a hub by the hash of its id.

    In a block of no more members than a turn has hubs all are, so that block is done with. Whatever stands in a block
    in the role of an index entry stands there as a member too.
    """
    rows = blocks.filter("not indexed").join(mixed, ["token", "cls"])
    share = F.pmod(F.xxhash64("doc", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    hubs = rows.filter(share < F.lit(float(HUBS[turn])) / F.col("m")).select("token", "cls", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("comp").alias("cx"))
    other = rows.select("token", "cls", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"))
    return hubs.join(other, ["token", "cls"]).filter("cx <> cy").filter(_may_link(percent)).select("x", "nx", "px", "y", "ny", "py")


def _all_pairs(blocks: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """Every pair between components that a mixed block can hold: members outside its largest component, with all members."""
    rows = blocks.join(mixed.select("token", "cls"), ["token", "cls"])
    largest = rows.groupBy("token", "cls", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("token", "cls").agg(F.max_by("comp", "m").alias("main"))
    rows = rows.join(largest, ["token", "cls"])
    minor = rows.filter("comp <> main").select("token", "cls", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("comp").alias("cx"), F.col("indexed").alias("ix"))
    other = rows.select("token", "cls", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("comp").alias("cy"), F.col("indexed").alias("iy"))
    ordered = F.when(F.col("ix"), F.col("nx") <= F.col("ny")).otherwise(F.col("ny") <= F.col("nx"))
    return minor.join(other, ["token", "cls"]).filter("cx <> cy and ix <> iy").filter(ordered).filter(_may_link(percent)).select("x", "nx", "px", "y", "ny", "py")


def _different(pairs: DataFrame) -> DataFrame:
    """Different (a, b). As one key: by both columns Spark would leave the rows where a join on b has dealt them, and could
    not split the task of a hub with very many pairs."""
    return pairs.select(F.struct("a", "b").alias("p")).distinct().select("p.a", "p.b")


def _links(pairs: DataFrame, prints: DataFrame, tested: DataFrame | None, picked: DataFrame, width: int, percent: int, ws: Workspace) -> tuple[DataFrame, DataFrame] | None:
    """(pairs that were compared, those that link); None if there was nothing to compare."""
    a = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    if tested is not None:
        a = a.join(tested, ["a", "b"], "left_anti")
    bits_a = prints.select(F.col("doc").alias("a"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    bits_b = prints.select(F.col("doc").alias("b"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    differ = F.aggregate(F.zip_with("bx", "by", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    a = ws.save(_different(a.join(bits_a, "a").join(bits_b, "b").filter(differ <= F.col("nx") + F.col("ny") - 2 * _overlap(percent))))
    if a.isEmpty():
        ws.drop(a)
        return None
    sets = _sets_of(picked, a.select("a").union(a.select("b")).distinct(), width)
    sa, sb = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    both = a.select("a", "b").join(sa, "a").join(sb, "b").withColumns({"nx": F.size("sa"), "ny": F.size("sb")})
    linked = ws.save(_different(both.filter(F.size(F.array_intersect("sa", "sb")) >= _overlap(percent))))
    return a, linked


def jaccard_components(df: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: (id_col, n_shingles, component_id), the smallest id that links reach."""
    spark = df.sparkSession
    ws = Workspace(spark, "sets")
    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    run, ddl = _describe(width)
    described = ws.save(picked.mapInArrow(thin(run), ddl))
    levels = spark.sparkContext.broadcast(_levels(described))
    docs = described.filter("chunk is null").select("doc", "n", "print", "bits")
    known = docs.filter("doc is not null and n > 0")
    classes = ws.save(known.groupBy("print", "n").agg(F.min("doc").alias("rep"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("m")))
    prints = classes.select(F.col("rep").alias("doc"), F.col("n").cast("int").alias("n"), "bits")
    members_of = ws.save(known.select("doc", "print", "n").join(classes.select("print", "n", "rep"), ["print", "n"]).select("doc", F.col("n").cast("int").alias("n"), "rep").distinct())
    members = members_of.filter("doc <> rep")

    shingles = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(shingles * (100 - percent) / 100 / _ENTRIES) + 1)
    run, ddl = _heads(width, percent, levels, parts)
    shared, shared_ddl = _shared(parts)
    entries = picked.mapInArrow(thin(run), ddl).groupBy("part").applyInArrow(shared, shared_ddl)
    entries = entries.join(members, ["doc", "n"], "left").withColumn("doc", F.coalesce("rep", "doc")).drop("rep")
    entries = ws.save(entries.groupBy("token", "doc").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))

    # an id with several texts links their classes
    many = members_of.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").drop("z")
    links = ws.save(many.join(members_of, "doc").select("a", F.col("rep").alias("b")).filter("a <> b"))
    labels = spark.createDataFrame([], "node long, comp long")
    tested: DataFrame | None = None
    stale = True
    for turn in range(len(HUBS) + 1):
        blocks = _blocks(entries, labels.select(F.col("node").alias("doc"), "comp"), percent)
        mixed = ws.save(_mixed(blocks, HUBS[turn - 1] if turn else 1))
        if mixed.isEmpty():
            break
        pairs = _hub_pairs(blocks, mixed, percent, turn) if turn < len(HUBS) else _all_pairs(blocks, mixed, percent)
        found = _links(pairs, prints, tested, picked, width, percent, ws)
        ws.drop(mixed)
        if found is not None:
            new, linked = found
            tested = new.select("a", "b") if tested is None else tested.union(new.select("a", "b"))
            links = links.union(linked)
            labels, stale = ws.save(connected_components(links, ws)), False
    if stale:
        labels = connected_components(links, ws)
    return ws.result(_with_components(docs, classes, labels).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), "component_id"))


def _with_components(docs: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    known = docs.filter("doc is not null and n > 0").join(classes.select("print", "n", "rep"), ["print", "n"])
    linked = known.join(labels, F.col("rep") == F.col("node"), "left").select("doc", "n", F.coalesce("comp", "rep").alias("component_id"))
    return linked.unionByName(docs.filter("doc is null or n = 0").select("doc", "n", F.col("doc").alias("component_id")))


def drop_near_copies(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of df without the near copies: of each component the row with the smallest id stays, a null id after all others.

    Where ids are null or have several texts, each (id, text) is a document of its own, numbered in the order of ids.
    """
    mark = F.xxhash64(F.col("__text"))
    picked = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    unclear = picked.groupBy("__id").agg(F.min(mark).alias("__a"), F.max(mark).alias("__z")).filter("__id is null or __a <> __z")
    if unclear.isEmpty():
        kept = jaccard_components(df, width, percent, id_col, text_col).filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept_id")).distinct()
        return df.join(kept, F.col(id_col) == F.col("__kept_id"), "left_semi")
    ws = Workspace(df.sparkSession, "numbered")
    marked = df.withColumn("__sha", F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
    names = marked.select(F.col(id_col).alias("__id"), F.col("__sha").alias("__own")).distinct()
    names = ws.save(names.orderBy(F.col("__id").asc_nulls_last(), "__own").withColumn("__key", F.monotonically_increasing_id()))
    numbered = ws.save(marked.join(names, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__own"))).drop("__id", "__own", "__sha"))
    kept = jaccard_components(numbered, width, percent, "__key", text_col).filter("__key = component_id").select(F.col("__key").alias("__kept_key")).distinct()
    return numbered.join(kept, F.col("__key") == F.col("__kept_key"), "left_semi").drop("__key")
