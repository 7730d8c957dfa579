"""Embedding near-dedup with an inverted multi-index.

The halves of the unit vectors have a codebook each; the pairs of codes form a grid of cells, and every vector is
listed in its own. A query visits cells in the order of their distance (multi-sequence traversal: a heap over the two
sorted lists of codes) as long as the distance exceeds that of its own cell by no more than a slack; what it finds
there is verified by the cosine in double precision, so no link is below the limit. A pair is found if either of its
vectors visits the cell of the other.

The slack is set, on the bounded sample that also trains the codebooks, so that TARGET of the pairs are found, both of
the linked pairs of the sample and of sample vectors turned by random angles up to the limit. Of grids that are coarser
by halves the one with the least work is taken, by the visits that sample vectors make: where vectors spread evenly in
many dimensions a fine grid would copy each to most of its cells. The index holds all rows.

Equal vectors are one class (its members link with each other, and count as many times in n_links). Lists longer than
BLOCK are cut into blocks, and the queries of a cell likewise, so a task holds two blocks at a time whatever the size
of a cell; a task returns sums of links and, for the components, one edge a vector and not the pairs.

Vectors of different lengths cannot link; each length that occurs in two classes or more has an index and a sample of
its own (and some jobs of its own: lengths are taken to be few).

Cases: a vector that is null, empty, all zero or has null or non-finite components links with nothing; ties and
repeated rows of an id are one node; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.common import thin
from kinspark.llm.components import connected_components
from kinspark.llm.workspace import Workspace

#: Share of pairs to find; rows of a cell in a list on average; rows of a block.
TARGET, PER_CELL, BLOCK = 0.96, 64, 2048
#: Bounds of the codes of one half: their squares are the cells of a grid, which grows with the rows up to some 10^9 of them.
LEAST_CODES, MOST_CODES = 4, 4096
#: Rows that train the codebooks and set the slack: so many, or so many for each code of a half.
SAMPLE, SAMPLE_PER_CODE = 8192, 16
#: Sample rows whose pairs are looked at together; steps of the slack, up to the most that two halves of unit vectors can need.
BLOCK_PAIRS, BINS, WIDEST = 64, 1 << 16, 8.0
#: Sample vectors whose visits are counted to choose the codes, and comparisons that a copy of a vector to a cell is as dear as.
TRIED, COPY = 256, 32


class MultiIndex:
    """Codebooks of the two halves and the slack of the traversal."""

    def __init__(self, vectors: np.ndarray, codes: int, limit: float, target: float = TARGET, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.half = vectors.shape[1] // 2
        self.books = [_k_means(part, codes, rng) for part in (vectors[:, : self.half], vectors[:, self.half :])]
        self.slack = self._slack(vectors, limit, target, rng)

    def distances(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to the codes of each half, less that of the nearest."""
        out = []
        for part, book in zip((v[:, : self.half], v[:, self.half :]), self.books, strict=True):
            d = (part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T
            out.append(d - d.min(1, keepdims=True))
        return out[0], out[1]

    def cells(self, d: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return d[0].argmin(1) * len(self.books[1]) + d[1].argmin(1)

    def extra(self, d: tuple[np.ndarray, np.ndarray], cells: np.ndarray) -> np.ndarray:
        """How much further than its own cell each vector has to a given cell."""
        at = np.arange(len(cells))
        return d[0][at, cells // len(self.books[1])] + d[1][at, cells % len(self.books[1])]

    def visits(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """Cells of one query, nearest first, within the slack (multi-sequence traversal)."""
        oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        heap, seen = [(a[oa[0]] + b[ob[0]], 0, 0)], {(0, 0)}
        while heap:
            d, i, j = heapq.heappop(heap)
            if d > self.slack:
                return
            yield int(oa[i]) * len(b) + int(ob[j])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(oa) and y < len(ob) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (a[oa[x]] + b[ob[y]], x, y))

    def _slack(self, v: np.ndarray, limit: float, target: float, rng) -> float:
        """Memory is that of BLOCK_PAIRS rows against the sample, whatever the codes and however many pairs link."""
        halves, size = (v[:, : self.half], v[:, self.half :]), len(self.books[1])
        least, own = np.empty((2, len(v))), np.empty((2, len(v)), np.int64)
        for s in range(0, len(v), BLOCK):
            for k, (part, book) in enumerate(zip(halves, self.books, strict=True)):
                d = (book**2).sum(1) - 2 * part[s : s + BLOCK] @ book.T
                own[k, s : s + BLOCK], least[k, s : s + BLOCK] = d.argmin(1), d.min(1)
        counts = np.zeros(BINS, np.int64)  # linked pairs by the slack they need, in steps of WIDEST / BINS
        for s in range(0, len(v), BLOCK_PAIRS):
            rows = slice(s, s + BLOCK_PAIRS)
            i, j = np.nonzero(v[rows] @ v.T >= limit)
            i, j = i[i + s < j], j[i + s < j]
            if len(i):
                there, back = np.zeros(len(i)), np.zeros(len(i))
                for k, (part, book) in enumerate(zip(halves, self.books, strict=True)):
                    d = (book**2).sum(1) - 2 * part[rows] @ book.T - least[k, rows, None]
                    there += d[i, own[k, j]]
                    mine = book[own[k, rows]]
                    d = (mine**2).sum(1) - 2 * part @ mine.T - least[k, :, None]
                    back += d[j, i]
                need = np.minimum(there, back)
                counts += np.bincount(np.clip(need * (BINS / WIDEST), 0, BINS - 1).astype(np.int64), minlength=BINS)
        found = (np.searchsorted(np.cumsum(counts), target * counts.sum()) + 1) * (WIDEST / BINS) if counts.any() else 0.0
        turned = []
        pick = rng.integers(0, len(v), 4096)
        for s in range(0, len(pick), 512):
            x = v[pick[s : s + 512]]
            z = rng.normal(size=x.shape)
            z -= (z * x).sum(1, keepdims=True) * x
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            c = rng.uniform(limit, 1, (len(x), 1))
            y = c * x + np.sqrt(1 - c * c) * z
            dx, dy = self.distances(x), self.distances(y)
            turned.append(np.minimum(self.extra(dx, self.cells(dy)), self.extra(dy, self.cells(dx))))
        return max(float(np.quantile(np.concatenate(turned), target)), float(found)) + 1e-9

    def mean_visits(self, v: np.ndarray, most: int) -> float:
        """Cells that a vector visits on average, counted up to `most` each."""
        a, b = self.distances(v)
        return float(np.mean([sum(1 for _ in itertools.islice(self.visits(x, y), most)) for x, y in zip(a, b, strict=True)]))


def chosen_index(vectors: np.ndarray, rows: int, limit: float) -> MultiIndex:
    """The index of the least work for so many rows, among codes from the finest grid (PER_CELL rows a cell) down by halves.

    Work is counted on TRIED sample vectors: each visited cell costs a copy of the vector, as dear as COPY comparisons,
    and a comparison with each of the cell's rows. It ends where coarser grids cost more.
    """
    codes = int(min(MOST_CODES, max(LEAST_CODES, 2 ** round(np.log2(max(1.0, np.sqrt(rows / PER_CELL)))))))
    best, least = None, np.inf
    while codes >= LEAST_CODES:
        index = MultiIndex(vectors, min(codes, len(vectors)), limit)
        cell = rows / codes**2
        tried = vectors[:: max(1, len(vectors) // TRIED)][:TRIED]
        most = codes * codes if not np.isfinite(least) else int(least / (COPY + cell)) + 1
        work = index.mean_visits(tried, min(most, codes * codes)) * (COPY + cell)
        if work >= least:
            break
        best, least = index, work
        codes //= 2
    return best


def _k_means(part: np.ndarray, codes: int, rng, rounds: int = 15) -> np.ndarray:
    book = part[rng.choice(len(part), min(codes, len(part)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([((book**2).sum(1) - 2 * part[s : s + 2048] @ book.T).argmin(1) for s in range(0, len(part), 2048)])
        count = np.bincount(near, minlength=len(book))
        sums = np.zeros_like(book)
        np.add.at(sums, near, part)
        book[count > 0] = sums[count > 0] / count[count > 0, None]
    return book


def _units(v: np.ndarray) -> np.ndarray:
    """Rows at unit length, NaN for a row without one. Divided by the largest component before squaring, so neither very
    large nor very small vectors lose their length."""
    v = v.astype(np.float64)
    largest = np.abs(v).max(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(np.isfinite(largest) & (largest > 0), v / largest, np.nan)
    return v / np.sqrt((v * v).sum(1, keepdims=True)) + 0.0


def _matrix(column, dim: int, kind: str) -> np.ndarray:
    """Unit vectors of a column of raw components."""
    return _units(np.frombuffer(b"".join(x.as_py() for x in column), kind).reshape(-1, dim))


def _unit_rows(kind: str):
    """(id, key, dim, vec) of rows (id, v) that have a length and finite components only: vec holds the components as
    they came, key is a digest of the unit vector."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.binary()), ("dim", pa.int32()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                sizes = np.diff(part.column(1).offsets.to_numpy())
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
                starts = np.cumsum(sizes) - sizes
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    v = flat[starts[at][:, None] + np.arange(size)].astype(kind)
                    u = _units(v)
                    good = np.isfinite(u).all(1)
                    keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in u[good]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[good])), pa.array(keys, pa.binary()), pa.array(np.full(len(keys), size, np.int32)), pa.array([x.tobytes() for x in v[good]], pa.binary())], schema=schema)

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, for links between positions."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_duplicates(df: DataFrame, limit: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of df: (id_col, n_links, component_id, kept)."""
    spark = df.sparkSession
    ws = Workspace(spark, "vectors")
    kind = "<f4" if dict(df.dtypes)[vector_col] == "array<float>" else "<f8"  # float components travel as they came
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    unit = ws.save(rows.filter("id is not null and size(v) > 0").mapInArrow(thin(_unit_rows(kind)), "id long, key binary, dim int, vec binary"))
    ids = unit.select("id", "key", "dim").distinct()
    sizes = ws.save(ids.groupBy("key", "dim").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m")))
    lengths = {r.dim: r["count"] for r in sizes.groupBy("dim").count().collect()}
    counts, edges = spark.createDataFrame([], "node long, links long"), spark.createDataFrame([], "a long, b long")
    for dim, n in sorted(lengths.items()):
        if n < 2:
            continue
        # one row of each class: its smallest id's
        own = unit.filter(F.col("dim") == dim).join(sizes.select("key", "dim", F.col("rep").alias("id"), "m"), ["key", "dim", "id"]).groupBy("id", "m").agg(F.min("vec").alias("vec"))
        many = max(SAMPLE, SAMPLE_PER_CODE * min(MOST_CODES, int(np.sqrt(n / PER_CELL)) + 1))
        sample = own.orderBy(F.xxhash64("id"), "id").limit(many).select("vec").collect()
        vectors = _units(np.frombuffer(b"".join(bytes(r.vec) for r in sample), kind).reshape(-1, dim))
        index = chosen_index(vectors, n, limit)
        own_counts, own_edges = _search(own, index, limit, dim, kind, ws)
        counts, edges = counts.union(own_counts), edges.union(own_edges)
    members = ws.save(ids.join(sizes, ["key", "dim"]).select("id", "rep", "m"))
    ws.drop(unit)
    comps = connected_components(edges, ws)
    of_class = sizes.select("rep", "m").join(counts, F.col("rep") == F.col("node"), "left").join(comps.withColumnRenamed("node", "cnode"), F.col("rep") == F.col("cnode"), "left")
    of_class = of_class.select("rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("comp"))
    of_id = members.select("id", "rep").join(of_class, "rep").groupBy("id").agg(F.max("n_links").alias("found"), F.min("comp").alias("found_comp"))
    result = rows.select("id").join(of_id, "id", "left").select("id", F.coalesce("found", F.lit(0)).alias("n_links"), F.coalesce("found_comp", "id").alias("comp"))
    return ws.result(result.select(F.col("id").alias(id_col), F.col("n_links").cast("long"), F.col("comp").alias("component_id"), (F.col("id") == F.col("comp")).alias("kept")))


def _search(classes: DataFrame, index: MultiIndex, limit: float, dim: int, kind: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Links of each representative, (node, links), and edges (a, b) with the same components as all links found.

    A vector is kept once, with the cells it visits; a copy goes to each of them only when the cells are dealt. In its
    own cell the listed rows are the queries, too.
    """
    shared = classes.sparkSession.sparkContext.broadcast(index)
    placed_schema = pa.schema([("id", pa.int64()), ("m", pa.int64()), ("vec", pa.binary()), ("own", pa.int32()), ("others", pa.list_(pa.int32()))])

    def place(batches):
        index = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                d = index.distances(_matrix(part.column(2), dim, kind))
                own = index.cells(d)
                others = [[c for c in index.visits(a, b) if c != o] for a, b, o in zip(*d, own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own.astype(np.int32)), pa.array(others, pa.list_(pa.int32()))], schema=placed_schema)

    placed = ws.save(classes.select("id", "m", "vec").mapInArrow(thin(place), "id long, m long, vec binary, own int, others array<int>"))
    listed = placed.groupBy(F.col("own").alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
    asks = placed.select(F.explode("others").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("asks"))
    sizes = listed.join(asks, "cell", "left").select("cell", F.ceil(F.col("rows") / BLOCK).cast("int").alias("nr"), F.ceil(F.coalesce("asks", F.lit(0)) / BLOCK).cast("int").alias("nq"))
    each = placed.select("id", "m", "vec", "own", "others", F.explode(F.concat(F.array(F.struct(F.col("own").alias("cell"), F.lit(False).alias("query"))), F.transform("others", lambda c: F.struct(c.alias("cell"), F.lit(True).alias("query"))))).alias("c"))
    dealt = each.select("id", "m", "vec", "own", F.when(~F.col("c.query"), F.col("others")).alias("others"), "c.cell", "c.query").join(sizes, "cell")
    # listed rows are cut into nr blocks, which meet each other once and each of the nq blocks of queries
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("nr"))).cast("int")
    lists = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.struct(F.least(F.col("mine"), r).alias("r"), F.greatest(F.col("mine"), r).alias("q"), F.lit(False).alias("asked")))
    queries = F.when(F.col("nq") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("nq") - 1, F.lit(0))), lambda q: F.struct(F.col("mine").alias("r"), q.alias("q"), F.lit(True).alias("asked")))).otherwise(F.array().cast("array<struct<r:int,q:int,asked:boolean>>"))
    asking = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda r: F.struct(r.alias("r"), F.col("mine").alias("q"), F.lit(True).alias("asked")))
    dealt = dealt.withColumn("mine", mine).withColumn("g", F.explode(F.when(F.col("query"), asking).otherwise(F.concat(lists, queries))))
    out_schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(key, group):
        block = key[0].as_py()
        among = not block["asked"]
        ask = group.column("query").to_numpy()
        ids, m, own = (group.column(x).to_numpy() for x in ("id", "m", "own"))
        u = _matrix(group.column("vec"), dim, kind)
        if among:  # one block, or two that meet: a pair is looked at where its first row is in the first block
            blocks = group.column("mine").to_numpy()
            q, r = np.flatnonzero(blocks == block["r"]), np.flatnonzero(blocks == block["q"])
        else:
            q, r = np.flatnonzero(ask), np.flatnonzero(~ask)
        if not len(q) or not len(r):
            return out_schema.empty_table()
        links = np.zeros(len(ids), np.int64)
        if not among:  # whether a listed row visits the cell that a query is listed in
            cells, cell_of = np.unique(own, return_inverse=True)
            visits = np.zeros((len(r), len(cells)), bool)
            for n, x in enumerate(r.tolist()):
                visits[n] = np.isin(cells, group.column("others")[x].as_py())
        pairs_q, pairs_r = [], []
        for s in range(0, len(q), 512):
            part = q[s : s + 512]
            i, j = np.nonzero(u[part] @ u[r].T >= limit)
            a, b = part[i], r[j]
            if among:  # within one block each pair is seen twice
                keep = ids[a] < ids[b] if block["r"] == block["q"] else np.ones(len(a), bool)
            else:  # a pair whose rows visit each other's cells is met twice, too: it counts where the smaller id asks
                keep = ~visits[j, cell_of[a]] | (ids[a] < ids[b])
            a, b = a[keep], b[keep]
            np.add.at(links, a, m[b])
            np.add.at(links, b, m[a])
            pairs_q.append(a)
            pairs_r.append(b)
        a, b = np.concatenate(pairs_q), np.concatenate(pairs_r)
        nodes, place = np.unique(ids, return_inverse=True)
        root = nodes[_roots(len(nodes), place[a], place[b])]
        total = np.bincount(place, links, len(nodes)).astype(np.int64)
        keep = np.zeros(len(nodes), bool)
        keep[np.concatenate([place[a], place[b]])] = True
        return pa.table([pa.array(nodes[keep]), pa.array(total[keep]), pa.array(root[keep])], schema=out_schema)

    # one key of all four: by the cell alone, which the join has dealt the rows by, all blocks of a cell would meet in one task
    block = F.struct("cell", F.col("g.r").alias("r"), F.col("g.q").alias("q"), F.col("g.asked").alias("asked")).alias("block")
    found = ws.save(dealt.select(block, "query", "mine", "id", "m", "own", "others", "vec").groupBy("block").applyInArrow(compare, "node long, links long, root long"))
    ws.drop(placed)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    return counts, found.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
