"""Approximate nearest neighbours: a database kept by cells of a codebook, searched in the few cells nearest to a query.

An index is a Parquet table partitioned by its keys and by cell, and a table of cells: for each set of keys (a view and a
scale, say) a codebook of its own, with each cell's center, rows and reach (the largest distance of a row from its
center), and the number of cells to probe. A bounded sample trains the codebook; up to TRIED further rows are queries whose exact
neighbours among all rows are found by brute force, and so many cells are probed that these queries find TARGET of their
neighbours, and what chance may make of it besides. All rows are indexed.

A search reads the partitions of the cells that its queries ask for and no others: which these are is a bounded list, so
it goes into the scan as a filter on partitions. Rows and queries of a cell meet in blocks whose number follows from how
many of each that cell has, so a cell that holds a third of the rows, or that a third of the queries ask for, is many
groups. Where all cells are probed, those that fit a block are read together, so that a query is sent once for a block and
not once for a cell. `exact` adds a second search for the queries that need it: of the cells that were left out, those whose center
is not farther than the reach and the distance of the last neighbour found, by the triangle inequality; so nothing is
missed.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspark.operators.matching import best_in_groups, best_matches, plan_bytes
from kinspark.operators.matrices import matrix
from kinspark.sources.sinks import read_record, write_record

#: Share of neighbours to find; rows of a cell on average; bounds of the cells; most sets of keys.
TARGET, PER_CELL, LEAST_CELLS, MOST_CELLS, MOST_KEYS = 0.95, 256, 4, 4096, 256
#: Rows of the sample: so many, or so many for each cell; further rows that set the number of probes as queries, for one set of
#: keys and for all; standard errors by which what they find is to exceed the target.
SAMPLE, SAMPLE_PER_CELL, TRIED, TRIED_OF_ALL, SURE = 4096, 16, 1024, 32768, 3.0
#: Bytes of vectors of a cell's rows, and of the queries that ask for it, in a block.
BLOCK_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
_SLACK = 1e-6
#: Numbers that a task holds at a time for distances to centers, and for the vectors that it gives back.
CELLS = 1 << 20


@dataclass(frozen=True)
class Book:
    """Cells of one set of keys: centers, rows and reach of each, and how many a search probes."""

    centers: np.ndarray
    probe: int
    rows: np.ndarray
    reach: np.ndarray

    def units(self, probe: int | None) -> np.ndarray | None:
        """For each cell the number of the cells that are read together, where a search probes all of them."""
        if min(probe or self.probe, len(self.centers)) < len(self.centers):
            return None
        return ((np.cumsum(self.rows) - self.rows) * _row_bytes(self.centers) // BLOCK_BYTES).astype(np.int32)


@dataclass(frozen=True)
class AnnIndex:
    rows: DataFrame
    keys: list[str]
    books: dict[str, Book]

    @classmethod
    def fit(cls, database: DataFrame, folder: str, n: int = 3, target: float = TARGET, keys: list[str] | None = None) -> AnnIndex:
        """An index of database (desc_id, name, vec, other columns) in folder, for searches of n neighbours or so among
        rows with equal keys. A row without a vector or without a key is not indexed."""
        spark, keys = database.sparkSession, keys or []
        known = database.filter("vec is not null and size(vec) > 0").withColumn("vec", F.col("vec").cast("array<float>")).dropna(subset=keys)
        known = known.withColumn("__key", _key(keys))
        known = known.persist()  # read three times
        try:
            counts = dict(known.groupBy("__key").agg(F.count(F.lit(1))).limit(MOST_KEYS + 1).collect())
            if len(counts) > MOST_KEYS:
                raise ValueError(f"more than {MOST_KEYS} sets of keys")
            books, tried = {}, {}
            for key, (ids, v) in _samples(known, counts).items():
                trained = v[: _trained(counts[key])]
                centers = _codebook(trained, min(_cells(counts[key]), len(trained)))
                books[key] = Book(centers, 1, np.zeros(len(centers)), np.zeros(len(centers)))
                most = _tried(len(counts))
                tried[key] = ids[-most:], v[-most:]  # those that did not train the codebook, if there are such
            placed = _nearest(known, "vec", {k: (b.centers, 1) for k, b in books.items()})
            stored = placed.drop("__key").withColumnRenamed("__away", "away")
            stored.hint("rebalance", *keys, "cell").write.mode("overwrite").partitionBy(*keys, "cell").parquet(f"{folder}/rows")  # few files for each cell
        finally:
            known.unpersist()
        written = spark.read.schema(stored.schema).parquet(f"{folder}/rows")
        for r in written.groupBy(_key(keys).alias("key"), "cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("reach")).toArrow().to_pylist():  # a row for each cell
            books[r["key"]].rows[r["cell"]], books[r["key"]].reach[r["cell"]] = r["n"], r["reach"]
        probes = _probes(written.withColumn("__key", _key(keys)), tried, books, n, target)
        cells = [(k, i, c, probes[k], int(b.rows[i]), b.reach[i]) for k, b in books.items() for i, c in enumerate(b.centers)]
        names = ["key", "cell", "center", "probe", "rows", "reach"]
        kinds = [pa.string(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.int64(), pa.float64()]
        table = pa.table([pa.array([x[i] for x in cells], k) for i, k in enumerate(kinds)], names=names)
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        write_record(spark, f"{folder}/index", {"kind": "ann", "keys": keys, "schema": stored.drop("away").schema.json()})
        return cls.load(spark, folder)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> AnnIndex:
        record = read_record(spark, f"{folder}/index")
        if record.get("kind") != "ann":
            raise ValueError(f"no index in {folder}")
        found = spark.read.parquet(f"{folder}/cells").toArrow().sort_by([("key", "ascending"), ("cell", "ascending")])
        books, key = {}, np.array(found.column("key").to_pylist(), object)
        for k in dict.fromkeys(key):
            own = found.filter(pa.array(key == k))
            books[k] = Book(matrix(own.column("center").combine_chunks()), own.column("probe")[0].as_py(), *(own.column(c).to_numpy() for c in ("rows", "reach")))
        schema = T.StructType.fromJson(json.loads(record["schema"]))
        return cls(spark.read.schema(schema).parquet(f"{folder}/rows"), record["keys"], books)

    @property
    def centers(self) -> np.ndarray:
        """Of an index without keys."""
        return self.books[""].centers

    @property
    def probe(self) -> int:
        return self.books[""].probe

    def search(self, queries: DataFrame, n: int, keys: list[str] | None = None, probe: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, *keys, desc_id, name, dist, rk): as knn_join(), of the rows in the `probe` cells nearest to each
        query; exact, of all rows. keys: those of the index, or more columns that rows and queries share."""
        keys = list(dict.fromkeys([*self.keys, *(keys or [])]))
        asked = queries.filter("query_vec is not null").dropna(subset=self.keys).select("query_id", *keys, F.col("query_vec").cast("array<float>").alias("query_vec")).withColumn("__key", _key(self.keys))
        units = {k: b.units(probe) for k, b in self.books.items()}
        near = _nearest(asked, "query_vec", {k: (b.centers, min(probe or b.probe, len(b.centers))) for k, b in self.books.items()}, units).drop("__away")
        best = _first(self._meet(near, n, keys, units), keys, n)
        if not exact:
            return best
        bound = best.groupBy("query_id", *keys).agg(F.when(F.count(F.lit(1)) == n, F.max("dist")).alias("__bound"))
        left = asked.join(bound, ["query_id", *keys], "left")
        more = self._meet(_unread(left, self.books, probe), n, keys)
        return _first(best.drop("rk").unionByName(more.select(*best.drop("rk").columns)), keys, n)

    def _meet(self, asked: DataFrame, n: int, keys: list[str], units: dict[str, np.ndarray | None] | None = None) -> DataFrame:
        """The best n of each query in each block of the cells it asks for. asked: (query_id, *keys, query_vec, __key, cell),
        cell being a number of units where the key has those."""
        spark, units = asked.sparkSession, units or {}
        wanted = asked.groupBy("__key", "cell").agg(F.count(F.lit(1)).alias("n")).toArrow().to_pylist()  # a row for each cell
        plan, places = [], []
        for r in wanted:
            book, unit = self.books[r["__key"]], units.get(r["__key"])
            own = [r["cell"]] if unit is None else np.flatnonzero(unit == r["cell"]).tolist()
            size, rows = _row_bytes(book.centers), book.rows[own].sum()
            if rows:
                plan.append((r["__key"], r["cell"], int(rows * size // BLOCK_BYTES + 1), int(r["n"] * size // QUERY_BYTES + 1)))
                places += [(r["__key"], c, r["cell"]) for c in own]
        # of cells, at most MOST_CELLS for each set of keys
        blocks = F.broadcast(spark.createDataFrame(plan, "__key string, cell int, __parts int, __asks int"))
        units_of = F.broadcast(spark.createDataFrame(places, "__key string, __place int, cell int"))
        # the cells, and for each key its values, as filters on partitions
        rows = self.rows.filter(F.col("cell").isin(sorted({c for _, c, _ in places})) & _key(self.keys).isin(sorted({k for k, *_ in plan})))

        def dealt(df: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
            mine = F.pmod(F.xxhash64("id"), F.col(count)).cast("int")
            return df.join(blocks, ["__key", "cell"]).withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("__parts", "__asks")

        d = rows.select(*keys, F.col("cell").alias("__place"), _key(self.keys).alias("__key"), F.col("desc_id").cast("long").alias("id"), F.col("name").cast("string").alias("name"), "vec", F.lit(False).alias("side"))
        d = d.join(units_of, ["__key", "__place"]).select(*keys, "cell", "__key", "id", "name", "vec", "side")
        q = asked.select(*keys, "cell", "__key", F.col("query_id").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.col("query_vec").alias("vec"), F.lit(True).alias("side"))
        both = dealt(d, "db", "__parts", "ask", "__asks").unionByName(dealt(q, "ask", "__asks", "db", "__parts"))
        return best_in_groups(both, n, [*keys, "cell"]).drop("cell")


def _key(keys: list[str]) -> Column:
    """The values of the keys as one string."""
    return F.concat_ws("\x1f", *(F.col(k).cast("string") for k in keys)) if keys else F.lit("")


def _first(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    return found.withColumn("rk", F.row_number().over(Window.partitionBy("query_id", *keys).orderBy("dist", "desc_id"))).filter(F.col("rk") <= n)


def _cells(rows: int) -> int:
    return int(min(MOST_CELLS, max(LEAST_CELLS, 2 ** round(np.log2(max(1.0, rows / PER_CELL))))))


def _row_bytes(centers: np.ndarray) -> int:
    return 4 * centers.shape[1] + 32


def _trained(rows: int) -> int:
    return max(SAMPLE, SAMPLE_PER_CELL * _cells(rows))


def _tried(sets: int) -> int:
    return max(64, min(TRIED, TRIED_OF_ALL // sets))


def _samples(known: DataFrame, counts: dict[str, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of each set of keys: those with the smallest hashes of their ids, as many as train the codebook and are tried, or all."""
    wanted = {k: _trained(c) + _tried(len(counts)) for k, c in counts.items()}
    shares = {k: min(1.0, 1.1 * wanted[k] / c) for k, c in counts.items()}
    if not counts:
        return {}
    share = F.element_at(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv)), F.col("__key"))
    place = F.pmod(F.xxhash64("desc_id"), F.lit(1 << 30))
    found = known.filter(place < share * (1 << 30)).select("__key", "vec", place.alias("place"), "desc_id").toArrow().sort_by([("place", "ascending"), ("desc_id", "ascending")])
    key = np.array(found.column("__key").to_pylist(), object)
    out = {}
    for k in dict.fromkeys(key):
        own = found.filter(pa.array(key == k)).slice(0, wanted[k]).combine_chunks()
        out[k] = own.column("desc_id").to_numpy(), matrix(own.column("vec").combine_chunks())
    return out


def _squares(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances to the centers, but for what is the same for all of them."""
    return (centers**2).sum(1) - 2 * v @ centers.T


def _codebook(v: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centers of cells by Lloyd's rounds; a cell that nothing is nearest to keeps its center."""
    centers = v[np.random.default_rng(5).choice(len(v), cells, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([_squares(v[s : s + 2048], centers).argmin(1) for s in range(0, len(v), 2048)])
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        centers[used] = np.add.reduceat(v[order], first) / np.diff(np.append(first, len(v)))[:, None]
    return centers


def _first_cells(square: np.ndarray, probe: int) -> np.ndarray:
    """The `probe` cells that are nearest, for each row of squared distances, in no order."""
    if probe == 1:
        return square.argmin(1)[:, None]
    return np.argpartition(square, probe - 1, 1)[:, :probe] if probe < square.shape[1] else np.tile(np.arange(square.shape[1]), (len(square), 1))


def _probes(rows: DataFrame, tried: dict[str, tuple[np.ndarray, np.ndarray]], books: dict[str, Book], n: int, target: float) -> dict[str, int]:
    """For each set of keys the least number of cells in which the target's share, and SURE standard errors more, of the
    exact n nearest of all rows to the tried ones stand. rows: (__key, cell, desc_id, vec); tried: ids and vectors."""
    out = dict.fromkeys(books, 1)
    if not tried:
        return out
    ids, key = np.concatenate([i for i, _ in tried.values()]), [k for k, (i, _) in tried.items() for _ in i]
    lists = pa.array([x for _, v in tried.values() for x in v.astype(np.float32)], pa.list_(pa.float32()))
    queries = rows.sparkSession.createDataFrame(pa.table({"query_id": pa.array(ids, pa.int64()), "__key": pa.array(key), "query_vec": lists}))
    # the rows cost what they are; the queries are few, so each task meets all of them
    blocks = (plan_bytes(rows) // BLOCK_BYTES + 1, len(ids) * max(_row_bytes(b.centers) for b in books.values()) // QUERY_BYTES + 1)
    found = best_matches(queries, rows.withColumn("name", F.col("cell").cast("string")), n + 1, ["__key"], blocks=blocks)
    near = found.filter("desc_id <> query_id").select("__key", "query_id", "name", "rk").toArrow().sort_by([("query_id", "ascending"), ("rk", "ascending")])
    of_key = np.array(near.column("__key").to_pylist(), object)
    for k, (ids, v) in tried.items():
        own = near.filter(pa.array(of_key == k))
        query, cell = own.column("query_id").to_numpy(), np.array(own.column("name").to_pylist(), int)
        order = np.argsort(ids, kind="stable")
        at = order[np.searchsorted(ids[order], query)]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < n  # without the query itself
        if not keep.any():
            continue
        place = np.empty((len(ids), len(books[k].centers)), np.int32)  # when a query comes to a cell
        nearest = np.argsort(_squares(v, books[k].centers), 1, kind="stable")
        np.put_along_axis(place, nearest, np.arange(nearest.shape[1], dtype=np.int32)[None, :], 1)
        needed = np.sort(place[at[keep], cell[keep]]) + 1
        share = min(1.0, target + SURE * np.sqrt(target * (1 - target) / len(ids)))
        out[k] = int(needed[min(len(needed) - 1, int(np.ceil(share * len(needed))))])
    return out


def _spread(df: DataFrame, column: str, shared, step: int, choose, extra: list[str] | None = None) -> DataFrame:
    """df with `cell` and `__away`: for each row the (cells, distances) that choose(value of its key, vectors, extra columns) names, of `step` rows at a time."""
    sent = df.sparkSession.sparkContext.broadcast(shared)
    names = df.columns
    at, key, more = names.index(column), names.index("__key"), [names.index(c) for c in extra or []]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                keys = np.array(part.column(key).to_pylist(), object)
                for k in dict.fromkeys(keys):
                    if k not in sent.value:
                        continue
                    own = part.filter(pa.array(keys == k))
                    v = matrix(own.column(at))
                    row, cell, away = choose(sent.value[k], v, [own.column(i).to_numpy(zero_copy_only=False) for i in more])
                    few = max(1, CELLS // max(1, v.shape[1]))
                    for s in range(0, len(row), few):
                        made = own.take(pa.array(row[s : s + few]))
                        yield pa.RecordBatch.from_arrays([*made.columns, pa.array(cell[s : s + few].astype(np.int32)), pa.array(away[s : s + few])], names=[*names, "cell", "__away"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("__away", T.DoubleType())]))


def _step(centers: list[np.ndarray]) -> int:
    return max(1, min(2048, CELLS // max([len(c) for c in centers], default=1)))


def _away(v: np.ndarray, centers: np.ndarray, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    out, few = np.zeros(len(row)), max(1, CELLS // max(1, v.shape[1]))
    for s in range(0, len(row), few):
        out[s : s + few] = np.sqrt(((v[row[s : s + few]] - centers[cell[s : s + few]]) ** 2).sum(1))
    return out


def _nearest(df: DataFrame, column: str, books: dict[str, tuple[np.ndarray, int]], units: dict[str, np.ndarray | None] | None = None) -> DataFrame:
    """A row for each of the cells nearest to its vector, as many as its key's book says; for each of the units, without a
    distance, where the key has those. Codebooks are bounded, so they are broadcast."""
    shared = {k: (*b, None if (units or {}).get(k) is None else np.unique(units[k])) for k, b in books.items()}

    def choose(book, v, _):
        centers, probe, all_of = book
        if all_of is not None:
            return np.repeat(np.arange(len(v)), len(all_of)), np.tile(all_of, len(v)), np.zeros(len(v) * len(all_of))
        cell = _first_cells(_squares(v, centers), probe)
        row = np.repeat(np.arange(len(v)), cell.shape[1])
        return row, cell.ravel(), _away(v, centers, row, cell.ravel())

    return _spread(df, column, shared, _step([c for c, _ in books.values()]), choose)


def _unread(df: DataFrame, books: dict[str, Book], probe: int | None) -> DataFrame:
    """Of the cells that a first search left out those that may hold a neighbour nearer than __bound (null: any)."""

    def choose(book, v, extra):
        square = _squares(v, book.centers)
        away = np.sqrt(np.maximum(0.0, square + (v * v).sum(1)[:, None]))
        bound = np.where(np.isnan(extra[0].astype(float)), np.inf, extra[0].astype(float))
        open_ = away <= bound[:, None] + book.reach + _SLACK * (1 + away)
        np.put_along_axis(open_, _first_cells(square, min(probe or book.probe, len(book.centers))), False, 1)
        row, cell = np.nonzero(open_)
        return row, cell, away[row, cell]

    return _spread(df, "query_vec", books, _step([b.centers for b in books.values()]), choose, ["__bound"]).drop("__bound", "__away")
