"""Nearest-neighbour joins and local naive Bayes nearest neighbour (LNBNN) scores.

The exact joins deal both sides into blocks, so that every pair of blocks is one task's group: its distances are one
matrix product, and it gives back the best few of each query. No side is broadcast, no group grows with the data, and a
pair of rows never becomes a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of vectors (as Catalyst estimates them) in a block of the database and of the queries.
BLOCK_BYTES, QUERY_BYTES = 16 << 20, 4 << 20
#: Estimates from here on are no estimates: the rows are counted instead, at so many bytes each.
_UNKNOWN, _ROW_BYTES = 1 << 60, 1024
#: Rough distances, and numbers of the vectors of candidates, that a task holds at a time (of 8 bytes, a few arrays of each).
CELLS, CANDIDATES = 1 << 20, 1 << 20
#: Squared distances of a matrix product that are closer than this may change places; they are computed again, exactly.
_NEAR = 1e-9
#: Lists that the names of a database are dealt into.
NAME_PARTS = 64


def plan_bytes(df: DataFrame) -> int:
    """The size of df as Catalyst estimates it, without a job; sources that have no estimate are counted."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return size if size < _UNKNOWN else df.count() * _ROW_BYTES


def _best_of_block(n: int, cosine: bool, schema: pa.Schema):
    """For each query of a group its n best database rows, ties by desc_id."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy(zero_copy_only=False)
        at_q, at_d = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(at_q) or not len(at_d):
            return schema.empty_table()
        vec = table.column("vec").combine_chunks()
        v = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vec), -1)
        ids = table.column("id").to_numpy()
        q, d = v[at_q], v[at_d]
        k = min(n, len(d))
        norm_d = np.linalg.norm(d, axis=1) if cosine else (d * d).sum(1)
        found_q, found_d, found = [], [], []
        step = max(1, min(512, CELLS // len(d)))
        for s in range(0, len(q), step):
            part = q[s : s + step]
            rough = part @ d.T
            with np.errstate(divide="ignore", invalid="ignore"):
                if cosine:
                    rough /= -np.linalg.norm(part, axis=1)[:, None]
                    rough /= norm_d
                else:
                    rough *= -2
                    rough += (part * part).sum(1)[:, None]
                    rough += norm_d
            rough[np.isnan(rough)] = np.inf
            scale = 1.0 if cosine else 1 + np.abs(norm_d).max()
            bound = np.partition(rough, k - 1, axis=1)[:, k - 1] + _NEAR * scale
            i, j = np.nonzero((rough <= bound[:, None]) & (rough < np.inf))
            exact = np.zeros(len(i))
            few = max(1, CANDIDATES // d.shape[1])
            for at in range(0, len(i), few):
                x, y = part[i[at : at + few]], d[j[at : at + few]]
                if cosine:
                    exact[at : at + few] = -(x * y).sum(1) / np.sqrt((x**2).sum(1) * (y**2).sum(1))
                else:
                    exact[at : at + few] = np.sqrt(((x - y) ** 2).sum(1))
            order = np.lexsort((ids[at_d[j]], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < n
            found_q.append(at_q[s + i[keep]])
            found_d.append(at_d[j[keep]])
            found.append(exact[keep])
        fq, fd, dist = (np.concatenate(x) for x in (found_q, found_d, found))
        keys = [table.column(c).take(pa.array(fq)) for c in schema.names[1:-3]]
        return pa.table([pa.array(ids[fq]), *keys, pa.array(ids[fd]), table.column("name").take(pa.array(fd)), pa.array(dist)], schema=schema)

    return run


def best_matches(queries: DataFrame, database: DataFrame, n: int, keys: list[str] | None = None, cosine: bool = False, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, *keys, desc_id, name, dist, rk): the n best database rows of each query among rows with equal keys.

    queries: (query_id, query_vec, *keys); database: (desc_id, name, vec, *keys). dist is the Euclidean distance, or the
    negative cosine; ties go to the smaller desc_id. blocks: how many of each side (database, queries); by default from
    the estimated sizes. A row without a vector, or by cosine without a length, matches nothing.
    """
    keys = keys or []
    d = database.select(*keys, F.col("desc_id").cast("long").alias("id"), F.col("name").cast("string").alias("name"), F.col("vec").cast("array<float>").alias("vec"), F.lit(False).alias("side"))
    q = queries.select(*keys, F.col("query_id").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.col("query_vec").cast("array<float>").alias("vec"), F.lit(True).alias("side"))
    nd, nq = blocks or (plan_bytes(database) // BLOCK_BYTES + 1, plan_bytes(queries) // QUERY_BYTES + 1)

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
        return df.filter("vec is not null").withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    both = dealt(d, "db", nd, "ask", nq).unionByName(dealt(q, "ask", nq, "db", nd))
    best = best_in_groups(both, n, keys, cosine)
    overall = Window.partitionBy("query_id", *keys).orderBy("dist", "desc_id")
    return best.withColumn("rk", F.row_number().over(overall)).filter(F.col("rk") <= n)


def best_in_groups(both: DataFrame, n: int, keys: list[str], cosine: bool = False) -> DataFrame:
    """(query_id, *keys, desc_id, name, dist): of each query its n best in each group of keys, db and ask. both: (*keys, db, ask, id, name, vec, side), side true for queries."""
    kinds = dict(both.select(*keys).dtypes)
    ddl = ", ".join(["query_id long", *(f"`{k}` {kinds[k]}" for k in keys), "desc_id long", "name string", "dist double"])
    arrow = pa.schema([("query_id", pa.int64()), *((k, _ARROW[kinds[k]]) for k in keys), ("desc_id", pa.int64()), ("name", pa.string()), ("dist", pa.float64())])
    return both.groupBy(*keys, "db", "ask").applyInArrow(_best_of_block(n, cosine, arrow), ddl)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "smallint": pa.int16()}


def knn_join(queries: DataFrame, database: DataFrame, n: int, keys: list[str] | None = None, blocks: tuple[int, int] | None = None) -> DataFrame:
    """The n nearest database rows of each query, by Euclidean distance and then desc_id, among rows with equal keys."""
    return best_matches(queries, database, n, keys, blocks=blocks)


def lnbnn_contributions(neighbours: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(query_id, *keys, name, contribution): nearest distance of each name less that of the last neighbour, which only sets the background."""
    per_query = Window.partitionBy("query_id", *(keys or []))
    marked = neighbours.withColumn("background", F.max("dist").over(per_query)).withColumn("last", F.max("rk").over(per_query))
    return marked.filter("rk < last").groupBy("query_id", *(keys or []), "name").agg((F.min("dist") - F.first("background")).alias("contribution"))


def lnbnn_hits(contributions: DataFrame, owners: DataFrame) -> DataFrame:
    """(image_id, name, score) of the names that an image's descriptors met. owners: (query_id, image_id)."""
    return contributions.join(owners, "query_id").groupBy("image_id", "name").agg(F.sum("contribution").alias("score"))


def with_names(images: DataFrame, names: DataFrame, by: list[str] | None = None) -> DataFrame:
    """images with every name, among rows with equal `by`. The names meet the images in NAME_PARTS lists."""
    by = by or []
    lists = names.groupBy(*by, F.pmod(F.xxhash64("name"), F.lit(NAME_PARTS)).alias("__part")).agg(F.collect_set("name").alias("__names"))
    parts = images.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(NAME_PARTS - 1))))
    return parts.join(lists, [*by, "__part"]).select(*images.columns, F.explode("__names").alias("name"))


def lnbnn_scores(contributions: DataFrame, owners: DataFrame, names: DataFrame) -> DataFrame:
    """(image_id, name, score) of every image and name: contributions summed over an image's descriptors; names never hit have 0.

    owners: (query_id, image_id). names: (name), the names of the database; they meet the images in NAME_PARTS lists, so
    the join has a row for each image and list. The result has one for each image and name; where only names that were
    hit matter, lnbnn_hits is enough.
    """
    hits = lnbnn_hits(contributions, owners)
    every = with_names(owners.select("image_id").distinct(), names)
    return every.join(hits, ["image_id", "name"], "left").select("image_id", "name", F.coalesce("score", F.lit(0.0)).alias("score"))


def rank_names(scores: DataFrame, descending: bool = False, by: str = "score") -> DataFrame:
    """Rank of each name of an image, ties by name."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(order, "name")))


def top_names(hits: DataFrame, images: DataFrame, names: DataFrame, n: int, by: list[str] | None = None, digits: int = 9) -> DataFrame:
    """(*images.columns, name, score, rank): the first n names of each image, as rank_names() of every image and name has them.

    hits: (image_id, *by, name, score) with scores of at most 0; images: (image_id, *by), each once; names: (*by, name).
    Names that an image did not meet share the score 0 and the order of names, so the first n names follow from its best
    n hits and the first 2 n - 1 names: no row for each image and name. Scores are rounded to digits.
    """
    by = by or []
    score = F.round("score", digits)
    best = Window.partitionBy("image_id", *by).orderBy("score", "name")
    met = hits.select("image_id", *by, "name", score.alias("score")).filter("score < 0").withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    lists = met.groupBy("image_id", *by).agg(F.array_sort(F.collect_list(F.struct("score", "name"))).alias("met"))
    one = F.lit(0).alias("__all")
    first = names.select(*by, one, "name").distinct().withColumn("at", F.row_number().over(Window.partitionBy(*by, "__all").orderBy("name"))).filter(F.col("at") <= 2 * n - 1)
    first = first.groupBy(*by, "__all").agg(F.array_sort(F.collect_list("name")).alias("first"))
    every = images.withColumn("__all", F.lit(0)).join(first, [*by, "__all"]).join(lists, ["image_id", *by], "left")
    zero = F.lit(0.0)
    rest = F.transform(F.array_except("first", F.coalesce(F.col("met.name"), F.array().cast("array<string>"))), lambda x: F.struct(zero.alias("score"), x.alias("name")))
    ranked = F.slice(F.concat(F.coalesce("met", F.array().cast("array<struct<score:double,name:string>>")), rest), 1, n)
    return every.select(*images.columns, F.posexplode(ranked).alias("p", "c")).select(*images.columns, "c.name", "c.score", (F.col("p") + 1).alias("rank"))


def cosine_top1(queries: DataFrame, database: DataFrame, blocks: tuple[int, int] | None = None) -> DataFrame:
    """(query_id, desc_id, name, similarity) of the most similar database row, ties by desc_id."""
    best = best_matches(queries, database, 1, cosine=True, blocks=blocks)
    return best.select("query_id", "desc_id", "name", (-F.col("dist")).alias("similarity"))


def recall_at(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate join found, as a one-row DataFrame."""
    hit = exact.join(found.select("query_id", "desc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "desc_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
