"""An extra beyond batch identification: descriptors that arrive, scored against a static database, and a database that
arrives, whose nearest neighbours and scores are kept as streaming state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from kinspark.operators.matching import knn_join, lnbnn_contributions


def score_stream(queries: DataFrame, database: DataFrame, folder: str, checkpoint: str, k: int = 2):
    """Start a query that writes (query_id, name, contribution) of each micro-batch to its own folder, so that a batch run again overwrites itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        found = lnbnn_contributions(knn_join(df, database, k + 1))
        found.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_MET = "image_id long, query_id long, desc_id long, name string, dist double, met_ms long"
_STATE = "desc_ids array<long>, names array<string>, dists array<double>, revision long"
_ANSWER = "query_id long, image_id long, revision long, settled boolean, names array<string>, contributions array<double>"


def meet_arrivals(arriving: DataFrame, queries: DataFrame, folder: str, checkpoint: str, k: int = 2):
    """Start a query that compares each micro-batch of a growing database (desc_id, name, vec) with queries (image_id, query_id, query_vec).

    The k + 1 nearest of the batch go to a folder of its own, which a batch run again overwrites. Nothing of the
    database is kept: whatever is among the nearest of all is among the nearest of its batch.
    """

    def batch(df: DataFrame, batch_id: int) -> None:
        near = knn_join(queries.select("query_id", "query_vec"), df.filter("desc_id is not null"), k + 1)
        found = near.join(queries.select("query_id", F.col("image_id").cast("long").alias("image_id")), "query_id")
        found.select("image_id", "query_id", "desc_id", "name", "dist", F.unix_millis(F.current_timestamp()).alias("met_ms")).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_nearest(met: str, folder: str, spark: SparkSession, checkpoint: str, k: int = 2, settle_ms: int = 600_000):
    """Start a query that keeps, as state, the k + 1 nearest neighbours of each query descriptor among all that meet_arrivals() wrote to met.

    A descriptor that gets nearer neighbours has a new revision of its answer in folder. The state is keyed by the
    descriptor and holds k + 1 neighbours, however many rows an image has. Merging is by descriptor id, so a neighbour
    that is delivered again, in any order, changes nothing. After settle_ms without a change a timer marks the answer as
    settled; its state stays, so that a late neighbour still revises it. An output batch that runs again overwrites
    itself, so answers() reads each revision once.
    """
    n = k + 1

    def revise(key, frames, state):
        desc_ids, names, dists, revision = state.get if state.exists else ([], [], [], 0)
        best = sorted(zip(dists, desc_ids, names, strict=True), key=lambda b: b[:2])
        if not state.hasTimedOut:
            before, met_ms = best, 0
            for frame in frames:
                met_ms = max(met_ms, int(frame["met_ms"].max()))
                known = {b[1] for b in best}
                new = {d: (x, d, None if name is None or name != name else name) for d, name, x in zip(frame["desc_id"], frame["name"], frame["dist"], strict=True) if d not in known}
                best = sorted([*best, *new.values()], key=lambda b: b[:2])[:n]
            changed = best != before
            revision += changed
            state.update(([int(b[1]) for b in best], [b[2] for b in best], [float(b[0]) for b in best], revision))
            state.setTimeoutTimestamp(met_ms + 1)
            if not changed:
                return
        nearest: dict = {}
        for x, _, name in best[:-1]:
            nearest.setdefault(name, x - best[-1][0])
        yield pd.DataFrame({
            "query_id": [key[1]], "image_id": [key[0]], "revision": [revision], "settled": [state.hasTimedOut], "names": [list(nearest)], "contributions": [[float(c) for c in nearest.values()]],
        })

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    arriving = spark.readStream.schema(_MET).parquet(met).withColumn("met_at", F.timestamp_millis("met_ms")).withWatermark("met_at", f"{settle_ms} milliseconds")
    revised = arriving.groupBy("image_id", "query_id").applyInPandasWithState(revise, _ANSWER, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return revised.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, image_id, revision, settled, name, contribution): the last revision of each descriptor that keep_nearest() wrote."""
    rows = spark.read.schema(_ANSWER).parquet(folder)
    last = F.max_by(F.struct("revision", "settled", F.arrays_zip(F.col("names").alias("name"), F.col("contributions").alias("contribution")).alias("met")), F.struct("revision", "settled")).alias("last")
    return rows.groupBy("query_id", "image_id").agg(last).select("query_id", "image_id", "last.revision", "last.settled", F.explode("last.met").alias("m")).select(
        "query_id", "image_id", "revision", "settled", F.col("m.name").alias("name"), F.col("m.contribution").alias("contribution"))


def arrived_scores(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, name, score) of the names that each image has met so far."""
    return answers(spark, folder).groupBy("image_id", "name").agg(F.sum("contribution").alias("score"))
