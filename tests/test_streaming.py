"""A database that arrives in batches, against the batch operators over all of it."""

import random
import time

import pytest

from kinspark.operators.matching import knn_join, lnbnn_contributions, lnbnn_hits
from kinspark.streaming.scoring import answers, arrived_scores, keep_nearest, meet_arrivals

DB = "desc_id long, name string, vec array<double>"


@pytest.fixture
def world(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(i, None if i % 17 == 0 else f"n{i % 7}", [rnd.random() for _ in range(4)]) for i in range(120)]
    queries = spark.createDataFrame([(i // 3, 1000 + i, [rnd.random() for _ in range(4)]) for i in range(9)], "image_id long, query_id long, query_vec array<double>")
    return rows, queries, {k: str(tmp_path / k) for k in ("in", "met", "out", "ck1", "ck2")}


def deliver(spark, rows, queries, at, settle_ms=600_000):
    spark.createDataFrame(rows, DB).coalesce(1).write.mode("append").parquet(at["in"])
    meet_arrivals(spark.readStream.schema(DB).parquet(at["in"]), queries, at["met"], at["ck1"]).awaitTermination()
    keep_nearest(at["met"], at["out"], spark, at["ck2"], settle_ms=settle_ms).awaitTermination()


def scores(df):
    return {(r.image_id, r.name): round(r.score, 6) for r in df.collect()}


def expected(spark, rows, queries):
    c = lnbnn_contributions(knn_join(queries.select("query_id", "query_vec"), spark.createDataFrame(rows, DB), 3))
    return scores(lnbnn_hits(c, queries.select("query_id", "image_id")))


def test_scores_follow_the_database(spark, world):
    rows, queries, at = world
    for upto in (40, 80, 120):
        deliver(spark, rows[upto - 40 : upto], queries, at)
        assert scores(arrived_scores(spark, at["out"])) == expected(spark, rows[:upto], queries)
    revisions = {r.query_id: r.revision for r in answers(spark, at["out"]).collect()}
    deliver(spark, [*rows[:40], (None, "x", [0.0] * 4), (500, "x", None)], queries, at)  # again, with rows that match nothing
    assert scores(arrived_scores(spark, at["out"])) == expected(spark, rows, queries)
    assert {r.query_id: r.revision for r in answers(spark, at["out"]).collect()} == revisions


def test_a_batch_run_again_changes_nothing(spark, world, tmp_path):
    rows, queries, at = world
    deliver(spark, rows[:60], queries, at)
    deliver(spark, rows[60:], queries, at)
    # all again from the start, as after the loss of both logs: the same folders, batches cut otherwise
    deliver(spark, rows[:1], queries, at | {"ck1": str(tmp_path / "other1"), "ck2": str(tmp_path / "other2")})
    assert scores(arrived_scores(spark, at["out"])) == expected(spark, rows, queries)


def test_timer_settles_and_late_rows_revise(spark, world):
    rows, queries, at = world
    some = queries.limit(1)
    deliver(spark, rows[:60], queries, at, settle_ms=1)
    assert not any(r.settled for r in answers(spark, at["out"]).collect())
    time.sleep(0.1)
    deliver(spark, rows[:1], some, at, settle_ms=1)  # a batch for one descriptor; the others have had none since
    own = some.first().query_id
    assert {r.settled for r in answers(spark, at["out"]).collect() if r.query_id != own} == {True}
    deliver(spark, rows[60:], queries, at, settle_ms=600_000)
    assert scores(arrived_scores(spark, at["out"])) == expected(spark, rows, queries)


def test_few_neighbours_and_no_rows(spark, world):
    rows, queries, at = world
    deliver(spark, [], queries, at)
    assert answers(spark, at["out"]).count() == 0
    deliver(spark, rows[1:2], queries, at)
    assert answers(spark, at["out"]).count() == 0  # a single neighbour only sets the background
    deliver(spark, rows[2:3], queries, at)
    assert scores(arrived_scores(spark, at["out"])) == expected(spark, rows[1:3], queries)
