"""Links of the set join against all pairs of a small table."""

import random
from itertools import combinations

import pytest

from kinspark.llm.set_links import jaccard_links


def shingles(text, width):
    words = (text or "").split()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def brute(rows, width, percent):
    """Linked pairs of different sets, and sets with their ids."""
    sets = {}
    for i, t in rows:
        if i is not None and shingles(t, width):
            sets.setdefault(shingles(t, width), set()).add(i)
    return {frozenset((x, y)) for x, y in combinations(sets, 2) if 100 * len(x & y) >= percent * len(x | y)}, sets


def check(spark, rows, width, percent):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k int, set_id string")
    links, members = jaccard_links(df, width, percent)
    want, sets = brute(rows, width, percent)
    own = {}
    for r in members.collect():
        own.setdefault(r.set_id, set()).add(r.doc_id)
    by_text = {}
    for s, ids in sets.items():
        by_text.setdefault(frozenset(ids), []).append(s)
    assert sorted(map(sorted, own.values())) == sorted(map(sorted, sets.values()))
    got = links.collect()
    assert len({(r.a, r.b) for r in got}) == len(got) == len(want) and all(r.a < r.b for r in got)
    if all(len(v) == 1 for v in by_text.values()):
        assert {frozenset(by_text[frozenset(own[e])][0] for e in (r.a, r.b)) for r in got} == want
    return got


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_links_equal_all_pairs(spark, width, percent):
    rnd = random.Random(width)
    rows = []
    for _ in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([60, 120, 300]))]
        for _ in range(14):
            words = list(base)
            for _ in range(rnd.randrange(6)):
                words[rnd.randrange(len(words))] = f"n{rnd.randrange(1000)}"
            rows.append((len(rows), " ".join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 80, 9)] + [rows[3]] + [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two"), (None, rows[0][1])]
    assert any(r.derived for r in check(spark, rows, width, percent))  # loose families: 12 of 88 links at 85 percent


def test_links_of_a_close_family_are_taken_over(spark):
    rnd = random.Random(1)
    base = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(30):
        words = list(base)
        words[rnd.randrange(500)] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = check(spark, rows, 4, 85)
    assert len(got) == 30 * 29 / 2 and sum(not r.derived for r in got) == 29  # the hub's own links are computed, no others


def test_links_of_no_rows_and_of_ids_with_several_texts(spark):
    assert not check(spark, [], 4, 85)
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text), (1, text + " more"), (2, text + " else"), (3, text), (1, text)]
    assert len(check(spark, rows, 4, 85)) == 3
