"""Masks against pixels, and the range join by cells against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.operators import masks as mk
from kinspark.operators.curvature import neighbours_within


def runs_of(pixels):
    flat = np.concatenate([[0], pixels.T.ravel().astype(int), [0]])
    return list(zip(np.flatnonzero(np.diff(flat) == 1).tolist(), np.flatnonzero(np.diff(flat) == -1).tolist(), strict=True))


def pixels_of(runs, height, width):
    flat = np.zeros(height * width, bool)
    for a, b in runs:
        flat[a:b] = True
    return flat.reshape(width, height).T


def plain_smoothed(pixels):
    h, w = pixels.shape
    seen, best = np.zeros((h, w), bool), []
    for y in range(h):
        for x in range(w):
            if pixels[y, x] and not seen[y, x]:
                seen[y, x], todo, part = True, [(y, x)], []
                while todo:
                    part.append(todo.pop())
                    for i in (-1, 0, 1):
                        for j in (-1, 0, 1):
                            p = part[-1][0] + i, part[-1][1] + j
                            if 0 <= p[0] < h and 0 <= p[1] < w and pixels[p] and not seen[p]:
                                seen[p] = True
                                todo.append(p)
                best = max(best, part, key=len)  # the first of equal ones
    out = np.zeros((h, w), bool)
    for p in best:
        out[p] = True
    big = np.array([[out[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].any() for x in range(w)] for y in range(h)])
    return np.array([[big[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].all() for x in range(w)] for y in range(h)]) if best else pixels


def test_masks_as_text():
    assert mk.text_of_runs([], 100) == "T3" and mk.runs_of_text("T3") == []  # one run of 100
    r = random.Random(1)
    for _ in range(300):
        h, w = r.randint(1, 30), r.randint(1, 30)
        pixels = np.array([[r.random() < 0.4 for _ in range(w)] for _ in range(h)])
        runs = runs_of(pixels)
        assert mk.runs_of_text(mk.text_of_runs(runs, h * w)) == runs
    wide = [(0, 5), (10, 4_000_000), (4_000_001, 4_000_007)]
    assert mk.runs_of_text(mk.text_of_runs(wide, 5_000_000)) == wide and mk.runs_of_text(mk.text_of_runs(wide, 4_000_007)) == wide
    for text in (None, "", "x", '{"size": [2]}', '{"size": [1, 3], "counts": "\\n"}', '{"size": [1, 3], "counts": "T"}', '{"size": [1, 3], "counts": "09"}'):
        assert mk.mask_of_json(text) is None
    assert mk.mask_of_json('{"size": [3, 4], "counts": "<"}') == (3, 4, [])


def test_smoothing_equals_pixels():
    r = random.Random(2)
    for k in range(250):
        h, w, share = r.randint(1, 14), r.randint(1, 14), r.choice([0.05, 0.2, 0.35, 0.6])
        pixels = np.array([[r.random() < share for _ in range(w)] for _ in range(h)])
        assert (pixels_of(mk.smoothed(runs_of(pixels), h, w), h, w) == plain_smoothed(pixels)).all(), k
    assert mk.smoothed([], 3, 3) == [] and mk.smoothed([(0, 9)], 3, 3) == [(0, 9)]


def test_foreground_takes_tusks_in_order_and_knows_odd_caches(spark):
    def mask(runs, size=(10, 10)):
        return f'{{"size": [{size[0]}, {size[1]}], "counts": "{mk.text_of_runs(runs, size[0] * size[1])}"}}'.replace("\\", "\\\\")

    def cached(bodies, tusks, size):
        return (None, None if size is None else size, None if bodies is None else ([(b,) for b in bodies],), None if tusks is None else ([(t,) for t in tusks],))

    rows = [
        ("chain", cached([mask([(0, 10)]), mask([(60, 70)])], [mask([(8, 20)]), mask([(19, 30)]), mask([(29, 35), (50, 52)])], (10, 10))),
        ("reversed", cached([mask([(0, 10)])], [mask([(29, 35)]), mask([(19, 30)]), mask([(8, 20)])], (10, 10))),
        ("touching", cached([mask([(0, 10)])], [mask([(10, 20)])], (10, 10))),
        ("none", cached([], [mask([(1, 2)])], (4, 3))), ("nothing", cached(None, None, None)), ("odd", cached(["x", mask([(1, 3)]), mask([(1, 2)], (5, 5))], [None], (10, 10))), ("null", None),
    ]
    kind = "path string, cached struct<crop_bbox:struct<x_min:int>,image_size:struct<width:int,height:int>,sam_body:struct<predictions:array<struct<rle_mask:string>>>,sam_tusk:struct<predictions:array<struct<rle_mask:string>>>>"
    df = spark.createDataFrame(rows, kind)
    got = {r.path: None if r.runs is None else [(x.start, x.stop) for x in r.runs] for r in mk.foreground(df, smooth=False).collect()}
    assert got == {"chain": [(0, 35), (50, 52), (60, 70)], "reversed": [(0, 20)], "touching": [(0, 10)], "none": [(0, 12)], "nothing": None, "odd": [(1, 3)], "null": None}
    smooth = {r.path: r.runs for r in mk.foreground(df).collect()}
    assert [(x.start, x.stop) for x in smooth["chain"]] == mk.smoothed([(0, 35), (50, 52), (60, 70)], 10, 10) and smooth["null"] is None
    assert mk.foreground(df.limit(0)).count() == 0


def test_range_join_equals_all_pairs(spark):
    r = np.random.default_rng(3)
    xy = {1: np.round(r.normal(size=(60, 2)), 1), 2: np.zeros((7, 2)), 3: np.array([[i * 0.1, 0.0] for i in range(41)]), 4: np.array([[5.0, 5.0]]), 5: r.integers(-3, 4, (50, 2)).astype(float)}
    df = spark.createDataFrame([(c, i, float(a), float(b)) for c, v in xy.items() for i, (a, b) in enumerate(v)], "contour_id long, pos int, x double, y double")
    for share in (0.025, 0.1, 0.5):
        want = set()
        for c, v in xy.items():
            reach = max(v[:, 0].max() - v[:, 0].min(), v[:, 1].max() - v[:, 1].min()) * share
            d = v[:, None, :] - v[None, :, :]
            want |= {(c, i, j) for i, j in zip(*np.nonzero(d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] <= reach * reach), strict=True)}
        got = [(x.contour_id, x.pos, x.other) for x in neighbours_within(df, share).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    far = spark.range(20_000).select(F.lit(1).alias("contour_id"), F.col("id").cast("int").alias("pos"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert neighbours_within(far, 2.5 / 19_999).count() == 5 * 20_000 - 6  # all pairs would be 400 million
    assert neighbours_within(df.limit(0), 0.1).count() == 0


@pytest.mark.parametrize("closing", [1, 3, 5])
def test_growing_and_shrinking(closing):
    mask = mk.by_column([(11, 13), (18, 20)], 7)
    assert mk.joined(mask, 7) == [(11, 13), (18, 20)]
    assert mk.joined(mk.others(mk.others(mask, 7, 4), 7, 4), 7) == [(11, 13), (18, 20)]
    big = pixels_of(mk.joined(mk.grown(mask, 7, 4, closing // 2), 7), 7, 4)
    base = pixels_of([(11, 13), (18, 20)], 7, 4)
    k = closing // 2
    assert (big == np.array([[base[max(0, y - k) : y + k + 1, max(0, x - k) : x + k + 1].any() for x in range(4)] for y in range(7)])).all()


def test_union_of_equal_runs_in_any_order(spark):
    """Runs that occur several times are ties of any order by start and stop; which comes first may not matter."""
    r = random.Random(4)
    runs = [(m, s, s + r.choice([0, 1, 5, 9])) for m in range(40) for s in r.choices(range(0, 60, 3), k=8)]
    runs += r.choices(runs, k=200)
    runs += [(99, s, e) for s, e in [(66, 87), (89, 127), (392, 412), (463, 485), (463, 485)]]
    want = sorted((m, a, b) for m in {x[0] for x in runs} for a, b in mk.merge([x[1:] for x in runs if x[0] == m], []))
    for _ in range(3):
        r.shuffle(runs)
        got = mk.union_runs(spark.createDataFrame(runs, "mask_id long, start long, stop long").repartition(5)).collect()
        assert sorted(map(tuple, got)) == want
    assert [x[1:] for x in want if x[0] == 99] == [(66, 87), (89, 127), (392, 412), (463, 485)]
