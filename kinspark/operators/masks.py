"""Masks as runs: array<struct<start, stop>> of pixel positions, ordered and apart from each other.

Positions go down the columns of a picture, one column after the other. Caches hold masks as text: lengths of runs of
background and mask in turn, each but the first three as the difference from the one two before, in groups of five bits,
the lowest first, with a sixth bit where more follow, as characters from "0". All work is on runs; no pixel is made.
"""

from __future__ import annotations

import json
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinspark.operators.numbering import many_parts

_RUNS = "array<struct<start:bigint,stop:bigint>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
#: Pixels of the square that holes are closed with.
CLOSING = 5


def runs_of_text(text: str) -> list[tuple[int, int]]:
    """Runs of a mask's text, without empty ones; ValueError where it is cut short or has a negative length."""
    runs, lengths, at, value, shift = [], [], 0, 0, 0
    for ch in text:
        bits = ord(ch) - 48
        if not 0 <= bits < 64:
            raise ValueError("no mask")
        value |= (bits & 31) << shift
        shift += 5
        if bits & 32:
            continue
        if bits & 16:
            value -= 1 << shift
        length = value + (lengths[-2] if len(lengths) > 2 else 0)
        if length < 0:
            raise ValueError("no mask")
        if len(lengths) % 2 and length:
            runs.append((at, at + length))
        lengths.append(length)
        at, value, shift = at + length, 0, 0
    if shift:
        raise ValueError("no mask")
    return merge(runs, [])


def text_of_runs(runs: list[tuple[int, int]], size: int) -> str:
    """The text of a mask over `size` pixels."""
    lengths, at, out = [], 0, []
    for start, stop in runs:
        lengths += [start - at, stop - start]
        at = stop
    if at < size or not lengths:
        lengths.append(size - at)
    for i, length in enumerate(lengths):
        value = length - lengths[i - 2] if i > 2 else length
        more = True
        while more:
            bits = value & 31
            value >>= 5
            more = value != (-1 if bits & 16 else 0)
            out.append(chr(48 + bits + 32 * more))
    return "".join(out)


def mask_of_json(text: str | None) -> tuple[int, int, list[tuple[int, int]]] | None:
    """(height, width, runs) of {"size": [height, width], "counts": text}; None if it is no mask of that size."""
    try:
        found = json.loads(text)
        height, width = (int(n) for n in found["size"])
        runs = runs_of_text(found["counts"])
    except (TypeError, ValueError, KeyError):
        return None
    return (height, width, runs) if not runs or runs[-1][1] <= height * width else None


@F.arrow_udf(T.StringType())
def mask_json(height: pa.Array, width: pa.Array, runs: pa.Array) -> pa.Array:
    """The masks of runs as a cache keeps them."""
    return pa.array([
        None if None in (h, w, r) else json.dumps({"size": [h, w], "counts": text_of_runs([(x["start"], x["stop"]) for x in r], h * w)})
        for h, w, r in zip(height.to_pylist(), width.to_pylist(), runs.to_pylist(), strict=True)
    ], pa.string())


def by_column(runs: list[tuple[int, int]], height: int) -> dict[int, list[tuple[int, int]]]:
    """Runs cut at the ends of columns: for each column its (first, end) lines."""
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, stop in runs:
        while start < stop:
            x, y = divmod(start, height)
            end = min(stop, (x + 1) * height)
            out[x].append((y, y + end - start))
            start = end
    return dict(out)


def joined(columns: dict[int, list[tuple[int, int]]], height: int) -> list[tuple[int, int]]:
    return merge([(x * height + a, x * height + b) for x, own in columns.items() for a, b in own], [])


def largest_part(columns: dict[int, list[tuple[int, int]]]) -> dict[int, list[tuple[int, int]]]:
    """The largest part of a mask whose pixels touch at sides or corners; of equal ones that with the highest, then leftmost pixel."""
    flat = [(x, a, b) for x in sorted(columns) for a, b in sorted(columns[x])]
    parent = list(range(len(flat)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    before, at = range(0), 0
    while at < len(flat):
        x, end = flat[at][0], at
        while end < len(flat) and flat[end][0] == x:
            end += 1
        if len(before) and flat[before[0]][0] == x - 1:
            i, j = before[0], at
            while i <= before[-1] and j < end:
                if flat[i][1] <= flat[j][2] and flat[j][1] <= flat[i][2]:
                    parent[root(j)] = root(i)
                if flat[i][2] < flat[j][2]:
                    i += 1
                else:
                    j += 1
        before, at = range(at, end), end
    area: dict[int, int] = defaultdict(int)
    first: dict[int, tuple[int, int]] = {}
    for i, (x, a, b) in enumerate(flat):
        r = root(i)
        area[r] += b - a
        first[r] = min(first.get(r, (a, x)), (a, x))
    best = min(area, key=lambda r: (-area[r], first[r]))
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, (x, a, b) in enumerate(flat):
        if root(i) == best:
            out[x].append((a, b))
    return dict(out)


def grown(columns: dict[int, list[tuple[int, int]]], height: int, width: int, reach: int) -> dict[int, list[tuple[int, int]]]:
    """Every pixel and those at most `reach` columns and lines away, inside the picture."""
    around: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for x, own in columns.items():
        wide = [(max(0, a - reach), min(height, b + reach)) for a, b in own]
        for at in range(max(0, x - reach), min(width, x + reach + 1)):
            around[at] += wide
    return {x: merge(own, []) for x, own in around.items()}


def others(columns: dict[int, list[tuple[int, int]]], height: int, width: int) -> dict[int, list[tuple[int, int]]]:
    """What is not in the mask."""
    out = {}
    for x in range(width):
        edges = [0, *(y for run in columns.get(x, []) for y in run), height]
        own = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
        if own:
            out[x] = own
    return out


def smoothed(runs: list[tuple[int, int]], height: int, width: int, closing: int = CLOSING) -> list[tuple[int, int]]:
    """The largest part of a mask, its small holes closed: grown by a square and shrunk again; beyond the picture nothing counts."""
    if not runs:
        return runs
    reach = closing // 2
    part = grown(largest_part(by_column(runs, height)), height, width, reach)
    return joined(others(grown(others(part, height, width), height, width, reach), height, width), height)


def absorbed(bodies: list[list[tuple[int, int]]], tusks: list[list[tuple[int, int]]]) -> list[list[tuple[int, int]]]:
    """Each body after it took in the tusks that overlap it, one after the other."""
    out = []
    for body in bodies:
        for tusk in tusks:
            if overlap(body, tusk):
                body = merge(body, tusk)
        out.append(body)
    return out


def foreground(cached: DataFrame, smooth: bool = True, key: str = "path") -> DataFrame:
    """(key, height, width, runs) of each picture of a cache (key, cached): all bodies with the tusks they take in, as one mask.

    What is no mask, or of another size than the picture's first body, is left out; without a body the whole picture
    counts, if the cache knows its size, and else height, width and runs are null. A picture is a row: no shuffle.
    """
    schema = pa.schema([(key, pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("runs", _RUN_TYPE)])

    def picture(bodies, tusks, height, width):
        bodies = [m for m in map(mask_of_json, bodies or []) if m is not None]
        if not bodies:
            return (height, width, [(0, height * width)]) if height and width else (None, None, None)
        size = bodies[0][:2]
        own, more = ([m[2] for m in masks if m is not None and m[:2] == size] for masks in (bodies, map(mask_of_json, tusks or [])))
        runs: list[tuple[int, int]] = []
        for body in absorbed(own, more):
            runs = merge(runs, body)
        return (*size, smoothed(runs, *size) if smooth else runs)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                keys, *columns = (c.to_pylist() for c in batch.slice(start, 256).columns)
                out = [(k, *picture(*row)) for k, row in zip(keys, zip(*columns, strict=True), strict=True)]
                runs = [None if r is None else [{"start": a, "stop": b} for a, b in r] for *_, r in out]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True))[:3], schema, strict=False)), pa.array(runs, _RUN_TYPE)], schema=schema)

    def masks(field: str) -> Column:
        return F.col(f"cached.{field}.predictions.rle_mask")

    picked = cached.select(F.col(key).cast("string").alias(key), masks("sam_body").alias("b"), masks("sam_tusk").alias("t"), F.col("cached.image_size.height").alias("h"), F.col("cached.image_size.width").alias("w"))
    return picked.mapInArrow(run, f"`{key}` string, height int, width int, runs {_RUNS}")


def smoothed_masks(masks: DataFrame, key: str = "mask_id") -> DataFrame:
    """(key, height, width, runs) with runs smoothed; null runs stay null."""
    schema = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))

    @F.arrow_udf(schema)
    def smooth(height: pa.Array, width: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for h, w, r in zip(height.to_pylist(), width.to_pylist(), runs.to_pylist(), strict=True):
            out.append(None if r is None else [{"start": a, "stop": b} for a, b in smoothed(merge([(x["start"], x["stop"]) for x in r], []), h, w)])
        return pa.array(out, _RUN_TYPE)

    # masks are a few bytes of a file that one task would read
    return masks.repartition(many_parts(masks), key).select(key, "height", "width", smooth("height", "width", "runs").alias("runs"))


def union_runs(runs: DataFrame) -> DataFrame:
    """(mask_id, start, stop) of the union of all runs (mask_id, start, stop) of a mask: gaps and islands."""
    from pyspark.sql import Window

    w = Window.partitionBy("mask_id").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("mask_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("mask_id", "start", "stop")


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def overlap(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> bool:
    i = j = 0
    while i < len(a) and j < len(b):
        if max(a[i][0], b[j][0]) < min(a[i][1], b[j][1]):
            return True
        if a[i][1] < b[j][1]:
            i += 1
        else:
            j += 1
    return False


def absorb_tusks(masks: DataFrame) -> DataFrame:
    """(image_id, idx, runs) of the body masks after each took in the tusks that overlap it, one after the other:
    a tusk may overlap only what an earlier one added. masks: (image_id, kind body or tusk, idx, runs)."""
    schema = pa.schema([("image_id", pa.int64()), ("idx", pa.int32()), ("runs", _RUN_TYPE)])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                out = []
                part = batch.slice(start, 1000)
                for image, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    runs = {k: [(m["idx"], [(r["start"], r["stop"]) for r in m["runs"]]) for m in own if m["kind"] == k] for k in ("body", "tusk")}
                    found = absorbed([body for _, body in runs["body"]], [tusk for _, tusk in runs["tusk"]])
                    out += [(image, i, [{"start": s, "stop": e} for s, e in body]) for (i, _), body in zip(runs["body"], found, strict=True)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    # the masks of one picture are a row: pictures are many and small
    each = masks.groupBy(F.col("image_id").cast("long").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "kind", "runs"))).alias("masks"))
    return each.mapInArrow(run, f"image_id long, idx int, runs {_RUNS}")
