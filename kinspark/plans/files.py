"""Queries that write files and read them again: listings, class maps, splits, caches, documents, masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinspark import schemas
from kinspark.models.appearance import cached_features
from kinspark.models.prepare import checked_split
from kinspark.operators import curation as cu
from kinspark.operators import masks as mk
from kinspark.plans.curating import _CLASSES, _N, SINGLE, SPLIT
from kinspark.plans.geometry import _E, _P
from kinspark.plans.tables import catalogue, polylines, scratch_folder, table
from kinspark.sources import scans, sinks


def image_scan(spark, sf_dir):
    """Pictures of 25 nations in folders of their regions, every fifth no picture, listed with their names and views."""
    folder = scratch_folder(spark, "images")
    jvm = spark._jvm
    for r in table(spark, sf_dir, "nation").collect():  # 25 small files
        end = ["_left.jpg", "_right.jpg", "_x.PNG", "_LEFT.jpeg", ".txt"][r.n_nationkey % 5]
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r.n_regionkey}/{r.n_nationkey}_{r.n_name.replace(' ', '-')}{end}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(b"x" * (r.n_nationkey + 1)))
        out.close()
    return scans.images(spark, folder).select("file_name", "individual", "view", "length")


def sample_listing(spark, sf_dir):
    """A listing whose names are numbers with leading zeros, as text."""
    folder = scratch_folder(spark, "listing")
    rows = catalogue(spark, sf_dir).select(F.format_string("%07d", "individual").alias("name"), F.concat(F.lit("c/"), F.col("filepath").cast("string")).alias("filepath"), F.concat(F.lit("o, "), F.col("view")).alias("original_path"))
    rows.write.option("header", True).csv(folder)
    return scans.samples_csv(spark, folder)


def class_map_file(spark, sf_dir):
    folder = scratch_folder(spark, "classes")
    sinks.write_class_map(cu.class_index(catalogue(spark, sf_dir)), folder)
    return scans.class_map(spark, folder)


def split_files(spark, sf_dir):
    """Training and test tables of both views and of all, written and counted again."""
    folder = scratch_folder(spark, "splits")
    split = cu.stratified_split(catalogue(spark, sf_dir)).filter("view <> 'P'").withColumn("side", F.when(F.col("view") == "O", "left").otherwise("right"))
    parts = {f"{v}_{s}": split.filter((F.col("side") == v) & (F.col("split") == s)).select("individual", "filepath") for v in ("left", "right") for s in ("train", "test")}
    for s in ("train", "test"):
        parts[s] = parts[f"left_{s}"].unionByName(parts[f"right_{s}"])
    sinks.write_split_files(parts, folder)
    out = None
    for name in parts:
        one = spark.read.option("header", True).schema("individual long, filepath long").csv(f"{folder}/{name}.csv").agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("filepath").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


def contour_cache(spark, sf_dir):
    """Contours of whole pixels in a cache; the lines of every seventh user are damaged."""
    folder = scratch_folder(spark, "contours")
    p = polylines(spark, sf_dir).select(F.col("contour_id").cast("string").alias("path"), "pos", F.array("pos", F.floor("y").cast("int")).alias("xy"))
    one = p.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "xy"))).alias("a"))
    cached = one.select("path", F.struct(F.array(F.col("a.xy")).alias("contours"), F.array(F.lit("left")).alias("views")).alias("cached"))
    sinks.write_cache(cached.filter("path % 7 <> 0"), folder)
    cached.filter("path % 7 = 0").select("path", F.lit("{broken").alias("cached")).write.mode("append").json(folder)
    read = scans.cached_lines(spark, folder, schemas.CONTOUR_CACHE)
    flat = F.flatten(F.col("cached.contours"))
    return read.select("path", F.array_join("cached.views", ",").alias("views"), F.size(flat).alias("points"), F.aggregate(flat, F.lit(0), lambda s, q: s + q[1]).alias("total"))


def face_cache(spark, sf_dir):
    """Faces read through a cache that knows a third of the orders; the rest is detected and added."""
    folder = scratch_folder(spark, "faces")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("path"))

    def detect(rows):
        face = F.struct(F.col("path").cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("width"), F.lit(3.0).alias("height"), (F.col("path") % 100 / 100).alias("confidence"))
        return rows.withColumn("cached", F.struct(F.array(face).alias("predictions")))

    known = orders.filter("path % 3 = 0")
    sinks.write_cache(detect(known).withColumn("cached", F.struct(F.transform("cached.predictions", lambda p: p.withField("y", F.lit(9.0))).alias("predictions"))), folder)
    read = scans.read_through(orders, spark, folder, schemas.FACE_CACHE, detect, sinks.write_cache)
    p = F.col("cached.predictions")[0]
    return read.select("path", p.x.alias("x"), p.y.alias("y"), p.confidence.alias("confidence"))


def mask_cache(spark, sf_dir):
    """Boxes and masks in a cache: crop, size, and the runs of bodies and tusks that are there."""
    folder = scratch_folder(spark, "masks")
    k = F.col("p_partkey").cast("int")
    one = F.struct(F.when(k % 2 == 0, F.concat(F.lit("b"), k.cast("string"))).alias("rle_mask"))
    value = F.struct(F.struct(k.alias("x_min"), F.lit(0).alias("y_min"), (k + 5).alias("x_max"), F.lit(7).alias("y_max")).alias("crop_bbox"), F.struct(F.lit(640).alias("width"), F.lit(480).alias("height")).alias("image_size"), F.struct(F.array(one, one).alias("predictions")).alias("sam_body"), F.struct(F.array(F.struct(F.lit("t").alias("rle_mask"))).alias("predictions")).alias("sam_tusk"))
    sinks.write_cache(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), value.alias("cached")), folder)
    read = scans.cached_lines(spark, folder, schemas.MASK_CACHE)
    return read.select("path", F.col("cached.crop_bbox.x_max").alias("x_max"), F.col("cached.image_size.width").alias("width"), F.size(sinks.rle_masks(F.col("cached.sam_body.predictions"))).alias("bodies"), F.size(sinks.rle_masks(F.col("cached.sam_tusk.predictions"))).alias("tusks"))


def coco_round_trip(spark, sf_dir):
    """Contours of users as one annotation document, read again with the name of each annotation's picture."""
    folder = scratch_folder(spark, "coco")
    p = polylines(spark, sf_dir)
    images = sinks.coco_ids(p.select(F.format_string("u%08d.jpg", "contour_id").alias("file_name")).distinct()).withColumns({"height": F.lit(10), "width": F.lit(20)})
    notes = sinks.coco_annotations(p).withColumn("file_name", F.format_string("u%08d.jpg", "contour_id")).join(images.select("file_name", "image_id"), "file_name")
    sinks.write_coco(images, sinks.numbered(notes, ["image_id", "contour_id"], "id", 1), folder, "contours")
    read = scans.coco_annotations(spark, f"{folder}/document.json")
    return read.select("id", "image_id", "file_name", "height", F.round(F.get("bbox", F.lit(2)), 4).alias("w"), F.round("area", 3).alias("area"), F.size("keypoints").alias("n"))


def result_lines(spark, sf_dir):
    """Result rows as JSON lines and back."""
    folder = scratch_folder(spark, "results")
    sinks.write_json(cu.counts(catalogue(spark, sf_dir)).select(F.col("individual").cast("string").alias("name"), "n"), folder)
    return spark.read.schema("name string, n long").json(folder)


def stored_features(spark, sf_dir):
    """Features of parts, their names' lengths, taken in two runs of which the second finds the first's; every fifth is unreadable."""
    folder = scratch_folder(spark, "features")
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("path"), F.when(F.col("p_partkey") % 5 != 0, F.encode("p_name", "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8")).alias("content"))
    cached_features(images.filter("path % 2 = 0"), _lengths, folder)
    changed = images.withColumn("content", F.when(F.col("path") % 2 == 0, F.encode(F.lit("no longer read"), "UTF-8")).otherwise(F.col("content")))
    return cached_features(changed, _lengths, folder).select("path", F.get("vec", F.lit(0)).cast("int").alias("length"))


def _lengths(contents: list[bytes]) -> list:
    return [[float(len(c))] if len(c) else None for c in contents]


def mask_union(spark, sf_dir):
    """Runs of line items, united for each order."""
    start = F.col("l_partkey") % 500
    return mk.union_runs(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mask_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop")))


def tusks_absorbed(spark, sf_dir):
    """A body and a tusk of each order, joined where they overlap."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b"))

    def run(start):
        return F.array(F.struct(start.alias("start"), (start + 10).alias("stop")))

    both = o.select("image_id", F.lit("body").alias("kind"), F.lit(0).alias("idx"), run(F.col("a")).alias("runs")).union(o.select("image_id", F.lit("tusk"), F.lit(0), run(F.col("b"))))
    return mk.absorb_tusks(both).select("image_id", F.explode("runs").alias("r")).select("image_id", "r.*")


def checked_splits(spark, sf_dir):
    return checked_split(catalogue(spark, sf_dir).select("individual", "filepath")).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("filepath").alias("total"))


def mask_round_trip(spark, sf_dir):
    """Two bodies and three tusks of each part in a cache: the second tusk overlaps what the first one added, every third
    part's last tusk what the second one did, and odd parts list them the other way round. Bodies with their tusks go
    into a cache as one mask each and are read again."""
    k = F.col("p_partkey").cast("int")
    a, u = k % 40, k % 40 + 55 + 10 * (k % 3)

    def mask(start, stop):
        return mk.mask_json(F.lit(20), F.lit(20), F.array(F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))))

    tusks = [mask(a + 25, a + 45), mask(a + 40, a + 60), mask(u, u + 100)]

    def predictions(*masks):
        return F.struct(F.array(*(F.struct(m.alias("rle_mask")) for m in masks)).alias("predictions"))

    cached = F.struct(
        F.struct(*(F.lit(0).alias(c) for c in ("x_min", "y_min", "x_max", "y_max"))).alias("crop_bbox"), F.struct(F.lit(20).alias("width"), F.lit(20).alias("height")).alias("image_size"),
        predictions(F.col("b1"), F.col("b2")).alias("sam_body"), F.when(k % 2 == 0, predictions(*map(F.col, ("t0", "t1", "t2")))).otherwise(predictions(*map(F.col, ("t2", "t1", "t0")))).alias("sam_tusk"),
    )
    masks = {"b1": mask(a, a + 30), "b2": mask(k % 7 + 150, k % 7 + 170), **{f"t{i}": t for i, t in enumerate(tusks)}}
    rows = table(spark, sf_dir, "part").select("p_partkey", *(m.alias(n) for n, m in masks.items()))
    first, second = scratch_folder(spark, "masks"), scratch_folder(spark, "masks")
    sinks.write_cache(rows.select(F.col("p_partkey").cast("string").alias("path"), cached.alias("cached")), first)
    found = mk.foreground(scans.cached_lines(spark, first, schemas.MASK_CACHE), smooth=False)
    one = F.struct(F.struct(F.col("width"), F.col("height")).alias("image_size"), predictions(mk.mask_json("height", "width", "runs")).alias("sam_body"))
    sinks.write_cache(found.select("path", one.alias("cached")), second)
    again = mk.foreground(scans.cached_lines(spark, second, schemas.MASK_CACHE), smooth=False)
    return again.select("path", F.explode("runs").alias("r")).select("path", "r.start", "r.stop")


def _taken(body: str, order: list[str]) -> str:
    """SQL of a body's interval after it took in tusks in an order."""
    out = f"(select p_partkey as k, {body} from part)"
    for i in order:
        out = f"(select k, case when s < e{i} and s{i} < e then least(s, s{i}) else s end as s, case when s < e{i} and s{i} < e then greatest(e, e{i}) else e end as e from {out} join t using (k))"
    return out


_A, _U = "p_partkey % 40", "p_partkey % 40 + 55 + 10 * (p_partkey % 3)"
_BODIES = " union all ".join(f"select * from {_taken(b, order)} where k % 2 = {odd}" for b in (f"{_A} as s, {_A} + 30 as e", "p_partkey % 7 + 150 as s, p_partkey % 7 + 170 as e") for odd, order in ((0, "012"), (1, "210")))
_ROUND_TRIP = f"""with t as (select p_partkey as k, {_A} + 25 as s0, {_A} + 45 as e0, {_A} + 40 as s1, {_A} + 60 as e1, {_U} as s2, {_U} + 100 as e2 from part), b as ({_BODIES}),
m as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as reach from b),
g as (select *, sum((reach is null or s > reach)::int) over (partition by k order by s, e rows unbounded preceding) as island from m)
select k::varchar as path, min(s)::bigint as start, max(e)::bigint as stop from g group by k, island"""


def masks_smoothed(spark, sf_dir):
    """Masks of ten by ten pixels, one for each part, their largest part closed."""
    k, p = F.col("p_partkey"), F.sequence(F.lit(0), F.lit(99))

    def on(i):
        x, y = F.floor(i / 10), i % 10
        return (k * 7 + x * x * 3 + y * y * 5 + x * y * (k % 5)) % 11 < 3

    runs = F.transform(F.filter(p, on), lambda i: F.struct(i.cast("long").alias("start"), (i + 1).cast("long").alias("stop")))
    masks = table(spark, sf_dir, "part").select(k.cast("long").alias("mask_id"), F.lit(10).alias("height"), F.lit(10).alias("width"), runs.alias("runs"))
    return mk.smoothed_masks(masks).select("mask_id", F.explode("runs").alias("r")).select("mask_id", "r.start", "r.stop")


#: Pixels that reach each other are found by going on from pixel to pixel; then closing by two joins with the square around.
_SMOOTHED = """with recursive a as (select p_partkey as k, i, i // 10 as x, i % 10 as y from part, unnest(range(0, 100)) t(i)),
p as materialized (select * from a where (k * 7 + x * x * 3 + y * y * 5 + x * y * (k % 5)) % 11 < 3),
n as materialized (select p.k, p.i, q.i as j from p join p q on p.k = q.k and abs(p.x - q.x) <= 1 and abs(p.y - q.y) <= 1),
c as (select k, i, i as of from p union select c.k, n.j, c.of from c join n on n.k = c.k and n.i = c.i),
o as (select k, i, min(of) as of from c group by k, i), s as (select k, of, count(*) as area, min((i % 10) * 10 + i // 10) as first from o group by k, of),
b as (select k, of from s qualify row_number() over (partition by k order by area desc, first) = 1),
l as (select o.k, o.i // 10 as x, o.i % 10 as y from o join b on o.k = b.k and o.of = b.of),
d as (select distinct a.k, a.i, a.x, a.y from a join l on a.k = l.k and abs(a.x - l.x) <= 2 and abs(a.y - l.y) <= 2),
z as (select a.* from a anti join d on a.k = d.k and a.i = d.i where a.k in (select k from l)),
e as (select d.k, d.i from d anti join (select distinct d.k, d.i from d join z on d.k = z.k and abs(d.x - z.x) <= 2 and abs(d.y - z.y) <= 2) g on d.k = g.k and d.i = g.i),
r as (select k, i, i - row_number() over (partition by k order by i) as island from e)
select k as mask_id, min(i)::bigint as start, max(i)::bigint + 1 as stop from r group by k, island"""

_RUNS = "r as (select l_orderkey as mask_id, l_partkey % 500 as s, l_partkey % 500 + l_quantity::bigint as e from lineitem)"
_SIDES = f"with {SPLIT}, v as (select case view when 'O' then 'left' else 'right' end || '_' || split as part, split, filepath from s where view <> 'P')"

QUERIES = {
    "image_scan": (image_scan, "select * from (select n_nationkey || '_' || replace(n_name, ' ', '-') || (['_left.jpg', '_right.jpg', '_x.PNG', '_LEFT.jpeg', '.txt'])[n_nationkey % 5 + 1] as file_name, n_nationkey::varchar as individual, case n_nationkey % 5 when 0 then 'left' when 1 then 'right' end as view, n_nationkey::bigint + 1 as length from nation) where file_name not like '%.txt'"),
    "sample_listing": (sample_listing, "select printf('%07d', o_custkey) as name, 'c/' || o_orderkey as filepath, 'o, ' || o_orderstatus as original_path from orders"),
    "class_map_file": (class_map_file, f"with {_N} select individual::varchar as name, class_idx from {_CLASSES.format(names='n')}"),
    "split_files": (split_files, _SIDES + " select part, count(*) as n, sum(filepath)::bigint as total from (select part, filepath from v union all select split, filepath from v) group by 1"),
    "contour_cache": (contour_cache, f"with {_P} select contour_id::varchar as path, case when contour_id % 7 <> 0 then 'left' end as views, case when contour_id % 7 <> 0 then count(*) else null end::int as points, case when contour_id % 7 <> 0 then sum(floor(y)) end::int as total from p group by contour_id"),
    "face_cache": (face_cache, "select o_orderkey::varchar as path, o_orderkey::double as x, case when o_orderkey % 3 = 0 then 9.0e0 else 1.0e0 end as y, o_orderkey % 100 / 100 as confidence from orders"),
    "mask_cache": (mask_cache, "select p_partkey::varchar as path, (p_partkey + 5)::int as x_max, 640 as width, (case when p_partkey % 2 = 0 then 2 else 0 end)::int as bodies, 1 as tusks from part"),
    "coco_round_trip": (coco_round_trip, f"with {_P}, {_E}, i as (select contour_id, row_number() over (order by contour_id) - 1 as image_id from e) select row_number() over (order by image_id) as id, image_id, printf('u%08d.jpg', contour_id) as file_name, 10 as height, round(xmax - xmin, 4) as w, round((xmax - xmin) * (ymax - ymin), 3) as area, 6 as n from e join i using (contour_id) where e.n >= 2"),
    "result_lines": (result_lines, f"with {_N} select individual::varchar as name, n from n"),
    "stored_features": (stored_features, "select p_partkey::varchar as path, case when p_partkey % 5 <> 0 then length(p_name) end::int as length from part"),
    "mask_round_trip": (mask_round_trip, _ROUND_TRIP),
    "masks_smoothed": (masks_smoothed, _SMOOTHED),
    "mask_union": (mask_union, f"with {_RUNS}, m as (select *, max(e) over (partition by mask_id order by s, e rows between unbounded preceding and 1 preceding) as reach from r), g as (select *, sum((reach is null or s > reach)::int) over (partition by mask_id order by s, e rows unbounded preceding) as island from m) select mask_id, min(s) as start, max(e) as stop from g group by mask_id, island"),
    "tusks_absorbed": (tusks_absorbed, "with o as (select o_orderkey as image_id, o_custkey % 40 as a, o_orderkey % 40 as b from orders) select image_id, case when abs(a - b) < 10 then least(a, b) else a end as start, case when abs(a - b) < 10 then greatest(a, b) + 10 else a + 10 end as stop from o"),
    "checked_splits": (checked_splits, f"with {SINGLE} select split, count(*) as n, sum(filepath)::bigint as total from s group by 1"),
}
