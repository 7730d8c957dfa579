"""Queries of predictions, listings and exports: what comes in from models and pages, and what goes out."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinspark import schemas
from kinspark.functions import boxes as bx
from kinspark.functions import names as nm
from kinspark.operators.numbering import dealt
from kinspark.plans.geometry import _P
from kinspark.plans.tables import boxes, catalogue, polylines, table
from kinspark.sources import scans, sinks


def prediction_points(spark, sf_dir):
    """Answers of the contour and the anchor model, made of events, in whole pixels; anchors need a confidence of 0.05."""
    e = table(spark, sf_dir, "events")
    point = F.struct(F.col("value").alias("x"), (F.col("value") / 2).alias("y"))
    answer = F.to_json(F.struct(F.array(F.struct(F.array(point).alias("points"), F.array(point, point).alias("keypoints"), (F.col("event_id") % 100 / 100).alias("confidence"))).alias("predictions")))
    raw = F.from_json(answer, schemas.POINT_PREDICTIONS)
    read = e.select("event_id", scans.contour_predictions(raw).alias("c"), scans.anchor_predictions(raw).alias("a"))
    c0, a1 = F.get("c", F.lit(0)), F.get("a", F.lit(0))
    return read.select("event_id", F.get(c0.points, F.lit(0)).x.alias("x"), F.get(c0.points, F.lit(0)).y.alias("y"), F.size("a").alias("anchors"), F.coalesce(F.size(a1.points), F.lit(0)).alias("keypoints"))


def mask_presence(spark, sf_dir):
    """Masks of each user's predictions that have one."""
    p = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct(F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("r"), F.col("event_id").cast("string"))).alias("rle_mask")).alias("p"))
    one = p.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "p"))).alias("l"))
    return one.select("user_id", F.array_join(sinks.rle_masks(F.col("l.p")), ",").alias("masks"))


def slider_images(spark, sf_dir):
    """Lazily loaded gallery images of product pages; a thumbnail before the slider does not count."""
    k = F.col("p_partkey").cast("string")
    html = F.concat(F.lit('<img class="aspect__media" data-flickity-lazyload="t.jpg"><div id="main-slider"><img class="aspect__media" data-flickity-lazyload="//cdn/'), k, F.lit('.jpg"><img class="other" data-flickity-lazyload="o.jpg"><img data-flickity-lazyload="/b'), k, F.lit('" class="x aspect__media"></div>'))
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(nm.slider_images(html)).alias("pos", "src"))


def photo_search(spark, sf_dir):
    """The first 75 photos of pages of ten parts, every seventh malformed; and their middle-sized addresses."""
    photo = F.struct(F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey")).alias("id"), F.struct(F.concat(F.lit("l"), F.col("p_partkey").cast("string")).alias("large"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("medium")).alias("src"))
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("page"), "p_partkey", photo.alias("photo"))
    pages = p.groupBy("page").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "photo"))), lambda x: x.photo).alias("photos"))).alias("body"))
    return scans.search_photos(pages, 75, "medium")


def photo_lookup(spark, sf_dir):
    """Single photos by id; a body without an address is malformed."""
    src = F.when(F.col("p_partkey") % 5 != 0, F.create_map(F.lit("large"), F.concat(F.lit("l"), F.col("p_partkey").cast("string"))))
    return scans.photo_by_id(table(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("id"), src.alias("src"))).alias("body")))


def contour_files(spark, sf_dir):
    """Cached contours with their picture: .jpg, or .JPG where that is all there is."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.concat(F.lit("c/"), k.cast("string"), F.lit(".json")).alias("path"))
    files = p.select(F.explode(F.filter(F.array(F.when(k % 2 == 0, ".jpg"), F.when(k % 3 == 0, ".JPG"), F.lit(".png")), lambda x: x.isNotNull())).alias("end"), k).select(F.concat(F.lit("i/"), k.cast("string"), F.col("end")).alias("path"))
    return scans.contour_files(p, files)


def not_done(spark, sf_dir):
    """Parts that no line item has in a quantity of 45 or more, as files that an earlier run has not made."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"))
    return scans.not_done(parts, table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("path")))


def last_as_queries(spark, sf_dir):
    return scans.last_as_queries(catalogue(spark, sf_dir), "filepath")


def positional_zip(spark, sf_dir):
    """Parts in order of their keys beside parts in order of their names and keys, backwards."""
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("path"))
    b = p.select(F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"))
    return scans.paired(a, b, "path", "name")


def box_labels(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bx.box_label(1.0 - 5 * F.col("l_discount"), F.col("l_extendedprice")).alias("label"))


def polygon_lists(spark, sf_dir):
    """Two polygons of each contour, of up to four and up to two of its points; the second never has enough."""
    p = polylines(spark, sf_dir).groupBy("contour_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct("x", "y").alias("p")))).alias("a"))
    flat = p.select("contour_id", F.posexplode(sinks.flat_polygons(F.array(F.slice(F.col("a.p"), 1, 4), F.slice(F.col("a.p"), 1, 2)))).alias("polygon", "v"))
    return flat.select("contour_id", "polygon", F.posexplode("v").alias("i", "value"))


def contour_json(spark, sf_dir):
    """Ten users' contours as one picture's JSON list."""
    p = polylines(spark, sf_dir).select(F.floor(F.col("contour_id") / 10).alias("image_id"), "contour_id", "pos", F.col("pos").alias("x"), F.floor("y").cast("int").alias("y"))
    return sinks.contour_json(p)


def coco_detections(spark, sf_dir):
    """Detections of orders as annotations, with the ids of a document; odd ones have one keypoint, which is none."""
    b = boxes(spark, sf_dir).select(F.format_string("%09d.jpg", "image_id").alias("file_name"), "det_idx", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))
    point = F.struct(F.col("x"), F.col("y"))
    b = dealt(b, "file_name").dropDuplicates(["file_name", "det_idx"]).withColumn("keypoints", F.when(F.col("det_idx") % 2 == 0, F.array(point, point)).otherwise(F.array(point)))
    files = table(spark, sf_dir, "orders").select(F.format_string("%09d.jpg", "o_orderkey").alias("file_name"))
    images, notes = sinks.coco_images_with(files, sinks.coco_detections(b))
    return notes.select("file_name", "image_id", "id", *(F.get("bbox", F.lit(i)).alias(f"b{i}") for i in range(4)), F.round("area", 4).alias("area"), F.size("keypoints").alias("n"), F.get("keypoints", F.lit(3)).alias("k3"))


_D = """d as (select distinct printf('%09d.jpg', l_orderkey) as file_name, ((l_linenumber::bigint * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity::bigint as det_idx,
(l_partkey % 100)::double as x, (l_suppkey % 100)::double as y, 20 + l_quantity as w, 30 + l_quantity as h from lineitem),
i as (select file_name, row_number() over (order by file_name) - 1 as image_id from (select printf('%09d.jpg', o_orderkey) as file_name from orders) where file_name in (select file_name from d))"""

QUERIES = {
    "prediction_points": (prediction_points, "select event_id, round_even(value, 0)::int as x, round_even(value / 2, 0)::int as y, (event_id % 100 >= 5)::int as anchors, 2 * (event_id % 100 >= 5)::int as keypoints from events"),
    "mask_presence": (mask_presence, "select user_id, coalesce(string_agg('r' || event_id, ',' order by event_id) filter (event_id % 3 <> 0), '') as masks from events group by 1"),
    "slider_images": (slider_images, "select p_partkey, pos::int as pos, case pos when 0 then '//cdn/' || p_partkey || '.jpg' else '/b' || p_partkey end as src from part, unnest([0, 1]) t(pos)"),
    "photo_search": (photo_search, "select p_partkey as id, 'm' || p_partkey as url from part where p_partkey % 7 <> 0 order by p_partkey // 10, p_partkey limit 75"),
    "photo_lookup": (photo_lookup, "select p_partkey as id, 'l' || p_partkey as url from part where p_partkey % 5 <> 0"),
    "contour_files": (contour_files, "select p_partkey, 'c/' || p_partkey || '.json' as path, case when p_partkey % 2 = 0 then 'i/' || p_partkey || '.jpg' when p_partkey % 3 = 0 then 'i/' || p_partkey || '.JPG' end as image_path from part"),
    "not_done": (not_done, "select p_partkey as path from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 45)"),
    "last_as_queries": (last_as_queries, "select o_custkey as individual, o_orderkey as filepath, o_orderstatus as view, row_number() over (order by o_orderkey desc) <= 2 as is_query from orders"),
    "positional_zip": (positional_zip, "with a as (select p_partkey as path, row_number() over (order by p_partkey) - 1 as place from part), b as (select n as name, row_number() over (order by n) - 1 as place from (select p_name || '#' || p_partkey as n from part)) select * from a join b using (place)"),
    "box_labels": (box_labels, "select l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%d%% %.1fk', round_even(100 * (1.0e0 - 5 * l_discount), 0)::int, round_even(l_extendedprice / 1000, 1)) as label from lineitem"),
    "polygon_lists": (polygon_lists, f"with {_P}, n as (select contour_id, count(*) as n from p group by 1) select contour_id, 0 as polygon, (2 * pos + k)::int as i, case k when 0 then x else y end as value from p join n using (contour_id), unnest([0, 1]) t(k) where n >= 3 and pos < 4"),
    "contour_json": (contour_json, f"with {_P}, c as (select contour_id // 10 as image_id, contour_id, '[' || string_agg('[' || pos || ',' || floor(y)::int || ']', ',' order by pos) || ']' as t from p group by all) select image_id, '[' || string_agg(t, ',' order by contour_id) || ']' as value from c group by 1"),
    "coco_detections": (coco_detections, f"with {_D} select file_name, image_id, row_number() over (order by image_id, det_idx) as id, x - w / 2 as b0, y - h / 2 as b1, w as b2, h as b3, round(w * h, 4) as area, case when det_idx % 2 = 0 then 6 else 0 end as n, case when det_idx % 2 = 0 then x end as k3 from d join i using (file_name)"),
}
