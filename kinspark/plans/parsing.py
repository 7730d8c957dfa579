"""Queries of name, HTML and JSON parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinspark.functions import names as nm
from kinspark.plans.tables import table

_N = "n as (select p_partkey, p_brand || '/' || replace(p_name, ' ', '_') || case p_partkey % 4 when 0 then '_left.jpg' when 1 then '_RIGHT.JPG' when 2 then '_right.jpg' else '.txt' end as path from part)"


def _paths(spark, sf_dir):
    k = F.col("p_partkey") % 4
    end = F.when(k == 0, "_left.jpg").when(k == 1, "_RIGHT.JPG").when(k == 2, "_right.jpg").otherwise(".txt")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit("/"), F.translate("p_name", " ", "_"), end).alias("path"))


def name_parse(spark, sf_dir):
    p = F.col("path")
    return _paths(spark, sf_dir).select("p_partkey", nm.individual(p).alias("individual"), nm.view_strict(p).alias("view"), nm.view_loose(p).alias("loose"), nm.cache_name(p).alias("cache"), nm.reflected(p).alias("mirrored"))


_NAME = f"""with {_N}, b as (select *, split_part(path, '/', -1) as f from n)
select p_partkey, split_part(f, '_', 1) as individual, case when f like '%\\_left.jpg' escape '\\' then 'left' when f like '%\\_right.jpg' escape '\\' then 'right' end as view,
case when contains(lower(f), '_left.') then 'left' when contains(lower(f), '_right.') then 'right' end as loose,
regexp_replace(f, '\\.[^.]*$', '') || '.json' as cache, regexp_replace(path, '(\\.[^./]*)$', '_reflected\\1') as mirrored from b"""


def image_suffix(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy(nm.is_image(F.col("path")).alias("is_image")).agg(F.count(F.lit(1)).alias("n"))


def href_extract(spark, sf_dir):
    """Different last path segments of the links of all pages, with the number of pages that hold them."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(nm.hrefs(F.col("html")))).alias("href"))
    return links.select("page_id", nm.last_segment(F.col("href")).alias("segment")).groupBy("segment").agg(F.countDistinct("page_id").alias("pages"))


def json_props(spark, sf_dir):
    """Cached JSON by event type: how many documents are well formed, and the sum of their k."""
    k = F.get_json_object(F.col("props"), "$.k").cast("long")
    well = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.when(well.getField("k").isNotNull(), 1)).alias("parsed"), F.sum(k).alias("total"))


def photo_names(spark, sf_dir):
    """Photo file names made from keys and read back; large ones stay."""
    p = table(spark, sf_dir, "part").withColumn("size", F.when(F.col("p_partkey") % 3 == 0, "large").otherwise("small"))
    n = p.select("p_partkey", nm.photo_name(F.col("p_partkey"), F.col("size")).alias("name"))
    return n.select("p_partkey", "name", nm.photo_id(F.col("name")).alias("photo"), F.contains("name", F.lit("-large")).alias("kept"))


QUERIES = {
    "name_parse": (name_parse, _NAME),
    "image_suffix": (image_suffix, f"with {_N} select regexp_matches(lower(path), '\\.(jpg|jpeg|png|gif|bmp|tiff)$') as is_image, count(*) as n from n group by 1"),
    "href_extract": (href_extract, """with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from pages) select split_part(href, '/', -1) as segment, count(distinct page_id) as pages from l group by 1"""),
    "json_props": (json_props, "select event_type, count((props->>'k')::bigint) as parsed, sum((props->>'k')::bigint)::bigint as total from events group by 1"),
    "photo_names": (photo_names, "select p_partkey, 'pexels-photo-' || p_partkey || '-' || (case when p_partkey % 3 = 0 then 'large' else 'small' end) || '.jpg' as name, p_partkey as photo, p_partkey % 3 = 0 as kept from part"),
}
