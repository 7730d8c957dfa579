"""Queries of boxes, contours, signals and annotation export."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinspark.functions import boxes as bx
from kinspark.operators import contours as ct
from kinspark.operators import detections as dt
from kinspark.operators import signal as sg
from kinspark.operators.curvature import SCALES, integral_curvature, neighbours_within
from kinspark.operators.numbering import numbered
from kinspark.plans.tables import boxes, polylines, series, table
from kinspark.sources import sinks

_B = """b as (select l_orderkey as image_id, ((l_linenumber::bigint * 1000000 + l_partkey) * 100000 + l_suppkey) * 100 + l_quantity::bigint as det_idx, 11 + l_linenumber % 6 as version, 1.0e0 - 5 * l_discount as confidence, l_quantity * (1 + l_tax) as area,
(l_partkey % 100)::double as x1, (l_suppkey % 100)::double as y1, l_partkey % 100 + 20 + l_quantity as x2, l_suppkey % 100 + 30 + l_quantity as y2 from lineitem)"""
_PAIRS = f"""{_B}, ok as (select * from b where confidence >= 0.5e0),
f as (select image_id, version, count(*) as n, arg_min(struct_pack(x1, y1, x2, y2), det_idx) as q from ok group by all),
p as (select a.image_id, a.version as v1, b.version as v2,
  greatest(0, least(a.q.x2, b.q.x2) - greatest(a.q.x1, b.q.x1)) * greatest(0, least(a.q.y2, b.q.y2) - greatest(a.q.y1, b.q.y1)) as i,
  greatest(0, a.q.x2 - a.q.x1) * greatest(0, a.q.y2 - a.q.y1) + greatest(0, b.q.x2 - b.q.x1) * greatest(0, b.q.y2 - b.q.y1) as s
  from f a join f b on a.image_id = b.image_id and a.version < b.version),
u as (select image_id, v1, v2, case when s - i <= 0 then 0 else i / (s - i) end as iou from p)"""


def iou_pairs(spark, sf_dir):
    out = dt.version_pairs(dt.first_boxes(boxes(spark, sf_dir)))
    return out.select("image_id", "v1", "v2", F.round(F.col("iou") + 1e-9, 5).alias("iou"))


_WEIGHTS = {11: 0.1, **dt.WEIGHTS}


def consensus_score(spark, sf_dir):
    return dt.consensus_score(boxes(spark, sf_dir), _WEIGHTS)


_CONSENSUS = f"""with {_PAIRS}, w as (select * from (values {', '.join(f'({a}, {b}, {round((_WEIGHTS[a] + _WEIGHTS[b]) / 2, 2)}e0)' for a in _WEIGHTS for b in _WEIGHTS if a < b)}) w(v1, v2, w)),
g as (select image_id, sum(iou * w) as g from u join w using (v1, v2) group by 1),
m as (select image_id, count(*) as models, count(*) filter (n >= 2) as flags from f group by 1)
select i.image_id, case when coalesce(models, 0) < 3 then -1.0e0 else round_even((coalesce(g, 0) - 0.2e0 * flags) / {sum(_WEIGHTS.values()) * 2}e0, 4) end as score
from (select distinct image_id from b) i left join m using (image_id) left join g using (image_id)"""


def triage_label(spark, sf_dir):
    return dt.triage_labels(boxes(spark, sf_dir))


_TRIAGE = f"""with {_B}, r as (select image_id, list(area order by area desc) filter (confidence > 0.8e0) as h, list(area order by area desc) filter (confidence > 0.7e0) as m,
count(*) filter (confidence > 0.9e0) as n9, count(*) filter (confidence > 0.6e0) as n6 from b group by 1),
k as (select image_id, coalesce(len(h), 0) as nh, coalesce(len(m), 0) as nm, n9, n6, h[1] / h[2] as rh, m[1] / m[2] as rm from r)
select image_id, case when nh > 1 then case when rh >= 4 then 'Probable' when rh >= 3 then 'Uncertain' when rh >= 2 then 'Likely Bad' else 'Rejected' end
when nh = 1 then case when n9 = 1 then 'Certain' else 'Probable' end
when nm > 1 then case when rm >= 4 then 'Uncertain' when rm >= 2 then 'Likely Bad' else 'Rejected' end
when nm = 1 then 'Probable' when n6 = 0 then 'Rejected' else 'Uncertain' end as label from k"""


def triage_counts(spark, sf_dir):
    return triage_label(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def pad_clamp_crop(spark, sf_dir):
    """Face crops of boxes around (x1, y1) and ear crops of the boxes, in a frame of 120 by 110."""
    b = boxes(spark, sf_dir)
    w, h = F.lit(120), F.lit(110)
    face = bx.face_crop(F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), w, h)
    ear = bx.ear_crop(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), w, h)
    return b.select("image_id", "det_idx", *(c.alias(f"f{i}") for i, c in enumerate(face)), *(c.alias(f"e{i}") for i, c in enumerate(ear)))


_CROP = f"""with {_B}, s as (select *, x2 - x1 as w, y2 - y1 as h from b)
select image_id, det_idx,
{', '.join(f"greatest(0, least(trunc({c} {s} {d} / 2)::int {s} trunc({d} * 0.05e0)::int, {m})) as f{i}" for i, (c, s, d, m) in enumerate([('x1', '-', 'w', 120), ('y1', '-', 'h', 110), ('x1', '+', 'w', 120), ('y1', '+', 'h', 110)]))},
{', '.join(f"greatest(0, least(trunc({c} {s} 0.1e0 * {d})::int, {m})) as e{i}" for i, (c, s, d, m) in enumerate([('x1', '-', 'w', 120), ('y1', '-', 'h', 110), ('x2', '+', 'w', 120), ('y2', '+', 'h', 110)]))}
from s"""


def best_box(spark, sf_dir):
    return dt.best_box(boxes(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def box_conversions(spark, sf_dir):
    """Corners and sides of the boxes, taken as center boxes, as top-left boxes and back."""
    b = boxes(spark, sf_dir)
    t = bx.center_to_top_left(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    back = b.withColumn("t", t).withColumn("c", bx.top_left_to_center(*(F.get("t", F.lit(i)) for i in range(4))))
    return back.select("image_id", "det_idx", F.get("t", F.lit(0)).alias("x"), F.get("t", F.lit(1)).alias("y"), F.get("c", F.lit(0)).alias("cx"), F.get("c", F.lit(1)).alias("cy"))


_P = """p as (select user_id as contour_id, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as pos, (row_number() over (partition by user_id order by ts, event_id) - 1)::double as x, value as y from events)"""
_E = "e as (select contour_id, count(*) as n, arg_min(y, pos) as y0, arg_max(y, pos) as y1, avg(x) as cx, avg(y) as cy, min(x) as xmin, max(x) as xmax, min(y) as ymin, max(y) as ymax, arg_min(x, pos) as x0, arg_max(x, pos) as x1 from p group by 1)"


def polygon_area(spark, sf_dir):
    return ct.polygon_area(polylines(spark, sf_dir)).withColumn("area", F.round("area", 4))


_AREA = f"""with {_P}, n as (select *, coalesce(lead(x) over w, first_value(x) over w) as nx, coalesce(lead(y) over w, first_value(y) over w) as ny from p window w as (partition by contour_id order by pos))
select contour_id, round(abs(sum(x * ny - y * nx)) / 2, 4) as area from n group by 1"""


def orient_contour(spark, sf_dir):
    return ct.orient(polylines(spark, sf_dir))


_ORIENT = f"with {_P}, {_E} select contour_id, (case when y1 - y0 > 0 then pos else n - 1 - pos end)::int as pos, x, y from p join e using (contour_id)"


def _centres(spark, sf_dir):
    """Each user's contour centre and, for the image of ten users, three anchors: users 0, 3 and 6 of the ten."""
    c = polylines(spark, sf_dir).groupBy("contour_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")).withColumn("image_id", F.floor(F.col("contour_id") / 10))
    a = c.filter(F.col("contour_id") % 10 % 3 == 0).select("image_id", (F.col("contour_id") % 10).alias("anchor_idx"), (F.col("cx") + 1).alias("ax"), F.col("cy").alias("ay"))
    return c, a


def nearest_anchor(spark, sf_dir):
    return ct.nearest_anchor(*_centres(spark, sf_dir))


_ANCHOR = f"""with {_P}, {_E}, c as (select contour_id, contour_id // 10 as image_id, cx, cy from e), a as (select image_id, contour_id % 10 as anchor_idx, cx + 1 as ax, cy as ay from c where contour_id % 10 % 3 = 0)
select c.image_id, contour_id, anchor_idx from c join a using (image_id) qualify row_number() over (partition by contour_id order by pow(cx - ax, 2) + pow(cy - ay, 2), anchor_idx) = 1"""


def nearest_vertex(spark, sf_dir):
    """The points nearest to two anchors: the contour's centre and its upper left corner."""
    p = polylines(spark, sf_dir)
    g = p.groupBy("contour_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("mx"), F.min("y").alias("my"))
    a = g.select("contour_id", F.explode(F.array(F.struct(F.lit(0).alias("anchor_idx"), F.col("cx").alias("ax"), F.col("cy").alias("ay")), F.struct(F.lit(1).alias("anchor_idx"), F.col("mx").alias("ax"), F.col("my").alias("ay")))).alias("a")).select("contour_id", "a.*")
    return ct.nearest_vertex(p, a)


_VERTEX = f"""with {_P}, {_E}, a as (select contour_id, 0 as anchor_idx, cx as ax, cy as ay from e union all select contour_id, 1, xmin, ymin from e)
select contour_id, anchor_idx, pos from p join a using (contour_id) qualify row_number() over (partition by contour_id, anchor_idx order by pow(x - ax, 2) + pow(y - ay, 2), pos) = 1"""


def view_label(spark, sf_dir):
    p = polylines(spark, sf_dir).groupBy("contour_id").agg(F.avg("y").alias("cx"), F.min_by("y", "pos").alias("ax0"), F.max_by("y", "pos").alias("ax1"))
    return ct.view_label(p)


def cut_longer(spark, sf_dir):
    """Contours cut at their lowest and highest point."""
    p = polylines(spark, sf_dir)
    cuts = p.groupBy("contour_id").agg(F.min_by("pos", F.struct("y", "pos")).alias("i"), F.min_by("pos", F.struct((-F.col("y")).alias("y"), "pos")).alias("j"))
    return ct.cut_longer(p, cuts)


_LONGER = f"""with {_P}, k as (select contour_id, (first(pos order by y, pos)) as i, (first(pos order by y desc, pos)) as j, count(*)::int as n from p group by 1),
c as (select contour_id, least(i, j) as lo, greatest(i, j) as hi, n, hi - lo + 1 > n - hi + lo + 1 as inside from k)
select contour_id, (case when inside then pos - lo when pos >= hi then pos - hi else n - hi + pos end)::bigint as pos, x, y from p join c using (contour_id)
where (inside and pos between lo and hi) or (not inside and (pos >= hi or pos <= lo))"""


def densify(spark, sf_dir):
    out = ct.densify(polylines(spark, sf_dir), 2.0)
    return out.select("contour_id", "edge", "step", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_DENSE = f"""with {_P}, l as (select *, coalesce(lag(x) over w, last_value(x) over (partition by contour_id order by pos rows between unbounded preceding and unbounded following)) as px,
coalesce(lag(y) over w, last_value(y) over (partition by contour_id order by pos rows between unbounded preceding and unbounded following)) as py from p window w as (partition by contour_id order by pos)),
d as (select *, sqrt(pow(x - px, 2) + pow(y - py, 2)) as len from l)
select contour_id, pos as edge, s::int as step, round(px + s * 2.0e0 / len * (x - px), 4) as x, round(py + s * 2.0e0 / len * (y - py), 4) as y
from d, unnest(range(0, floor(len / 2.0e0)::bigint + 1)) t(s) where len > 0"""


def select_by_weight(spark, sf_dir):
    b = boxes(spark, sf_dir).select("image_id", F.col("det_idx").alias("idx"), "area", "confidence")
    return ct.select_by_weight(b, "auto").withColumn("weight", F.round("weight", 4))


_SELECT = f"""with {_B}, r as (select image_id, det_idx as idx, area * confidence as weight, row_number() over (partition by image_id order by area * confidence desc, det_idx) as rank from b),
s as (select *, max(weight) filter (rank = 1) over (partition by image_id) as w1, max(weight) filter (rank = 2) over (partition by image_id) as w2 from r)
select image_id, idx, round(weight, 4) as weight, rank from s where rank <= case when w2 is null or w1 > 3 * w2 then 1 else 2 end"""


def resample_linear(spark, sf_dir):
    return sg.resample_linear(series(spark, sf_dir), 64).withColumn("value", F.round(F.col("value") + 1e-9, 4))


_RESAMPLE = f"""with {_P}, v as (select contour_id, list(y order by pos) as v, count(*) as n from p group by 1), a as (select *, i * (n - 1) / 64e0 as u from v, unnest(range(0, 64)) t(i))
select contour_id as series_id, i::int as i, round(v[floor(u)::int + 1] + (v[least(floor(u)::int + 2, n)] - v[floor(u)::int + 1]) * (u - floor(u)) + 1e-9, 4) as value from a"""


def resample_polyline(spark, sf_dir):
    out = sg.resample_polyline(polylines(spark, sf_dir), 32)
    return out.select("contour_id", "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_ARC = f"""with {_P}, s as (select *, sum(step) over (partition by contour_id order by pos) as s from (select *, coalesce(sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)), 0) as step from p window w as (partition by contour_id order by pos))),
g as (select contour_id, s, lead(s) over w as s1, x, y, lead(x) over w as x1, lead(y) over w as y1, max(s) over (partition by contour_id) as total from s window w as (partition by contour_id order by pos)),
i as (select contour_id, total, i from (select distinct contour_id, total from g where total > 0), unnest(range(0, 32)) t(i))
select i.contour_id, i::int as i, round(x + least(1, (i * (i.total / 31) - s) / (s1 - s)) * (x1 - x), 4) as x, round(y + least(1, (i * (i.total / 31) - s) / (s1 - s)) * (y1 - y), 4) as y
from i join g on g.contour_id = i.contour_id and s1 > s and i * (i.total / 31) >= s - 1e-9 * (i.total / 31) and (i * (i.total / 31) < s1 - 1e-9 * (i.total / 31) or (i = 31 and s1 >= g.total))"""

_GAUSS = [math.exp(-0.5 * (k / 2.0) ** 2) for k in range(-8, 9)]
_GAUSS = [w / sum(_GAUSS) for w in _GAUSS]


def gaussian_smooth(spark, sf_dir):
    return sg.gaussian_smooth(series(spark, sf_dir)).withColumn("value", F.round("value", 5))


_SMOOTH = f"""with {_P}, n as (select contour_id, count(*) as n from p group by 1), k as (select k - 8 as k, ({_GAUSS})[k + 1] as w from range(0, 17) t(k)),
m as (select p.contour_id, p.pos, k.w, n, (((p.pos + k.k) % (2 * n)) + 2 * n) % (2 * n) as m from p join n using (contour_id) cross join k)
select m.contour_id as series_id, m.pos, round(sum(m.w * q.y), 5) as value from m join p q on q.contour_id = m.contour_id and q.pos = case when m.m < n then m.m else 2 * n - 1 - m.m end group by all"""


def local_extrema(spark, sf_dir):
    return sg.local_extrema(series(spark, sf_dir)).select("series_id", "pos", "kind")


def _around(side: str, end: str) -> str:
    return ", ".join(f"coalesce({side}(y, {k}) over w, {end}) " for k in (1, 2, 3))


_EXTREMA = f"""with {_P}, b as (select *, first_value(y) over w as lo, last_value(y) over (partition by contour_id order by pos rows between unbounded preceding and unbounded following) as hi from p window w as (partition by contour_id order by pos)),
a as (select contour_id, pos, y, [{_around('lag', 'lo')}, {_around('lead', 'hi')}] as r from b window w as (partition by contour_id order by pos))
select contour_id as series_id, pos, case when y > list_max(r) then 'max' else 'min' end as kind from a where y > list_max(r) or y < list_min(r)"""


def keypoint_pairs(spark, sf_dir):
    """All pairs of each series' first extrema: its 32 largest by distance from 0.5."""
    e = sg.local_extrema(series(spark, sf_dir))
    rk = F.row_number().over(Window.partitionBy("series_id").orderBy(F.abs(F.col("value") - 0.5).desc(), "pos"))
    return sg.keypoint_pairs(e.withColumn("rk", rk).filter("rk <= 32").select("series_id", "pos"))


_KEYS = _EXTREMA.replace("select contour_id as series_id, pos, case", "select * from (select contour_id as series_id, pos, y, case") + ")"
_KEYPAIRS = f"""with x as ({_KEYS}), k as (select series_id, pos from x qualify row_number() over (partition by series_id order by abs(y - 0.5e0) desc, pos) <= 32)
select a.series_id, a.pos as kp0, b.pos as kp1 from k a join k b on a.series_id = b.series_id and a.pos < b.pos"""


def coco_ids(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_name"), F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".jpg")).alias("file_name"))
    return sinks.coco_ids(files)


def coco_bbox(spark, sf_dir):
    c = sinks.coco_annotations(polylines(spark, sf_dir))
    return c.select("contour_id", *(F.round(F.get("bbox", F.lit(i)), 5).alias(f"b{i}") for i in range(4)), F.round("area", 4).alias("area"), *(F.round(F.get("keypoints", F.lit(i)), 5).alias(f"k{i}") for i in range(6)))


_COCO = f"""with {_P}, {_E} select contour_id, round(xmin, 5) as b0, round(ymin, 5) as b1, round(xmax - xmin, 5) as b2, round(ymax - ymin, 5) as b3, round((xmax - xmin) * (ymax - ymin), 4) as area,
round(x0, 5) as k0, round(y0, 5) as k1, 2.0e0 as k2, round(x1, 5) as k3, round(y1, 5) as k4, 2.0e0 as k5 from e where n >= 2"""


def palette(spark, sf_dir):
    """A colour for each supplier, evenly spread in the order of their keys."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    rows = numbered(s, ["s_suppkey"], "i").crossJoin(n)  # beside one row
    return rows.select("s_suppkey", bx.palette(F.col("i"), F.col("n")).alias("c")).select("s_suppkey", *(F.get("c", F.lit(k)).alias(n) for k, n in enumerate("rgb")))


_PALETTE = """with n as (select s_suppkey, (row_number() over (order by s_suppkey) - 1) * 360 // (select count(*) from supplier) as h from supplier),
h as (select s_suppkey, trunc(255 * (1 - abs(((h / 60e0) % 2) - 1)))::int as x, h // 60 as s from n)
select s_suppkey, case s when 0 then 255 when 1 then x when 2 then 0 when 3 then 0 when 4 then x else 255 end as r, case s when 0 then x when 1 then 255 when 2 then 255 when 3 then x else 0 end as g, case s when 0 then 0 when 1 then 0 when 2 then x when 3 then 255 when 4 then 255 else x end as b from h"""


def curvature(spark, sf_dir):
    out = integral_curvature(polylines(spark, sf_dir))
    return out.withColumn("curv", F.round(F.col("curv") + 1e-9, 5))


_CURVATURE = f"""with {_P}, {_E}, r as (select contour_id, k::int as scale_idx, ([0.02e0, 0.04e0, 0.06e0, 0.08e0])[k + 1] * greatest(xmax - xmin, ymax - ymin) as r from e, range(0, 4) t(k)),
m as (select a.contour_id, a.pos, scale_idx, r, b.pos as j, b.x - a.x as dx, b.y - a.y as dy from p a join p b using (contour_id) join r using (contour_id)
  where (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) <= r * r),
c as (select contour_id, pos, scale_idx, count(*) as n, atan2(arg_max(dy, j) - arg_min(dy, j), arg_max(dx, j) - arg_min(dx, j)) as a from m group by all),
t as (select m.*, n, cos(a) * dx + sin(a) * dy as u, cos(a) * dy - sin(a) * dx as v from m join c using (contour_id, pos, scale_idx)),
l as (select *, lead(u) over w as u1, lead(v) over w as v1 from t window w as (partition by contour_id, pos, scale_idx order by j)),
s as (select contour_id, pos, scale_idx, any_value(n) as n, any_value(r) as r, sum(((v + v1) / 2 + r) * (u1 - u)) as area, greatest(min(u), -any_value(r)) as lo, least(max(u), any_value(r)) as hi from l group by all)
select contour_id, pos, scale_idx, round(case when n = 1 then 0.5e0 when (hi - lo) * 2 * r > 0 then area / ((hi - lo) * 2 * r) end + 1e-9, 5) as curv from s"""


def range_neighbours(spark, sf_dir):
    """Points of each contour within a tenth of its extent of each of its points."""
    near = neighbours_within(polylines(spark, sf_dir), 0.1)
    return near.groupBy("contour_id", "pos").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("first"), F.max("other").alias("last"))


_NEAR = f"""with {_P}, {_E}, r as (select contour_id, 0.1e0 * greatest(xmax - xmin, ymax - ymin) as r from e)
select a.contour_id, a.pos, count(*) as n, min(b.pos) as first, max(b.pos) as last from p a join p b using (contour_id) join r using (contour_id)
where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= r * r group by all"""


def radii(spark, sf_dir):
    return ct.radii(polylines(spark, sf_dir), list(SCALES)).withColumn("radius", F.round("radius", 6))


def rotated(spark, sf_dir):
    """Contours turned by a tenth of their number about (1, 2)."""
    p = polylines(spark, sf_dir)
    angles = p.select("contour_id").distinct().select("contour_id", (F.col("contour_id") / 10).alias("angle"), F.lit(1.0).alias("cx"), F.lit(2.0).alias("cy"))
    return ct.rotated(p, angles).select("contour_id", "pos", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def reoriented(spark, sf_dir):
    """Contours seen from their centre with a level chord."""
    p = polylines(spark, sf_dir)
    out = ct.reoriented(p, p.groupBy("contour_id").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))
    return out.select("contour_id", "pos", F.round(F.col("x") + 1e-9, 4).alias("x"), F.round(F.col("y") + 1e-9, 4).alias("y"))


_REORIENTED = f"""with {_P}, {_E}, a as (select *, atan2(y1 - y0, x1 - x0) as a from e)
select contour_id, pos, round(cos(a) * (x - cx) + sin(a) * (y - cy) + 1e-9, 4) as x, round(cos(a) * (y - cy) - sin(a) * (x - cx) + 1e-9, 4) as y from p join a using (contour_id)"""


def mirrored(spark, sf_dir):
    """Contours in pictures as wide as a hundred more than their number."""
    p = polylines(spark, sf_dir)
    return ct.mirrored(p, p.select("contour_id").distinct().withColumn("width", F.col("contour_id") + 100))


def keypoints(spark, sf_dir):
    """At most eight keypoints of each series, resampled to 64 samples and smoothed."""
    smooth = sg.gaussian_smooth(sg.resample_linear(series(spark, sf_dir), 64).select("series_id", F.col("i").alias("pos"), "value"))
    smooth = smooth.withColumn("value", F.round("value", 9))
    return sg.keypoints(sg.local_extrema(smooth), smooth, 64, 8)


_KEYPOINTS = f"""with {_P}, l as (select contour_id, list(y order by pos) as v, count(*) as n from p group by 1),
u as (select contour_id, i::int as i, i * (n - 1) / 64e0 as t, v, n from l, range(0, 64) t(i)),
e as (select contour_id, list(v[floor(t)::int + 1] + (v[least(floor(t)::int + 2, n)] - v[floor(t)::int + 1]) * (t - floor(t)) order by i) as v from u group by 1),
s as (select contour_id, i::int as pos, round(list_dot_product([v[case when j < 64 then j + 1 else 128 - j end] for j in [(((i + k) % 128) + 128) % 128 for k in range(-8, 9)]], {_GAUSS}), 9) as y from e, range(0, 64) t(i)),
b as (select *, first_value(y) over w as lo, last_value(y) over (partition by contour_id order by pos rows between unbounded preceding and unbounded following) as hi from s window w as (partition by contour_id order by pos)),
a as (select contour_id, pos, y, [{_around('lag', 'lo')}, {_around('lead', 'hi')}] as r from b window w as (partition by contour_id order by pos)),
x as (select contour_id, pos, case when y > list_max(r) then 0 else 1 end as kind from a where y > list_max(r) or y < list_min(r)),
k as (select contour_id, list(pos order by kind, pos) as p from x group by 1),
f as (select contour_id, list_concat(case when p[1] > 1 then [0] else [] end, list_concat(p, case when p[-1] < 62 then [63] else [] end)) as p from k),
o as (select contour_id, unnest(p) as pos, generate_subscripts(p, 1) as g, len(p) as m from f),
w as (select o.contour_id, o.pos, row_number() over (partition by o.contour_id order by case when g = 1 or g = m then 1e308 else abs(y - 0.5e0) end desc, o.pos) as rk from o join s using (contour_id, pos))
select distinct contour_id as series_id, pos::int as pos from w where rk <= 8"""


def descriptors(spark, sf_dir):
    return sg.descriptors(series(spark, sf_dir))


QUERIES = {
    "iou_pairs": (iou_pairs, f"with {_PAIRS} select image_id, v1, v2, round(iou + 1e-9, 5) as iou from u"),
    "consensus_score": (consensus_score, _CONSENSUS),
    "triage_label": (triage_label, _TRIAGE),
    "triage_counts": (triage_counts, f"select label, count(*) as n from ({_TRIAGE}) group by 1"),
    "pad_clamp_crop": (pad_clamp_crop, _CROP),
    "best_box": (best_box, f"with {_B} select image_id, det_idx, round(confidence, 6) as confidence from b qualify row_number() over (partition by image_id order by confidence desc, det_idx) = 1"),
    "box_conversions": (box_conversions, f"with {_B} select image_id, det_idx, x1 - x2 / 2 as x, y1 - y2 / 2 as y, x1 - x2 / 2 + x2 / 2 as cx, y1 - y2 / 2 + y2 / 2 as cy from b"),
    "polygon_area": (polygon_area, _AREA),
    "orient_contour": (orient_contour, _ORIENT),
    "nearest_anchor": (nearest_anchor, _ANCHOR),
    "nearest_vertex": (nearest_vertex, _VERTEX),
    "view_label": (view_label, f"with {_P}, {_E} select contour_id, case when (y0 + y1) / 2 > cy then 'right' else 'left' end as view from e"),
    "cut_longer": (cut_longer, _LONGER),
    "densify": (densify, _DENSE),
    "select_by_weight": (select_by_weight, _SELECT),
    "resample_linear": (resample_linear, _RESAMPLE),
    "resample_polyline": (resample_polyline, _ARC),
    "gaussian_smooth": (gaussian_smooth, _SMOOTH),
    "local_extrema": (local_extrema, _EXTREMA),
    "keypoint_pairs": (keypoint_pairs, _KEYPAIRS),
    "coco_ids": (coco_ids, "select file_name, row_number() over (order by file_name) - 1 as image_id from (select p_name || '-' || p_partkey || '.jpg' as file_name from part)"),
    "coco_bbox": (coco_bbox, _COCO),
    "palette": (palette, _PALETTE),
    "curvature": (curvature, _CURVATURE),
    "range_neighbours": (range_neighbours, _NEAR),
    "radii": (radii, f"with {_P}, {_E} select contour_id, k::int as scale_idx, round(greatest(xmax - xmin, ymax - ymin) * ([0.02e0, 0.04e0, 0.06e0, 0.08e0])[k + 1], 6) as radius from e, range(0, 4) t(k)"),
    "rotated": (rotated, f"with {_P} select contour_id, pos, round(cos(contour_id / 10) * (x - 1) + sin(contour_id / 10) * (y - 2), 4) as x, round(cos(contour_id / 10) * (y - 2) - sin(contour_id / 10) * (x - 1), 4) as y from p"),
    "reoriented": (reoriented, _REORIENTED),
    "mirrored": (mirrored, f"with {_P} select contour_id, pos, contour_id + 100 - 1 - x as x, y from p"),
    "keypoints": (keypoints, _KEYPOINTS),
    "descriptors": (descriptors, None),
}
