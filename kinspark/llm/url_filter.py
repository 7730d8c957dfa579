"""URL filters: listed rules first, then a path-template tree with labelled purity. Native.

The tree has a root for each host and a level for each path segment, however many there are. A node with more than
CHILDREN different children is variable: digits of its children become "#", and children that are rare even so become
"*". That may make nodes one and the same, so it goes on until nothing changes.

Branches of a host that differ in one literal segment only are then compared, the deepest such segment first: each
branch's share of blocked labels is tested against that of all branches in its place (z test). Those that do not differ
become one branch, with "{}" for the segment, and so do branches without labels if none of the labelled ones differs;
branches that differ stay apart. That, too, goes on until no segment is left to compare.

A template's purity is its share of blocked labels, smoothed towards that of the node above it, which is smoothed
towards the node above that, up to the host and the share of all labels. So a template without labels has the purity of
the nearest node that has some. It is rejected if the purity exceeds REJECT. The pages that rules judge are the labels;
a table of own labels can be added.

Counts are summed by node before they are shuffled; where rows meet the decision on their node, the join is salted, so
a host with a third of all pages is no hot spot. Only nodes of many children are joined at all.

Cases: a null url or one without "://" has an empty host and path, no rule, and is allowed; very long paths are read
whole; equal urls share a template and a verdict; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinspark.llm.workspace import Workspace

#: Children a node may have before it counts as variable; share of its pages below which a child is rare.
CHILDREN, RARE = 12, 0.02
#: Weight of the smoothing, in labels; purity beyond which a template is rejected (more of its labels are blocked than
#: allowed); z of the merge test.
SMOOTHING, REJECT, MERGE_Z = 4.0, 0.5, 2.0
#: Parts that the rows of one node are dealt into where they meet a decision.
SALT = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.lit(None)
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, template, purity) of each row. labels: (id_col, blocked boolean), beside the rules."""
    ws = Workspace(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", matching_rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"))
    seen = rows.filter("host <> ''")
    blocked = F.col("ruled") == "block"
    if labels is not None:
        own = labels.select(F.col(id_col).alias("id"), F.col("blocked").cast("boolean").alias("blocked")).groupBy("id").agg(F.max("blocked").alias("blocked"))
        seen, blocked = seen.join(own, "id", "left"), F.coalesce(blocked, F.col("blocked"))
    tree = template_tree(seen.select("host", "path", blocked.alias("blocked")), ws)
    judged = seen.select("id", "host", "path", "rule", "ruled").join(tree, ["host", "path"])
    judged = judged.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("purity") > REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity")
    rest = rows.filter("host = ''").select("id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit("").alias("template"), F.lit(None).cast("double").alias("purity"))
    return judged.unionByName(rest).withColumnRenamed("id", id_col)


def template_tree(labelled: DataFrame, ws: Workspace) -> DataFrame:
    """(host, path, template, purity) for each different path of (host, path, blocked); blocked is null without a label."""
    count = [F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("blocked"), 1)).alias("bad"), F.count("blocked").alias("known")]
    paths = labelled.groupBy("host", "path").agg(*count)
    tokens = F.split("path", "/")
    paths = ws.save(paths.withColumn("tpl", F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).withColumn("id", F.monotonically_increasing_id()))
    while (changes := _generalised(paths, ws)) is not None:
        new = F.transform("tpl", lambda x, i: F.coalesce(F.try_element_at("changes", i), x))
        older, paths = paths, ws.save(paths.join(changes, "id", "left").withColumn("tpl", F.coalesce(new, "tpl")).drop("changes"))
        ws.drop(older, changes)
    templates = paths.groupBy("host", "tpl").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    groups = _merged(ws.save(templates.withColumn("group", F.col("tpl")).withColumn("tested", F.array().cast("array<int>"))), ws)
    purity = _purity(groups.groupBy("host", "group").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known")), ws)
    named = groups.select("host", "tpl", "group").join(purity, ["host", "group"])
    return paths.select("host", "path", "tpl").join(named, ["host", "tpl"]).select("host", "path", F.concat(F.lit("/"), F.array_join("group", "/")).alias("template"), "purity")


def _salted(decisions: DataFrame) -> DataFrame:
    return decisions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _nodes(tokens: str) -> Column:
    """The nodes from the root of `host` down to the whole of an array of tokens: each a hash of the node above and a token."""
    root = F.array(F.xxhash64("host"))
    return F.aggregate(tokens, root, lambda nodes, x: F.array_append(nodes, F.xxhash64(F.element_at(nodes, -1), x)))


def _generalised(paths: DataFrame, ws: Workspace) -> DataFrame | None:
    """(id, changes map<position, token>) of paths with a variable node; None if no token changes."""
    cells = paths.select("id", "n", F.posexplode(F.arrays_zip(F.col("tpl").alias("child"), F.slice(_nodes("tpl"), 1, F.size("tpl")).alias("node"))).alias("pos", "c"))
    cells = cells.select("id", "n", "pos", "c.child", "c.node")
    children = ws.save(cells.groupBy("node", "child").agg(F.sum("n").alias("c")))
    digit = F.col("child").rlike("[0-9]")
    totals = children.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("t"), F.max(digit).alias("digits"))
    variable = ws.save(totals.filter(F.col("k") > CHILDREN))
    common = children.withColumn("salt", F.pmod(F.xxhash64("child"), F.lit(SALT)).cast("int")).join(_salted(variable.filter("not digits")), ["node", "salt"])
    common = common.filter(F.col("c") >= RARE * F.col("t")).groupBy("node").agg(F.collect_list("child").alias("common"))  # 1 / RARE of them at most
    decisions = ws.save(variable.join(common, "node", "left").select("node", "digits", F.coalesce("common", F.array().cast("array<string>")).alias("common")))
    name = F.when(F.col("digits"), F.regexp_replace("child", "[0-9]+", "#")).when(F.array_contains("common", F.col("child")), F.col("child")).otherwise("*")
    met = cells.withColumn("salt", F.pmod("id", F.lit(SALT)).cast("int")).join(_salted(decisions), ["node", "salt"]).withColumn("name", name).filter("name <> child")
    changes = ws.save(met.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "name"))).alias("changes")))
    ws.drop(children, variable, decisions)
    if changes.isEmpty():
        ws.drop(changes)
        return None
    return changes


def _literals(group: str, tested: str) -> Column:
    """Positions of the tokens of a template that are names, and have not been compared."""
    at = F.sequence(F.lit(0), F.greatest(F.size(group) - 1, F.lit(0)))
    return F.filter(at, lambda i: F.coalesce(~F.get(group, i).rlike("[#*{}]|^$"), F.lit(False)) & ~F.array_contains(tested, i))


def _merged(templates: DataFrame, ws: Workspace) -> DataFrame:
    """templates (host, tpl, group, tested, bad, known) with the group that each has come into."""
    while True:
        groups = templates.groupBy("host", "group", "tested").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"))
        groups = ws.save(groups.withColumn("gid", F.monotonically_increasing_id()))
        whole = F.aggregate(F.transform("group", lambda x, i: F.xxhash64(i, x)), F.xxhash64("host"), lambda h, x: h.bitwiseXOR(x))
        each = groups.withColumn("whole", whole).select("gid", "group", "whole", F.explode(_literals("group", "tested")).alias("pos"))
        # a template with a mark in place of one token: its hash, without the template, which is as long as all these together
        place = F.col("whole").bitwiseXOR(F.xxhash64("pos", F.get("group", F.col("pos")))).bitwiseXOR(F.xxhash64("pos", F.lit("{}")))
        each = ws.save(each.select("gid", "pos", place.alias("place")))
        shared = each.groupBy("place").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("place")
        deepest = each.join(shared, "place", "left_semi").groupBy("gid").agg(F.max(F.struct("pos", "place")).alias("c")).select("gid", "c.*")
        mask = F.transform("group", lambda x, i: F.when(i == F.col("pos"), F.lit("{}")).otherwise(x))
        chosen = ws.save(groups.join(deepest, "gid").withColumn("mask", mask).drop("gid"))
        ws.drop(each, groups)
        if chosen.isEmpty():
            ws.drop(chosen)
            return templates
        pool = chosen.groupBy("place").agg(F.count(F.lit(1)).alias("m"), (F.try_divide(F.sum("bad"), F.sum("known"))).alias("p"))
        own = F.try_divide(F.col("bad"), F.col("known"))
        differs = F.abs(own - F.col("p")) > MERGE_Z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("known")) + 1e-9
        judged = chosen.join(pool, "place").withColumn("differs", F.coalesce(differs, F.lit(False)))
        torn = judged.groupBy("place").agg(F.max("differs").alias("torn"))
        judged = judged.join(torn, "place")
        joins = (F.col("m") > 1) & ~F.col("differs") & ~((F.col("known") == 0) & F.col("torn"))
        step = judged.select("host", "group", "tested", F.when(joins, F.col("mask")).otherwise(F.col("group")).alias("new_group"), F.array_append("tested", F.col("pos")).alias("new_tested"))
        older, templates = templates, templates.join(step, ["host", "group", "tested"], "left")
        templates = templates.select("host", "tpl", "n", "bad", "known", F.coalesce("new_group", "group").alias("group"), F.array_sort(F.coalesce("new_tested", "tested")).alias("tested"))
        templates = ws.save(templates)
        ws.drop(older, chosen)


def _purity(groups: DataFrame, ws: Workspace) -> DataFrame:
    """(host, group, purity): smoothed from the share of all labels down to the template."""
    whole = groups.agg((F.sum("bad") / F.greatest(F.sum("known"), F.lit(1))).alias("p")).first().p or 0.0
    groups = ws.save(groups.withColumn("gid", F.monotonically_increasing_id()))
    nodes = ws.save(groups.select("gid", "bad", "known", F.posexplode(_nodes("group")).alias("d", "node")))
    sums = nodes.groupBy("node").agg(F.sum("bad").alias("b"), F.sum("known").alias("k"))
    line = nodes.select("gid", "d", "node").join(sums, "node").groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("d", "b", "k"))).alias("line"))
    return groups.join(line, "gid").select("host", "group", F.aggregate("line", F.lit(float(whole)), lambda p, x: (x.b + SMOOTHING * p) / (x.k + SMOOTHING)).alias("purity"))
