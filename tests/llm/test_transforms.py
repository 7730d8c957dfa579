"""Fill-in-the-middle, mixing and timestamps against brute force, SQL and hand-made edges."""

import hashlib
import random
import re
from datetime import datetime, timedelta, timezone
from fractions import Fraction
from zoneinfo import ZoneInfo

import duckdb
import pytest
from pyspark.sql import functions as F

from kinspark.llm import queries as q
from kinspark.llm.fill_in_middle import count_units, cuts, ends_at, fill_in_middle, restored
from kinspark.llm.lookup import attach
from kinspark.llm.mixing import cycled, mix_sources, targets, word_count
from kinspark.llm.timestamps import majorities, normalise_stamps, settle, vote
from kinspark.llm.workspace import Workspace
from tests.conftest import DATA, compare

SMALL = str(DATA / "sf0.001")
CLASHING = "doc_id long, text string, lang string, source string, n long, form string, h1 int, t int, c int, size int, bucket string, class int, target int"


def rows(spark, texts, sources=None, ids=None):
    found = [(i, t, "en", s, 1, "f", 2, 3, 4, 5, "b", 6, 7) for i, t, s in zip(ids or range(len(texts)), texts, sources or ["s"] * len(texts), strict=True)]
    return spark.createDataFrame(found, CLASHING)


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for t in ("documents", "stamps"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_mixing", "op13_timestamps"])
def test_query_matches_sql(spark, views, name):
    compare(spark, views, q.queries()[name], q.oracle_sql()[name])


# fill in the middle


def plain_form(doc_id, text, seed=1):
    """With all units in a list."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_units_are_counted_and_cut_without_a_list():
    r = random.Random(3)
    for _ in range(500):
        text = "".join(r.choice("abAB 1é日\n<>PSM𝔸") for _ in range(r.randrange(30)))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert count_units(text) == len(units)
        ranks = sorted(r.randrange(len(units) + 1) for _ in range(3))
        assert list(ends_at(text, *ranks)) == [len("".join(units[:k])) for k in ranks]
    assert cuts("", None, None) == (0, None, None)
    assert cuts("ab", 0, 1) == (1, 0, 2)


def test_fill_in_middle_equals_brute_force_and_comes_back(spark):
    r = random.Random(4)
    texts = [None, "", " ", "one", "x" * 5000, "<P> in it", "ends with <", "<P", "S><M", "ünï 𝔸𝔹 日本", "a\r\nb\tc", "word " * 40_000, "same text", "same text"]
    texts += ["".join(r.choice("abC 1é日\n<>PSM𝔸") for _ in range(r.randrange(60))) for _ in range(400)]
    ids = [*range(len(texts) - 2), 5, None]
    out = fill_in_middle(rows(spark, texts, ids=ids)).withColumn("again", restored(F.col("output"), F.col("form")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, r.again) for r in out.collect())
    want = sorted((i is None, i or 0, *(x or 0 if k in (2, 3) else x for k, x in enumerate(plain_form(i, t))), t or "") for i, t in zip(ids, texts, strict=True))
    assert got == want
    assert {g[3] for g in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_parameters_and_empty_table(spark):
    df = rows(spark, ["a b c d e"] * 50)
    assert {r.form for r in fill_in_middle(df, percent=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(df, percent=100, percent_spm=100).collect()} == {"spm"}
    assert fill_in_middle(df, seed=1).collect() != fill_in_middle(df, seed=2).collect()
    assert fill_in_middle(df.filter("false")).collect() == []


# mixing


def water_filled(sizes, weights, epochs, budget):
    """Clamp and share anew until none is above its cap."""
    caps, fixed = {s: Fraction(epochs * n) for s, n in sizes.items()}, {}
    while True:
        free = {s: weights[s] for s in sizes if s not in fixed and weights[s]}
        left = budget - sum(fixed.values())
        share = {s: left * w / sum(free.values()) for s, w in free.items()} if free else {}
        over = [s for s in share if share[s] >= caps[s]]
        if not over:
            return {s: fixed.get(s, share.get(s, Fraction(0))) for s in sizes}
        fixed |= {s: caps[s] for s in over}


def test_targets_equal_brute_force(spark):
    r = random.Random(5)
    for _ in range(12):
        sizes = {f"s{i}": r.choice([0, 1, 7, 100, 5000]) for i in range(r.randint(1, 9))}
        weights = {s: r.choice([0, 1, 2, 50]) for s in sizes}
        epochs, budget = r.choice([(3, sum(sizes.values())), (1, 2 * sum(sizes.values())), (2, 40)])
        df = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, size long, weight long")
        want = water_filled(sizes, weights, epochs, Fraction(budget))
        for row in targets(df, epochs, budget).collect():
            assert row.target == pytest.approx(float(want[row.source]), rel=1e-12)


def test_mix_takes_what_it_should(spark):
    r = random.Random(6)
    texts = [" ".join("w" for _ in range(int(2 ** r.uniform(0, 9)))) for _ in range(3000)]
    sources = [r.choice(["big"] * 20 + ["a", "b", "ü", None]) for _ in texts]
    df = rows(spark, texts, sources)
    out = mix_sources(df, cycled(5, 2, 1)).collect()
    assert len(out) == len(texts)
    assert {r.doc_id: r.size for r in out} == {i: len(t.split()) for i, t in enumerate(texts)}
    order = ["a", "b", "big", "ü", None]
    sizes = {s: sum(len(t.split()) for t, x in zip(texts, sources, strict=True) if x == s) for s in order}
    want = water_filled(sizes, dict(zip(order, [5, 2, 1, 5, 2], strict=True)), 3, Fraction(sum(sizes.values())))
    for s in order:
        of = [r for r in out if r.source == s]
        assert of[0].target == pytest.approx(float(want[s])) and of[0].source_size == sizes[s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= max(2, of[0].target / 1024)
        assert len({r.copies for r in of}) <= 2
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in out)
    again = mix_sources(df.repartition(7), cycled(5, 2, 1), most=0).collect()  # 0: the join by salts
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sorted(map(str, out)) != sorted(map(str, mix_sources(df, cycled(5, 2, 1), seed=2).collect()))


def test_mix_of_odd_tables(spark):
    odd = rows(spark, [None, "", "  ", "one two", "one two", "x " * 30_000], [None, "e", "e", "s", "s", "s"], [None, None, 2, 3, 3, 4])
    got = {(r.doc_id, r.source, r.size, r.copies, r.taken) for r in mix_sources(odd, cycled(1)).collect()}
    assert {g[2] for g in got} == {0, 2, 30_000} and all(t == n * c for _, _, n, c, t in got)
    assert mix_sources(odd.filter("false"), cycled(5, 2, 1)).collect() == []
    assert [r.target for r in mix_sources(odd.filter("doc_id = 4"), cycled(5), epochs=3, budget=10**9).collect()] == [90_000.0]
    assert [r.c for r in spark.createDataFrame([("a\x1cb \x0bc\u00a0d",)], "t string").select(word_count(F.col("t")).alias("c")).collect()] == [2]


def test_many_sources_are_ranked_in_ranges(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "'one two three' as text", "concat('s', lpad(cast(id % 1000 as string), 4, '0')) as source")
    got = {r.source: r.target for r in mix_sources(df, cycled(5, 2, 1), most=0).collect()}
    level = Fraction(9000, sum(5 if i % 3 == 0 else 2 if i % 3 == 1 else 1 for i in range(1000)))
    assert all(got[f"s{i:04}"] == pytest.approx(float(min(27, (5, 2, 1)[i % 3] * level))) for i in range(1000))


def test_attach_keeps_null_keys_and_splits(spark):
    ws = Workspace(spark, "test")
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("a", 1)], "k string, v int")
    small = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    want = [("None", 2, 20), ("a", 1, 10), ("a", 1, 10), ("b", 3, None)]
    for most in (1 << 20, 0):
        assert sorted((str(r.k), r.v, r.w) for r in attach(df, ws, small, ["k"], most).collect()) == want


# timestamps

MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def plain_readings(raw):
    """{order: (wall, offset)} by strptime over the written-out forms, or an int for an epoch."""
    s = raw.strip(" \t\n\x0b\x0c\r")
    if re.fullmatch("[0-9]{10}", s):
        return int(s) * 10**6
    if re.fullmatch("[0-9]{13}", s):
        return int(s) * 1000
    shapes = [(r"20\d\d-\d\d-\d\d", "%Y-%m-%d", ""), (r"20\d{6}", "%Y%m%d", ""), (r"\d\d\.\d\d\.20\d\d", "%d.%m.%Y", ""), (rf"\d\d (?:{'|'.join(MONTHS)}) 20\d\d", "%d %b %Y", ""), (r"\d\d/\d\d/20\d\d", "%d/%m/%Y", "day"), (r"\d\d/\d\d/20\d\d", "%m/%d/%Y", "month")]
    out = {}
    for shape, form, order in shapes:
        m = re.fullmatch(rf"({shape})(?:[T ](\d\d:\d\d)(:\d\d)?( ?[AP]M)?(?: ?(Z|[+-]\d\d:?\d\d))?)?", s, re.ASCII)
        if not m:
            continue
        day, hm, sec, half, zone = m.groups()
        try:
            text, clock = f"{day} {hm or '00:00'}{sec or ':00'}", "%I:%M:%S %p" if half else "%H:%M:%S"
            wall = datetime.strptime(text + (f" {half.strip()}" if half else ""), f"{form} {clock}")
        except ValueError:
            continue
        if wall.second > 59 or (sec and int(sec[1:]) > 59):
            continue
        offset = None
        if zone:
            sign, digits = (zone[0], zone[1:].replace(":", "")) if zone != "Z" else ("+", "0000")
            if int(digits[:2]) > 14 or int(digits[2:]) > 59:
                continue
            offset = (int(digits[:2]) * 60 + int(digits[2:])) * (-1 if sign == "-" else 1)
        out[order] = (wall, offset)
    return out


def moments(wall, zone):
    """All moments at which the zone's clocks show the wall time, found by trying the quarter hours of 36 hours."""
    z, start = ZoneInfo(zone), wall.replace(tzinfo=timezone.utc) - timedelta(hours=18)
    tried = (start + timedelta(minutes=15 * i) for i in range(145))
    return [t for t in tried if t.astimezone(z).replace(tzinfo=None) == wall]


def test_stamps_equal_brute_force(spark):
    r = random.Random(7)

    def two(most):
        return f"{r.choice([r.randrange(1, most + 1), r.randrange(100)]):02}" if r.random() < 0.15 else f"{r.randrange(1, most + 1):02}"

    def stamp():
        y = f"20{r.randrange(100):02}"
        day = r.choice([f"{y}-{two(12)}-{two(28)}", f"{y}{two(12)}{two(28)}", f"{two(31)}.{two(12)}.{y}", f"{two(31)} {r.choice([*MONTHS, 'may'])} {y}", *[f"{two(20)}/{two(14)}/{y}"] * 4])
        if r.random() < 0.2:
            return day
        clock = f"{r.choice('T   t')}{two(23)}:{two(59)}" + r.choice(["", f":{two(59)}"]) + r.choice(["", "", "AM", " PM"]) + r.choice(["", "", "Z", " +05:30", "-0800", " -15:00", "+14:59", "x"])
        return r.choice(["", "", " ", "\t"]) + day + clock + r.choice(["", "", "\n", " \x0b", "\u00a0"])

    changes = [f"{d} {h:02}:{m:02}" for d in ("2024-03-10", "2024-11-03", "2024-03-31", "2024-10-27", "2024-04-07", "2024-10-06") for h in range(4) for m in (0, 15, 30, 45)]
    zones = ["UTC", "America/New_York", "Europe/Berlin", "Asia/Kolkata", "Australia/Lord_Howe"]
    data = [(i, r.choice(["a", "b", "c", None]), r.choice(zones), r.choice([stamp(), stamp(), stamp(), *r.sample(changes, 2), str(r.randrange(10**14)), str(r.randrange(10**10, 10**11))[:10]])) for i in range(4000)]
    data += [(10**18 + 1, "a", "UTC", "05/05/2024"), (None, "a", "UTC", None), (7, "z", "No/Zone", "2024-01-01"), (8, "z", None, "2024-01-01"), (9, "z", None, "2024-01-01T00:00Z"), (10, "z", "America", "20240101"), (11, "z", "UTC", "1" * 100_000), (12, "z", "UTC", "")]
    ballot = {}
    for _, source, _, raw in data:
        found = plain_readings(raw) if raw else {}
        if isinstance(found, dict) and len(found) == 1 and "" not in found:
            ballot.setdefault(source, []).append(next(iter(found)))
    want = []
    for i, source, zone, raw in data:
        found = plain_readings(raw) if raw else {}
        if isinstance(found, int):
            want.append((i, found, "epoch", False))
            continue
        needs = found and next(iter(found.values()))[1] is None
        if not found or needs and zone not in zones:
            want.append((i, None, "bad", False))
            continue
        rule, (wall, offset) = "plain", next(iter(found.values()))
        if len(found) == 2 and found["day"] != found["month"]:
            day, month = (ballot.get(source, []).count(o) for o in ("day", "month"))
            rule = "votes" if day != month else "default"
            wall, offset = found["day" if day > month else "month"]
        if offset is not None:
            want.append((i, int((wall - datetime(1970, 1, 1)).total_seconds() - offset * 60) * 10**6, rule, rule != "plain"))
            continue
        at = [] if zone == "UTC" or wall.minute % 15 or wall.second else moments(wall, zone)
        if len(at) > 1:
            moment = at[0]
        else:
            before = (wall.replace(tzinfo=timezone.utc) - timedelta(days=1)).astimezone(ZoneInfo(zone)).utcoffset()
            moment = at[0] if at else wall.replace(tzinfo=timezone.utc) - (before if not (wall.minute % 15 or wall.second) and zone != "UTC" else wall.replace(tzinfo=ZoneInfo(zone)).utcoffset())
        odd = zone != "UTC" and not (wall.minute % 15 or wall.second) and len(at) != 1
        odd |= bool((wall.minute % 15 or wall.second) and wall.replace(tzinfo=ZoneInfo(zone)).utcoffset() != wall.replace(tzinfo=ZoneInfo(zone), fold=1).utcoffset())
        want.append((i, int((moment - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds()) * 10**6, rule, rule != "plain" or odd))
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "stamp_id long, source string, zone string, raw string, id int, majority string")
    for most in (1 << 20, 0):
        got = [tuple(r) for r in normalise_stamps(df, most=most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} >= {"bad", "epoch", "plain", "votes"} and sum(w[3] and w[2] == "plain" for w in want) > 20


def test_votes_margin_and_ties(spark):
    def of(stamps, margin=1):
        df = spark.createDataFrame([(i, "s", "UTC", raw) for i, raw in enumerate(stamps)], "stamp_id long, source string, zone string, raw string")
        return {r.stamp_id: (r.rule, r.utc_us) for r in normalise_stamps(df, margin).collect()}

    day_first = int(datetime(2024, 4, 3, tzinfo=timezone.utc).timestamp()) * 10**6
    month_first = int(datetime(2024, 3, 4, tzinfo=timezone.utc).timestamp()) * 10**6
    assert of(["03/04/2024"])[0] == ("default", month_first)
    assert of(["03/04/2024", "13/01/2024", "01/13/2024"])[0] == ("default", month_first)  # a tie
    assert of(["03/04/2024", "13/01/2024", "14/01/2024", "01/13/2024"])[0] == ("votes", day_first)
    assert of(["03/04/2024", "13/01/2024", "14/01/2024", "01/13/2024"], margin=2)[0] == ("default", month_first)
    assert of(["03/04/2024", "13/01/2024 25:00", "31/02/2024"])[0] == ("default", month_first)  # bad ones have no vote
    assert vote("13/01/2024", "UTC") == "day" and vote("13/01/2024", None) is None and vote("05/05/2024", "UTC") is None


def test_skipped_and_repeated_wall_times():
    def at(*x):
        return int(datetime(*x, tzinfo=timezone.utc).timestamp()) * 10**6

    assert settle("2024-03-10 02:30", "America/New_York", None) == (at(2024, 3, 10, 7, 30), "plain", True)  # skipped: as before the change
    assert settle("2024-11-03 01:30", "America/New_York", None) == (at(2024, 11, 3, 5, 30), "plain", True)  # repeated: the first
    assert settle("2024-11-03 01:30Z", "America/New_York", None) == (at(2024, 11, 3, 1, 30), "plain", False)
    assert settle("2024-03-10 03:00", "America/New_York", None) == (at(2024, 3, 10, 7), "plain", False)
    assert settle("12 Jan 2024 12:05 AM", "UTC", None) == (at(2024, 1, 12, 0, 5), "plain", False)
    assert settle("2024-01-12 00:05 AM", "UTC", None)[1] == "bad" == settle("2024-01-12 24:00", "UTC", None)[1] == settle("2024-01-12\n", "UTC", None)[1]


def test_no_stamps(spark):
    df = spark.createDataFrame([], "stamp_id long, source string, zone string, raw string")
    assert normalise_stamps(df).collect() == [] and majorities(df).collect() == []


def test_identifiers_are_learnt_from_all_documents(spark):
    """Every text counts, however many there are, copies once: a word of each of 3,000 texts, one of three of them, and one of 50 copies."""
    from kinspark.llm.secret_scan import learnt_identifiers

    rare = F.when(F.col("id").isin(7, 1500, 2999), F.lit(" Uncommon")).otherwise(F.lit(""))
    texts = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("everywhere "), F.col("id").cast("string"), rare).alias("text"))
    copies = spark.range(5000, 5050).select(F.col("id").alias("doc_id"), F.lit("repeated").alias("text"))
    assert learnt_identifiers(texts.union(copies)).split() == [b"Uncommon", b"everywhere"]
