"""Mixed timestamps to microseconds of UTC, in two passes of mapInPandas.

Both passes match a stamp once, with one compiled expression of named groups, and leave the calendar to datetime. The
first pass reads the slashed stamps only and sums, batch by batch, how many of a source can be read with the day first
alone and with the month first alone; the sums by source are what is shuffled. The second pass gets the decisions
beside its rows and settles the stamps that both orders allow. The decisions (a row for each source with a majority)
are broadcast up to a measured size; beyond it they are joined by source and salt (see lookup.attach), so no source is
one task.

Wall times become UTC by zoneinfo: fold=0 is the side before a change of the zone's offset, fold=1 the one after it. A
time whose two sides differ is skipped if going there and back with fold=0 does not give it again, else repeated.

Rules of a result: `bad` (null, no known form, or impossible), `epoch`, `votes` and `default` (a slashed stamp of two
dates, by its source's majority or, without one, the month first), `plain`.

Cases: a stamp that needs a zone is bad where the zone is null or unknown; stamps of a null source have a source of
their own, null; a tie of votes is no majority; repeated rows vote as often as they occur; bad stamps never vote; a
stamp longer than any form (LONGEST after trimming) is bad whatever it holds; a null id stays null; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.lookup import LOOKUP_BYTES, attach
from kinspark.llm.workspace import Workspace

#: Months by their English short names, and the forms of a stamp.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
STAMP = re.compile(
    rf"""
    (?P<seconds>[0-9]{{10}}) | (?P<millis>[0-9]{{13}})
    | (?: (?P<dash_y>20[0-9]{{2}})-(?P<dash_m>[0-9]{{2}})-(?P<dash_d>[0-9]{{2}})
        | (?P<run_y>20[0-9]{{2}})(?P<run_m>[0-9]{{2}})(?P<run_d>[0-9]{{2}})
        | (?P<dot_d>[0-9]{{2}})[.](?P<dot_m>[0-9]{{2}})[.](?P<dot_y>20[0-9]{{2}})
        | (?P<name_d>[0-9]{{2}})[ ](?P<name_m>{"|".join(MONTHS)})[ ](?P<name_y>20[0-9]{{2}})
        | (?P<slash_a>[0-9]{{2}})/(?P<slash_b>[0-9]{{2}})/(?P<slash_y>20[0-9]{{2}})
      )
      (?: [T ](?P<h>[0-9]{{2}}):(?P<mi>[0-9]{{2}}) (?: :(?P<s>[0-9]{{2}}) )? (?: [ ]?(?P<half>[AP]M) )?
          (?: [ ]?(?: (?P<utc>Z) | (?P<sign>[+-])(?P<off_h>[0-9]{{2}}):?(?P<off_m>[0-9]{{2}}) ) )? )?
    """,
    re.VERBOSE,
)
#: Characters that a stamp is trimmed by; characters of the longest form, and some more.
BLANKS, LONGEST = " \t\n\x0b\x0c\r", 48
_START = datetime(1970, 1, 1)
_MICRO = timedelta(microseconds=1)
_BAD = (None, "bad", False)


@functools.lru_cache(maxsize=1024)
def zone_of(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):  # no such zone, not a name, or a folder of zones
        return None


def wall_clock(found: re.Match) -> tuple[list[tuple[str, datetime]], int | None] | None:
    """([(order, wall time)], offset in minutes or None) of a matched stamp; order is day, month or "" where the form tells. None: impossible."""
    g = found.groupdict()
    h, mi, s = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0)
    if g["half"]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["half"] == "PM")
    offset = 0 if g["utc"] else None
    if g["sign"]:
        hours, minutes = int(g["off_h"]), int(g["off_m"])
        if hours > 14 or minutes > 59:
            return None
        offset = (60 * hours + minutes) * (-1 if g["sign"] == "-" else 1)
    if g["slash_y"]:
        a, b = int(g["slash_a"]), int(g["slash_b"])
        dates = [("day", g["slash_y"], b, a), ("month", g["slash_y"], a, b)]
    else:
        form = next(f for f in ("dash", "run", "dot", "name") if g[f"{f}_y"])
        month = g[f"{form}_m"]
        dates = [("", g[f"{form}_y"], MONTHS.index(month) + 1 if form == "name" else int(month), int(g[f"{form}_d"]))]
    walls = []
    for order, y, m, d in dates:
        try:
            walls.append((order, datetime(int(y), m, d, h, mi, s)))
        except ValueError:
            pass
    return (walls, offset) if walls else None


def readings(raw, zone) -> tuple[re.Match | None, list[tuple[str, datetime]], int | None]:
    """(match, possible wall times by order, offset); no wall times if the stamp is bad or an epoch."""
    found = STAMP.fullmatch(raw) if isinstance(raw, str) else None
    if found is None or found["seconds"] or found["millis"]:
        return found, [], None
    walls, offset = wall_clock(found) or ([], None)
    if offset is None and zone_of(zone if isinstance(zone, str) else None) is None:
        return found, [], None
    return found, walls, offset


def vote(raw, zone) -> str | None:
    """The only order in which a slashed stamp is possible; None if both or neither are."""
    found, walls, _ = readings(raw, zone)
    return walls[0][0] if len(walls) == 1 and found["slash_y"] else None


def in_utc(wall: datetime, offset: int | None, zone: ZoneInfo | None) -> tuple[int, bool]:
    """(microseconds, whether the zone skips or repeats the wall time)."""
    if offset is not None:
        return (wall - _START) // _MICRO - offset * 60_000_000, False
    before, after = (wall.replace(tzinfo=zone, fold=f) for f in (0, 1))
    moment = wall - before.utcoffset()
    changes = before.utcoffset() != after.utcoffset()
    if changes:
        there_and_back = moment.replace(tzinfo=zone).tzinfo.fromutc(moment.replace(tzinfo=zone)).replace(tzinfo=None)
        skipped = there_and_back != wall
        repeated = not skipped and zone.fromutc((wall - after.utcoffset()).replace(tzinfo=zone)).replace(tzinfo=None) == wall
        changes = skipped or repeated
    return (moment - _START) // _MICRO, changes


def settle(raw, zone, majority) -> tuple[int | None, str, bool]:
    """(microseconds, rule, ambiguous) of a stamp, given the order that most of its source vote for (day, month or none)."""
    found, walls, offset = readings(raw, zone)
    if found is None:
        return _BAD
    if found["seconds"]:
        return int(raw) * 1_000_000, "epoch", False
    if found["millis"]:
        return int(raw) * 1000, "epoch", False
    if not walls:
        return _BAD
    rule, wall = "plain", walls[0][1]
    if len(walls) == 2 and walls[0][1] != walls[1][1]:
        decided = majority in ("day", "month")
        rule = "votes" if decided else "default"
        wall = dict(walls)[majority if decided else "month"]
    micros, changes = in_utc(wall, offset, zone_of(zone) if offset is None else None)
    return micros, rule, changes or rule != "plain"


def _votes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        sums: dict = defaultdict(lambda: {"day": 0, "month": 0})
        for source, zone, raw in zip(f["source"], f["zone"], f["raw"], strict=True):
            if (order := vote(raw, zone)) is not None:
                sums[source if isinstance(source, str) else None][order] += 1
        if sums:
            yield pd.DataFrame({"source": list(sums), "day": [v["day"] for v in sums.values()], "month": [v["month"] for v in sums.values()]})


def _settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = [settle(*x) for x in zip(f["raw"], f["zone"], f["majority"], strict=True)]
        micros = pd.array([x[0] for x in out], dtype="Int64")
        yield pd.DataFrame({"id": f["id"], "utc_us": micros, "rule": [x[1] for x in out], "ambiguous": [x[2] for x in out]})


def majorities(stamps: DataFrame, margin: int = 1) -> DataFrame:
    """(source, majority): sources in which one order has over margin times the other's votes."""
    slashed = stamps.filter(F.contains("raw", F.lit("/"))).select("source", "zone", "raw")
    sums = slashed.mapInPandas(_votes, "source string, day long, month long").groupBy("source").agg(F.sum("day").alias("day"), F.sum("month").alias("month"))
    order = F.when(F.col("day") > margin * F.col("month"), "day").when(F.col("month") > margin * F.col("day"), "month")
    return sums.select("source", order.alias("majority")).filter("majority is not null")


def normalise_stamps(df: DataFrame, margin: int = 1, id_col: str = "stamp_id", most: int = LOOKUP_BYTES) -> DataFrame:
    """(id_col, utc_us, rule, ambiguous) of each row of (id_col, source, zone, raw)."""
    raw = F.btrim(F.col("raw").cast("string"), F.lit(BLANKS))
    stamps = df.select(
        F.col(id_col).cast("string").alias("id"), F.col("source").cast("string").alias("source"), F.col("zone").cast("string").alias("zone"),
        F.when(F.char_length(raw) <= LONGEST, raw).alias("raw"),
    )
    ws = Workspace(df.sparkSession, "stamps")
    beside = attach(stamps, ws, majorities(stamps, margin), ["source"], most)
    out = beside.select("id", "zone", "raw", "majority").mapInPandas(_settled, "id string, utc_us long, rule string, ambiguous boolean")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "utc_us", "rule", "ambiguous")
