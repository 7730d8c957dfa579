"""Records of one JSON document that is larger than a task: {"images": [{...}, ...], "annotations": [{...}, ...], ...}.

Spark's text reader cuts the document at closing braces into blocks of its own size, each read by one task. A block does
not know whether it begins inside a string or how deep, so there are two passes. The first gives, for each block, what
it does to the state of a reader: whether it turns the inside of strings out, which brackets it closes and opens (as
read from outside a string and from inside one), and the last key it met at each depth. The driver puts these few rows,
one for each block, together from the first block on and so knows the state at the head of each. In the second pass
every block gives its whole records, and of a record that goes over its edge its part; the parts of one are joined.

The blocks of both passes must be the same: a session whose split sizes were changed in between is an error, not a wrong
result. Of a document that is cut short the last record may be wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_REST = re.compile(r'(?:[^"\\]|\\.)*', re.DOTALL)
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"?|[{}\[\]]', re.DOTALL)
_COLON = re.compile(r"\s*:")
#: Where records stand: in an object of the list under a key of the document.
_RECORD = "{[{"


@dataclass
class Reader:
    """Follows JSON text. opened: brackets that are open; closed: how many it closed that were open before it began;
    keys: the last key at each depth, counted from where it began."""

    inside: bool = False
    opened: str = ""
    closed: int = 0
    keys: dict[int, str] = field(default_factory=dict)

    def feed(self, text: str) -> Iterator[tuple[str, int]]:
        """Brackets of a text that ends with one, and where they stand, each before or after it took effect: opening ones after, closing ones before."""
        at = 0
        if self.inside:
            at = _REST.match(text).end()
            if at >= len(text):
                return
            self.inside, at = False, at + 1
        for m in _TOKEN.finditer(text, at):
            token = m[0]
            if token[0] == '"':
                if len(token) == 1 or token[-1] != '"' or _open(token):
                    self.inside = True
                elif _COLON.match(text, m.end()):
                    self.keys[len(self.opened) - self.closed] = token[1:-1]
            elif token in "{[":
                self.opened += token
                yield token, m.start()
            else:
                yield token, m.start()
                if self.opened:
                    self.opened = self.opened[:-1]
                else:
                    self.closed += 1


def _open(token: str) -> bool:
    """Whether the last quote of a token is escaped."""
    back = len(token) - 1 - len(token[:-1].rstrip("\\"))
    return back % 2 == 1


@dataclass(frozen=True)
class _State:
    """At the head of a block: inside a string, brackets that are open, the document's last key, the block that the record in hand began in."""

    inside: bool = False
    opened: str = ""
    key: str = ""
    owner: int = -1


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches: Iterator[pa.RecordBatch], new):
    """(reader of new(file, block), text of a line with its brace, whether the block begins) of all lines."""
    held, reader = None, None
    for batch in batches:
        for text, file, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            fresh = (file, block) != held
            if fresh:
                held, reader = (file, block), new(file, block)
            yield held, reader, text + "}", fresh


def _summaries(batches):
    """A row for each block and whether it is read from inside a string."""
    out: dict[tuple[str, int], tuple[Reader, Reader]] = {}
    for key, pair, text, fresh in _by_block(batches, lambda *_: (Reader(), Reader(inside=True))):
        if fresh:
            out[key] = pair
        for reader in pair:
            for _ in reader.feed(text):
                pass
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("from_inside", pa.bool_()), ("inside", pa.bool_()), ("closed", pa.int64()), ("opened", pa.string()), ("keys", pa.list_(pa.string()))])
    rows = [(f, b, i, r.inside, r.closed, r.opened, [f"{k} {v}" for k, v in r.keys.items()]) for (f, b), pair in out.items() for i, r in zip((False, True), pair, strict=True)]
    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def _states(rows: list) -> dict[tuple[str, int], _State]:
    """The state at the head of each block, in the order of the blocks of each file."""
    found = {(r.file, r.block, r.from_inside): r for r in rows}
    out: dict[tuple[str, int], _State] = {}
    state, held = _State(), None
    for file, block in sorted({(r.file, r.block) for r in rows}):
        if file != held:
            state, held = _State(), file
        out[file, block] = state
        r = found[file, block, state.inside]
        keys = {int(k.split(" ", 1)[0]): k.split(" ", 1)[1] for k in r["keys"]}
        opened = state.opened[: max(0, len(state.opened) - r.closed)]
        whole = len(opened) >= len(_RECORD)  # the record at the head was not closed in this block
        state = replace(state, inside=r.inside, opened=opened + r.opened, key=keys.get(1 - len(state.opened), state.key))
        state = replace(state, owner=-1 if not state.opened.startswith(_RECORD) else state.owner if whole and state.owner >= 0 else block)
    return out


def records(spark: SparkSession, path: str, section: str, schema: str) -> DataFrame:
    """The records of a section of the document(s) at path, as columns of schema (fields of a struct, as DDL); what does not fit is null."""
    summaries = _blocks(spark, path).mapInArrow(_summaries, "file string, block long, from_inside boolean, inside boolean, closed long, opened string, keys array<string>")
    shared = spark.sparkContext.broadcast(_states(summaries.collect()))  # two rows for each block of the document

    def pieces(batches):
        file, block, owner, seq, whole, out = [], [], [], [], [], []
        weight = 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(owner, pa.int64()), pa.array(seq, pa.int64()), pa.array(whole, pa.bool_()), pa.array(out, pa.string())], names=["file", "owner", "seq", "whole", "text"])

        def new(f, b):
            if (f, b) not in shared.value:
                raise ValueError(f"{f} has no block at {b}: the sizes of splits have changed since it was looked at")
            state = shared.value[f, b]
            return Reader(state.inside, state.opened, 0, {1: state.key}), state

        parts: list[str] = []
        begun, ours, place = False, -1, ("", 0)

        def put(text, complete):
            nonlocal weight
            file.append(place[0])
            owner.append(ours)
            seq.append(place[1])
            whole.append(complete)
            out.append(text)
            weight += len(text)

        for key, (reader, state), text, fresh in _by_block(batches, new):
            if fresh:
                if begun and parts:
                    put("".join(parts), False)
                place, parts = key, []
                begun = state.opened.startswith(_RECORD) and state.key == section
                ours = state.owner if begun else -1
                ended = False
            start = 0
            for token, at in reader.feed(text):
                if token == "{" and reader.opened == _RECORD and reader.keys.get(1) == section:
                    begun, ours, start, parts, ended = True, key[1], at, [], True
                elif token == "}" and reader.opened == _RECORD and begun:
                    parts.append(text[start : at + 1])
                    put("".join(parts), ended)
                    begun, parts = False, []
            if begun:
                parts.append(text[start:])
            if weight > 4 << 20 or len(out) >= 10_000:
                yield batch()
                file, block, owner, seq, whole, out, weight = [], [], [], [], [], [], 0
        if begun and parts:
            put("".join(parts), False)
        yield batch()

    found = _blocks(spark, path).mapInArrow(pieces, "file string, owner long, seq long, whole boolean, text string")
    torn = found.filter("not whole").groupBy("file", "owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda p: p.text), "").alias("text"))
    both = found.filter("whole").select("text").unionByName(torn.select("text"))
    return both.select(F.from_json("text", schema).alias("r")).filter("r is not null").select("r.*")
