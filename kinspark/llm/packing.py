"""Packing by vector bin packing.

Each example is a vector (tokens, segments, loss-bearing tokens) and a sequence a bin with a limit on each. The open
bin takes, of all waiting examples that still fit, the one with the largest weighted dot product with what the bin has
left, the weights being the mean demand of what waits (the dot-product heuristic of vector bin packing). If none fits
and examples may be cut, the one with the largest product is cut to what is left.

Packing is local to a partition: no shuffle, memory bounded by the window, and a lost task packs the same rows in the
same way again. The price is one unfinished bin per partition; where cutting is allowed it is divided into sequences
whose lengths are powers of two, which need no padding; so is a bin that its number of segments closes. A bin that
takes all that waits before it is full is put back and waits for more.

Cases: a null text is an empty one (one token, the end mark); very long texts fill whole sequences; repeated rows are
packed as often as they occur; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.llm.bpe import codec
from kinspark.llm.common import arrow_rows, slices_of, thin

#: Examples that wait for a bin at a time, or more until they have the tokens of two bins or the segments of more than one.
WINDOW = 1024
#: Turns of a conversation that are one example.
STRETCH = 256


@dataclass(frozen=True)
class Limits:
    """Of one sequence. With as many segments as tokens, segments are no limit of their own."""

    tokens: int = 4096
    segments: int = 4096
    loss: int = 4096


@dataclass
class Piece:
    key: object
    start: int
    ids: np.ndarray
    loss: np.ndarray | None  # a byte for each id, 1 where it bears loss; None: all do
    total: int

    def n_loss(self) -> int:
        return len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[:n], self.loss[n:])
        return Piece(self.key, self.start, self.ids[:n], a, self.total), Piece(self.key, self.start + n, self.ids[n:], b, self.total)


class VectorBinPacker:
    """Bins, as lists of pieces, from a stream of pieces."""

    def __init__(self, limits: Limits, cut: bool, window: int = WINDOW):
        self.limits, self.cut, self.window = limits, cut, window
        self.caps = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.waiting: list[Piece] = []
        self.tokens = 0

    def bins(self, pieces: Iterable[Piece]) -> Iterator[list[Piece]]:
        size = self.limits.tokens
        for p in pieces:
            if not self.cut and (len(p.ids) > size or p.n_loss() > self.limits.loss):
                yield [p]  # longer than any sequence and not to be cut: it stays whole, alone
                continue
            while self.cut and len(p.ids) >= size and self.limits.loss >= size:
                whole, p = p.split(size)
                yield [whole]
            if len(p.ids):
                self.waiting.append(p)
                self.tokens += len(p.ids)
            n = len(self.waiting)
            if n >= self.window and (self.tokens >= 2 * size or n >= self.window + self.limits.segments):
                yield from self._pack(self.window // 2)
        yield from self._pack(0)

    def _pack(self, leave: int) -> Iterator[list[Piece]]:
        """Fill bins while more than `leave` pieces wait; the last bin of all is divided into powers of two."""
        items, caps = self.waiting, self.caps
        need = np.array([[len(p.ids), 1, p.n_loss()] for p in items], float).reshape(-1, 3) / caps
        alive = np.ones(len(items), bool)
        left = len(items)
        while left > leave:
            rest, own, took, full = np.ones(3), [], [], False
            weights = need[alive].mean(0)
            while left:
                worth = need @ (weights * rest)
                fits = alive & (need <= rest + 1e-9).all(1)
                if fits.any():
                    i = int(np.where(fits, worth, -1).argmax())
                    own.append(items[i])
                    took.append(i)
                    rest = rest - need[i]
                    alive[i] = False
                    left -= 1
                    continue
                room = int(round(rest[0] * caps[0]))
                if not self.cut or room < 1 or rest[1] * caps[1] < 0.5:
                    break
                i = int(np.where(alive, worth, -1).argmax())
                if items[i].loss is not None or round(rest[2] * caps[2]) < room:
                    room = _loss_room(items[i], room, int(round(rest[2] * caps[2])))
                    if room < 1:
                        break
                head, items[i] = items[i].split(room)
                own.append(head)
                need[i] = np.array([len(items[i].ids), 1, items[i].n_loss()]) / caps
                break
            if not own:  # nothing fits an empty bin: cannot happen for pieces within the limits
                i = int(np.flatnonzero(alive)[0])
                own, alive[i], full = [items[i]], False, True
                left -= 1
            if left == 0 and leave and not full and (rest * caps >= 0.5).all():
                alive[took] = True
                break
            closed = left == 0 and leave == 0 or rest[1] * caps[1] < 0.5
            if closed and self.cut:
                yield from powers_of_two(own)
            else:
                yield own
        self.waiting = [p for p, a in zip(items, alive, strict=True) if a]
        self.tokens = sum(len(p.ids) for p in self.waiting)


def _loss_room(p: Piece, room: int, loss: int) -> int:
    """The longest head of p of at most `room` tokens and `loss` loss-bearing tokens."""
    if p.loss is None:
        return min(room, loss)
    return int(np.searchsorted(np.cumsum(p.loss[:room]), loss, "right"))


def powers_of_two(own: list[Piece]) -> Iterator[list[Piece]]:
    """Divide one bin into bins whose lengths are the powers of two in its own, the largest first."""
    total = sum(len(p.ids) for p in own)
    todo = own[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        if not total >> bit & 1:
            continue
        room, out = 1 << bit, []
        while room:
            p = todo.pop()
            if len(p.ids) > room:
                p, rest = p.split(room)
                todo.append(rest)
            out.append(p)
            room -= len(p.ids)
        yield out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("n_loss", pa.int64())])
_DDL = "{} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, n_loss long"


def pack_documents(df: DataFrame, path: str, end_id: int = 2, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of at most limits.tokens: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss).

    A sequence id is the partition's number in the upper 31 bits and a count in the lower 32. with_ids adds the ids
    (array<int>), for writing the sequences out. All ids of a document bear loss.
    """
    schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _SCHEMA

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        end = np.array([end_id], np.uint32)

        def pieces():
            for batch in batches:
                for keys, texts in slices_of(batch, "k", "t"):
                    for key, ids in zip(keys, bpe.encode_many(texts), strict=True):
                        whole = np.concatenate([ids, end])
                        yield Piece(key, 0, whole, None, len(whole))

        yield from arrow_rows(_rows(VectorBinPacker(limits, cut=True).bins(pieces()), with_ids), schema)

    picked = df.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    return picked.mapInArrow(thin(run), _DDL.format(f"`{id_col}`") + (", ids array<int>" if with_ids else ""))


def pack_conversations(df: DataFrame, path: str, end_id: int = 2, limits: Limits = Limits(segments=64), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Conversations (conv_id, turn, role, text) in sequences; the turns of loss_roles bear loss. A stretch of STRETCH turns
    of one conversation is an example; one beyond the limits is cut between turns, and a turn beyond them where it must.

    (conv_id, stretch, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss); start and doc_tokens count
    within the stretch. Turns are put in order by (turn, role, text). A null id or turn is a value of its own, a null
    role bears no loss, a null text is an empty one; repeated rows are repeated turns. A task holds one stretch at a
    time, however many turns a conversation has.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), *list(_SCHEMA)[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        end = np.array([end_id], np.uint32)

        def pieces():
            for batch in batches:
                for keys, stretches, turns in slices_of(batch, "conv_id", "stretch", "turns"):
                    for key, stretch, own in zip(keys, stretches, turns, strict=True):
                        ids = [np.concatenate([x, end]) for x in bpe.encode_many([t["text"] for t in own])]
                        loss = [np.full(len(x), t["role"] in loss_roles, np.uint8) for x, t in zip(ids, own, strict=True)]
                        yield from _within(limits, (key, stretch), ids, loss)

        yield from arrow_rows(((*r[0], *r[1:]) for r in _rows(VectorBinPacker(limits, cut=False).bins(pieces()), False)), schema)

    turn = F.col("turn").cast("long")
    turns = F.sort_array(F.collect_list(F.struct(turn.alias("turn"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text")))).alias("turns")
    examples = df.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.floor(turn / STRETCH).alias("stretch")).agg(turns)
    return examples.mapInArrow(thin(run), _DDL.format("conv_id").replace("conv_id long", "conv_id long, stretch long"))


def _within(limits: Limits, key: object, ids: list[np.ndarray], loss: list[np.ndarray]) -> Iterator[Piece]:
    """A stretch of turns as pieces within the limits, as few as go in order."""
    total, start = sum(map(len, ids)), 0
    held_ids: list[np.ndarray] = []
    held_loss: list[np.ndarray] = []
    tokens = bearing = 0
    for x, y in zip(ids, loss, strict=True):
        while True:
            room = min(limits.tokens - tokens, len(x))
            if bearing + int(y[:room].sum()) > limits.loss:
                room = int(np.searchsorted(np.cumsum(y[:room]), limits.loss - bearing, "right"))
            if room == len(x):
                break
            if tokens == 0:
                yield Piece(key, start, x[:room], y[:room], total)
                start, x, y = start + room, x[room:], y[room:]
            else:
                yield Piece(key, start, np.concatenate(held_ids), np.concatenate(held_loss), total)
                start, tokens, bearing, held_ids, held_loss = start + tokens, 0, 0, [], []
        held_ids.append(x)
        held_loss.append(y)
        tokens, bearing = tokens + len(x), bearing + int(y.sum())
    if tokens:
        yield Piece(key, start, np.concatenate(held_ids), np.concatenate(held_loss), total)


def _rows(bins: Iterator[list[Piece]], with_ids: bool) -> Iterator[tuple]:
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 32
    for own in bins:
        offset = 0
        for p in own:
            n = len(p.ids)
            row = (p.key, p.start, n, zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, sequence, offset, p.n_loss())
            yield (*row, p.ids.astype(np.int32)) if with_ids else row
            offset += n
        sequence += 1
