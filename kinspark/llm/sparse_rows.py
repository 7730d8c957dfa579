"""A sparse table of integers that is looked up as array operations.

Row displacement: each row has a base, and its cell of a column stands at base + column if that place names the row as
its owner. A lookup is three gathers whatever the number of columns, and the table is a little larger than its cells.
"""

from __future__ import annotations

import numpy as np

#: Places per cell; rows of more cells than WIDE have places of their own; turns without room for all before there is more.
ROOM, WIDE, ROUNDS = 1.6, 48, 16


class SparseRows:
    """values[i] at (rows[i], cols[i]); each cell is given once. Values, rows and columns are below 2^31."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, n_rows: int, n_cols: int):
        order = np.lexsort((cols, rows))
        rows, cols, values = rows[order].astype(np.int64), cols[order].astype(np.int64), values[order]
        self.cols = n_cols
        counts = np.bincount(rows, minlength=n_rows)
        first = np.cumsum(counts) - counts
        pad, size = n_cols, int(len(rows) * ROOM) + n_cols
        owner = np.full(size, -1, np.int64)
        base = np.zeros(n_rows, np.int64)
        rng = np.random.default_rng(11)
        left = np.flatnonzero(counts > WIDE)
        for k in np.unique(counts[(counts > 1) & (counts <= WIDE)])[::-1].tolist():
            todo = np.flatnonzero(counts == k)
            own = cols[first[todo][:, None] + np.arange(k)]
            turn = 0
            while len(todo):
                turn += 1
                if turn % ROUNDS == 0:  # too full for rows like these
                    owner = np.concatenate([owner, np.full(2 * k * len(todo) + n_cols, -1, np.int64)])
                    size = len(owner)
                low = -own[:, 0]  # the first cell may stand at the first place
                at = low + rng.integers(0, np.maximum(1, size - (own[:, -1] + low)))
                places = at[:, None] + own
                free = (owner[places] < 0).all(1)
                # of rows that ask for one place the last stays
                ask = np.flatnonzero(free)
                asked, names = places[ask], todo[ask]
                owner[asked.ravel()] = np.repeat(names, k)
                won = (owner[asked] == names[:, None]).all(1)
                lost, loser = asked[~won].ravel(), np.repeat(names[~won], k)
                owner[lost[owner[lost] == loser]] = -1
                claim = ask[won]
                base[todo[claim]] = at[claim]
                keep = np.ones(len(todo), bool)
                keep[claim] = False
                todo, own = todo[keep], own[keep]
        single = np.flatnonzero(counts == 1)
        room = np.flatnonzero(owner < 0)[: len(single)]
        near, far = single[: len(room)], single[len(room) :]
        owner[room] = near
        base[near] = room - cols[first[near]]
        spans = [owner]
        for r in [*left.tolist(), *far.tolist()]:
            own = cols[first[r] : first[r] + counts[r]]
            span = np.full(int(own[-1] - own[0]) + 1, -1, np.int64)
            span[own - own[0]] = r
            base[r] = size - own[0]
            spans.append(span)
            size += len(span)
        owner = np.concatenate(spans)
        self.base = (base + pad).astype(np.int32)
        self.cells = np.full(size + 2 * pad, -1 << 32, np.int64)  # owner in the upper half, value in the lower
        self.cells[self.base[rows].astype(np.int64) + cols] = rows << 32 | values

    def get(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether there is such a cell, its value or any other)."""
        found = self.cells[self.base[rows] + cols]
        return (found >> 32) == rows, found & 0x7FFFFFFF
