"""A linear classifier of many classes with calibrated pairwise probabilities.

Class vectors: one vector for each class, so that the machine of a pair of classes is their difference. All are fitted at
once: the sum over rows and other classes of the squared hinge of (1 - own score + other score) and the squared lengths
of the vectors (for two classes the support vector machine with cost 1 of the squared hinge). One matrix of classes by
dimensions, one pass over the rows for each step of the limited-memory quasi-Newton method, however many classes there
are. Classifiers without a fold each, which give every row a score that it had no part in, are further matrices in the
same passes.

Sigmoids: for each pair of classes Platt's sigmoid of the held-out difference, by Newton steps with backtracking; all
pairs step in the same passes. Probabilities: Wu, Lin and Weng's pairwise coupling, by its fixed-point iteration.

Cases: a null vector teaches nothing; a class without rows gets the least probable place that the others leave it; ties
of probability go to the smaller class; with less than two classes the one has probability 1.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinspark.operators import matrices as mx

#: Bytes of all class vectors of a fit, its own and those without a fold, that are broadcast for a pass.
WEIGHT_BYTES = 512 << 20
#: Folds for held-out scores, steps that the quasi-Newton method remembers, the relative gain under which two steps in a row end it; most sweeps of the coupling and its tolerance.
FOLDS, MEMORY, TOLERANCE, SWEEPS, COUPLED = 5, 10, 1e-5, 500, 1e-12
#: Constants of the sigmoid's Newton method (least step, ridge, sufficient decrease, gradient at the end, most steps).
LEAST_STEP, RIDGE, DECREASE, FLAT, NEWTON_STEPS = 1e-10, 1e-12, 1e-4, 1e-5, 100


def quasi_newton(x: np.ndarray, steps: int) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points to evaluate and is sent (value, gradient) of each; returns the last one accepted. For convex functions."""
    value, gradient = yield x
    pairs, small = [], 0
    for _ in range(steps):
        if small == 2 or not gradient.any():
            break
        turn, kept = gradient.copy(), []
        for s, y, rho in reversed(pairs):
            kept.append(rho * (s @ turn))
            turn -= kept[-1] * y
        if pairs:
            turn *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        else:
            turn /= np.linalg.norm(gradient)
        for (s, y, rho), a in zip(pairs, reversed(kept), strict=True):
            turn += s * (a - rho * (y @ turn))
        slope, step = -(gradient @ turn), 1.0
        while True:
            new = x - step * turn
            new_value, new_gradient = yield new
            if new_value <= value + DECREASE * step * slope or step < LEAST_STEP:
                break
            step /= 2
        if new_value > value:
            break
        small = small + 1 if value - new_value <= TOLERANCE * abs(new_value) else 0
        s, y = new - x, new_gradient - gradient
        if s @ y > 0:
            pairs = [*pairs[-MEMORY + 1 :], (s, y, 1 / (s @ y))]
        x, value, gradient = new, new_value, new_gradient
    return x


def _evaluate(rows: DataFrame, points: list[np.ndarray], classes: int, dims: int, machines: list[int], tasks: int) -> list[tuple[float, np.ndarray]]:
    """(value, gradient) of the machines at their points, in one pass. Machine 0 learns from all rows, machine f + 1 from those outside fold f."""
    width = classes * (dims + 1)
    shared = rows.sparkSession.sparkContext.broadcast([p.reshape(classes, dims + 1) for p in points])

    def run(batches):
        acc = np.zeros((len(machines), 1 + width))
        for part, v in mx.matrices(batches):
            x = np.hstack([v, np.ones((len(v), 1))])
            own, fold = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for at, (m, w) in enumerate(zip(machines, shared.value, strict=True)):
                use = slice(None) if m == 0 else fold != m - 1
                xs, ys = x[use], own[use]
                each = np.arange(len(ys))
                scores = xs @ w.T
                lack = np.maximum(0.0, 1 - scores[each, ys][:, None] + scores)
                lack[each, ys] = 0
                acc[at, 0] += (lack * lack).sum()
                pull = 2 * lack
                pull[each, ys] = -pull.sum(1)
                acc[at, 1:] += (pull.T @ xs).ravel()
        return acc

    size = len(machines) * (1 + width)
    sums = mx.total(rows, run, size, tasks).reshape(len(machines), 1 + width)
    shared.unpersist()
    out = []
    for p, row in zip(points, sums, strict=True):
        free = p.reshape(classes, dims + 1).copy()
        free[:, -1] = 0  # intercepts cost nothing
        out.append((row[0] + (free * free).sum(), row[1:] + 2 * free.ravel()))
    return out


def class_vectors(rows: DataFrame, classes: int, dims: int, steps: int, folds: int = FOLDS, tasks: int = 0) -> list[np.ndarray]:
    """[vectors by all rows, vectors without fold 0, ...], each (classes, dims + 1), the intercept last. rows: (features, class_idx, fold)."""
    machines = list(range(folds + 1))
    if 8 * len(machines) * classes * (dims + 1) > WEIGHT_BYTES:
        raise ValueError(f"{classes} classes of {dims} dimensions exceed {WEIGHT_BYTES} bytes")
    fits = {m: quasi_newton(np.zeros(classes * (dims + 1)), steps) for m in machines}
    points, done = {m: next(f) for m, f in fits.items()}, {}
    while points:
        asked = sorted(points)
        for m, found in zip(asked, _evaluate(rows, [points[m] for m in asked], classes, dims, asked, tasks), strict=True):
            try:
                points[m] = fits[m].send(found)
            except StopIteration as end:
                done[m] = end.value
                del points[m]
    return [done[m].reshape(classes, dims + 1) for m in machines]


def held_out_scores(rows: DataFrame, without: list[np.ndarray]) -> DataFrame:
    """(class_idx, scores) of each row, by the vectors that its fold had no part in."""
    shared = rows.sparkSession.sparkContext.broadcast(without)

    def run(batches):
        for part, v in mx.matrices(batches):
            x = np.hstack([v, np.ones((len(v), 1))])
            fold = part.column(2).to_numpy(zero_copy_only=False)
            scores = np.zeros((len(v), len(shared.value[0])))
            for f, w in enumerate(shared.value):
                scores[fold == f] = x[fold == f] @ w.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([lists, part.column(1)], names=["scores", "class_idx"])

    return rows.mapInArrow(run, "scores array<double>, class_idx int")


def sigmoids(scores: DataFrame, classes: int, tasks: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) as classes x classes matrices: P(i rather than j) = 1 / (1 + exp(A[i, j] * (s_i - s_j) + B[i, j])). scores: (scores, class_idx)."""
    i, j = np.triu_indices(classes, 1)

    def run_counts(batches):
        acc = np.zeros(classes)
        for batch in batches:
            acc += np.bincount(batch.column(1).to_numpy(zero_copy_only=False), minlength=classes)
        return acc

    counts = mx.total(scores, run_counts, classes, tasks)
    counts = counts if len(counts) else np.zeros(classes)
    high, low = (counts + 1) / (counts + 2), 1 / (counts + 2)  # targets of a class's rows where it is the first and the second of a pair
    a, b = np.zeros(len(i)), np.log((counts[j] + 1) / (counts[i] + 1))
    value = np.full(len(i), np.inf)
    turn_a, turn_b, slope, step = (np.zeros(len(i)) for _ in range(4))
    try_a, try_b, open_ = a.copy(), b.copy(), np.ones(len(i), bool)
    for _ in range(NEWTON_STEPS * 4):
        f, g1, g2, h11, h22, h21 = _sigmoid_sums(scores, classes, try_a, try_b, high, low, tasks)
        better = open_ & (f < np.where(np.isinf(value), np.inf, value + DECREASE * step * slope))
        flat = better & (np.abs(g1) < FLAT) & (np.abs(g2) < FLAT)
        a, b, value = np.where(better, try_a, a), np.where(better, try_b, b), np.where(better, f, value)
        det = (h11 + RIDGE) * (h22 + RIDGE) - h21 * h21
        new_a, new_b = -((h22 + RIDGE) * g1 - h21 * g2) / det, -(-h21 * g1 + (h11 + RIDGE) * g2) / det
        turn_a, turn_b = np.where(better, new_a, turn_a), np.where(better, new_b, turn_b)
        slope = np.where(better, g1 * new_a + g2 * new_b, slope)
        step = np.where(better, 1.0, step / 2)
        open_ &= ~flat & (step >= LEAST_STEP)
        if not open_.any():
            break
        try_a, try_b = np.where(open_, a + step * turn_a, a), np.where(open_, b + step * turn_b, b)
    whole_a, whole_b = np.zeros((classes, classes)), np.zeros((classes, classes))
    whole_a[i, j] = whole_a[j, i] = a  # 1 - P turns the signs of the difference and of B
    whole_b[i, j], whole_b[j, i] = b, -b
    return whole_a, whole_b


def _sigmoid_sums(scores: DataFrame, classes: int, a: np.ndarray, b: np.ndarray, high: np.ndarray, low: np.ndarray, tasks: int) -> list[np.ndarray]:
    """For each pair value, gradient (2) and second derivatives (A A, B B, A B), in one pass."""
    i, j = np.triu_indices(classes, 1)
    whole = np.zeros((2, classes, classes))
    whole[0, i, j] = whole[0, j, i] = a
    whole[1, i, j] = whole[1, j, i] = b
    shared = scores.sparkSession.sparkContext.broadcast((whole, high, low))

    def run(batches):
        (wa, wb), high, low = shared.value
        acc = np.zeros((6, classes, classes))  # by own and other class
        for part, s in mx.matrices(batches, rows=max(16, min(mx.ROWS, (4 << 20) // (8 * classes)))):
            own = part.column(1).to_numpy(zero_copy_only=False)
            first = own[:, None] < np.arange(classes)  # the own class is the first of the pair
            f = s[np.arange(len(s)), own][:, None] - s
            f = np.where(first, f, -f)
            t = np.where(first, high[own][:, None], low[own][:, None])
            z = f * wa[own] + wb[own]
            e = np.exp(-np.abs(z))
            p = np.where(z >= 0, e, 1.0) / (1 + e)
            d1, d2 = t - p, p * (1 - p)
            loss = np.where(z >= 0, t, t - 1) * z + np.log1p(e)
            for k, x in enumerate((loss, f * d1, d1, f * f * d2, d2, f * d2)):
                np.add.at(acc[k], own, x)
        return acc

    sums = mx.total(scores, run, 6 * classes * classes, tasks).reshape(6, classes, classes)
    shared.unpersist()
    return [m[i, j] + m[j, i] for m in sums]


def coupled(scores: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Class probabilities of rows of scores: the p that least violates r_ji p_i = r_ij p_j over all pairs."""
    m, c = scores.shape
    if c < 2:
        return np.ones((m, c))
    out, block = np.empty((m, c)), max(1, (1 << 22) // (c * c))
    for s in range(0, m, block):
        x = scores[s : s + block]
        z = (x[:, :, None] - x[:, None, :]) * a + b
        r = np.clip(1 / (1 + np.exp(np.clip(z, -700, 700))), 1e-7, 1 - 1e-7)
        q = -r * r.transpose(0, 2, 1)
        each = np.arange(c)
        r[:, each, each] = 0
        q[:, each, each] = (r * r).sum(1)  # sum over j of r_ji squared
        out[s : s + block] = _fixed_point(q)
    return out


def _fixed_point(q: np.ndarray) -> np.ndarray:
    """Sweeps of p_t to the point where (Qp)_t = p'Qp, in place of a linear system for each row."""
    n, c, _ = q.shape
    p = np.full((n, c), 1 / c)
    qp = np.einsum("nij,nj->ni", q, p)
    pqp = (p * qp).sum(1)
    for _ in range(SWEEPS):
        if np.abs(qp - pqp[:, None]).max() < COUPLED:
            break
        for t in range(c):
            d = (pqp - qp[:, t]) / q[:, t, t]
            pqp = (pqp + d * (d * q[:, t, t] + 2 * qp[:, t])) / (1 + d) ** 2
            qp = (qp + d[:, None] * q[:, t]) / (1 + d)[:, None]
            p[:, t] += d
            p /= (1 + d)[:, None]
    return p


def coupled_rows(df: DataFrame, id_col: str, a: np.ndarray, b: np.ndarray, column: str = "scores") -> DataFrame:
    """(id_col, class_idx, p, rank) of each row's scores; ties to the smaller class. The sigmoids are broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((a, b))

    def run(batches: Iterator[pa.RecordBatch]):
        for part, s in mx.matrices(batches, at=1):
            yield ranked(part.column(0), coupled(s, *shared.value), [id_col, "class_idx", "p", "rank"])

    picked = df.filter(F.col(column).isNotNull()).select(id_col, F.col(column).cast("array<double>").alias("s"))
    return picked.mapInArrow(run, f"`{id_col}` {dict(df.dtypes)[id_col]}, class_idx int, p double, rank int")


def ranked(ids: pa.Array, p: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each id and class with its place by p, ties to the smaller class."""
    m, c = p.shape
    place = np.empty((m, c), np.int32)
    np.put_along_axis(place, np.argsort(-p, 1, kind="stable"), np.arange(1, c + 1, dtype=np.int32)[None, :], 1)
    each = pa.array(np.repeat(np.arange(m), c))
    return pa.RecordBatch.from_arrays([ids.take(each), pa.array(np.tile(np.arange(c, dtype=np.int32), m)), pa.array(p.ravel()), pa.array(place.ravel())], names=names)
