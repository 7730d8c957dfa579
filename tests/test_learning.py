"""Principal components, class vectors, sigmoids and pairwise coupling against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspark.models.appearance import AppearanceIdentifier, AppearanceModel
from kinspark.operators import features as ft
from kinspark.operators import matrices as mx
from kinspark.operators import pairwise as pw
from kinspark.operators.principal import PopulationScaler, principal_axes


def table(spark, v, **more):
    rows = [(i, x.tolist(), *(int(m[i]) for m in more.values())) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, ", ".join(["id long", "vec array<double>", *(f"{n} int" for n in more)]))


def clusters(n, classes, dims, seed, spread=1.0):
    r = np.random.default_rng(seed)
    own = r.integers(0, classes, n)
    return r.normal(size=(classes, dims))[own] * 2 + spread * r.normal(size=(n, dims)), own


@pytest.mark.parametrize("way", ["covariance", "dual", "random"])
def test_principal_axes_equal_numpy(spark, way):
    r = np.random.default_rng(0)
    v = r.normal(size=(90, 12)) @ (r.normal(size=(12, 40)) * 3) + 0.01 * r.normal(size=(90, 40)) + 5
    v[:, 7] = 4.0  # without spread
    df = table(spark, v).union(spark.createDataFrame([(99, None)], "id long, vec array<double>")).repartition(5)
    std = v.std(0)
    z = (v - v.mean(0)) / np.where(std > 0, std, 1)
    _, lengths, axes = np.linalg.svd(z, full_matrices=False)
    axes = axes[:6] * np.sign(np.take_along_axis(axes[:6], np.abs(axes[:6]).argmax(1)[:, None], 1))
    found = principal_axes(df, "vec", 6, way=way)
    assert np.allclose(found.variances, lengths[:6] ** 2 / 90, rtol=1e-8)
    assert np.allclose(found.fold(np.eye(6)), axes, atol=1e-7)
    for part_bytes in (1 << 20, 8 * 40 * 2):  # at once, and two components at a time
        got = {r.id: r.out for r in found.project(df, "vec", "out", part_bytes).collect()}
        assert got.pop(99) is None and np.allclose(np.array([got[i] for i in range(90)]), z @ axes.T, atol=1e-7)


def test_more_components_than_rows_or_rank(spark):
    r = np.random.default_rng(1)
    v = r.normal(size=(20, 3)) @ r.normal(size=(3, 30))
    for way in ("covariance", "dual", "random"):
        found = principal_axes(table(spark, v), "vec", 99, way=way)
        assert len(found.variances) == 20 and np.allclose(found.variances[3:], 0, atol=1e-9)
        w = found.fold(np.eye(20))[:3]
        assert np.allclose(w @ w.T, np.eye(3), atol=1e-7) and found.variances.sum() == pytest.approx(30)
    same = principal_axes(table(spark, np.vstack([v, v])), "vec", 3, way="dual")  # equal rows have equal hashes
    assert np.allclose(same.fold(np.eye(3)), principal_axes(table(spark, v), "vec", 3, way="covariance").fold(np.eye(3)), atol=1e-6)
    with pytest.raises(ValueError):
        PopulationScaler.fit(table(spark, v).filter("false"), "vec")


def test_wide_vectors_without_a_matrix_of_dimensions(spark):
    """60,000 dimensions: a covariance would take 29 GB."""
    n, d = 300, 60_000
    rows = spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: F.sin(F.col("id") * (j % 7 + 1) / 10) * (j % 11 + 1) + F.cos(F.col("id") + j % 5)).cast("array<float>").alias("vec"))
    v = np.array([[np.sin(i * (j % 7 + 1) / 10) * (j % 11 + 1) + np.cos(i + j % 5) for j in range(7 * 11 * 5)] for i in range(n)], np.float32).astype(float)
    z = (v - v.mean(0)) / v.std(0)  # the columns repeat every 385 dimensions
    copies = np.bincount(np.arange(d) % 385)
    want = np.linalg.svd(z * np.sqrt(copies), compute_uv=False)[:4] ** 2 / n
    for way in ("dual", "random"):
        assert np.allclose(principal_axes(rows, "vec", 4, way=way).variances, want, rtol=1e-5)


def test_sums_over_tasks(spark):
    df = spark.range(1000, numPartitions=40).selectExpr("array(cast(id as double)) as v")

    def run(batches):
        acc = np.zeros(20_000)
        for _, v in mx.matrices(batches):
            acc += v.sum()
        return acc

    for known in ({}, {"size": 20_000, "tasks": 40}):
        got = mx.total(df, run, **known)
        assert got.shape == (20_000,) and (got == 499_500).all()
    assert len(mx.total(df.filter("false"), lambda b: None)) == 0


def objective(w, x, y):
    s = x @ w.T
    lack = np.maximum(0, 1 - s[np.arange(len(y)), y][:, None] + s)
    lack[np.arange(len(y)), y] = 0
    g = 2 * lack
    g[np.arange(len(y)), y] = -g.sum(1)
    free = w.copy()
    free[:, -1] = 0
    return (lack**2).sum() + (free**2).sum(), g.T @ x + 2 * free


def test_class_vectors_are_the_optimum_in_few_passes(spark, monkeypatch):
    for classes in (2, 7):
        v, own = clusters(200, classes, 5, classes)
        fold = np.arange(200) % 2
        df = table(spark, v, class_idx=own, fold=fold).select("vec", "class_idx", "fold")
        passes = []
        whole = mx.total
        monkeypatch.setattr(pw.mx, "total", lambda *a: passes.append(1) or whole(*a))
        found = pw.class_vectors(df, classes, 5, 100, 2, 4)
        monkeypatch.undo()
        assert len(passes) < 150  # of all classes and folds together
        x = np.hstack([v, np.ones((200, 1))])
        for m, w in enumerate(found):
            use = fold != m - 1
            value, gradient = objective(w, x[use], own[use])
            assert np.abs(gradient).max() < 1e-3 * np.abs(objective(np.zeros_like(w), x[use], own[use])[1]).max()
            best = w.copy()  # plain descent from there gains next to nothing
            for _ in range(3000):
                best -= 2e-4 * objective(best, x[use], own[use])[1]
            assert value <= 1.002 * objective(best, x[use], own[use])[0]
        scores = {tuple(np.round(r.scores, 6)) for r in pw.held_out_scores(df, found[1:]).collect()}
        assert scores == {tuple(np.round(found[1 + fold[i]] @ x[i], 6)) for i in range(200)}
    with pytest.raises(ValueError):
        pw.class_vectors(df, 10**6, 10**6, 5)


def test_sigmoids_are_the_optimum(spark):
    v, own = clusters(400, 4, 3, 9, 3.0)
    scores = v @ np.random.default_rng(3).normal(size=(3, 4))
    df = table(spark, scores, class_idx=own).select("vec", "class_idx")
    a, b = pw.sigmoids(df, 4, 4)
    assert np.allclose(a, a.T) and np.allclose(b, -b.T)
    for i in range(4):
        for j in range(i + 1, 4):
            use = (own == i) | (own == j)
            f, yes = scores[use, i] - scores[use, j], own[use] == i
            t = np.where(yes, (yes.sum() + 1) / (yes.sum() + 2), 1 / ((~yes).sum() + 2))

            def loss(x, y):
                z = f * x + y
                return (np.where(z >= 0, t, t - 1) * z + np.log1p(np.exp(-np.abs(z)))).sum()

            p = 1 / (1 + np.exp(f * a[i, j] + b[i, j]))
            assert abs((f * (t - p)).sum()) < 1e-3 and abs((t - p).sum()) < 1e-3
            assert all(loss(a[i, j], b[i, j]) <= loss(a[i, j] + x, b[i, j] + y) for x in (-0.01, 0, 0.01) for y in (-0.01, 0, 0.01))


def test_coupling_solves_its_linear_system():
    r = np.random.default_rng(4)
    for c in (2, 3, 9):
        s = 2 * r.normal(size=(25, c))
        a, b = -1 - r.random((c, c)), r.normal(size=(c, c))
        a, b = (a + a.T) / 2, b - b.T
        p = pw.coupled(s, a, b)
        assert np.allclose(p.sum(1), 1) and (p > 0).all()
        for row, got in zip(s, p, strict=True):
            rij = np.clip(1 / (1 + np.exp((row[:, None] - row) * a + b)), 1e-7, 1 - 1e-7)
            np.fill_diagonal(rij, 0)
            q = -rij.T * rij
            np.fill_diagonal(q, (rij.T**2).sum(1))
            system = np.block([[q, np.ones((c, 1))], [np.ones((1, c)), np.zeros((1, 1))]])
            assert np.allclose(np.linalg.solve(system, np.append(np.zeros(c), 1))[:c], got, atol=1e-7)
    assert pw.coupled(np.zeros((2, 1)), np.zeros((1, 1)), np.zeros((1, 1))).tolist() == [[1.0], [1.0]]


def test_appearance_from_fit_to_load(spark, tmp_path, monkeypatch):
    v, own = clusters(240, 5, 12, 6, 1.5)
    d = table(spark, v, class_idx=own).select(F.col("id").alias("image_id"), F.concat(F.lit("n"), F.col("class_idx").cast("string")).alias("name"), "vec")
    classes = spark.createDataFrame([(f"n{i}", i) for i in range(5)], "name string, class_idx int")
    train, test = d.filter("image_id < 180"), d.filter("image_id >= 180")
    model = AppearanceIdentifier(components=8).fit(train, classes)
    got = {(r.image_id, r.name): (r.p, r.rank) for r in model.predict(test).collect()}
    sums = {i: sum(p for (k, _), (p, _) in got.items() if k == i) for i in range(180, 240)}
    assert all(s == pytest.approx(1) for s in sums.values()) and len(got) == 300
    right = sum(got[i, f"n{own[i]}"][1] == 1 for i in range(180, 240)) / 60
    sure = sum(max(p for (k, _), (p, _) in got.items() if k == i) for i in range(180, 240)) / 60
    assert right > 0.8 and abs(right - sure) < 0.12  # calibrated
    model.save(spark, str(tmp_path / "m"))
    again = AppearanceModel.load(spark, str(tmp_path / "m"))
    assert {(r.image_id, r.name): (r.p, r.rank) for r in again.predict(test).collect()} == got
    same = AppearanceIdentifier(components=8).fit(train.repartition(3), classes)
    assert all(p == pytest.approx(got[k][0], abs=1e-4) for k, p in (((r.image_id, r.name), r.p) for r in same.predict(test).collect()))
    other = AppearanceIdentifier(components=8, seed=7).fit(train, classes)
    assert not np.allclose(other.head.sigmoids[0], model.head.sigmoids[0])
    monkeypatch.setattr(ft, "HEAD_BYTES", 8 * 12 * 2)  # two classes at a time
    parts = {(r.image_id, r.name): (r.p, r.rank) for r in again.predict(test).collect()}
    assert all(parts[k][1] == got[k][1] and parts[k][0] == pytest.approx(got[k][0]) for k in got)
