"""DBSCAN against a sequential brute force, including a hot cell."""

import numpy as np
import pytest

from tillroll.operators import dbscan
from tillroll.operators.pairwise import counts_within


def brute(x, eps, ms):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    nb = [np.nonzero(d[i] <= eps)[0] for i in range(n)]
    core = np.array([len(v) >= ms for v in nb])
    lab = np.full(n, -1)
    c = 0
    for i in range(n):
        if lab[i] != -1 or not core[i]:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if lab[j] != -1:
                continue
            lab[j] = c
            if core[j]:
                stack.extend(k for k in nb[j] if lab[k] == -1)
        c += 1
    return lab


def test_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    blob = rng.normal(0, 0.05, size=(120, 3))           # one very dense cell
    spread = rng.uniform(-2, 2, size=(180, 3))
    line = np.stack([np.linspace(3, 6, 40), np.zeros(40), np.zeros(40)], axis=1)
    x = np.vstack([blob, spread, line])
    ids = [f"{i:05d}" for i in range(len(x))]
    df = spark.createDataFrame([(ids[i], *map(float, x[i])) for i in range(len(x))],
                               "CustomerID string, Recency double, Frequency double, Monetary double")
    for eps, ms in [(0.5, 5), (0.3, 4), (0.12, 3)]:
        want = brute(x, eps, ms)
        got = {r.CustomerID: r.Cluster for r in dbscan.dbscan(df, eps, ms).collect()}
        assert [got[i] for i in ids] == list(want), (eps, ms)


def test_partition_independent(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, size=(200, 3))
    rows = [(f"{i:04d}", *map(float, x[i])) for i in range(len(x))]
    schema = "CustomerID string, Recency double, Frequency double, Monetary double"
    a = {r.CustomerID: r.Cluster for r in dbscan.dbscan(
        spark.createDataFrame(rows, schema).repartition(1), 0.3, 4).collect()}
    b = {r.CustomerID: r.Cluster for r in dbscan.dbscan(
        spark.createDataFrame(rows, schema).repartition(7), 0.3, 4).collect()}
    assert a == b


def test_neighbour_counts(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(-1, 1, size=(150, 3))
    rows = [(f"{i:04d}", *map(float, x[i])) for i in range(len(x))]
    df = spark.createDataFrame(rows, "CustomerID string, Recency double, Frequency double, Monetary double")
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    want = (d <= 0.4).sum(1)
    got = {r.CustomerID: r.n_neighbors for r in dbscan.neighbour_counts(df, 0.4).collect()}
    assert [got[f"{i:04d}"] for i in range(len(x))] == list(want)


@pytest.mark.parametrize("decimals", [None, 1])
def test_strip_counts_equal_brute_force(spark, monkeypatch, decimals):
    """Counts by strips (free points) and lines (days and counts), many tasks a place, a line dealt by its points."""
    monkeypatch.setattr(dbscan, "TASK_POINTS", 64)
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 0.3, size=(300, 3)), np.full((40, 3), 0.25)])
    if decimals is not None:
        x[:, :2] = np.round(x[:, :2] * 2, decimals) / 4
        monkeypatch.setattr(dbscan, "LINE_POINTS", 1)
    df = spark.createDataFrame([(f"{i:04d}", *map(float, r)) for i, r in enumerate(x)],
                               "CustomerID string, Recency double, Frequency double, Monetary double")
    want = (((x[:, None, :] - x[None, :, :]) ** 2).sum(-1) <= 0.25).sum(1)
    got = {r.CustomerID: r.n_neighbors for r in dbscan.neighbour_counts(df, 0.5).collect()}
    assert [got[f"{i:04d}"] for i in range(len(x))] == list(want)


def test_counts_hold_no_table_of_distances():
    """200,000 points on lines, all near each other: the kernel neither holds nor computes their distances."""
    import tracemalloc
    rng = np.random.default_rng(2)
    t = np.column_stack([rng.integers(0, 10, 200_000) / 40, np.zeros(200_000), rng.uniform(0, 0.4, 200_000)])
    tracemalloc.start()
    got = counts_within(t[:20_000], t, 0.5, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == 200_000).all() and peak < 300 << 20


def test_counts_within_odd_points():
    from math import nan
    got = counts_within(np.array([[0.0, 0.0], [nan, 0.0], [3.0, 0.0]]), np.array([[0.3, 0.4], [0.0, nan], [0.0, 0.0]]), 0.5, None)
    assert got.tolist() == [2, 0, 0]
    assert counts_within(np.zeros((2, 1)), np.empty((0, 1)), 0.5, 0.1).tolist() == [0, 0]


def _points(spark, x):
    return spark.createDataFrame([(f"{i:05d}", *map(float, r)) for i, r in enumerate(x)],
                                 "CustomerID string, Recency double, Frequency double, Monetary double")


def test_dense_cells_meet_a_few_points(spark, monkeypatch):
    """A dense cloud over many cells: far fewer distances than its points' pairs, the labels of brute force."""
    work = []
    plain = dbscan.pairs_within

    def counted(rows, dim, e2):
        from pyspark.sql import functions as F
        work.append((rows.agg(F.sum(F.size("xa").cast("long") * F.size("xb"))).first()[0] or 0) / dim ** 2)
        return plain(rows, dim, e2)

    monkeypatch.setattr(dbscan, "pairs_within", counted)
    x = np.random.default_rng(21).uniform(0, 0.85, size=(3000, 3))
    got = {r.CustomerID: r.Cluster for r in dbscan.dbscan(_points(spark, x), 0.5, 5).collect()}
    assert set(got.values()) == {0} and len(got) == 3000
    assert sum(work) < 3000 * 3000 / 4


def test_sheets_nearly_eps_apart(spark):
    """Dense sheets whose cells hold no near pair among a few points of each: one pair joins two, none the third."""
    rng = np.random.default_rng(22)
    a = np.column_stack([rng.uniform(0, 0.1, 150), rng.uniform(0, 0.1, 150), np.zeros(150)])
    b = np.column_stack([rng.uniform(0.25, 0.35, 150), rng.uniform(0, 0.1, 150), np.full(150, 0.45)])
    c = np.column_stack([rng.uniform(0, 0.1, 150), rng.uniform(0, 0.1, 150), np.full(150, -0.5001)])
    for bridge in ([], [[0.14, 0.05, 0.0], [0.21, 0.05, 0.45]]):
        x = np.vstack([a, b, c, *[[p] for p in bridge]])
        for eps in (0.5, 0.47):
            want = brute(x, eps, 5)
            got = {r.CustomerID: r.Cluster for r in dbscan.dbscan(_points(spark, x), eps, 5).collect()}
            assert [got[f"{i:05d}"] for i in range(len(x))] == list(want), (len(bridge), eps)


def test_sheets_just_within_eps_meet_in_parts(spark, monkeypatch):
    """Dense sheets a hair under eps apart: work far under the pairs of their points, the labels of brute force."""
    work = []
    plain = dbscan.pairs_within

    def counted(rows, dim, e2):
        from pyspark.sql import functions as F
        work.append((rows.agg(F.sum(F.size("xa").cast("long") * F.size("xb"))).first()[0] or 0) / dim ** 2)
        return plain(rows, dim, e2)

    monkeypatch.setattr(dbscan, "pairs_within", counted)
    monkeypatch.setattr(dbscan, "PART_PAIRS", 256, raising=False)
    xy = np.random.default_rng(23).uniform(0, 0.28, size=(3000, 2))
    x = np.column_stack([xy, np.where(np.arange(3000) % 2, 0.4999999999, 0.0)])
    d2 = ((x[::2, None, :] - x[None, 1::2, :]) ** 2).sum(-1)
    assert (d2 > 0.25).all()
    got = {r.CustomerID: r.Cluster for r in dbscan.dbscan(_points(spark, x), 0.5, 5).collect()}
    assert [got[f"{i:05d}"] for i in range(len(x))] == [i % 2 for i in range(3000)]
    assert sum(work) < 1500 * 1500 / 4


@pytest.mark.parametrize("bridge", [False, True])
def test_parts_equal_brute_force(spark, monkeypatch, bridge):
    """Tilted sheets, copies and points that differ by rounding, with parts of few points and one pair that joins or none."""
    monkeypatch.setattr(dbscan, "PART_PAIRS", 4, raising=False)
    rng = np.random.default_rng(24)
    a = np.column_stack([rng.uniform(0, 0.25, 60), rng.uniform(0, 0.25, 60), np.zeros(60)])
    a[:, 2] = a[:, 0] * 0.4
    b = a + [0.0, 0.0, 0.5 * np.sqrt(1 + 0.16) + 1e-3]
    clump = np.array([0.0, 0.1, 0.0]) + rng.integers(0, 3, (30, 3)) * 2e-12
    x = np.vstack([a, b, clump, clump + [0.0, 0.0, 0.5000001], a[:20]])
    if bridge:
        x = np.vstack([x, [[0.12, 0.12, 0.12 * 0.4 + 0.02], [0.1, 0.12, 0.1 * 0.4 + 0.5]]])
    got = {r.CustomerID: r.Cluster for r in dbscan.dbscan(_points(spark, x), 0.5, 5).collect()}
    assert [got[f"{i:05d}"] for i in range(len(x))] == list(brute(x, 0.5, 5))
