"""Golden clustering fixtures (1-D points) and guards."""

import pytest

from tillroll.operators import dbscan, evaluate

PTS = [0.0, 1.0, 2.0, 10.0, 11.0, 12.0, 50.0]


@pytest.fixture
def points(spark):
    return spark.createDataFrame([(f"p{i}", x) for i, x in enumerate(PTS)], "CustomerID string, x double")


def test_dbscan_golden(points):
    lab = {r.CustomerID: r.Cluster for r in dbscan.dbscan(points, 1.0, 3, features=["x"]).collect()}
    assert [lab[f"p{i}"] for i in range(7)] == [0, 0, 0, 1, 1, 1, -1]


def test_metrics_golden(points, spark):
    lab = dbscan.dbscan(points, 1.0, 3, features=["x"])
    pts = points.join(lab, "CustomerID")
    sil = evaluate.silhouette_exact(pts, features=["x"]).first()[0]
    dbi = evaluate.davies_bouldin(pts, features=["x"]).first()[0]
    assert round(sil, 4) == 0.8657
    assert round(dbi, 4) == 0.1333
    m = evaluate.cluster_metrics(pts, features=["x"]).first()
    assert (m.silhouette_score, m.davies_bouldin_index, m.n_clusters, m.noise_count, m.status) == \
        (0.8657, 0.1333, 2, 1, "Success")


def test_singleton_silhouette_zero(spark):
    df = spark.createDataFrame([("a", 0.0, 0), ("b", 1.0, 0), ("c", 10.0, 1)],
                               "CustomerID string, x double, Cluster int")
    # a: a=1, b=10 -> 0.9 ; b: a=1, b=9 -> 0.8889 ; c: singleton -> 0
    s = evaluate.silhouette_exact(df, features=["x"]).first()[0]
    assert abs(s - (0.9 + 8 / 9 + 0.0) / 3) < 1e-12


def test_guards(spark):
    one = spark.createDataFrame([("a", 0.0, 0), ("b", 1.0, 0)], "CustomerID string, x double, Cluster int")
    m = evaluate.cluster_metrics(one, features=["x"]).first()
    assert m.silhouette_score is None and m.n_clusters == 1
    assert m.status.startswith("Insufficient")


def test_squared_silhouette_matches_brute_force(spark):
    import itertools
    rows = [("a", 0.0, 0), ("b", 1.0, 0), ("c", 3.0, 0), ("d", 10.0, 1), ("e", 12.0, 1), ("f", 30.0, 2)]
    df = spark.createDataFrame(rows, "CustomerID string, x double, Cluster int")
    got = evaluate.silhouette_squared(df, features=["x"]).first()[0]
    vals = []
    for i, xi, ki in rows:
        same = [(xi - xj) ** 2 for j, xj, kj in rows if kj == ki and j != i]
        if not same:
            vals.append(0.0)
            continue
        a = sum(same) / len(same)
        b = min(sum((xi - xj) ** 2 for _, xj, kj in rows if kj == k) /
                sum(1 for _, _, kj in rows if kj == k) for k in {r[2] for r in rows} if k != ki)
        vals.append((b - a) / max(a, b))
    assert abs(got - sum(vals) / len(vals)) < 1e-12
    assert itertools is not None
