"""K-Means invariants, report assembly, payload JSON and the entry contract."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import kmeans, report

SF = "/root/testdata/sf0.001"


@pytest.fixture
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.3, size=(40, 3)) for c in (0.0, 4.0, 8.0)])
    return spark.createDataFrame([(f"{i:03d}", *map(float, x[i])) for i in range(len(x))],
                                 "CustomerID string, Recency double, Frequency double, Monetary double")


def test_kmeans_labels_are_nearest_centres(blobs):
    res = kmeans.kmeans(blobs, k=3, n_init=2)
    assigned = kmeans.assign_nearest(blobs, res.centroids)
    j = res.labels.join(assigned.withColumnRenamed("Cluster", "nearest"), "CustomerID")
    assert j.filter(F.col("Cluster") != F.col("nearest")).count() == 0
    assert [r.Cluster for r in res.centroids.collect()] == [0, 1, 2]
    sizes = sorted(r["count"] for r in res.labels.groupBy("Cluster").count().collect())
    assert sizes == [40, 40, 40]


def test_elbow_decreasing_and_k1_closed_form(blobs):
    curve = [r.wcss for r in kmeans.elbow_curve(blobs, max_k=5).orderBy("k").collect()]
    x = np.array([[r.Recency, r.Frequency, r.Monetary] for r in blobs.collect()])
    assert abs(curve[0] - ((x - x.mean(0)) ** 2).sum()) < 1e-6
    assert all(a >= b - 1e-9 for a, b in zip(curve, curve[1:]))


def _profile(spark, rows):
    return spark.createDataFrame(rows, "Cluster int, Recency_Mean double, Frequency_Mean double, "
                                       "Monetary_Mean double, Customer_Count long")


def _rules(spark):
    return spark.createDataFrame(
        [("a", "b", "a ➔ b", 0.5, 0.6667, 1.3333), ("b", "c", "b ➔ c", 0.25, 0.5, 0.9)],
        "antecedents_str string, consequents_str string, rule string, support double, "
        "confidence double, lift double")


def test_personas(spark):
    p = _profile(spark, [(0, 10.0, 12.0, 100.0, 5), (1, 150.0, 2.0, 100.0, 3), (2, 20.0, 2.0, 50.0, 9),
                         (-1, 300.0, 1.0, 10.0, 2)])
    got = {r.Cluster: (r.persona, r.is_noise) for r in report.cluster_personas(p).collect()}
    assert got == {0: (report.PERSONA_VIP, False), 1: (report.PERSONA_RISK, False),
                   2: (report.PERSONA_CORE, False), -1: (report.PERSONA_RISK, True)}


def test_payload_json_and_report(spark):
    p = _profile(spark, [(0, 10.0, 2.0, 1234.5, 5)])
    payload = json.loads(report.insight_payload(p, _rules(spark)).first().payload)
    assert payload["project_title"] == report.PROJECT_TITLE
    assert payload["cluster_segments"][0]["customer_count"] == 5
    assert [r["lift"] for r in payload["top_association_rules"]] == [1.3333, 0.9]
    text = report.report_text(report.offline_report(p, _rules(spark)))
    assert "### 👑 Cluster 0: High-Value VIP Loyalists" in text
    assert "- **Average Total Monetary Value:** $1,234.50" in text
    assert "### Rule #1: [a] ➔ [b]" in text
    assert "Lift = `1.3333` | Confidence = `66.7%` | Support = `50.0%`" in text
    assert text.splitlines()[-1].startswith("- **Expected ROI:**")


def test_empty_sections(spark):
    p = _profile(spark, [])
    r = spark.createDataFrame([], _rules(spark).schema)
    text = report.report_text(report.offline_report(p, r))
    assert report.REPORT_NO_CLUSTERS in text and report.REPORT_NO_RULES in text
    payload = json.loads(report.insight_payload(p, r).first().payload)
    assert payload["cluster_segments"] == [] and payload["top_association_rules"] == []


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "rule" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_streaming_clean(spark, tmpdir_path):
    import os
    from tillroll.streaming import clean_stream
    src = os.path.join(tmpdir_path, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID\n"
                "1,A,apple,2,2024-01-01 10:00,1.5,7\nC2,A,apple,-1,2024-01-01 10:00,1.5,7\n")
    q = (clean_stream(spark, src).writeStream.format("memory").queryName("cleaned_stream")
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select InvoiceNo, TotalPrice from cleaned_stream").collect()
    assert [(r.InvoiceNo, r.TotalPrice) for r in rows] == [("1", 3.0)]


def test_silhouette_blocks_shuffle_few_rows(spark, monkeypatch):
    """Any block sizes give the sequential score; by default the points meet in few, large blocks."""
    import numpy as np

    from tillroll.operators import evaluate as ev
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 1.0, size=(70, 3)) for c in (0, 2, 5)] + [np.full((1, 3), 9.0)])
    lab = np.repeat([0, 1, 4, 7], [70, 70, 70, 1])
    df = spark.createDataFrame([(f"{i:03d}", int(c), *map(float, r)) for i, (c, r) in enumerate(zip(lab, x, strict=True))],
                               "CustomerID string, Cluster int, Recency double, Frequency double, Monetary double")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i, c in enumerate(lab):
        means = {o: d[i, lab == o].sum() / ((lab == o).sum() - (o == c)) for o in set(lab) if o != c or (lab == c).sum() > 1}
        s.append((min(v for o, v in means.items() if o != c) - means[c]) / max(
            means[c], min(v for o, v in means.items() if o != c)) if c in means else 0.0)
    for block in (1 << 19, 64, 9):
        assert abs(ev.silhouette_exact(df, block_rows=block).first()[0] - np.mean(s)) < 1e-9, block
    seen = {}
    real = ev.cogroup_blocks
    monkeypatch.setattr(ev, "blocks_for", lambda n, rows: seen.setdefault(len(seen), rows) and 2)
    monkeypatch.setattr(ev, "cogroup_blocks", lambda *a, **k: real(*a, **k))
    ev.silhouette_exact(df)
    assert seen[0] >= 1 << 19  # a point is shuffled once a block of that many rows


def test_label_sums_equal_all_distances():
    import numpy as np

    from tillroll.operators.evaluate import label_sums
    rng = np.random.default_rng(1)
    lx, rx, lab = rng.normal(size=(70, 3)), rng.normal(size=(50, 3)), rng.integers(0, 4, 50) * 3
    uniq, sizes, sums = label_sums(lx, rx, lab, tile=5, rows=8)
    d = np.sqrt(((lx[:, None] - rx[None]) ** 2).sum(-1))
    assert uniq.tolist() == [0, 3, 6, 9] and sizes.tolist() == [(lab == u).sum() for u in uniq]
    assert np.allclose(sums, np.stack([d[:, lab == u].sum(1) for u in uniq], 1), rtol=1e-12)
