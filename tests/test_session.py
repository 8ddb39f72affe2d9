"""Intermediate folders and shipping of the package."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from tillroll import session

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_no_folder_remains_after_results_are_consumed(spark):
    from tillroll.plans.queries import QUERIES
    session.drop_intermediates(spark)
    rows = QUERIES["rfm_scaled"](spark, "/root/testdata/sf0.001").collect()
    paths = list(session._written)
    assert rows and paths and all(os.path.isdir(p.removeprefix("file:")) for p in paths)
    assert session.drop_intermediates(spark) == len(paths)
    assert not any(os.path.exists(p.removeprefix("file:")) for p in paths)


def test_release_deletes_one_table(spark):
    df = session.cut_lineage(spark.range(3))
    path = df._tillroll_path.removeprefix("file:")
    assert os.path.isdir(path)
    session.release(df)
    assert not os.path.exists(path)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_a_shared_folder(master):
    conf = SimpleNamespace(get=lambda key, default=None: default)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master=master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_kernels_run_from_another_folder(tmp_path):
    """Workers get the package as a zip: no PYTHONPATH, another working folder."""
    script = tmp_path / "run.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "from tillroll.session import get_session\n"
        "from tillroll.operators.dbscan import dbscan\n"
        "s = get_session('local[2]', shuffle_partitions=2)\n"
        "df = s.createDataFrame([(str(i), i * 0.1, 0.0, 0.0) for i in range(12)],\n"
        "                       'CustomerID string, Recency double, Frequency double, Monetary double')\n"
        "print('LABELS', sorted({r.Cluster for r in dbscan(df, 0.5, 3).collect()}))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "LABELS [0]" in out.stdout, out.stderr[-2000:]


def test_empty_inputs_raise(spark):
    from tillroll.operators import agglomerative, dbscan, kmeans
    empty = spark.createDataFrame([], "CustomerID string, Recency double, Frequency double, Monetary double")
    for run in (kmeans.kmeans, kmeans.elbow_curve, dbscan.dbscan, agglomerative.agglomerative):
        with pytest.raises(ValueError):
            run(empty)


def test_basket_matrix_with_awkward_item_names(spark):
    from tillroll.operators import baskets
    lines = spark.createDataFrame([("1", "a`b", 1.0), ("1", "InvoiceNo", 2.0), ("2", "x.y", 1.0)],
                                  "InvoiceNo string, Description string, Quantity double")
    rows = {r["InvoiceNo"]: r for r in baskets.basket_matrix(lines, ["a`b", "InvoiceNo", "x.y"]).collect()}
    assert set(rows["1"].asDict()) == {"InvoiceNo", "a`b", "InvoiceNo_item", "x.y"}
    assert rows["1"]["a`b"] and rows["1"]["InvoiceNo_item"] and not rows["1"]["x.y"] and rows["2"]["x.y"]
    assert baskets.basket_matrix(lines, items=["x.y"]).columns == ["InvoiceNo", "x.y"]


def test_miner_comparison_and_its_long_form(spark):
    from tillroll.operators import mining
    items = spark.createDataFrame([(str(i), x) for i in range(6) for x in "abc"[: 1 + i % 3]], "InvoiceNo string, item string")
    arrays = items.groupBy("InvoiceNo").agg({"item": "collect_set"}).toDF("InvoiceNo", "items")
    table = mining.compare_miners(items, arrays, 0.3)
    row = table.first()
    assert row.apriori_itemset_count == row.fpgrowth_itemset_count > 0
    long = {(r.algorithm, r.measure): r.value for r in mining.miner_timings(table).collect()}
    assert len(long) == 4 and long[("Apriori", "itemsets")] == row.apriori_itemset_count
