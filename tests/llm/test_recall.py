"""Recall of multi-index hashing with the registered query's blocks, and with rotations and radius from a true sample."""

import os

import numpy as np
import pytest

from tillroll.llm import mih


@pytest.mark.parametrize(("table", "every", "options"), [
    ("sf0.1", 50, {}), ("sf0.1", 50, {"fit_rows": 500}), ("check_s", 100, {"fit_rows": 1000}), ("check_l", 100, {})])
def test_recall_with_default_blocks(spark, table, every, options):
    path = f"/root/testdata/{table}/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip(f"no {path}")
    vectors = spark.read.parquet(path)
    rows = vectors.toPandas()
    x, ids = np.stack(rows.embedding.to_list()).astype(float), rows.vec_id.to_numpy()
    if table == "check_l":  # several blocks and a sample of a fifth, as in the registered query
        assert len(ids) > 3 * mih.BLOCK_ROWS and len(ids) > 5 * mih.FIT_ROWS
    got = mih.nearest(vectors, lambda i: i % every == 0, **options).toPandas().groupby("query_id").vec_id.apply(set)
    hits = asked = 0
    for q in np.flatnonzero(ids % every == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
        asked += 10
    assert asked and hits / asked >= 0.95
