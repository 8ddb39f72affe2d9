"""Cluster evaluation: silhouette, Davies–Bouldin, metric record, profiles.

Points are ``(id, label, f1..fd)`` rows; label -1 is noise and is left out of
the scores, as is usual for density clustering.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.pairwise import blocks_for, cogroup_blocks, distance_chunks
from tillroll.operators.rfm import FEATURES
from tillroll.session import cut_lineage

NOISE = -1
# Status texts of the metric record.
STATUS_OK = "Success"
STATUS_FEW = ("Insufficient valid clusters for metric calculation "
              "(Requires >= 2 non-noise clusters).")
METRICS_SCHEMA = ("silhouette_score double, davies_bouldin_index double, n_clusters int, "
                  "noise_count int, status string")


def label_sums(lx, rx, labels, tile: int = 4096, rows: int = 64):
    """(distinct labels, their sizes, sums): the summed distances of every row of ``lx`` to each label's rows of ``rx``."""
    order = np.argsort(labels, kind="stable")
    rc = np.ascontiguousarray(rx[order].T)
    uniq, first, sizes = np.unique(labels[order], return_index=True, return_counts=True)
    pieces = [(j, s, min(s + tile, lo + k)) for j, (lo, k) in enumerate(zip(first.tolist(), sizes.tolist(), strict=True))
              for s in range(lo, lo + k, tile)]
    sums = np.zeros((len(lx), len(uniq)))
    d, step = np.empty((rows, tile)), np.empty((rows, tile))  # reused: they stay in the cache
    for lo in range(0, len(lx), rows):
        own = lx[lo:lo + rows]
        for j, s, e in pieces:
            total, diff = d[:len(own), :e - s], step[:len(own), :e - s]
            np.subtract(own[:, :1], rc[0, s:e], out=total)
            np.multiply(total, total, out=total)
            for c in range(1, len(rc)):
                np.subtract(own[:, c:c + 1], rc[c, s:e], out=diff)
                np.multiply(diff, diff, out=diff)
                np.add(total, diff, out=total)
            sums[lo:lo + rows, j] += np.sqrt(total, out=total).sum(axis=1)
    return uniq, sizes, sums


def silhouette_exact(points: DataFrame, id_col: str = "CustomerID", label: str = "Cluster",
                     features=FEATURES, block_rows: int = 1 << 19) -> DataFrame:
    """Mean silhouette with Euclidean distances, exactly; one row ``silhouette_score``.

    For every point the blocked kernel sums its distances to each cluster of
    the other block (never materialising pairs); the sums are added up per
    (point, cluster), giving a = own-cluster mean (excluding itself), b = the
    smallest other-cluster mean, s = (b - a) / max(a, b), s = 0 for a point
    alone in its cluster. Quadratic arithmetic: see ``silhouette_squared``
    for the linear variant.

    Every point is shuffled once a block of the other side, so the blocks are
    large (the sums of a block come to at most ``block_rows``) and the other
    side's rows bare numbers; the points whose sums are taken are dealt into
    at least 48 blocks, one task each.
    """
    pts = points.filter(F.col(label) != NOISE).select(
        id_col, F.xxhash64(id_col).alias("_key"), F.col(label).cast("long").alias("_own"),
        *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    pts = cut_lineage(pts)   # read by the count and by both kernel sides
    size = pts.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_own").alias("k")).first()
    n, k = size["n"], size["k"]
    fcols = [f"_f{i}" for i in range(len(features))]

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({id_col: [], "_own": [], "_other": [], "_sum": [], "_cnt": []})
        uniq, sizes, sums = label_sums(lp[fcols].to_numpy(float), rp[fcols].to_numpy(float), rp["_own"].to_numpy())
        k = len(uniq)
        return pd.DataFrame({
            id_col: np.repeat(lp[id_col].to_numpy(), k),
            "_own": np.repeat(lp["_own"].to_numpy(), k),
            "_other": np.tile(uniq, len(lp)),
            "_sum": sums.ravel(),
            "_cnt": np.tile(sizes, len(lp)).astype("int64"),
        })

    schema = f"{id_col} string, _own long, _other long, _sum double, _cnt long"
    probe_rows = max(1, min(block_rows // max(k, 1), max(1024, n // 48)))
    per = (cogroup_blocks(pts.select("_key", "_own", *fcols), "_key", blocks_for(n, block_rows), kernel, schema,
                          probes=pts, probe_blocks=blocks_for(n, probe_rows))
           .groupBy(id_col, "_own", "_other")
           .agg(F.sum("_sum").alias("_sum"), F.sum("_cnt").alias("_cnt")))
    own = F.col("_own") == F.col("_other")
    ab = per.groupBy(id_col).agg(
        F.max(F.when(own & (F.col("_cnt") > 1), F.col("_sum") / (F.col("_cnt") - 1))).alias("a"),
        F.min(F.when(~own, F.col("_sum") / F.col("_cnt"))).alias("b"),
        F.max(F.when(own, F.col("_cnt"))).alias("n_own"))
    s = F.when(F.col("n_own") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.agg(F.avg(s).alias("silhouette_score"))


def silhouette_squared(points: DataFrame, label: str = "Cluster", features=FEATURES) -> DataFrame:
    """Silhouette on squared Euclidean distances in O(n·k) (closed form).

    Sum over a cluster C of |x - y|^2 = |C||x|^2 - 2 x·S_C + Q_C with S_C the
    feature sums and Q_C the summed squared norms, so each point only needs
    the k cluster summaries, shipped as one array (a scalar subquery of k
    structs) and evaluated with array functions. Differs from the Euclidean
    score; never a silent stand-in for ``silhouette_exact``.
    """
    pts = points.filter(F.col(label) != NOISE)
    sq = sum((F.col(c) * F.col(c) for c in features), F.lit(0.0))
    summ = pts.groupBy(label).agg(
        F.struct(F.col(label).cast("long").alias("k"), F.count(F.lit(1)).alias("n"),
                 F.sum(sq).alias("q"),
                 *[F.sum(c).alias(f"s{i}") for i, c in enumerate(features)]).alias("st"))
    # the subquery value is projected first: lambdas may not contain subqueries
    pts = pts.select(label, *features, summ.agg(F.collect_list("st")).scalar().alias("_arr"))
    arr = F.col("_arr")
    own_l = F.col(label).cast("long")
    x2 = sq

    def total(st):
        dot = sum((F.col(c) * st[f"s{i}"] for i, c in enumerate(features)), F.lit(0.0))
        return st["n"] * x2 - 2 * dot + st["q"]

    own = F.filter(arr, lambda st: st["k"] == own_l)[0]
    others = F.transform(F.filter(arr, lambda st: st["k"] != own_l),
                         lambda st: total(st) / st["n"])
    a = F.when(own["n"] > 1, total(own) / (own["n"] - 1))
    b = F.array_min(others)
    s = F.when(own["n"] <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return pts.agg(F.avg(s).alias("silhouette_score"))


def davies_bouldin(points: DataFrame, label: str = "Cluster", features=FEATURES,
                   block_rows: int = 4096) -> DataFrame:
    """Davies–Bouldin index; one row ``davies_bouldin_index``.

    Centroids and spreads (mean distance to the centroid) are two grouped
    aggregates; the max over other clusters of (σi + σj) / d(ci, cj) uses the
    blocked kernel on the k-row centroid table. Coincident centroids add 0.
    """
    pts = cut_lineage(points.filter(F.col(label) != NOISE).select(label, *features))
    cents = pts.groupBy(label).agg(*[F.avg(c).alias(f"_c{i}") for i, c in enumerate(features)])
    k = cents.count()
    dist = F.sqrt(sum(((F.col(c) - F.col(f"_c{i}")) * (F.col(c) - F.col(f"_c{i}"))
                       for i, c in enumerate(features)), F.lit(0.0)))
    spread = (pts.join(cents, label)
              .groupBy(label, *[f"_c{i}" for i in range(len(features))])
              .agg(F.avg(dist).alias("_sigma"))
              .select(F.col(label).cast("long").alias("_lab"), "_sigma",
                      *[f"_c{i}" for i in range(len(features))]))
    ccols = [f"_c{i}" for i in range(len(features))]

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({"_lab": [], "_r": []})
        lx, rx = lp[ccols].to_numpy(float), rp[ccols].to_numpy(float)
        ls, rs = lp["_sigma"].to_numpy(float), rp["_sigma"].to_numpy(float)
        same = lp["_lab"].to_numpy()[:, None] == rp["_lab"].to_numpy()[None, :]
        best = np.zeros(len(lx))
        for s, d in distance_chunks(lx, rx):
            num = ls[s:s + len(d), None] + rs[None, :]
            with np.errstate(divide="ignore", invalid="ignore"):
                r = np.where((d == 0) | same[s:s + len(d)], 0.0, num / d)
            best[s:s + len(d)] = r.max(axis=1)
        return pd.DataFrame({"_lab": lp["_lab"].to_numpy(), "_r": best})

    per = (cogroup_blocks(spread.withColumn("_key", F.col("_lab").cast("string")), "_key",
                          blocks_for(k, block_rows), kernel, "_lab long, _r double")
           .groupBy("_lab").agg(F.max("_r").alias("_r")))
    return per.agg(F.avg("_r").alias("davies_bouldin_index"))


def cluster_metrics(points: DataFrame, id_col: str = "CustomerID", label: str = "Cluster",
                    features=FEATURES, method: str = "exact") -> DataFrame:
    """One-row record: silhouette (4 dp), Davies–Bouldin (4 dp), cluster count
    (noise excluded), noise count and a status text. With fewer than two
    clusters, or no more rows than clusters, the scores are null."""
    spark = points.sparkSession
    # read by the counts, the silhouette and Davies-Bouldin: the upstream
    # (lines -> features -> labels) runs once
    points = cut_lineage(points.select(id_col, label, *features))
    c = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(label) == NOISE).alias("noise"),
        F.count_distinct(F.when(F.col(label) != NOISE, F.col(label))).alias("k")).first()
    n, noise, k = int(c["n"]), int(c["noise"]), int(c["k"])
    if k < 2 or n <= k:
        return spark.createDataFrame([(None, None, k, noise, STATUS_FEW)], METRICS_SCHEMA)
    if n - noise <= k:
        msg = (f"Error computing metrics: Number of labels is {k}. "
               f"Valid values are 2 to n_samples - 1 (inclusive)")
        return spark.createDataFrame([(None, None, k, noise, msg)], METRICS_SCHEMA)
    sil = (silhouette_exact(points, id_col, label, features) if method == "exact"
           else silhouette_squared(points, label, features))
    dbi = davies_bouldin(points, label, features)
    return spark.range(1).select(
        F.round(sil.scalar(), 4).alias("silhouette_score"),
        F.round(dbi.scalar(), 4).alias("davies_bouldin_index"),
        F.lit(k).alias("n_clusters"), F.lit(noise).alias("noise_count"),
        F.lit(STATUS_OK).alias("status"))


def cluster_profiles(raw_rfm: DataFrame, labels: DataFrame, id_col: str = "CustomerID",
                     label: str = "Cluster") -> DataFrame:
    """Mean R (1 dp), F (1 dp), M (2 dp) and customer count per cluster,
    noise included as its own group. Labels join by customer id (both sides
    are hash-partitioned on it after the RFM aggregate)."""
    j = raw_rfm.join(labels.select(id_col, label), id_col)
    return (j.groupBy(label).agg(
        F.round(F.avg("Recency"), 1).alias("Recency_Mean"),
        F.round(F.avg("Frequency"), 1).alias("Frequency_Mean"),
        F.round(F.avg("Monetary"), 2).alias("Monetary_Mean"),
        F.count(F.lit(1)).alias("Customer_Count")))


def cluster_points(scaled: DataFrame, labels: DataFrame, id_col: str = "CustomerID",
                   label: str = "Cluster") -> DataFrame:
    """Scaled features with a display label (``Cluster l`` or ``Noise (-1)``)."""
    j = scaled.join(labels.select(id_col, label), id_col)
    return j.withColumn("ClusterLabel", F.when(F.col(label) == NOISE, F.lit("Noise (-1)"))
                        .otherwise(F.concat(F.lit("Cluster "), F.col(label).cast("string"))))
