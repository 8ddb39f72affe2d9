"""K-Means segmentation, elbow curve and nearest-centroid assignment.

All restarts of all cluster counts run in one distributed Lloyd loop: a pass
over the points assigns every point to the centres of every model that is
still moving and returns one partial sum per (model, cluster) and batch. The
driver holds centres only (restarts x counts x k rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.rfm import FEATURES
from tillroll.session import cut_lineage

#: A model stops when the squared shift of all its centres falls to this share of the mean feature variance.
REL_TOL = 1e-4
#: Restarts, of which the cheapest wins, for the segmentation and for every point of the elbow.
N_INIT = 10
MAX_ITER = 300


@dataclass
class KMeansResult:
    labels: DataFrame      # (id, Cluster)
    centroids: DataFrame   # (Cluster, name, features...)
    cost: float            # within-cluster sum of squares


def _usable(points: DataFrame, id_col: str, features) -> DataFrame:
    """Points with every feature present; a customer without one can't be placed and is left out."""
    keep = F.lit(True)
    for c in features:
        keep = keep & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return points.select(id_col, *[F.col(c).cast("double").alias(c) for c in features]).where(keep)


def _draw(id_col: str, seed: int, restart, step: int):
    """A uniform number in (0, 1) drawn from the point's id, the restart and the step."""
    text = F.concat_ws(":", F.lit(str(seed)), restart.cast("string"), F.lit(str(step)), F.col(id_col).cast("string"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def starting_centres(points: DataFrame, k: int, n_init: int, seed: int, id_col: str, features) -> np.ndarray:
    """[restart][k][feature]: starts drawn in proportion to the squared distance to the centres before.

    Each point runs an exponential race: -ln(u) / d2 is smallest for a point
    with probability d2 / sum(d2), so one ``min_by`` per restart draws the next
    centre in a single aggregation, whatever the partitioning. A smaller k
    starts from the first centres of the same sequence.
    """
    centres: list[list[list[float]]] = [[] for _ in range(n_init)]
    for step in range(k):
        rows = points.select(id_col, *features, F.explode(F.sequence(F.lit(0), F.lit(n_init - 1))).alias("_r"))
        race = -F.log(_draw(id_col, seed, F.col("_r"), step))
        if step:
            table = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in own]) for own in centres])
            own = F.transform(table[F.col("_r")], lambda c: sum(
                ((F.col(f) - c[i]) * (F.col(f) - c[i]) for i, f in enumerate(features)), F.lit(0.0)))
            d2 = F.array_min(own)
            # points that coincide with a centre run last
            race = F.when(d2 > 0, race / d2).otherwise(F.lit(float("inf")))
        best = (rows.select("_r", F.struct(race.alias("race"), F.col(id_col).cast("string").alias("id"),
                                           *features).alias("s"))
                .groupBy("_r").agg(F.min("s").alias("s")).collect())
        for row in best:
            centres[row["_r"]].append([float(row["s"][f]) for f in features])
    return np.array(centres)


def _assign(points: DataFrame, models: list[np.ndarray], features) -> list[list]:
    """[model][cluster] -> (n, sums, cost) of one pass over the points."""

    stacked = np.concatenate(models)
    norms = (stacked ** 2).sum(1)
    edges = np.concatenate([[0], np.cumsum([len(c) for c in models])])

    def partial(batches):
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(features))])
            score = norms - 2.0 * (x @ stacked.T)  # squared distance to every centre, but for the point's own norm
            out = [[], [], [], []]
            for m, c in enumerate(models):
                k = len(c)
                near = score[:, edges[m]:edges[m + 1]].argmin(1)
                n = np.bincount(near, minlength=k)
                sums = [np.bincount(near, weights=w, minlength=k) for w in (*x.T, ((x - c[near]) ** 2).sum(1))]
                for j in np.flatnonzero(n).tolist():
                    for col, v in zip(out, (m, j, int(n[j]), [float(w[j]) for w in sums]), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.list_(pa.float64()))], names=["m", "j", "n", "s"])

    sums = points.select(*features).mapInArrow(partial, "m int, j int, n long, s array<double>")
    rows = (sums.groupBy("m", "j").agg(F.sum("n").alias("n"),
                                       *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(features) + 1)]).collect())
    found: list[list] = [[None] * len(c) for c in models]
    for r in rows:
        found[r["m"]][r["j"]] = (r["n"], np.array([r[f"s{i}"] for i in range(len(features))]), r[f"s{len(features)}"])
    return found


def fit_all(points: DataFrame, ks: list[int], n_init: int, seed: int, max_iter: int, id_col: str,
            features) -> dict[int, tuple[np.ndarray, float]]:
    """Best (centres, cost) for each k in ``ks`` out of ``n_init`` restarts, all fitted together.

    Lloyd's iteration with the usual rule: centres move to their clusters'
    means (an empty cluster's centre stays) until the summed squared shift is
    at most REL_TOL times the mean feature variance. Equal costs: the earlier
    restart.
    """
    spread = points.agg(*[F.var_pop(c) for c in features]).first()
    limit = REL_TOL * float(np.mean([v or 0.0 for v in spread]))
    starts = starting_centres(points, max(ks), n_init, seed, id_col, features)
    keys = [(k, r) for k in ks for r in range(n_init)]
    centres = {key: starts[key[1], :key[0]].copy() for key in keys}
    moving = list(keys)
    for _ in range(max_iter):
        if not moving:
            break
        found = _assign(points, [centres[key] for key in moving], features)
        still = []
        for key, clusters in zip(moving, found, strict=True):
            old = centres[key]
            new = np.array([c[1] / c[0] if c else o for c, o in zip(clusters, old, strict=True)])
            centres[key] = new
            if ((new - old) ** 2).sum() > limit:
                still.append(key)
        moving = still
    final = _assign(points, [centres[key] for key in keys], features)
    out: dict[int, tuple[np.ndarray, float]] = {}
    for key, clusters in zip(keys, final, strict=True):
        cost = float(sum(c[2] for c in clusters if c))
        if key[0] not in out or round(cost, 6) < round(out[key[0]][1], 6):
            out[key[0]] = (centres[key], cost)
    return out


def kmeans(points: DataFrame, k: int = 3, seed: int = 42, n_init: int = N_INIT, max_iter: int = MAX_ITER,
           id_col: str = "CustomerID", features=FEATURES) -> KMeansResult:
    """Best of ``n_init`` restarts by cost (Euclidean).

    Clusters are renumbered by centroid order (lexicographic on the features)
    so labels do not depend on the fit. Points with a missing feature are left
    out; fewer usable points than clusters raise ``ValueError``.
    """
    points = cut_lineage(_usable(points, id_col, features))
    n = points.count()
    if n < k or n == 0:
        raise ValueError(f"{k} clusters need at least {max(k, 1)} points, got {n}")
    centres, cost = fit_all(points, [k], n_init, seed, max_iter, id_col, features)[k]
    centres = sorted(tuple(float(x) for x in c) for c in centres)
    spark = points.sparkSession
    cent = spark.createDataFrame([(i, f"Cluster {i}", *c) for i, c in enumerate(centres)],
                                 ["Cluster", "name", *features]).orderBy("Cluster")
    labels = assign_nearest(points, cent, id_col, features=features).select(id_col, "Cluster")
    return KMeansResult(labels, cent, cost)


def elbow_curve(points: DataFrame, max_k: int = 10, seed: int = 42, n_init: int = N_INIT, max_iter: int = MAX_ITER,
                id_col: str = "CustomerID", features=FEATURES) -> DataFrame:
    """(k, wcss) for k = 1..min(max_k, n): the cost of the best of ``n_init`` restarts for every k."""
    points = cut_lineage(_usable(points, id_col, features))
    n = points.count()
    if n == 0:
        raise ValueError("the elbow curve needs at least one point")
    best = fit_all(points, list(range(1, min(max_k, n) + 1)), n_init, seed, max_iter, id_col, features)
    return points.sparkSession.createDataFrame([(k, c[1]) for k, c in sorted(best.items())], "k int, wcss double")


def assign_nearest(points: DataFrame, centroids: DataFrame, id_col: str = "CustomerID",
                   label: str = "Cluster", features=FEATURES) -> DataFrame:
    """Label every point with its nearest centroid (ties: lower label).

    The k centroids travel as one array value (a scalar subquery) and the
    arg-min runs in array functions inside the projection: no join at all.
    """
    cents = centroids.agg(F.collect_list(F.struct(
        F.col(label).cast("int").alias("k"),
        *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]))).scalar()

    def d2(c):
        return sum(((F.col(f) - c[f"c{i}"]) * (F.col(f) - c[f"c{i}"])
                    for i, f in enumerate(features)), F.lit(0.0))

    # the subquery value is projected first: lambdas may not contain subqueries
    staged = points.select(id_col, *features, cents.alias("_cents"))
    scored = F.transform("_cents", lambda c: F.struct(d2(c).alias("d"), c["k"].alias("k")))
    best = F.array_min(scored)   # struct order: distance first, then label
    return staged.select(id_col, best["k"].alias(label), F.sqrt(best["d"]).alias("distance"))
