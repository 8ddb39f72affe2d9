"""DBSCAN over a DataFrame of points, exact and independent of partitioning.

Core point: at least ``min_samples`` points (itself included) within ``eps``.
Clusters are the connected components of core points (two cores within eps
are linked), numbered in the order of their smallest point id (the order a
sequential scan over id-sorted rows discovers them); a non-core point within
eps of a core takes the smallest such cluster label; everything else is -1.

Plan: points go to a grid of side eps/sqrt(d), so two points of one cell are
always within eps. From there on the work is done between *cells*: those that
may hold points within eps of each other meet in an equi-join of grid
coordinates, and the bounding boxes of their points decide most pairs (all
within eps, or none). Core cells are then joined by a few points of each, at
most one of every part of a cell, which join all but sparse or truly separate
cells. Distances are computed only for what is left: of points in sparse cells
whose surely near points don't make them core yet, of core cells that are in
different clusters so far, and of border points that a smaller label may still
reach; and only to points within eps of the other cell's bounding box. These
travel as lists of bounded length. Core cells of different clusters are cut
into ever smaller parts first, so that only small parts meet point by point. Components are labelled
on the core-cell graph by minimum-label propagation with pointer jumping,
checkpointed each round.
"""

from __future__ import annotations

import functools
import itertools
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.ranking import dense_index
from tillroll.operators.pairwise import counts_within, grid_cells, halo_cogroup, packed_points, pairs_within
from tillroll.operators.rfm import FEATURES
from tillroll.session import cut_lineage, release


#: Points that a line holds on average, at least, to be a strip of its own; points that a task holds of each side.
LINE_POINTS, TASK_POINTS = 32, 1 << 19
#: Pairs of points that two parts of cells hold at most to meet all.
PART_PAIRS = 4096


def _prep(points: DataFrame, id_col: str, features, eps: float) -> tuple[DataFrame, int]:
    dim = len(features)
    side = eps / math.sqrt(dim) * (1 - 1e-9)
    pts = points.select(F.col(id_col).cast("string").alias("_id"),
                        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
    # read by every grid step below: materialise the n prepared points once
    return cut_lineage(grid_cells(pts, [f"_x{i}" for i in range(dim)], side)), dim


def neighbour_counts(points: DataFrame, eps: float = 0.5, id_col: str = "CustomerID",
                     features=FEATURES) -> DataFrame:
    """Exact number of points within ``eps`` of each point (itself included): ``(id, n_neighbors)``.

    Points are counted along strips (see ``counts_within``). Where points share
    all coordinates but one (whole days and numbers of orders do), a strip is
    such a line: the work then grows with the points times the lines around
    them. Otherwise strips are cells whose side shrinks with the cube root of
    the number of points, which balances strips against the points at their rims.
    """
    g, dim = _prep(points, id_col, features, eps)
    sizes = g.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(f"_x{i}").alias(f"d{i}") for i in range(dim)]).first()
    along = max(range(dim), key=lambda i: sizes[f"d{i}"])
    xs = [f"_x{i}" for i in range(dim) if i != along] + [f"_x{along}"]
    lines = g.groupBy(*xs[:-1]).agg(F.count(F.lit(1)).alias("_k")) if dim > 1 else g.agg(F.count(F.lit(1)).alias("_k"))
    exact = dim == 1 or lines.count() * LINE_POINTS <= sizes["n"]
    side = None if exact else eps / max(2, round(0.3 * sizes["n"] ** (1 / 3)))
    strip = [F.col(x) if exact else F.floor(F.col(x) / side) for x in xs[:-1]]

    def kernel(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({"_id": [], "_n": []})
        return pd.DataFrame({"_id": lp["_id"].to_numpy(),
                             "_n": counts_within(lp[xs].to_numpy(float), rp[xs].to_numpy(float), eps, side)})

    # a strip's points stay together, but for one that fills a task: that one is dealt by its points
    keyed = g.select("_id", *xs, F.xxhash64(*strip, F.lit(0)).alias("_strip"))
    full = keyed.groupBy("_strip").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") > TASK_POINTS // 4)
    keyed = keyed.join(full, "_strip", "left").select("_id", *xs, F.when(F.col("_k").isNull(), F.col("_strip")).otherwise(
        F.xxhash64("_id", *xs)).alias("_strip"))
    keyed = cut_lineage(keyed)
    parts = halo_cogroup(keyed, keyed.drop("_id"), xs, eps, kernel, "_id string, _n long", 2 * eps,
                         TASK_POINTS // 2, TASK_POINTS, F.col("_strip"))
    return parts.groupBy("_id").agg(F.sum("_n").alias("n_neighbors")).withColumnRenamed("_id", id_col)


def _boxes(points: DataFrame, dim: int) -> DataFrame:
    """(cell, n, _g*, _lo*, _hi*) of every occupied cell: smallest id, size and bounding box of its points."""
    lows = [F.min(f"_x{i}").alias(f"_lo{i}") for i in range(dim)]
    highs = [F.max(f"_x{i}").alias(f"_hi{i}") for i in range(dim)]
    return points.groupBy(*[f"_g{i}" for i in range(dim)]).agg(
        F.min("_id").alias("cell"), F.count(F.lit(1)).alias("n"), *lows, *highs)


def _box_pairs(left: DataFrame, right: DataFrame, dim: int, e2: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, n, sure, extra...): cells u of ``left`` and v of ``right`` that may hold points within eps of each other.

    ``n`` and the extra columns are those of v; ``sure`` if all their points are that near.
    A merge join by hint: Spark's estimate doesn't know the exploded offsets, and would broadcast them.
    """
    reach = range(-math.ceil(math.sqrt(dim)), math.ceil(math.sqrt(dim)) + 1)
    offsets = F.array(*[F.array(*[F.lit(o) for o in off]) for off in itertools.product(reach, repeat=dim)])
    g = [f"_g{i}" for i in range(dim)]
    box = [f"_{s}{i}" for s in ("lo", "hi") for i in range(dim)]
    a = (left.select(F.col("cell").alias("u"), *g, *[F.col(c).alias(f"a{c}") for c in box], F.explode(offsets).alias("off"))
         .withColumns({c: F.col(c) + F.col("off")[i] for i, c in enumerate(g)}).drop("off"))
    b = right.select(F.col("cell").alias("v"), "n", *g, *[F.col(c).alias(f"b{c}") for c in box], *extra)
    apart = [F.greatest(F.lit(0.0), F.col(f"b_lo{i}") - F.col(f"a_hi{i}"), F.col(f"a_lo{i}") - F.col(f"b_hi{i}"))
             for i in range(dim)]
    span = [F.greatest(F.col(f"b_hi{i}") - F.col(f"a_lo{i}"), F.col(f"a_hi{i}") - F.col(f"b_lo{i}")) for i in range(dim)]
    near = sum((x * x for x in apart), F.lit(0.0)) <= e2 * (1 + 1e-12)
    return a.hint("merge").join(b, g).where(near).select("u", "v", "n", (sum((x * x for x in span), F.lit(0.0)) <= e2).alias("sure"),
                                           *extra)


def _rims(pairs: DataFrame, boxes: DataFrame, points: DataFrame, dim: int, e2: float) -> DataFrame:
    """(uv, _id, _x*): for each pair (u, v) the points of cell v within eps of the bounding box of cell u."""
    xs = [f"_x{i}" for i in range(dim)]
    box = boxes.select(F.col("cell").alias("u"), *[f"_{s}{i}" for s in ("lo", "hi") for i in range(dim)])
    apart = [F.greatest(F.lit(0.0), F.col(f"_lo{i}") - F.col(x), F.col(x) - F.col(f"_hi{i}")) for i, x in enumerate(xs)]
    return (pairs.select("u", "v").join(box, "u").join(points.select(F.col("cell").alias("v"), "_id", *xs), "v")
            .where(sum((x * x for x in apart), F.lit(0.0)) <= e2 * (1 + 1e-12))
            .select(F.struct("u", "v").alias("uv"), "_id", *xs))


def _rim_lists(pairs: DataFrame, boxes: DataFrame, points: DataFrame, dim: int, e2: float) -> DataFrame:
    """(u, v, xb): the points of ``_rims`` as lists."""
    packed = packed_points(_rims(pairs, boxes, points, dim, e2), "uv", [f"_x{i}" for i in range(dim)])
    return packed.select("uv.u", "uv.v", F.col("x").alias("xb"))


def _witnesses(points: DataFrame, key: str, dim: int, side: float) -> DataFrame:
    """(key, x): one point of each grid cell of that side, as one list a key."""
    xs = [f"_x{i}" for i in range(dim)]
    one = points.groupBy(key, *[F.floor(F.col(x) / side).alias(f"_f{i}") for i, x in enumerate(xs)]).agg(
        F.min(F.array(*xs)).alias("p"))
    return one.groupBy(key).agg(F.flatten(F.collect_list("p")).alias("x"))


def _core_flags(g: DataFrame, dim: int, eps: float, min_samples: int) -> DataFrame:
    """(_id, _g*, _x*, _core), written once; only points of sparse cells near undecided ones meet others."""
    gc, xs, e2 = [f"_g{i}" for i in range(dim)], [f"_x{i}" for i in range(dim)], eps * eps
    cells = cut_lineage(_boxes(g, dim))
    placed = g.join(cells.select(*gc, "cell", "n"), gc)
    near = cut_lineage(_box_pairs(cells.where(F.col("n") < min_samples), cells, dim, e2))
    sure = near.where("sure").groupBy("u").agg(F.sum("n").alias("sure_n"))  # its own cell among them
    few = sure.where(F.col("sure_n") < min_samples)
    undecided = cut_lineage(near.where("not sure").join(few, "u").select("u", "v"))
    lone = placed.where(F.col("n") < min_samples).select(F.col("cell").alias("u"), F.col("_id"), F.array(*xs).alias("xa"))
    rows = _rim_lists(undecided, cells, placed, dim, e2).join(lone, "u").select(F.col("_id").alias("u"), "v", "xa", "xb")
    counts = pairs_within(rows, dim, e2).groupBy(F.col("u").alias("_id")).agg(F.sum("n").alias("more"))
    out = placed.join(sure.select(F.col("u").alias("cell"), "sure_n"), "cell", "left").join(counts, "_id", "left")
    total = F.coalesce("sure_n", "n") + F.coalesce("more", F.lit(0))
    return cut_lineage(out.select("_id", *gc, *xs, (total >= min_samples).alias("_core")))


def _linked(pairs: DataFrame, one: DataFrame, two: DataFrame, dim: int, e2: float) -> DataFrame:
    """(u, v) of the pairs with a point of the list of u in ``one`` within eps of one of the list of v in ``two``."""
    rows = (pairs.join(one.withColumnRenamed("x", "xa").hint("merge"), "u")
            .join(two.withColumnRenamed("x", "xb").hint("merge"), "v").select("u", "v", "xa", "xb"))
    return pairs_within(rows, dim, e2).where("n > 0").select("u", "v").distinct()


def _met(pairs: DataFrame, rims: list[DataFrame], dim: int, eps: float, side: float) -> DataFrame:
    """(u, v): the clusters cu, cv of pairs (uv, cu, cv) that have a point in each of the ``rims`` of uv within eps.

    The rims are cut into parts of that side. Bounding boxes leave the pairs of
    parts that may hold near points, and one point of each part joins most of
    their clusters. Pairs of clusters not joined go on with parts of half the
    side, until their points are few enough to meet all: distances grow with
    the points, not with their pairs.
    """
    xs, e2, none = [f"_x{i}" for i in range(dim)], eps * eps, F.array().cast("array<long>")
    apart = [F.greatest(F.lit(0.0), F.col(f"blo{i}") - F.col(f"ahi{i}"), F.col(f"alo{i}") - F.col(f"bhi{i}")) for i in range(dim)]
    near = sum((x * x for x in apart), F.lit(0.0)) <= e2 * (1 + 1e-12)
    points = [r.dropDuplicates(["uv", *xs]).withColumn("part", none) for r in rims]
    still, found = pairs.withColumns({"a": none, "b": none}), []

    def joined(rows):
        hits = pairs_within(rows.select(F.col("cu").alias("u"), F.col("cv").alias("v"), "xa", "xb"), dim, e2)
        found.append(cut_lineage(hits.where("n > 0").select(F.col("u").alias("cu"), F.col("v").alias("cv")).distinct()))
        return found[-1]

    while True:
        last = side < eps * 1e-9  # parts of points that differ by rounding only
        points = [cut_lineage(p.select("uv", F.col("part").alias("of"), F.array(*[F.floor(F.col(x) / side) for x in xs]).alias("part"),
                                       "_id", *xs)) for p in points]
        for p, c in zip(points, "ab", strict=True):
            parts = p.groupBy("uv", F.col("of").alias(c), F.col("part").alias(f"{c}part")).agg(
                F.count(F.lit(1)).alias(f"n{c}"), F.min(F.array(*xs)).alias(f"x{c}"),
                *[f(x).alias(f"{c}{name}{i}") for i, x in enumerate(xs) for f, name in ((F.min, "lo"), (F.max, "hi"))])
            still = still.hint("merge").join(parts, ["uv", c])
        still = cut_lineage(still.where(near).select("uv", "cu", "cv", F.col("apart").alias("a"), F.col("bpart").alias("b"),
                                                     (F.col("na") * F.col("nb")).alias("n"), "xa", "xb"))
        still = cut_lineage(still.join(joined(still), ["cu", "cv"], "left_anti").drop("xa", "xb"))
        rows = few = still if last else still.where(F.col("n") <= PART_PAIRS)
        for p, c in zip(points, "ab", strict=True):
            own = p.join(few.select("uv", F.col(c).alias("part")), ["uv", "part"], "left_semi")
            lists = packed_points(own.select(F.struct("uv", "part").alias("key"), "_id", *xs), "key", xs)
            rows = rows.hint("merge").join(lists.select("key.uv", F.col("key.part").alias(c), F.col("x").alias(f"x{c}")), ["uv", c])
        more = joined(rows)
        still = cut_lineage(still.where(F.col("n") > PART_PAIRS).join(more, ["cu", "cv"], "left_anti").drop("n"))
        if last or still.isEmpty():
            return functools.reduce(DataFrame.unionByName, found).select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        points = [p.join(still.select("uv", F.col(c).alias("part")), ["uv", "part"], "left_semi")
                  for p, c in zip(points, "ab", strict=True)]
        side /= 2


def connected_min_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node id of each node's connected component: ``(node, comp)``.

    ``nodes(node)``, ``edges(u, v)`` undirected. Each round takes the minimum
    label over the neighbourhood, then jumps once (label := label of label);
    labels only decrease and are node ids of the same component, so the fixed
    point is the component minimum, and every round before it lowers a label.
    One written table and one count per round; the round before is deleted.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = cut_lineage(both.distinct())
    lab = cut_lineage(nodes.select("node", F.col("node").alias("comp")))
    while True:
        nb = (both.join(lab.withColumnRenamed("node", "v").withColumnRenamed("comp", "c"), "v")
                  .groupBy(F.col("u").alias("node")).agg(F.min("c").alias("c")))
        step = (lab.join(nb, "node", "left")
                   .select("node", F.least("comp", F.coalesce("c", "comp")).alias("comp")))
        jump = (step.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("c2")),
                          "comp", "left")
                    .select("node", F.least("comp", F.coalesce("c2", "comp")).alias("comp")))
        new = cut_lineage(jump)
        changed = (new.join(lab.withColumnRenamed("comp", "old"), "node")
                      .filter(F.col("comp") != F.col("old")).limit(1).count())
        release(lab)
        lab = new
        if changed == 0:
            release(both)
            return lab


def dbscan(points: DataFrame, eps: float = 0.5, min_samples: int = 5,
           id_col: str = "CustomerID", features=FEATURES) -> DataFrame:
    """``(id, Cluster)`` for every point; -1 marks noise. An empty input raises ``ValueError``."""
    if points.isEmpty():
        raise ValueError("no points to cluster")
    g, dim = _prep(points, id_col, features, eps)
    gc = [f"_g{i}" for i in range(dim)]
    xs = [f"_x{i}" for i in range(dim)]
    e2 = eps * eps
    flagged = _core_flags(g, dim, eps, min_samples)
    cores = flagged.filter("_core")

    # core cells by their smallest core id; sure links and a few points of each cell join most of them
    cells = cut_lineage(_boxes(cores, dim))
    placed = cut_lineage(cores.join(cells.select(*gc, "cell"), gc))
    links = cut_lineage(_box_pairs(cells, cells, dim, e2).where("u < v").select("u", "v", "sure"))
    side = eps / math.sqrt(dim)
    few = cut_lineage(_witnesses(placed, "cell", dim, side / 3))
    seen = cut_lineage(_linked(links.where("not sure"), few.withColumnRenamed("cell", "u"),
                               few.withColumnRenamed("cell", "v"), dim, e2).unionByName(links.where("sure").select("u", "v")))
    comps = connected_min_labels(cells.select(F.col("cell").alias("node")), seen)
    sides = [comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")) for c in "uv"]
    left = cut_lineage(links.where("not sure").join(sides[0], "u").join(sides[1], "v").where("cu != cv")
                       .select("u", "v", "cu", "cv"))
    if not left.isEmpty():
        # of cells of different clusters, what lies within eps of the other's box
        back = left.select(F.col("u").alias("v"), F.col("v").alias("u"))
        swap = F.struct(F.col("uv.v").alias("u"), F.col("uv.u").alias("v")).alias("uv")
        rims = [_rims(back, cells, placed, dim, e2).select(swap, "_id", *xs), _rims(left, cells, placed, dim, e2)]
        named_pairs = left.select(F.struct("u", "v").alias("uv"), F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv"))
        more = cut_lineage(_met(named_pairs, rims, dim, eps, side / 3))
        joined = connected_min_labels(comps.select(F.col("comp").alias("node")).distinct(), more)
        comps = comps.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp").select(
            "node", F.col("root").alias("comp"))
    numbered = dense_index(comps, ["comp"], "_label")
    label = cut_lineage(comps.join(numbered, "comp").select(F.col("node").alias("cell"), "_label"))

    # border points: the smallest label of a core point within eps; sure ones first, then what may be smaller
    rest = flagged.filter(~F.col("_core"))
    edge = cut_lineage(_boxes(rest, dim))
    named = rest.join(edge.select(*gc, F.col("cell").alias("u")), gc).select("_id", "u", F.array(*xs).alias("xa"))
    near = cut_lineage(_box_pairs(edge, cells.join(label, "cell"), dim, e2, ("_label",)))
    best = near.where("sure").groupBy("u").agg(F.min("_label").alias("best"))
    may = near.where("not sure").join(best, "u", "left").where(F.col("best").isNull() | (F.col("_label") < F.col("best")))
    may = cut_lineage(may.select("u", "v", "_label"))
    rows = (_rim_lists(may, edge, placed, dim, e2).join(may, ["u", "v"]).join(named, "u")
            .select(F.col("_id").alias("u"), F.col("_label").cast("string").alias("v"), "xa", "xb"))
    found = pairs_within(rows, dim, e2).where("n > 0").select(F.col("u").alias("_id"), F.col("v").cast("long").alias("_label"))
    given = named.join(best, "u").select("_id", F.col("best").alias("_label"))
    border = found.unionByName(given).groupBy("_id").agg(F.min("_label").alias("_label"))
    labels = placed.join(label, "cell").select("_id", "_label").unionByName(border)
    return (flagged.select("_id").join(labels, "_id", "left")
                   .select(F.col("_id").alias(id_col),
                           F.coalesce(F.col("_label"), F.lit(-1)).cast("int").alias("Cluster")))
