"""Nearest neighbours by multi-index hashing: rotated binary codes, substring indexes, pigeonhole probing, rerank."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut_lineage, ship_package

#: Vectors the rotations and the radius are learned from: the first in the order of a hash of their id.
FIT_ROWS = 10_000
#: Rotations that are learned; each gives one bit per dimension.
ROTATIONS = 4
#: Bits of a substring; a code of b bits is indexed by b / 16 substrings.
SUBSTRING = 16
#: Share of the true neighbours in the sample that the radius has to reach.
REACH = 0.98
#: Vectors of an index block, and queries that meet it at once.
BLOCK_ROWS = 16_384
QUERY_ROWS = 1_024


@dataclass
class Codebook:
    """Learned rotations of centred vectors, and the Hamming radius to search."""

    center: np.ndarray
    rotations: np.ndarray  # [dims, bits]
    radius: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Substring values [rows][bits / 16]."""
        bits = (x - self.center) @ self.rotations > 0
        packed = np.packbits(bits, axis=1)
        return packed.view(">u2").astype(np.uint16)


def learn(sample: np.ndarray, k: int, rotations: int = ROTATIONS, reach: float = REACH, seed: int = 11,
          rounds: int = 15) -> Codebook:
    """Iterative quantisation: rotations that bring the centred vectors close to their signs.

    Each rotation starts from another random orthogonal matrix and alternates
    between signs and the best rotation onto them (an SVD). The radius is the
    Hamming distance below which ``reach`` of the sample's true ``k`` nearest
    neighbours lie, scaled by nothing: a larger table's neighbours are closer.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    center = sample.mean(0)
    x = sample - center
    turned = []
    for _ in range(rotations):
        r = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ v
        turned.append(r)
    rot = np.concatenate(turned, axis=1)
    pad = -rot.shape[1] % SUBSTRING
    if pad:
        rot = np.concatenate([rot, np.zeros((dims, pad))], axis=1)
    book = Codebook(center, rot, rot.shape[1])
    probe = x[:: max(1, len(x) // 400)][:400]
    codes = np.unpackbits(book.encode(sample).astype(">u2").view(np.uint8), axis=1).astype(np.float32)
    own = np.unpackbits(book.encode(probe + center).astype(">u2").view(np.uint8), axis=1).astype(np.float32)
    far = ((probe ** 2).sum(1)[:, None] - 2 * probe @ x.T + (x ** 2).sum(1)[None])
    near = np.argsort(far, 1, kind="stable")[:, 1:k + 1]
    ham = own.sum(1)[:, None] + codes.sum(1)[None] - 2 * own @ codes.T
    if near.size:
        book.radius = int(np.quantile(np.take_along_axis(ham, near, 1), reach, method="higher"))
    return book


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(SUBSTRING), r)],
                    dtype=np.uint16)


_POPCOUNT = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


class SubstringIndex:
    """Inverted lists of one block's codes, one index per substring."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, s], np.arange((1 << SUBSTRING) + 1)) for s, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row within ``radius`` of ``code``.

        With m substrings, a row that close differs by at most radius // m in
        one of the first (radius % m) + 1 substrings, or by one less in
        another, so those values are probed and nothing else is missed.
        """
        m = len(code)
        each, rest = divmod(radius, m)
        hit = np.zeros(len(self.codes), dtype=bool)
        for s in range(m):
            r = min(SUBSTRING, each if s <= rest else each - 1)
            if r < 0:
                continue
            values = code[s] ^ _masks_of(r)
            lo, hi = self.starts[s][values], self.starts[s][values.astype(np.int64) + 1]
            some = hi > lo
            lo, n = lo[some], (hi - lo)[some]
            if len(n):
                at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                hit[self.order[s][at]] = True
        rows = np.flatnonzero(hit)
        return rows[_POPCOUNT[self.codes[rows] ^ code].sum(1) <= radius]


_MASKS: dict[int, np.ndarray] = {}


def _masks_of(radius: int) -> np.ndarray:
    if radius not in _MASKS:
        _MASKS[radius] = _masks(radius)
    return _MASKS[radius]


def _usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x): vectors without nulls or non-finite components that aren't zero."""
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x"))
            .where(F.col("id").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0)))


def nearest(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            fit_rows: int = FIT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest of every query row by Euclidean distance.

    ``queries`` is a condition on (id); a query's own row is no candidate. The
    rows are dealt to blocks by a hash of their id (their number follows the
    row count), each block indexes its codes by substring, and the stated
    query set visits every block in batches. A visit returns at most ``k``
    rows per query, so the final ranking sorts blocks times ``k`` rows.
    Where a block has fewer than ``k`` codes within the radius for a query,
    the radius is widened for that query until it has them or the block ends.

    Defined cases: vectors that are null, zero, or hold null or non-finite
    components take no part, nor do vectors of another length than the most
    common one; ties go to the smaller id; repeated rows are candidates each, but
    ask once;
    an empty table gives an empty result; extra columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = _usable(vectors, id_col, vec_col)
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == common["d"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).toPandas()  # fit_rows vectors
    book = learn(np.stack(sample["x"].to_list()), k)
    held = spark.sparkContext.broadcast(book)
    count = rows.count()
    blocks = max(1, -(-count // block_rows))
    asked = rows.where(queries(F.col("id"))).dropDuplicates(["id", "x"])  # repeated rows ask once
    batches = max(1, -(-asked.count() // QUERY_ROWS))
    # a group is one block and one batch of queries: both sides are of bounded size
    data = (rows.withColumn("b", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))))
    visit = (asked.withColumn("q", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(batches)).cast("int"))
             .withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))

    def search(base: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})
        if not len(base) or not len(ask):
            return empty
        base = base.sort_values("id", kind="stable")
        ids, x = base["id"].to_numpy(), np.stack(base["x"].to_list())
        codes = held.value.encode(x)
        index = SubstringIndex(codes)
        q_ids, q = ask["id"].to_numpy(), np.stack(ask["x"].to_list())
        q_codes = held.value.encode(q)
        bits = SUBSTRING * codes.shape[1]
        out = []
        for i, qid in enumerate(q_ids.tolist()):
            radius = held.value.radius
            while True:
                near = index.within(q_codes[i], radius)
                near = near[ids[near] != qid]
                if len(near) >= k or radius >= bits:
                    break
                radius = min(bits, radius + codes.shape[1])
            d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
            best = np.lexsort((ids[near], d))[:k]
            out.append(pd.DataFrame({"query_id": qid, "vec_id": ids[near][best], "score": d[best]}))
        return pd.concat(out, ignore_index=True).astype(empty.dtypes.to_dict())

    found = (data.groupBy("b", "q").cogroup(visit.groupBy("b", "q"))
             .applyInPandas(search, "query_id long, vec_id long, score double"))
    from pyspark.sql import Window
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (cut_lineage(found).withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
