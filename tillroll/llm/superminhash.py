"""Near-duplicate groups: SuperMinHash signatures, banding, exact verification, union-find."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut_lineage, id_text, text_slices
from tillroll.llm.components import components
from tillroll.llm.shingles import mix, shingle_sets

SHINGLE_WORDS = 5
SIMILARITY_PCT = 75
#: 32 bands of 4 ranks: a pair at similarity 0.75 shares no band with probability (1 - 0.75^4)^32 = 5e-6.
BANDS, ROWS = 32, 4
#: Elements whose permutations are held at once (one byte per rank each).
_ELEMENTS = 40_000
#: Text that is hashed at once.
_SLICE = 1 << 20
#: Documents of a block when the documents of a cluster are compared; a task holds two blocks' shingle sets.
BLOCK_DOCS = 256
#: Shingles that two blocks are compared on at once.
_COLUMNS = 8192
_U = np.uint64


def signatures(sets: list[np.ndarray], length: int) -> np.ndarray:
    """SuperMinHash signatures, one row per set (infinite for an empty set).

    In step j every element draws a rank j + r and a place among those that
    its own random permutation has not used yet; a place keeps its smallest
    rank. So an element's ranks are correlated: each place gets one, in
    different steps. A set is ready once no place holds a rank above its
    number of steps, which larger sets reach after one or two steps.
    """
    out = np.full((len(sets), length), np.inf)
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    begin = 0
    while begin < len(sets):
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + sizes[end] <= _ELEMENTS):
            total += int(sizes[end])
            end += 1
        if total:
            _sign(np.concatenate(sets[begin:end]), np.repeat(np.arange(end - begin), sizes[begin:end]),
                  out[begin:end])
        begin = end
    return out


def _sign(elements: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    length = out.shape[1]
    flat = out.reshape(-1)
    perm = None
    for j in range(length):
        drawn = mix(elements + _U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rank = j + (drawn >> _U(11)).astype(np.float64) * 2.0 ** -53
        place = j + ((drawn & _U(0x7FF)) * _U(length - j) >> _U(11)).astype(np.int64)
        if j:
            rows = np.arange(len(elements))
            slot = perm[rows, place].astype(np.int64)
            perm[rows, place] = perm[:, j]
        else:
            slot = place
        np.minimum.at(flat, owner * length + slot, rank)
        # ranks of later steps are at least j + 1: a set whose places are all below is ready
        open_set = out.max(1) > j + 1
        live = open_set[owner]
        if not live.any():
            return
        if j == 0:
            elements, owner, place = elements[live], owner[live], place[live]
            perm = np.empty((len(elements), length), np.uint8 if length <= 256 else np.uint16)
            perm[:] = np.arange(length)
            perm[np.arange(len(elements)), place] = 0
        elif not live.all():
            elements, owner, perm = elements[live], owner[live], perm[live]


def band_keys(ranks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band, with the band's number mixed in."""
    bits = ranks[:, :bands * rows].copy().view(np.uint64).reshape(len(ranks), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _U(0xA0761D6478BD642F), (len(ranks), bands))
    for r in range(rows):
        key = mix((key ^ bits[:, :, r]) * _U(0xE7037ED1A0B428DB))
    return key.view(np.int64)


def signature_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, digest, bands) per document; digest identifies the shingle set, null when empty."""

    def sign(batches):
        for batch in batches:
            for part in text_slices(batch, _SLICE):
                sets = shingle_sets(part.column(1), SHINGLE_WORDS)
                keys = band_keys(signatures(sets, bands * rows), bands, rows)
                some = np.array([len(s) > 0 for s in sets])
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), bands).cast(
                    pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()),
                     lists if some.all() else pa.array([k if o else None for k, o in zip(keys.tolist(), some)],
                                                       pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "bands"])

    return id_text(docs).mapInArrow(sign, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``ids``: the full distinct shingle sets, sorted."""

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, _SLICE):
                sets = shingle_sets(part.column(1), SHINGLE_WORDS)
                offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))],
                    names=["id", "shingles"])

    # one row per id, taken where the semi-join has put the rows of an id together anyway
    wanted = id_text(docs).join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return wanted.mapInArrow(cut, "id long, shingles array<long>")


def _links(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def confirm(batches):
        for batch in batches:
            u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            a, b = batch.column(2), batch.column(3)
            ao, bo = np.asarray(a.offsets), np.asarray(b.offsets)
            av, bv = np.asarray(a.values).view(np.uint64), np.asarray(b.values).view(np.uint64)
            keep = np.zeros(len(u), dtype=bool)
            for i in range(len(u)):
                x, y = av[ao[i]:ao[i + 1]], bv[bo[i]:bo[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                keep[i] = 100 * both >= pct * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    first = pairs.join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v")
    rows = first.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u")
    return rows.select("u", "v", "a", "b").mapInArrow(confirm, "u long, v long")


def _links_between(ids: np.ndarray, sets: list[np.ndarray], group: np.ndarray, side: np.ndarray,
                   pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) between documents of different components, all compared on full sets.

    Intersection sizes are products of 0/1 incidence matrices, taken over a
    bounded number of shingles at a time; shingles of one document alone are
    left out, as no intersection has them. ``side`` tells the two blocks apart
    (all equal: one block with itself).
    """
    left = np.flatnonzero(side == side.min())
    right = np.flatnonzero(side == side.max())
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    # the most frequent component needs no rows of its own when both blocks are the same
    if len(left) == len(ids):
        values, counts = np.unique(group, return_counts=True)
        left = np.flatnonzero(group != values[counts.argmax()])
    if not len(left) or not len(right):
        return ids[:0], ids[:0]
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(ids)), sizes)
    names, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    column = np.cumsum(times > 1)[at] - 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, _COLUMNS):
        lo, hi = np.searchsorted(column, (c, c + _COLUMNS))
        hot = np.zeros((len(ids), min(_COLUMNS, width - c)), np.float32)
        hot[owner[lo:hi], column[lo:hi] - c] = 1
        both += hot[left] @ hot[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    link = (100 * both.astype(np.float64) >= pct * union) & (group[left][:, None] != group[right][None, :])
    i, j = np.nonzero(link)
    return ids[left[i]], ids[right[j]]


def _cross_links(sets: DataFrame, open_rows: DataFrame, pct: int) -> DataFrame:
    """Links between components among the documents that share a bucket with another component.

    ``open_rows`` (bucket, id, n, group). A document can only be linked if
    enough of its shingles occur in another open document, so those with too
    many shingles of their own leave first. The rest are clustered by shared
    buckets; the documents of a cluster are dealt to blocks, and every pair of
    blocks is one task's work, which returns nothing but links.
    """
    held = cut_lineage(sets.join(open_rows.select("id"), "id", "left_semi"))
    alone = (held.select("id", F.explode("shingles").alias("s")).groupBy("s")
             .agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1")
             .groupBy("id").agg(F.count(F.lit(1)).alias("own")))
    linkable = held.join(alone, "id", "left").where(
        F.lit(100) * (F.size("shingles") - F.coalesce("own", F.lit(0))) >= F.lit(pct) * F.size("shingles")).select("id")
    rows = open_rows.join(linkable, "id", "left_semi")
    still = rows.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi"),
                                       F.min("id").alias("first")).where("lo <> hi").select("bucket", "first")
    rows = cut_lineage(rows.join(still, "bucket").select("id", "group", "first"))
    near = components(rows.select(F.col("id").alias("u"), F.col("first").alias("v")))
    placed = (rows.select("id", "group").distinct()
              .join(near.select(F.col("u").alias("id"), F.col("v").alias("cluster")), "id", "left")
              .select("id", "group", F.coalesce("cluster", "id").alias("cluster")))
    sizes = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_DOCS)).cast("int").alias("blocks"))
    dealt = (placed.join(sizes, "cluster")
             .withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cluster", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"),
                     "own", "id", "group"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        sets = [np.asarray(s, dtype=np.int64).view(np.uint64) for s in frame["shingles"]]
        u, v = _links_between(frame["id"].to_numpy(), sets, frame["group"].to_numpy(), frame["own"].to_numpy(), pct)
        return pd.DataFrame({"u": u, "v": v})

    return (dealt.join(held, "id").groupBy("cluster", "lo", "hi").applyInPandas(compare, "u long, v long"))


def near_duplicate_groups(docs: DataFrame, pct: int = SIMILARITY_PCT, bands: int = BANDS,
                          rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    1. Each text gives its shingle set's digest and SuperMinHash band keys;
       documents of one set are one class, named by its smallest doc_id.
    2. Classes that share a band key are candidates, but a bucket never lists
       all its pairs. First every member meets the bucket's centre, the member
       with the most candidates of its own: an original meets its copies, and
       links confirmed on full sets are united by union-find.
    3. Buckets that still hold several components go on: what is left of them
       is compared in blocks inside tasks (``_cross_links``), so every
       candidate pair across components is seen and only links come out.
    4. ``component_id`` is the smallest doc_id reachable.

    Hot keys: copies collapse by a partial aggregation; bucket joins and the
    final join on the digest are plain equi-joins that Spark splits on skew.
    Nothing but round counters reaches the driver.

    Defined cases: null or empty text, or text of white space, has no shingles
    and stays alone; a null doc_id takes no part and stays (component null);
    repeated rows share their doc_id's result; an empty table gives an empty
    result; extra columns are ignored.
    """
    table = cut_lineage(signature_table(docs, bands, rows))
    classes = cut_lineage(
        table.where("digest is not null and doc_id is not null")
        .groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"),
                               F.first("bands").alias("bands")))
    spread = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = cut_lineage(spread.join(shared, "bucket").select("bucket", "id", "n", "members"))
    degree = members.groupBy("id").agg(F.sum("members").alias("degree"))
    ranked = members.join(degree, "id")
    centres = ranked.groupBy("bucket").agg(
        F.max(F.struct("degree", (-F.col("id")).alias("tie"), "id", "n")).alias("c")).select(
        "bucket", F.col("c.id").alias("u"), F.col("c.n").alias("m"))
    fits = F.lit(100) * F.least("n", "m") >= F.lit(pct) * F.greatest("n", "m")
    pairs = cut_lineage(members.join(centres, "bucket").where(fits & (F.col("id") != F.col("u")))
                        .select("u", F.col("id").alias("v")).distinct())
    sets = cut_lineage(_sets_of(docs, members.select("id")))
    stars = components(_links(pairs, sets, pct))

    placed = (members.join(stars.withColumnRenamed("u", "id").withColumnRenamed("v", "group"), "id", "left")
              .select("bucket", "id", F.coalesce("group", "id").alias("group")))
    mixed = (placed.groupBy("bucket").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
             .where("lo <> hi").select("bucket"))
    open_rows = cut_lineage(placed.join(mixed, "bucket", "left_semi"))
    found = cut_lineage(_cross_links(sets, open_rows, pct))
    groups = stars if found.isEmpty() else components(stars.union(found))

    named = classes.select("digest", "id").join(
        groups.select(F.col("u").alias("id"), F.col("v").alias("group")), "id", "left").select(
        "digest", F.coalesce("group", "id").alias("component_id"))
    full = table.where("digest is not null").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = table.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is its component's first; the columns stay."""
    dropped = near_duplicate_groups(docs).where("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
