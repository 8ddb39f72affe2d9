"""Best-fit packing with certificates: dual feasible functions bound each group's sequences, loose groups exchange documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut_lineage, release, tokenizer_json
from tillroll.llm.ffd_pack import document_pieces

#: Expected pieces in a packing group; a task packs one group at a time.
GROUP_PIECES = 2048
#: Sequences that a certified group gives up along with its loosest one, so that the exchange has sizes to choose from.
SPARE = 15
#: Exchange rounds at most; they end earlier when the bound is met, or when so many in a row save nothing.
ROUNDS = 24
FRUITLESS = 3
#: Steps k of the rounding function, and numbers of parts of the cutting function, that the bound tries.
STEPS = range(1, 9)
PARTS = range(2, 17)

_KEYS = "doc_id long, piece long, start long, length long, ids_crc32 long, doc_tokens long, place long"
_PACKED = _KEYS + ", sequence_id long, offset long, bound long, released boolean"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item: largest first, each into the fullest bin that still holds it.

    Bins are stacked by their free room, and the rooms in use are the bits of
    one integer, so the fullest fitting bin is the lowest bit from the item's
    size up.
    """
    bins = np.zeros(len(sizes), dtype=np.int64)
    offsets = np.zeros(len(sizes), dtype=np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = opened = 0
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, opened
            opened += 1
        bins[item], offsets[item] = b, capacity - room
        if room > size:
            stacks[room - size].append(b)
            rooms |= 1 << (room - size)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of ``counts[size]`` items of each size needs, by dual feasible functions.

    A function f of sizes is dual feasible if sizes that fit together have f
    summing to at most 1, so the sum of f over all items bounds the number of
    bins. Tried, in whole numbers: the size itself and its rounding up to k
    steps, each after items below e are dropped and items above capacity - e
    count as full (every e); and the function that counts how many of
    ``PARTS`` equal small items a large one shuts out.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    e = np.arange(0, capacity // 2 + 1)
    count_to = np.cumsum(n)
    above = count_to[-1] - count_to[capacity - e]  # items over capacity - e
    best = 0
    for k in (0, *STEPS):
        scaled = (k + 1) * x
        value = x if k == 0 else np.where(scaled % capacity == 0, k * x, scaled // capacity * capacity)
        scale = capacity * max(k, 1)
        total = np.concatenate([[0], np.cumsum(value * n)])
        sums = above * scale + total[capacity - e + 1] - total[e]
        best = max(best, -(-int(sums.max()) // scale))
    half = x * 2 > capacity
    for parts in PARTS:
        for small in {max(1, capacity // parts), capacity // (parts + 1) + 1}:
            most = capacity // small
            value = np.where(half, most - (capacity - x) // small, np.where(x >= small, 1, 0))
            best = max(best, -(-int((value * n).sum()) // most))
    return best


def _exchange(pool: DataFrame, rnd: int, capacity: int, group_pieces: int, spare: int) -> DataFrame:
    """Pack the pool's pieces in random groups; ``released`` marks those that may be exchanged. Written once."""
    groups = max(1, -(-pool.count() // group_pieces))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "place", "start"], kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        bins, offsets = best_fit_decreasing(sizes, capacity)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        if len(used) > bound:  # a gap: all but full sequences are up for exchange
            loose = used < capacity
        else:
            loose = np.zeros(len(used), dtype=bool)
            loose[np.argsort(used, kind="stable")[:spare + 1]] = True
        group["sequence_id"] = (rnd << 56) + (group["pack_group"].to_numpy() << 20) + bins
        group["offset"], group["bound"], group["released"] = offsets, bound, loose[bins]
        return group.drop(columns="pack_group")

    keyed = pool.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "place", "start", F.lit(rnd)), F.lit(groups)))
    return cut_lineage(keyed.groupBy("pack_group").applyInPandas(pack, _PACKED))


def pack_certified(docs: DataFrame, capacity: int = 4096, group_pieces: int = GROUP_PIECES, spare: int = SPARE,
                   rounds: int = ROUNDS, tokenizer_path: str | None = None) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` ids; one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, round (in which the sequence was closed). A document
    is its ids and the end id; only those longer than ``capacity`` are cut, at
    its multiples.

    Pieces are packed best-fit decreasing in random groups, and dual feasible
    functions bound the sequences of each group from below. A group that meets
    its bound is certified: it closes its sequences but the loosest and a few
    spare ones. One with a gap closes only its full sequences. The documents
    that aren't closed are dealt to new random groups and packed again, until
    the number of all sequences meets the bound of the whole table, or
    ``FRUITLESS`` rounds in a row save nothing (such exchanges are undone), or
    after ``rounds`` rounds.
    The pool shrinks by more than ten times a round unless gaps remain. Only
    piece rows (seven longs) are shuffled; the driver sees counts, and the
    histogram of lengths, which has at most ``capacity`` rows.

    Defined cases: null or empty text is the end id alone; a null doc_id is
    packed as it is; repeated rows are packed each; equal lengths are packed in
    the order of (doc_id, place in the table); an empty table gives an empty
    result; extra columns are ignored; a long text spreads over groups by its
    pieces.
    """
    pieces = document_pieces(docs, capacity, tokenizer_json(tokenizer_path))
    pieces = cut_lineage(pieces.withColumn("piece", F.floor(F.col("start") / capacity).cast("long")))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most one row a length
        counts[r["length"]] = r["count"]
    bound = lower_bound(counts, capacity)

    table = _exchange(pieces, 0, capacity, group_pieces, spare)
    closed: list[DataFrame] = []
    done = at = fruitless = 0  # sequences closed in earlier rounds; round of ``table``; exchanges since then
    for rnd in range(1, rounds + 1):
        seen = table.agg(F.count_if(F.col("offset") == 0).alias("all"),
                         F.count_if((F.col("offset") == 0) & F.col("released")).alias("open")).first()
        if done + seen["all"] <= bound or not seen["open"] or fruitless == FRUITLESS:
            break
        # groups twice the size after each fruitless exchange: more sizes to choose from
        again = _exchange(table.where("released").select(*pieces.columns), rnd, capacity,
                          group_pieces << fruitless, spare)
        if again.where("offset = 0").count() >= seen["open"]:
            release(again)
            fruitless += 1
            continue
        closed.append(table.where("not released").withColumn("round", F.lit(at)))
        done += seen["all"] - seen["open"]
        table, at, fruitless = again, rnd, 0
    out = table.withColumn("round", F.lit(at))
    for part in closed:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "round")
