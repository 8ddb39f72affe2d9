"""Sequence packing: first-fit decreasing over a tournament tree, within randomised groups of documents."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import id_text, text_slices, tokenizer_json
from tillroll.llm.wordcode import worker_coder

#: Expected documents in a packing group; a task packs one group at a time.
GROUP_DOCS = 2048
END_ID = 1
#: A worker's cache, and the text it encodes at once: small, as the worker goes on to other stages beside a full heap.
CACHE_CHUNKS, SLICE_BYTES = 200_000, 1 << 20

_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item, items taken from the largest down (ties: first come).

    A tournament tree holds the largest free capacity below each node; the
    first bin that fits is found by one walk from the root.
    """
    n = len(sizes)
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(n, dtype=np.int64)
    offsets = np.zeros(n, dtype=np.int64)
    full = int(np.searchsorted(-sizes[order], -capacity, side="right"))
    bins[order[:full]] = np.arange(full)  # items that fill a bin need no search
    rest = order[full:]
    leaves = 1
    while leaves < max(1, len(rest)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    for item in rest.tolist():
        size = int(sizes[item])
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[item] = full + node - leaves
        offsets[item] = capacity - free[node]
        free[node] -= size
        node //= 2
        while node:
            a, b = free[2 * node], free[2 * node + 1]
            top = a if a >= b else b
            if free[node] == top:
                break
            free[node] = top
            node //= 2
    return bins, offsets


def document_pieces(docs: DataFrame, capacity: int, source: str) -> DataFrame:
    """Cut each document's ids (with the end id) into pieces of at most ``capacity``."""
    held = docs.sparkSession.sparkContext.broadcast(source)

    def cut(batches):
        coder = worker_coder(held.value, cache_chunks=CACHE_CHUNKS)
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                flat, offs = coder.encode(part.column(1))
                ids = part.column(0).to_pylist()
                rows = part.column(2).to_pylist()
                end = np.array([END_ID], dtype="<u4")
                out = [[], [], [], [], [], []]
                values = flat.astype("<u4")
                for i, (d, row) in enumerate(zip(ids, rows, strict=True)):
                    own = np.append(values[offs[i]:offs[i + 1]], end)
                    for s in range(0, len(own), capacity):
                        piece = own[s:s + capacity]
                        for col, v in zip(out, (d, s, len(piece), zlib.crc32(piece), len(own), row), strict=True):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=pa.int64()) for c in out],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    rows = id_text(docs).withColumn("place", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, _PIECES)


def pack_documents(docs: DataFrame, capacity: int = 2048, group_docs: int = GROUP_DOCS,
                   tokenizer_path: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` ids; one row per piece.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens (ids in the sequence), padded_length. A sequence
    is padded to ``capacity`` unless its length is a power of two. Documents
    longer than a sequence are cut at multiples of ``capacity``; the last
    pieces are packed with other documents'. Groups are drawn from a hash of
    the doc_id and the row's place in the table, so a doc_id or source with a
    third of the rows spreads over all groups; their number follows the row
    count, so a group stays the same size at any scale. The text never leaves
    its task: only piece rows (six longs) are shuffled.

    Defined cases: null or empty text is the end id alone; a null doc_id is
    packed as it is; repeated rows are packed each; an empty table gives an
    empty result; extra columns are ignored.
    """
    pieces = document_pieces(docs, capacity, tokenizer_json(tokenizer_path))
    groups = max(1, -(-docs.count() // group_docs))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "place", "start"], kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        bins, offsets = first_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        group["sequence_id"] = (group["pack_group"].to_numpy() << 32) + bins
        group["offset"] = offsets
        group["sequence_tokens"] = fill
        group["padded_length"] = np.where(fill & (fill - 1) == 0, fill, capacity)
        return group[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                      "sequence_tokens", "padded_length"]]

    keyed = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "place"), F.lit(groups)))
    return keyed.groupBy("pack_group").applyInPandas(
        pack, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, sequence_tokens long, padded_length long")
