"""Periodic runs of words by string synchronising sets, over many documents side by side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import id_text, text_slices

#: Shortest run reported, in words; a run also holds its period twice.
MIN_RUN = 12
#: First scale. Periods below three times of it are found by comparing the words at that distance directly.
FIRST_SCALE = 4
#: Bytes of text worked through together; their block names take 8 bytes a word and scale.
SLICE_BYTES = 1 << 20
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: the selecting hash of a block's name."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def block_names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """names[k][i]: 64-bit name of the 2^k words from i on, for all k with 2^k <= ``longest``."""
    names = [_mix(codes.astype(np.uint64) * _M1 + _M2)]
    while 2 << (len(names) - 1) <= longest:
        half, last = 1 << (len(names) - 1), names[-1]
        if len(last) <= half:
            break
        names.append(_mix(last[:-half] * _M1 + (last[half:] ^ _M3)))
    return names


def ragged_ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value): the values starts[i], starts[i] + 1, ... of every i, ``counts[i]`` of them."""
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner] + starts[owner]


def _reach(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """Words that agree from i and j on (``back``: before i and j), i < j, by blocks of falling length."""
    i, j = i.copy(), j.copy()
    out = np.zeros(len(i), dtype=np.int64)
    top = len(names) - 1
    for k in [top, *range(top, -1, -1)]:  # twice the longest block, so that no shorter stretch is missed
        size, name = 1 << k, names[k]
        if back:
            ok = i >= size
            a, b = np.where(ok, i - size, 0), np.where(ok, j - size, 0)
        else:
            ok = j < len(name)
            a, b = np.where(ok, i, 0), np.where(ok, j, 0)
        ok &= name[a] == name[b]
        out += ok * size
        shift = np.where(ok, -size if back else size, 0)
        i += shift
        j += shift
    return out


def _extend(names: list[np.ndarray], i: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of the maximal stretches with those periods around i, where they hold the period twice."""
    after = _reach(names, i, i + period, False)
    before = _reach(names, i, i + period, True)
    ok = after + before >= period
    return np.stack([(i - before)[ok], (i + period + after)[ok], period[ok]], axis=1)


def _unique(runs: np.ndarray) -> np.ndarray:
    """One row a stretch, with its smallest period (a stretch that holds a multiple of its period twice has it too)."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), dtype=bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[first]


def _short_periods(codes: np.ndarray, below: int) -> np.ndarray:
    """Runs with a period under ``below``: stretches of words equal to those ``q`` before."""
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, min(below, len(codes))):
        same = np.zeros(len(codes) - q + 2, dtype=np.int8)
        same[1:-1] = codes[q:] == codes[:-q]
        edge = np.diff(same)
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stop - start >= q
        found.append(np.stack([start[long], stop[long] + q, np.full(int(long.sum()), q)], axis=1))
    return _unique(np.concatenate(found))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` values in a row."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    if size < width:
        more = width - size
        out = np.minimum(out[:-more], out[more:])
    return out


def synchronising_set(names: list[np.ndarray], scale: int, periodic: np.ndarray) -> np.ndarray:
    """Positions i whose hash, or that at i + scale, is the least of those from i to i + scale.

    Hashes are those of blocks of ``scale`` words; ``periodic`` blocks take no
    part. Whether i is in the set depends on the 2 * scale words from i on
    alone, and any 3 * scale - 1 words whose period is over a third of the
    scale have a position among their first ``scale``.
    """
    k = scale.bit_length() - 1
    rank = np.where(periodic, _NONE, _mix(names[k] ^ _M2))
    if len(rank) <= scale:
        return np.zeros(0, dtype=np.int64)
    least = _least(rank, scale + 1)
    return np.flatnonzero((least != _NONE) & ((least == rank[:len(least)]) | (least == rank[scale:])))


def _equal_contexts(at: np.ndarray, context: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, distance) of positions with the same context, low <= distance < high; one row for a chain of overlapping ones."""
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    live = np.arange(len(at))
    starts, gaps = [], []
    step = 1
    while len(live):  # a context is not periodic, so only few of its places lie that close
        live = live[live + step < len(at)]
        gap = at[live + step] - at[live]
        near = (context[live + step] == context[live]) & (gap < high)
        live, gap = live[near], gap[near]
        far = gap >= low
        starts.append(at[live[far]])
        gaps.append(gap[far])
        step += 1
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, q = np.concatenate(starts), np.concatenate(gaps)
    order = np.lexsort((i, q))
    i, q = i[order], q[order]
    head = np.ones(len(i), dtype=bool)
    head[1:] = (q[1:] != q[:-1]) | (i[1:] - i[:-1] > low // 3)
    return i[head], q[head]


def _joined_periodic(names: list[np.ndarray], runs: np.ndarray) -> np.ndarray:
    """Runs that lie in two touching runs of one smaller period and the same repeated word block.

    Such a run is periodic on both sides of the border, so it may have no
    synchronising position. Its period is the shift that lays the second run's
    block on the first one's, plus whole blocks.
    """
    runs = runs[runs[:, 1] - runs[:, 0] >= 8 * runs[:, 2]]
    runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
    if len(runs) < 2:
        return np.zeros((0, 3), dtype=np.int64)
    a, b = runs[:-1], runs[1:]
    touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    a, b = a[touch], b[touch]
    p = a[:, 2]
    owner, x = ragged_ranges(b[:, 0], p)  # every rotation of the second run's block
    y = (a[:, 1] - p)[owner]
    k = np.frexp(p)[1] - 1  # 2^k <= p < 2^(k+1): two overlapping blocks cover a period
    same = np.zeros(len(x), dtype=bool)
    for level in np.unique(k):
        mine = k[owner] == level
        name, tail = names[level], (p[owner] - (1 << int(level)))[mine]
        same[mine] = (name[x[mine]] == name[y[mine]]) & (name[x[mine] + tail] == name[y[mine] + tail])
    owner, shift = owner[same], (x - y)[same]
    a, b, p = a[owner], b[owner], p[owner]
    most = np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0])
    first = shift % p
    first = np.where(first == 0, p, first)
    pair, turn = ragged_ranges(np.zeros(len(p), np.int64), np.maximum(0, (most - first) // p + 1))
    q = first[pair] + turn * p[pair]
    i = np.maximum(a[pair, 0], b[pair, 0] - q)
    inside = i < np.minimum(a[pair, 1], b[pair, 1] - q)
    return _extend(names, i[inside], q[inside])


def word_runs(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, end, period) of all runs with 2 periods or more in the documents ``codes[bounds[d]:bounds[d + 1]]``.

    Equal codes are equal words; starts and ends count within ``codes`` and
    the result is sorted by start and period. Documents are laid out with a
    word of its own behind each, so that no run leaves its document.

    At every scale t = 4, 8, ... a run with a period q of 3 t to 6 t either has
    a synchronising position in its first 3 t words, and an equal context q
    further on, or is periodic there with a period of at most t / 3 (see
    ``_joined_periodic``). Proposed periods are extended to maximal stretches
    by the names of dyadic blocks. Names are 64-bit hashes: two different
    blocks of a slice share one with a probability near 1e-9 at a million words.
    """
    lens = np.diff(bounds)
    docs = len(lens)
    if not len(codes):
        return np.zeros((0, 3), dtype=np.int64)
    place = np.arange(len(codes)) + np.repeat(np.arange(docs), lens)
    line = np.empty(len(codes) + docs, dtype=np.int64)
    line[place] = codes
    stops = bounds[1:] + np.arange(docs)
    line[stops] = codes.max() + 1 + np.arange(docs)
    longest = int(lens.max())
    names = block_names(line, max(longest, 1))
    runs = _short_periods(line, 3 * FIRST_SCALE)
    scale = FIRST_SCALE
    while 6 * scale <= longest and scale.bit_length() < len(names):
        k = scale.bit_length() - 1
        inner = runs[(runs[:, 2] <= scale // 3) & (runs[:, 1] - runs[:, 0] >= scale)]
        marks = np.zeros(len(line) + 1, dtype=np.int64)
        np.add.at(marks, inner[:, 0], 1)
        np.add.at(marks, inner[:, 1] - scale + 1, -1)
        at = synchronising_set(names, scale, np.cumsum(marks)[:len(names[k])] > 0)
        at = at[at < len(names[k + 1])]
        i, q = _equal_contexts(at, names[k + 1][at], 3 * scale, 6 * scale)
        runs = _unique(np.concatenate([runs, _extend(names, i, q)]))
        scale *= 2
    runs = _unique(np.concatenate([runs, _joined_periodic(names, runs)]))
    before = np.cumsum(line > codes.max())  # words of its own up to each place
    shift = before[runs[:, 0]]
    runs = runs - np.stack([shift, shift, np.zeros_like(shift)], axis=1)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(texts: pa.Array, min_run: int):
    """(words, runs, kept words) of the texts: ragged runs as (offsets, rows), and the joined kept words."""
    split = pc.ascii_split_whitespace(texts)
    ends = np.asarray(split.offsets).astype(np.int64)
    pieces = split.flatten()
    real = np.asarray(pc.not_equal(pc.binary_length(pieces), 0))
    ends -= ends[0]
    bounds = np.concatenate([[0], np.cumsum(real)])[ends]  # leading and trailing white space gives empty pieces
    words = pieces.filter(pa.array(real))
    codes = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    runs = word_runs(codes, bounds)
    runs = runs[runs[:, 1] - runs[:, 0] >= min_run]
    cut = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(cut, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cut, runs[:, 1], -1)
    keep = np.cumsum(cut)[:len(codes)] == 0
    kept = np.concatenate([[0], np.cumsum(keep)])[bounds]
    left = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), words.filter(pa.array(keep)))
    doc = np.searchsorted(bounds, runs[:, 0], side="right") - 1
    offsets = np.searchsorted(doc, np.arange(len(bounds)))
    return np.diff(bounds), offsets, runs, bounds[doc], pc.binary_join(left, " ")


def periodic_runs(docs: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every document.

    Words are maximal strings without ASCII white space, numbered from 0, and
    equal if they are the same bytes. A run is a stretch of ``min_run`` words
    or more that holds its smallest period twice and can't be extended with
    that period. ``runs`` are in order of start and period; ``collapsed`` is
    the words that stay, joined by one space, when every run is cut back to its
    first period.

    A document's text is one value, so it is worked through in one task; the
    work is linear in its words, times the number of scales. Documents go
    through side by side in slices of about a megabyte of text, and nothing is
    shuffled.

    Defined cases: null, empty and white-space texts have no words, no runs
    and an empty ``collapsed``; a null doc_id and repeated rows give a row
    each; ties can't occur, since a stretch is reported with its smallest
    period only; an empty table gives an empty result; extra columns are
    ignored.
    """
    def find(batches):
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                words, offsets, runs, base, collapsed = _collapse(part.column(1), min_run)
                items = pa.StructArray.from_arrays(
                    [pa.array(runs[:, 0] - base), pa.array(runs[:, 1] - runs[:, 0]), pa.array(runs[:, 2])],
                    names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(words), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items),
                     collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return id_text(docs).mapInArrow(
        find, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest run and digests of a ``periodic_runs`` result."""
    # longest first, then smallest start, then smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.p")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def plant_periods(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), where every tenth document by crc32 of its id becomes periodic from some word on.

    With h the unsigned crc32 of the decimal doc_id and g = h / 10 rounded
    down: if h is divisible by 10, word i >= a = g % n becomes word
    a + (i - a) % p of the original, p = 1 + (n - a) / (3 + g % 8) rounded
    down, and the words are joined by one space. A null doc_id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # the words are taken apart only in the planted tenth
    planted = docs.withColumn("g", F.floor(h / 10)).withColumn(
        "w", F.when((h % 10 == 0) & F.col("text").isNotNull(), words))
    n = F.size("w")
    planted = planted.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn(
        "p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    word = F.expr("array_join(transform(sequence(0, size(w) - 1), "
                  "i -> w[cast(if(i < a, i, a + (i - a) % p) as int)]), ' ')")
    return planted.select("doc_id", F.when(n > 0, word).otherwise(F.col("text")).alias("text"))
