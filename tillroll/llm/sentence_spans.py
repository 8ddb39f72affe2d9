"""Substring dedup by sliding sentence spans: runs of consecutive sentences that occur again are cut out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tillroll.llm.common import cut_lineage, id_text, text_slices
from tillroll.llm.shingles import hashed_words, mix, text_bytes

#: Sentences in a span, and words that a span grows to (spans of a few short words recur by chance).
SPAN, SPAN_WORDS = 3, 12
#: A sentence of more words than this is cut behind the word of least hash in every window of so many words.
LONG_SENTENCE, CUT_WINDOW = 12, 6
_SLICE = 4 << 20
_U = np.uint64
_ODD = 0x9E3779B97F4A7C15


def sentences(texts: pa.Array):
    """(start bytes, words, hashes, offsets of the documents among them) of all sentences.

    A sentence ends behind a word whose last mark is ``.``, ``!`` or ``?``,
    and at a line break. Text without such ends would be one sentence, so long
    ones are cut by their words' hashes: the same passage is cut alike in any
    surroundings, but for less than two windows at its edges, and no piece of
    one is longer than a window, whatever its words are. Case and white space don't
    count for the hash.
    """
    buf, offsets = text_bytes(texts)
    words, starts, ends = hashed_words(buf, offsets)
    bounds = np.searchsorted(starts, offsets)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    tail = buf[ends - 1]
    close = ((tail == 34) | (tail == 39) | (tail == 41)) & (ends - starts > 1)  # a closing quote or bracket
    tail = np.where(close, buf[np.maximum(ends - 2, 0)], tail)
    stop = (tail == 46) | (tail == 33) | (tail == 63)
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    stop[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    stop[bounds[1:][bounds[1:] > 0] - 1] = True
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    size = last - first + 1
    stop |= _window_cuts(words, np.repeat(first, size), np.repeat(last, size)) & np.repeat(size > LONG_SENTENCE, size)
    last = np.flatnonzero(stop)
    first = np.concatenate([[0], last[:-1] + 1])
    n = len(words)
    power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD, np.uint64)]))
    back = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:n])])
    hashes = mix((sums[last + 1] - sums[first]) * back[first] + (last - first).astype(np.uint64))
    return starts[first], last - first + 1, hashes, np.searchsorted(first, bounds)


def _window_cuts(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words whose hash is the least, and of equal ones the last, in a window of their sentence (``first`` to ``last``)."""
    at = np.arange(len(words))
    before, behind = np.zeros(len(words), np.int8), np.zeros(len(words), np.int8)
    for reach, step in ((before, -1), (behind, 1)):
        open_ = np.ones(len(words), dtype=bool)
        for i in range(1, CUT_WINDOW):
            other = at + step * i
            open_ &= (other >= first) & (other <= last)
            value = words[np.clip(other, 0, len(words) - 1)]
            open_ &= value >= words if step < 0 else value > words
            reach += open_
    return before + behind + 1 >= CUT_WINDOW


def span_hashes(texts: pa.Array, span: int = SPAN, span_words: int = SPAN_WORDS):
    """(document, first sentence, sentences, hash) of every run.

    A run starts at every sentence and grows from ``span`` sentences until it
    holds ``span_words`` words; another ends at every sentence and grows
    backwards alike (once, where both are the same run). So whatever surrounds
    a passage of that size, runs inside it cover all of its sentences.
    """
    _, words, hashes, bounds = sentences(texts)
    n = len(hashes)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    doc = np.searchsorted(bounds, at, side="right") - 1
    ahead = np.maximum(at + span, np.searchsorted(total, total[:-1] + span_words))
    back = np.minimum(at + 1 - span, np.searchsorted(total, total[1:] - span_words, side="right") - 1)
    ahead[ahead > bounds[doc + 1]] = -1  # the text ends before
    back[back < bounds[doc]] = -1
    some, other = np.flatnonzero(ahead >= 0), np.flatnonzero(back >= 0)
    other = other[ahead[back[other]] != other + 1]
    first = np.concatenate([some, back[other]])
    size = np.concatenate([ahead[some], other + 1]) - first
    key = np.zeros(len(first), np.uint64)
    live = np.arange(len(first))
    for i in range(int(size.max(initial=0))):
        live = live[size[live] > i]
        key[live] = mix(key[live] * _U(_ODD) + hashes[first[live] + i])
    return doc[first], first - bounds[doc[first]], size, key.view(np.int64)


def span_table(docs: DataFrame, span: int, span_words: int) -> DataFrame:
    """(h, doc_id, pos) of every run; texts shorter than a run have none. ``pos`` holds place and length."""
    base = _length_base(span, span_words)

    def spans(batches):
        for batch in batches:
            for part in text_slices(batch, _SLICE):
                doc, pos, size, key = span_hashes(part.column(1), span, span_words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), part.column(0).take(pa.array(doc)), pa.array(pos * base + size)],
                    names=["h", "doc_id", "pos"])

    return id_text(docs).where("doc_id is not null").mapInArrow(spans, "h long, doc_id long, pos long")


def _length_base(span: int, span_words: int) -> int:
    """More than the sentences of any run: each has a word at least."""
    return max(span, span_words) + 1


_CUT = StructType([StructField("doc_id", LongType()), StructField("text", StringType()),
                   StructField("n_sentences", IntegerType()), StructField("n_removed", IntegerType()),
                   StructField("removed", StringType())])


def drop_repeated_spans(docs: DataFrame, span: int = SPAN, span_words: int = SPAN_WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, removed) of every document, repeated sentences cut out.

    Every run of ``span`` consecutive sentences, or of as many more as hold
    ``span_words`` words, is hashed (64 bits); the first occurrence of a hash
    in the corpus, by (doc_id, sentence), stays, and the sentences of all
    others go. ``removed`` lists the cut ranges as
    ``start:end`` in code points of the original text.

    Hashes are counted by a partial aggregation, and the occurrences meet the
    repeated hashes in a plain equi-join that Spark splits when one passage is
    very common; a document's cuts are bounded by its own sentences.

    Defined cases: null or empty text stays empty with no sentence; a null
    doc_id is returned unchanged; rows that share a doc_id share their cuts
    and count as one occurrence; an empty table gives an empty result; extra
    columns are ignored.
    """
    found = span_table(docs, span, span_words)
    repeated = cut_lineage(found.groupBy("h").agg(F.min(F.struct("doc_id", "pos")).alias("first"),
                                                  F.count(F.lit(1)).alias("n")).where("n > 1")
                           .select("h", F.col("first.doc_id").alias("fd"), F.col("first.pos").alias("fp")))
    again = (found.join(repeated, "h").where("doc_id <> fd or pos <> fp")
             .groupBy("doc_id").agg(F.collect_set("pos").alias("cuts")))

    def cut(batches):
        for batch in batches:
            for part in text_slices(batch, _SLICE):
                yield _cut_batch(part, _length_base(span, span_words))

    return id_text(docs).join(again, "doc_id", "left").mapInArrow(cut, _CUT)


def _cut_batch(part: pa.RecordBatch, base: int) -> pa.RecordBatch:
    texts = part.column(1)
    buf, offsets = text_bytes(texts)
    starts, _, _, bounds = sentences(texts)
    out, removed, gone = texts.to_pylist(), [""] * len(texts), [0] * len(texts)
    cuts = part.column(2)
    for i in np.flatnonzero(np.asarray(cuts.is_valid())).tolist():
        a, b = int(bounds[i]), int(bounds[i + 1])
        drop = np.zeros(b - a + 1, dtype=bool)
        for code in cuts[i].as_py():
            p, size = divmod(code, base)
            drop[p:p + size] = True
        drop[b - a:] = False
        edges = np.append(starts[a:b], offsets[i + 1])
        own = buf[offsets[i]:offsets[i + 1]]
        points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
        change = np.flatnonzero(np.diff(np.concatenate([[False], drop[:b - a], [False]]).astype(np.int8)))
        ranges = [(int(edges[s] - offsets[i]), int(edges[e] - offsets[i])) for s, e in change.reshape(-1, 2).tolist()]
        raw, done, keep = own.tobytes(), 0, []
        for s, e in ranges:
            keep.append(raw[done:s])
            done = e
        out[i] = b"".join([*keep, raw[done:]]).decode("utf-8")
        removed[i] = ",".join(f"{points[s]}:{points[e]}" for s, e in ranges)
        gone[i] = int(drop.sum())
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(out, pa.string()), pa.array(np.diff(bounds).astype(np.int32)),
         pa.array(gone, pa.int32()), pa.array(removed, pa.string())], names=_CUT.names)
