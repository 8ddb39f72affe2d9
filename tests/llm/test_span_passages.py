"""Repeated passages under sentence-span dedup, whatever their sentences and surroundings are."""

import re
from collections import defaultdict

import numpy as np

from tillroll.llm import sentence_spans


def _fresh(rng, n, stop=9):
    """Words that occur nowhere else, with a full stop behind every ``stop``-th."""
    return " ".join(f"o{int(x)}" + "." * (i % stop == stop - 1) for i, x in enumerate(rng.integers(0, 10 ** 12, n)))


def _cut(spark, rows):
    got = sentence_spans.drop_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r.doc_id: r.text for r in got.collect()}


def test_passages_of_short_lines_are_cut_whole(spark):
    rng = np.random.default_rng(8)
    words = [f"v{int(x)}" for x in rng.integers(0, 10 ** 9, 60)]
    for stop in (".", ""):
        passage = "".join(" ".join(words[i:i + 3]) + f"{stop}\n" for i in range(0, 60, 3))
        rows = [(i, f"{_fresh(rng, 18)}\n{passage}{_fresh(rng, 27)}") for i in range(4)]
        got = _cut(spark, rows)
        assert got == {i: t if i == 0 else t.replace(passage, "") for i, t in rows}


def test_runs_at_both_edges_of_a_passage(spark):
    """A long sentence before or behind short ones: the short ones belong to a run that lies in the passage."""
    rng = np.random.default_rng(9)
    long = " ".join(f"v{int(x)}" for x in rng.integers(0, 10 ** 9, 11))
    for passage in (f"{long}. One. Two three. Four.\n", f"One. Two three. Four. {long}.\n"):
        rows = [(i, f"{_fresh(rng, 18)}\n{passage}{_fresh(rng, 27)}") for i in range(3)]
        got = _cut(spark, rows)
        assert got == {i: t if i == 0 else t.replace(passage, "") for i, t in rows}


def _vocabulary(rng, types):
    """A drawer of words: ``types`` of Zipf's frequencies, or ever new ones."""
    if not types:
        return lambda n: [f"v{int(x)}" for x in rng.integers(0, 10 ** 12, n)]
    own, share = rng.integers(0, 10 ** 12, types), 1 / np.arange(1, types + 1)
    return lambda n: [f"z{int(own[i])}" for i in rng.choice(types, n, p=share / share.sum())]


def test_passages_of_long_sentences_are_cut_whole(spark):
    rows, passages = [], {}
    for seed in range(40):
        rng = np.random.default_rng(seed)
        for sentences, size, types in ((5, 20, 0), (20, 18, 0), (5, 20, 40)):
            draw = _vocabulary(rng, types)
            passage = "".join(" ".join(draw(size)) + ". " for _ in range(sentences))
            for i in range(3):
                passages[len(rows)] = passage
                rows.append((len(rows), f"{_fresh(rng, 27)} {passage}{_fresh(rng, 27)}"))
    got = _cut(spark, rows)
    assert got == {i: t if i % 3 == 0 else t.replace(passages[i], "") for i, t in rows}


def test_unpunctuated_passages_lose_only_their_edges(spark):
    rows, words = [], {}
    for seed in range(40):
        rng = np.random.default_rng(seed)
        for types in (0, 40, 200):
            passage = _vocabulary(rng, types)(60)
            for i in range(3):
                words[len(rows)] = passage
                around = [_fresh(rng, 30, 31), _fresh(rng, 27, 31)]  # no stop between them and the passage
                rows.append((len(rows), f"{around[0]} {' '.join(passage)} {around[1]}"))
    got = _cut(spark, rows)
    for i, t in rows:
        left = [w for w in got[i].split() if w in set(words[i])]
        assert len(left) == 60 if i % 3 == 0 else len(left) <= 20  # of 10 words at either edge
        if i % 3:
            own = [w for w in t.split() if w not in set(words[i])]
            assert [w for w in got[i].split() if w not in set(words[i])] == own


def _own_sentences(text):
    """(start, end, lower-case words) of the sentences, by a regular expression."""
    out, start, words = [], None, []
    for m in re.finditer(r"[^ \t\n\v\f\r]+|\n", text):
        if m[0] != "\n":
            start, end = m.start() if start is None else start, m.end()
            words.append(re.sub("[A-Z]", lambda c: c[0].lower(), m[0]))
        if words and (m[0] == "\n" or re.search(r"[.!?]$|[.!?]['\")]$", m[0])):
            out.append((start, end, tuple(words)))
            start, words = None, []
    return out + ([(start, end, tuple(words))] if words else [])


def _check_cuts(rows, got):
    """Sentences that lie in an earlier run of 3 or more of 12 words or more are gone; what is gone occurs elsewhere.

    Returns how many sentences had to go.
    """
    first, must, spots = {}, defaultdict(set), defaultdict(set)
    split = {i: _own_sentences(t) for i, t in rows}
    for i in sorted(split):
        own = split[i]
        for a in range(len(own)):
            for b in range(a + 3, min(a + 16, len(own)) + 1):
                run = tuple(w for _, _, w in own[a:b])
                if sum(map(len, run)) >= 12 and first.setdefault(run, (i, a)) != (i, a):
                    must[i].update(range(a, b))
        flat = [w for _, _, ws in own for w in ws]
        for k in range(len(flat) - 11):
            spots[tuple(flat[k:k + 12])].add((i, k))
    for i, text in rows:
        gone = np.zeros(len(text) + 1, dtype=bool)
        for r in filter(None, got[i].removed.split(",")):
            a, b = map(int, r.split(":"))
            gone[a:b] = True
        assert "".join(c for c, g in zip(text, gone, strict=False) if not g) == got[i].text
        for s in must[i]:
            a, b, _ = split[i][s]
            assert gone[a:b].all(), (i, text[a:b])
        words = [(m.start(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0]))
                 for m in re.finditer(r"[^ \t\n\v\f\r]+", text)]
        again = np.zeros(len(words), dtype=bool)
        for k in range(len(words) - 11):
            if len(spots[tuple(w for _, w in words[k:k + 12])]) > 1:
                again[k:k + 12] = True
        assert all(again[k] for k, (a, _) in enumerate(words) if gone[a]), i
    return sum(map(len, must.values()))


def test_every_repeated_run_goes_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in sentence_spans.drop_repeated_spans(docs).collect()}
    assert _check_cuts(rows, got) > 1000


def test_planted_passages_over_seeds_lengths_and_vocabularies(spark):
    """All but the edge sentences goes, with and without a stop before the passage."""
    rows, cases, least = [], {}, 0
    for seed in range(12):
        for size in (1, 2, 3, 5, 8, 12, 13, 20, 30):
            for types in (0, 15, 40, 200):
                rng = np.random.default_rng([seed, size, types])
                draw, join = _vocabulary(rng, types), ("\n", ". ", " ")[seed % 3]
                body = [" ".join(draw(size)) for _ in range(max(5, 60 // size))]
                passage = ". ".join(body) + "."
                for i in range(3):
                    cases[len(rows)] = passage
                    rows.append((len(rows), f"{_fresh(rng, 20, 7)}{join}{passage}{join}{_fresh(rng, 20, 7)}"))
                least += 2 * (len(body) - 2)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_spans.drop_repeated_spans(table).collect()}
    assert _check_cuts(rows, got) >= least
    for i, passage in cases.items():
        inner = passage.split(". ", 1)[1].rsplit(". ", 1)[0]
        assert (inner in got[i].text) == (i % 3 == 0)
