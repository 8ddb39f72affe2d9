"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tillroll.llm import sync_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _brute(words, shortest):
    """All runs by comparing every distance, smallest period first."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q, q))
            i = j + 1
    return sorted(r for r in out if r[1] - r[0] >= shortest)


def _fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def _hard(rng):
    """Words with nested, touching and overlapping repeats."""
    kind = rng.randrange(7)
    n = rng.randint(1, 400)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return _fibonacci(n)
    if kind == 2:  # powers of a rotated block side by side
        block = [rng.randrange(3) for _ in range(rng.randint(1, 9))]
        out = []
        for _ in range(rng.randint(1, 5)):
            r = rng.randrange(len(block))
            out += (block[r:] + block[:r]) * rng.randint(1, 30) + block[:rng.randrange(len(block) + 1)]
        return out
    if kind == 3:  # a power of something that is itself full of powers
        inner = [0, 1] * rng.randint(2, 20) + [rng.randrange(2)] * rng.randint(0, 12)
        return (inner * rng.randint(2, 5) + inner[:rng.randrange(len(inner))])[:600]
    if kind == 4:
        return [0] * n
    if kind == 5:  # a long period once and a bit, between distinct words
        block = [rng.randrange(10 ** 6) for _ in range(rng.randint(5, 120))]
        return [rng.randrange(10 ** 6) for _ in range(40)] + block * 2 + block[:rng.randrange(len(block))]
    return [bin(i).count("1") % 2 for i in range(n)]


def test_runs_equal_all_periods_tried():
    rng = random.Random(11)
    for _ in range(60):
        docs = [_hard(rng) for _ in range(rng.randint(1, 12))] + [[]]
        bounds = np.cumsum([0] + [len(d) for d in docs])
        got = sync_runs.word_runs(np.array([w for d in docs for w in d], dtype=np.int64), bounds)
        for d, (a, b) in zip(docs, zip(bounds[:-1], bounds[1:])):
            own = got[(got[:, 0] >= a) & (got[:, 1] <= b) & (got[:, 0] < b)]
            assert [(s - a, e - a, q) for s, e, q in own.tolist()] == _brute(d, 0)


def test_long_periods_and_long_documents():
    rng = random.Random(5)
    block = [rng.randrange(2) for _ in range(3000)]
    docs = [block * 2 + block[:500], [0, 1] * 2000 + [1, 0] * 2000, [7] * 9000, _fibonacci(3000)]
    for d in docs:
        got = sync_runs.word_runs(np.array(d), np.array([0, len(d)]))
        assert len({(s, e) for s, e, _ in got.tolist()}) == len(got)
        if len(d) <= 4000:
            assert [tuple(r) for r in got.tolist()] == _brute(d, 0)
    got = sync_runs.word_runs(np.array(docs[0]), np.array([0, len(docs[0])]))
    assert [0, 6500, 3000] in got.tolist()
    # (01)^k (10)^k: a run of every odd period around the border
    got = sync_runs.word_runs(np.array(docs[1]), np.array([0, 8000]))
    odd = {q for _, _, q in got.tolist()} - {1, 2}
    assert odd == set(range(3, 4000, 2))


def test_synchronising_positions_depend_on_their_context_only_and_are_dense():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 4, 300)
    line = np.concatenate([rng.integers(0, 4, 100), part, rng.integers(0, 4, 77), part, rng.integers(0, 4, 50)])
    names = sync_runs.block_names(line, len(line))
    for scale in (8, 16, 32):
        k = scale.bit_length() - 1
        at = set(sync_runs.synchronising_set(names, scale, np.zeros(len(names[k]), bool)).tolist())
        first = {i - 100 for i in at if 100 <= i <= 400 - 2 * scale}
        assert first == {i - 477 for i in at if 477 <= i <= 777 - 2 * scale}
        assert all(any(j in at for j in range(i, i + scale)) for i in range(0, len(line) - 3 * scale + 2))


def _expected(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = _brute(words, 12)
    dropped = {i for s, e, q in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2])) if runs else None
    head = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(kept.encode()).hexdigest())


def _rows(docs):
    got = sync_runs.run_digests(sync_runs.periodic_runs(sync_runs.plant_periods(docs)))
    return [tuple(r) for r in got.collect()]


def _sorted(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_brute_force(spark, sf):
    from tillroll.llm.queries import LLM_QUERIES
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = [tuple(r) for r in LLM_QUERIES["op12_sync_runs"](spark, f"/root/testdata/{sf}").collect()]
    want = [_expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert _sorted(got) == _sorted(want)
    assert sum(r[1] > 0 for r in got) >= 10


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert _sorted(_rows(odd_docs)) == _sorted([_expected(d, t) for d, t in rows])
    assert _rows(no_docs) == []
    planted = spark.createDataFrame([(i, "a b c d e f g h " * 5) for i in range(60)], "doc_id long, text string")
    assert _sorted(_rows(planted)) == _sorted([_expected(i, "a b c d e f g h " * 5) for i in range(60)])


def test_collapsed_text_keeps_the_first_period(spark):
    df = spark.createDataFrame([(1, "x " + "a b c " * 6 + "y"), (2, "a b c " * 3)], "doc_id long, text string")
    got = {r.doc_id: r for r in sync_runs.periodic_runs(df).collect()}
    assert got[1].collapsed == "x a b c y" and [tuple(r) for r in got[1].runs] == [(1, 18, 3)]
    assert got[2].collapsed == " ".join(["a b c"] * 3) and got[2].runs == [] and got[2].n_words == 9
