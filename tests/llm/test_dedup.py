"""Exact, near and substring dedup against brute force."""

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tillroll.llm import components, exact_refine, sentence_spans, shingles, superminhash

DOCS = "/root/testdata/sf0.01/documents.parquet"


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_exact_groups(odd_docs):
    rows = exact_refine.exact_groups(odd_docs.drop("kept")).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r.text or ""].append(r)
    for group in texts.values():
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.group_size for r in group} == {len(group)}
        assert {r.keep_id for r in group} == {max(ids) if ids else None}
        assert sum(r.kept for r in group) == 1
        assert all(r.kept <= (r.doc_id == r.keep_id) for r in group)
    assert len(rows) == odd_docs.count()


def test_exact_keep_one_keeps_columns(odd_docs, no_docs):
    kept = exact_refine.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert exact_refine.exact_groups(no_docs).count() == 0


def test_same_length_and_prefix_but_other_text(spark, tmp_path):
    rows = [(i, "p" * 200 + str(i % 3) + "q") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = exact_refine.exact_groups(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, 6 + i % 3, 3) for i in range(9)}


def test_shingle_sets_equal_brute_force(spark, monkeypatch):
    texts = [r.text for r in spark.read.parquet(DOCS).orderBy("doc_id").limit(200).collect()]
    texts += ["", "a", "A b c d", "a b c d e", " x\ty\nz\x0bw\x0cv\ru ", "é ü ẞ I"]
    sets = shingles.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    monkeypatch.setattr(shingles, "BLOCK", 700)
    assert all((a == b).all() for a, b in zip(sets, shingles.shingle_sets(pa.array(texts))))


def test_superminhash_estimates_similarity_better_than_independent_hashes():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, one = int(rng.integers(20, 200)), int(rng.integers(1, 100))
        items = rng.integers(0, 2 ** 63, both + 2 * one).astype(np.uint64)
        sig = superminhash.signatures([items[:both + one], np.concatenate([items[:both], items[both + one:]])], 128)
        j = both / (both + 2 * one)
        errors.append(((sig[0] == sig[1]).mean() - j) ** 2 / (j * (1 - j) / 128))
    assert np.mean(errors) < 1.1  # the variance of independent minima is 1
    empty = superminhash.signatures([np.zeros(0, np.uint64)], 8)
    assert np.isinf(empty).all()


def test_each_place_gets_one_rank_per_step():
    sig = superminhash.signatures([np.array([5], np.uint64)], 64)[0]
    assert sorted(np.floor(sig).astype(int)) == list(range(64))


def _near(docs):
    """component of every id by brute force."""
    rows = [(r.doc_id, shingle_set(r.text)) for r in docs.where("doc_id is not null").select("doc_id", "text").collect()]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for k, (_, s) in enumerate(rows):
        for x in s:
            by[x].append(k)
    shared = defaultdict(int)
    for ks in by.values():
        for a in range(len(ks)):
            for b in range(a):
                shared[(ks[b], ks[a])] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(rows[a][1]) + len(rows[b][1]) - n):
            x, y = sorted((root(rows[a][0]), root(rows[b][0])))
            parent[y] = x
    return {i: root(i) for i, _ in rows}


def test_near_duplicate_groups_odd(odd_docs, no_docs):
    want = _near(odd_docs)
    for r in superminhash.near_duplicate_groups(odd_docs).collect():
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id == r.component_id)
    assert superminhash.near_duplicate_groups(no_docs).count() == 0


def test_chain_of_near_copies_is_one_component(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(40):  # each differs a little from the one before: the ends share little
        words = words.copy()
        words[int(rng.integers(0, 400))] = f"n{i}"
        words[int(rng.integers(0, 400))] = f"m{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicate_groups(docs).collect()}
    assert got == _near(docs)


def test_buckets_with_several_components_are_searched_whole(spark, monkeypatch):
    """With one band of one rank nearly unrelated texts meet; every cross pair must still be seen."""
    rng = np.random.default_rng(8)
    base = [[f"w{int(x)}" for x in rng.integers(0, 10 ** 6, 60)] for _ in range(6)]
    rows = []
    for i in range(60):
        words = ["common"] * 5 + base[i % 6].copy()
        words[5 + int(rng.integers(0, 60))] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(superminhash, "BLOCK_DOCS", 7)
    got = {r.doc_id: r.component_id for r in superminhash.near_duplicate_groups(docs, bands=4, rows=1).collect()}
    want = _near(docs)
    assert set(want.values()) and {k: got[k] for k in got} == want


def test_block_comparison_equals_set_arithmetic(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(superminhash, "_COLUMNS", 16)
    base = rng.integers(0, 2 ** 62, 40)
    sets = [np.unique(np.where(rng.random(40) < 0.12, rng.integers(0, 2 ** 62, 40), base)).astype(np.uint64)
            for _ in range(30)]
    ids = np.arange(100, 130)
    for side in (np.zeros(30, int), np.arange(30) % 2):
        group = rng.integers(0, 4, 30)
        u, v = superminhash._links_between(ids, sets, group, side, 75)
        want = set()
        for a in range(30):
            for b in range(a):
                n = len(np.intersect1d(sets[a], sets[b]))
                crosses = side.max() == side.min() or side[a] != side[b]
                if crosses and group[a] != group[b] and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                    want.add((100 + b, 100 + a))
        assert {tuple(sorted(x)) for x in zip(u.tolist(), v.tolist())} == want


def test_keep_one_per_group(odd_docs):
    kept = superminhash.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    want = _near(odd_docs)
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = rng.integers(0, 300, (250, 2))
    got = {r.u: r.v for r in components.components(
        spark.createDataFrame(edges.tolist(), "u long, v long").repartition(5)).collect()}
    parent = list(range(300))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges.tolist():
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert got == {i: root(i) for i in range(300) if root(i) != i}


def _grown_runs(words):
    """(first, end) of the shortest runs of 3 sentences and 12 words or more that start, and that end, at every sentence."""
    runs, n = set(), len(words)
    for i in range(n):
        ahead = next((j for j in range(i + 3, n + 1) if sum(words[i:j]) >= sentence_spans.SPAN_WORDS), None)
        back = next((j for j in range(i - 2, -1, -1) if sum(words[j:i + 1]) >= sentence_spans.SPAN_WORDS), None)
        runs |= {(i, ahead)} if ahead else set()
        runs |= {(back, i + 1)} if back is not None else set()
    return sorted(runs)


def _brute_spans(rows):
    """Texts with every sentence cut that lies in a repeated run which isn't the corpus's first."""
    split = {d: sentence_spans.sentences(pa.array([t])) for d, t in rows}
    spots = defaultdict(list)
    for doc_id, (_, words, hashes, _) in sorted(split.items()):
        for a, b in _grown_runs(words.tolist()):
            spots[tuple(hashes[a:b].tolist())].append((doc_id, a, b))
    cuts = defaultdict(set)
    for found in spots.values():
        for doc_id, a, b in sorted(found)[1:]:
            cuts[doc_id].update(range(a, b))
    out = {}
    for doc_id, text in rows:
        raw, starts = text.encode(), split[doc_id][0].tolist()
        keep = [raw[:starts[0]] if starts else raw]
        for i, s in enumerate(starts):
            if i not in cuts[doc_id]:
                keep.append(raw[s:starts[i + 1] if i + 1 < len(starts) else len(raw)])
        out[doc_id] = b"".join(keep).decode()
    return out


def test_repeated_spans_equal_brute_force(spark):
    docs = spark.read.parquet(DOCS)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = sentence_spans.drop_repeated_spans(docs).collect()
    assert {r.doc_id: r.text for r in got} == _brute_spans(rows)
    texts = dict(rows)
    for r in got:
        rest = texts[r.doc_id]
        for span in reversed([s for s in r.removed.split(",") if s]):
            a, b = map(int, span.split(":"))
            rest = rest[:a] + rest[b:]
        assert rest == r.text


def test_spans_odd(odd_docs, no_docs):
    got = {r.doc_id: r for r in sentence_spans.drop_repeated_spans(odd_docs).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed > 0 and got[3].text == "" and got[None].n_removed == 0
    assert sentence_spans.drop_repeated_spans(odd_docs).count() == odd_docs.count()
    assert sentence_spans.drop_repeated_spans(no_docs).count() == 0


def _brute_exact(rows):
    """{(doc_id, text): [keep_id, group_size, how many of its rows stay]} from (doc_id, text)."""
    from collections import Counter
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    out = {}
    for t, ids in by.items():
        top = max(ids, key=lambda d: (d is not None, d or 0))
        for d in Counter(ids):
            out[d, t] = [top if len(ids) > 1 else d, len(ids), int(d == top)]
    return out


def _stays(df):
    got = defaultdict(lambda: [None, 0, 0])
    for r in df.collect():
        e = got[r.doc_id, r.text or ""]
        e[0], e[1], e[2] = r.keep_id, r.group_size, e[2] + r.kept
    return dict(got)


def test_exact_groups_do_not_depend_on_how_scans_are_split(spark, tmp_path, monkeypatch):
    """Other splits in every job, and an input that is shuffled anew each time, give the same groups."""
    rng = np.random.default_rng(4)
    rows = [(int(i), f"text {rng.integers(0, 150)} " + "x" * 70) for i in rng.permutation(400)]
    rows += [(7, "again"), (7, "again"), (3, "again"), (None, "again"), (9, None), (9, ""), (9, "")]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(path)
    docs = spark.read.parquet(path)
    want = _brute_exact(rows)
    conf = {"spark.sql.files.maxPartitionBytes": ["4m", "900", "300", "1500"], "spark.sql.files.openCostInBytes": ["1"] * 4}
    before = {k: spark.conf.get(k) for k in conf}
    jobs = []
    cut = exact_refine.cut_lineage

    def changing(df):
        jobs.append(1)
        for k, values in conf.items():
            spark.conf.set(k, values[len(jobs) % 4])
        return cut(df)

    monkeypatch.setattr(exact_refine, "cut_lineage", changing)
    try:
        for table in (docs, docs.repartition(7), docs.orderBy("text")):
            assert _stays(exact_refine.exact_groups(table)) == want
            kept = exact_refine.keep_one(table).collect()
            assert sorted((r.text or "") for r in kept) == sorted({t for _, t in want})
            assert all(want[r.doc_id, r.text or ""][2] == 1 for r in kept)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(jobs) > 12
