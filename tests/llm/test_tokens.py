"""Speculative BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tillroll.llm import ffd_pack, spec_bpe, token_files
from tillroll.llm.common import tokenizer_json
from tillroll.llm.wordcode import ChunkCoder


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_str(tokenizer_json())


@pytest.fixture(scope="module")
def speculative():
    return spec_bpe.SpeculativeCoder(tokenizer_json())


def _texts():
    rng = random.Random(4)
    letters = "abcdefghilmnoprstuéèç'.0-"
    out = ["".join(rng.choice(letters[:rng.choice([2, 3, 5, 12, 24])]) for _ in range(rng.randint(0, 90)))
           for _ in range(3000)]
    return out + ["", " ", "a" * 500, "ha" * 200, "é" * 90, "don't 'll 've", "<|endoftext|>", "x<|startoftext|>y",
                  "日本語 Ω Σς ẞ ﬁ İ", "\x1c\x1da", "a b\u0085c", "²³ ½ ٣", "THE End."]


@pytest.mark.parametrize("which", ["speculative", "cache"])
def test_ids_equal_the_library(which, library, speculative):
    coder = speculative if which == "speculative" else ChunkCoder(tokenizer_json())
    texts = _texts()
    for _ in range(2):  # the second time from the cache
        flat, offs = coder.encode(pa.array(texts))
        want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])] == want


def test_small_caches_change_nothing(library):
    texts = _texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for coder in (ChunkCoder(tokenizer_json(), cache_chunks=50),
                  spec_bpe.SpeculativeCoder(tokenizer_json(), cache_chunks=50)):
        got = []
        for i in range(0, len(texts), 100):
            flat, offs = coder.encode(pa.array(texts[i:i + 100]))
            got += [flat[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]
        assert got == want


def test_side_by_side_and_heap_merging_agree(speculative):
    rng = random.Random(9)
    words = ["".join(rng.choice("aabeht") for _ in range(rng.randint(1, 60))).encode() for _ in range(400)]
    model = speculative.words
    for word, got in zip(words, model._merge_all(words)):
        assert got.tolist() == model.merge_long(word).tolist()


def test_round_trip_digests(odd_docs, library):
    rows = spec_bpe.round_trip_digests(odd_docs).collect()
    texts = defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        texts[r.doc_id].append(r.text or "")
    assert len(rows) == odd_docs.count()
    for r in rows:
        ids = library.encode(texts[r.doc_id][0], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encoded_ids(odd_docs, library):
    for r in spec_bpe.encode_documents(odd_docs.where("doc_id = 11")).collect():
        text = odd_docs.where("doc_id = 11").first().text
        assert r.ids == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, odd_docs, library, tmp_path, encoding):
    path = str(tmp_path / "tokens")
    token_files.write_token_files(odd_docs, path, encoding=encoding)
    want = sorted(((r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1])
                   for r in odd_docs.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = token_files.token_digests(spark, path).orderBy("start").collect()
    start = 0
    assert len(got) == len(want)
    for r, (doc_id, ids) in zip(got, want):
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4"))
        start += len(ids)
    meta = token_files.read_metadata(spark, path)
    assert {(r.doc_id, r.start) for r in meta.collect()} == {(r.doc_id, r.start) for r in got}
    some = token_files.read_tokens(spark, path, 9, 10).collect()
    assert {r.doc_id for r in some} == {9, 10}
    plan = token_files.read_metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[-1]


def test_token_file_layout(spark, odd_docs, tmp_path):
    import glob

    import pyarrow.parquet as pq
    path = str(tmp_path / "tokens")
    token_files.write_token_files(odd_docs, path)
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            col = meta.row_group(g).column(4)
            assert "list" in col.path_in_schema and col.has_offset_index
            assert any("DICTIONARY" in e for e in col.encodings)


def test_empty_tables(spark, no_docs, tmp_path):
    assert spec_bpe.round_trip_digests(no_docs).count() == 0
    token_files.write_token_files(no_docs, str(tmp_path / "t"))
    assert token_files.token_digests(spark, str(tmp_path / "t")).count() == 0
    assert ffd_pack.pack_documents(no_docs).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(1)
    for _ in range(30):
        sizes = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets = ffd_pack.first_fit_decreasing(sizes, 100)
        free = []
        for i in np.argsort(-sizes, kind="stable"):
            for b, f in enumerate(free):
                if f >= sizes[i]:
                    break
            else:
                b = len(free)
                free.append(100)
            assert (bins[i], offsets[i]) == (b, 100 - free[b])
            free[b] -= sizes[i]


@pytest.mark.parametrize("group_docs", [2048, 3])
def test_packing(odd_docs, library, group_docs):
    rows = ffd_pack.pack_documents(odd_docs, capacity=256, group_docs=group_docs).collect()
    want = defaultdict(list)
    for r in odd_docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 256):
            piece = np.array(ids[s:s + 256], dtype="<u4")
            want[r.doc_id].append((s, len(piece), zlib.crc32(piece), len(ids)))
    got = defaultdict(list)
    sequences = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_tokens, r.padded_length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for parts in sequences.values():
        at = 0
        for offset, length, tokens, padded in sorted(parts):
            assert offset == at
            at += length
        assert at == tokens <= 256
        assert padded == (at if at & (at - 1) == 0 else 256)


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = ffd_pack.pack_documents(docs).groupBy("sequence_id").agg({"length": "sum"}).collect()
    total = sum(r[1] for r in rows)
    assert total / (2048 * len(rows)) > 0.98
