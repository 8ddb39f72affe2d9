"""BPE by speculation: greedy longest match proposes, pair checks verify, failing words are merged exactly."""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tillroll.llm.common import id_text, text_slices, tokenizer_json
from tillroll.llm.wordcode import ChunkCoder, worker_coder

_END = 256  # the symbol after a word's last byte
_FAR = np.int64(1) << 40
#: Failing words of up to so many bytes are merged side by side, longer ones each by a heap.
_SIDE_BY_SIDE = 64


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Lookup:
    """int64 keys to int32 values by binary search; -1 where absent."""

    def __init__(self, keys, values):
        order = np.argsort(keys, kind="stable")
        self.keys = np.asarray(keys, dtype=np.int64)[order]
        self.values = np.asarray(values, dtype=np.int32)[order]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.values[at], -1) if len(self.keys) else np.full(len(keys), -1)


class SpeculativeWords:
    """Exact ids of pre-tokenised words, computed for many words at once in numpy."""

    def __init__(self, source: str):
        model = json.loads(source)["model"]
        vocab, byte_of = model["vocab"], _byte_of_char()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)  # when a token is made; single bytes are there from the start
        keys, made = [], []
        for r, (a, b) in enumerate(pairs):
            t = vocab[a + b]
            if self.rank[t] >= 0:
                raise ValueError("two merges make one token; its parts can't be undone")
            self.left[t], self.right[t], self.rank[t] = vocab[a], vocab[b], r
            keys.append(vocab[a] << 20 | vocab[b])
            made.append(t)
        self.merge_of = _Lookup(np.array(keys, dtype=np.int64), made)
        self.base = np.zeros((2, 256), np.int32)  # [is last][byte]
        bytes_of = {}
        for t, i in vocab.items():
            last = t.endswith("</w>")
            body = t[:-4] if last else t
            if all(c in byte_of for c in body) and (self.rank[i] >= 0 or len(body) == 1):
                bytes_of[i] = [byte_of[c] for c in body] + [_END] * last
                if len(body) == 1:
                    self.base[int(last), byte_of[body]] = i
        sound = self._self_coding()
        nodes: dict[tuple[int, int], int] = {}
        token_at = [-1]
        for i, path in bytes_of.items():
            if not sound[i]:
                continue
            node = 0
            for s in path:
                nxt = nodes.get((node, s))
                if nxt is None:
                    nxt = nodes[(node, s)] = len(token_at)
                    token_at.append(-1)
                node = nxt
            token_at[node] = i
        self.token_at = np.array(token_at, dtype=np.int32)
        self.step = _Lookup(np.array([n << 9 | s for n, s in nodes], dtype=np.int64), list(nodes.values()))
        self.proposed = self.merged = 0

    def compatible(self, a: np.ndarray, b: np.ndarray, until=None) -> np.ndarray:
        """Whether merging leaves the border between whole tokens ``a`` and ``b`` alone.

        Time runs backwards from the finished pair. At each moment the tokens
        that touch the border are known; if they have a merge that comes
        before the one that used up the left token (or not after the one that
        used up the right token: of equal merges the left one is first), then
        the border would have been merged away. Then the later made of the
        two is undone (of equal ones the right, made last).
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        gone_a = np.full(len(a), _FAR) if until is None else until.astype(np.int64).copy()
        gone_b = gone_a.copy()
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            m = self.merge_of(x << 20 | y)
            r = np.where(m >= 0, self.rank[m], _FAR)
            bad = (r < gone_a[live]) & (r <= gone_b[live])
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            left_later = rx > ry
            go_on = ~bad & ((rx >= 0) | (ry >= 0))
            la, lb = live[go_on & left_later], live[go_on & ~left_later]
            gone_a[la], a[la] = self.rank[a[la]], self.right[a[la]]
            gone_b[lb], b[lb] = self.rank[b[lb]], self.left[b[lb]]
            live = live[go_on]
        return good

    def _self_coding(self) -> np.ndarray:
        """Tokens whose own bytes are merged to that one token."""
        made = np.flatnonzero(self.rank >= 0)
        fits = np.ones(len(self.rank), dtype=bool)
        fits[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        for t in made[np.argsort(self.rank[made])].tolist():
            fits[t] &= fits[self.left[t]] & fits[self.right[t]]
        return fits

    def propose(self, syms: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Greedy longest match of all words together: a token at the place where it starts, else -1."""
        out = np.full(len(syms), -1, np.int32)
        last = ends - 1  # place of the end symbol
        at, begin, node = starts.copy(), starts.copy(), np.zeros(len(starts), np.int64)
        best, best_end = np.full(len(starts), -1, np.int32), starts.copy()
        while len(at):
            inside = at <= last
            nxt = self.step(node << 9 | syms[np.minimum(at, last)])
            moved = inside & (nxt >= 0)
            at = at + moved
            node = np.where(moved, nxt, node)
            token = np.where(moved, self.token_at[node], -1)
            hit = (token >= 0) & (at != last)  # the end symbol can't be left over
            best = np.where(hit, token, best)
            best_end = np.where(hit, at, best_end)
            stuck = ~moved
            out[begin[stuck]] = best[stuck]
            begin = np.where(stuck, best_end, begin)
            at = np.where(stuck, best_end, at)
            node[stuck] = 0
            best[stuck] = -1
            left = begin <= last
            if not left.all():
                at, begin, node, best, best_end, last = (v[left] for v in (at, begin, node, best, best_end, last))
        return out

    def encode(self, words: list[str]):
        raw = [w.encode("utf-8") for w in words]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        joined = np.frombuffer(b"\0".join(raw) + b"\0", dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(lens + 1)
        starts = ends - lens - 1
        joined[ends - 1] = _END
        tokens = self.propose(joined, starts, ends)
        places = np.flatnonzero(tokens >= 0)
        seq = tokens[places]
        owner = np.searchsorted(ends, places, side="right")
        same = owner[1:] == owner[:-1]
        key, back = np.unique(seq[:-1][same].astype(np.int64) << 20 | seq[1:][same], return_inverse=True)
        fits = self.compatible(key >> 20, key & 0xFFFFF)[back]
        failing = np.unique(owner[1:][same][~fits])
        self.proposed += len(words)
        self.merged += len(failing)
        counts = np.bincount(owner, minlength=len(words)).astype(np.int64)
        if not len(failing):
            return seq, np.concatenate([[0], np.cumsum(counts)])
        fixed = self._merge_all([raw[i] for i in failing.tolist()])
        keep = np.ones(len(words), dtype=bool)
        keep[failing] = False
        new_counts = counts.copy()
        new_counts[failing] = [len(f) for f in fixed]
        offsets = np.concatenate([[0], np.cumsum(new_counts)])
        flat = np.zeros(offsets[-1], np.int32)
        good = keep[owner]
        old = np.concatenate([[0], np.cumsum(counts)])
        flat[(np.arange(len(seq)) - old[owner] + offsets[owner])[good]] = seq[good]
        for i, f in zip(failing.tolist(), fixed, strict=True):
            flat[offsets[i]:offsets[i + 1]] = f
        return flat, offsets

    def _merge_all(self, raw: list[bytes]) -> list:
        out: list = [None] * len(raw)
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        for n in np.unique(lens).tolist():
            rows = np.flatnonzero(lens == n)
            if n > _SIDE_BY_SIDE:
                for r in rows.tolist():
                    out[r] = self.merge_long(raw[r])
                continue
            mat = np.frombuffer(b"".join(raw[r] for r in rows.tolist()), np.uint8).reshape(len(rows), n)
            merged, size = self._merge_equal(mat)
            for r, line, k in zip(rows.tolist(), merged, size.tolist(), strict=True):
                out[r] = line[:k]
        return out

    def _merge_equal(self, mat: np.ndarray):
        """Exact merging of words of one length: each round does every word's next merge."""
        k, n = mat.shape
        seq = self.base[0][mat].astype(np.int64)
        seq[:, -1] = self.base[1][mat[:, -1]]
        size = np.full(k, n)
        if n == 1:
            return seq, size
        made = self.merge_of((seq[:, :-1] << 20 | seq[:, 1:]).ravel()).reshape(k, n - 1).astype(np.int64)
        live = np.arange(k)
        cols = np.arange(n)
        while len(live):
            m = made[live]
            order = np.where(m >= 0, self.rank[m], _FAR)
            j = order.argmin(1)
            some = order[np.arange(len(live)), j] < _FAR
            live, j, m = live[some], j[some], m[some]
            if not len(live):
                break
            here = np.arange(len(live))
            s = seq[live]
            s[here, j] = m[here, j]
            shift = np.minimum(cols[None, :] + (cols[None, :] > j[:, None]), n - 1)
            s = np.take_along_axis(s, shift, 1)
            size[live] -= 1
            gap = np.minimum(np.arange(n - 1)[None, :] + (np.arange(n - 1)[None, :] > j[:, None]), n - 2)
            m = np.take_along_axis(m, gap, 1)
            count = size[live]
            for d in (-1, 0):
                p = j + d
                ok = (p >= 0) & (p + 1 < count)
                q = np.clip(p, 0, n - 2)
                fresh = self.merge_of(s[here, q] << 20 | s[here, q + 1])
                m[here, q] = np.where(ok, fresh, np.where((p >= 0) & (p + 1 >= count), -1, m[here, q]))
            m[np.arange(n - 1)[None, :] >= (count - 1)[:, None]] = -1
            seq[live], made[live] = s, m
        return seq, size

    def merge_long(self, word: bytes) -> np.ndarray:
        """Exact merging of one word by a heap over a linked list."""
        n = len(word)
        seq = self.base[0][np.frombuffer(word, np.uint8)].tolist()
        seq[-1] = int(self.base[1][word[-1]])
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        rank, left, pair = self.rank, seq, self._pair
        heap = [(r, i, seq[i], seq[i + 1], t) for i in range(n - 1)
                for t in (pair(seq[i], seq[i + 1]),) if t >= 0 for r in (int(rank[t]),)]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = nxt[i] if left[i] == a else -1
            if j < 0 or left[j] != b:
                continue
            left[i], left[j] = t, -1
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            for p, q in ((prev[i], i), (i, nxt[i])):
                if p >= 0 and q >= 0 and (u := pair(left[p], left[q])) >= 0:
                    heapq.heappush(heap, (int(rank[u]), p, left[p], left[q], u))
        return np.array([t for t in left if t >= 0], dtype=np.int32)

    def _pair(self, a: int, b: int) -> int:
        key = a << 20 | b
        at = int(np.searchsorted(self.merge_of.keys, key))
        return int(self.merge_of.values[at]) if at < len(self.merge_of.keys) and self.merge_of.keys[at] == key else -1


class SpeculativeCoder(ChunkCoder):
    """Chunk cache over speculative words, with each chunk's ids and decoded text kept as strings."""

    def __init__(self, source: str, cache_chunks: int = 200_000):
        from tokenizers import Tokenizer

        super().__init__(source, SpeculativeWords(source), cache_chunks)
        self.token_text = pa.array([t + " " for t in self.tokens], pa.string())
        self.token_id = pa.array([f"{i} " for i in range(len(self.tokens))], pa.string())
        spec = json.loads(source)
        added, steps = spec["added_tokens"], spec["pre_tokenizer"].get("pretokenizers", [])
        flags = ("normalized", "single_word", "lstrip", "rstrip")
        self.splits = (bool(steps) and steps[-1]["type"] == "ByteLevel" and not steps[-1]["use_regex"]
                       and not steps[-1]["add_prefix_space"] and not any(t[f] for t in added for f in flags))
        if self.splits:
            spec["truncation"] = spec["padding"] = None
            spec["pre_tokenizer"]["pretokenizers"] = steps[:-1]  # words as text, not as byte letters
            library = Tokenizer.from_str(json.dumps(spec))
            self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
            self.special_id = {t["content"]: t["id"] for t in added}
            longest = sorted(self.special_id, key=len, reverse=True)
            self.at_special = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def _encode_odd(self, chunks: list[str]):
        """The library normalises and splits chunks of any script into words; their ids come from ``words``."""
        if not self.splits:  # a file of another kind
            return super()._encode_odd(chunks)
        words, special, pieces = [], [], [0]
        for chunk in chunks:
            for piece in self.at_special.split(chunk) if self.at_special else [chunk]:
                special.append(self.special_id.get(piece, -1))
                if piece and special[-1] < 0:
                    words += [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))]
                words.append("\n")  # the border between pieces
            pieces.append(len(special))
        flat, offsets = self._encode_words(words, len(special))
        special = np.array(special)
        lens = np.where(special >= 0, 1, np.diff(offsets))
        ends = np.concatenate([[0], np.cumsum(lens)])
        out = np.zeros(ends[-1], np.int32)
        marked = np.zeros(len(out), dtype=bool)
        marked[ends[:-1][special >= 0]] = True
        out[marked], out[~marked] = special[special >= 0], flat
        return out, ends[pieces]

    def reset(self) -> None:
        super().reset()
        self.id_text = self.decoded = None

    def added(self, flat, offsets):
        ids = pa.array(flat)
        lists = pa.array(offsets.astype(np.int32))
        for name, table in (("id_text", self.token_id), ("decoded", self.token_text)):
            text = pc.binary_join(pa.ListArray.from_arrays(lists, table.take(ids)), "")
            old = getattr(self, name)
            setattr(self, name, text if old is None else pa.concat_arrays([old, text]))

    def trim(self, keep):
        super().trim(keep)
        for name in ("id_text", "decoded"):
            setattr(self, name, getattr(self, name).take(pa.array(keep)))

    def strings(self, codes: np.ndarray, bounds: np.ndarray, name: str):
        """Bytes of each text's ids, or of its decoded text, as memory slices."""
        if getattr(self, name) is None:
            return [b""] * (len(bounds) - 1)
        got = getattr(self, name).cast(pa.large_string()).take(pa.array(codes)) if len(codes) > 50_000_000 \
            else getattr(self, name).take(pa.array(codes))
        if isinstance(got, pa.ChunkedArray):
            got = got.combine_chunks()
        kind = np.int64 if pa.types.is_large_string(got.type) else np.int32
        offs = np.frombuffer(got.buffers()[1], dtype=kind)[got.offset:got.offset + len(got) + 1]
        data = memoryview(got.buffers()[2]) if got.buffers()[2] is not None else memoryview(b"")
        edges = offs[bounds].tolist()
        return [data[a:max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, ids): token ids of every whole text, equal to the library's without special tokens added."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))

    def encode(batches):
        coder = worker_coder(held.value, SpeculativeCoder)
        for batch in batches:
            for rows in text_slices(batch):
                flat, offs = coder.encode(rows.column(1))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))],
                    names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(encode, "doc_id long, ids array<int>")


def round_trip_digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again.

    The file has no decoder, so a decoded text is its tokens joined by spaces.
    Text is read once and nothing is shuffled; a batch is worked through in
    slices of bounded bytes. Null and empty texts have no ids and decode to
    the empty text; repeated rows are coded each; null doc_ids stay; an empty
    table gives an empty result; extra columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(tokenizer_json(tokenizer_path))

    def digest(batches):
        coder = worker_coder(held.value, SpeculativeCoder)
        for batch in batches:
            for rows in text_slices(batch):
                codes, bounds = coder.codes(rows.column(1))
                lens = np.concatenate([[0], np.cumsum(np.diff(coder.offsets)[codes])])
                shas = [[hashlib.sha256(s).hexdigest() for s in coder.strings(codes, bounds, name)]
                        for name in ("id_text", "decoded")]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(lens[bounds]).astype(np.int64)),
                     pa.array(shas[0], pa.string()), pa.array(shas[1], pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_text(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
