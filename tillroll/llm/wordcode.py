"""Token ids of whole texts through a cache of whitespace-separated chunks.

The tokenizer lower-cases, drops white space and never joins characters
across it, so a text's ids are the ids of its whitespace-separated chunks in a
row. Each batch is split and dictionary-encoded by Arrow; only chunks that the
worker has not met are tokenised. At a fixed number of entries a cache drops
its less used half, which bounds memory and changes no result.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: What the tokenizer file splits on, written here for chunks of Latin text (checked against the file).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of these characters are NFC already and lower-case character by character.
PLAIN = r"^[!-~\x{a1}-\x{24f}]*$"
PRETOKEN = regex.compile(SPLIT + r"|\n")
#: Entries after which a worker's caches drop the less used half.
CACHE_CHUNKS = 300_000


def ragged_take(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray):
    """Rows ``codes`` of a ragged array: (values, offsets)."""
    starts = offsets[codes]
    lens = offsets[codes + 1] - starts
    out = np.zeros(len(codes) + 1, dtype=np.int64)
    np.cumsum(lens, out=out[1:])
    kind = np.int32 if max(len(flat), int(out[-1])) < 1 << 31 else np.int64  # half the scratch memory
    at = np.repeat((starts - out[:-1]).astype(kind), lens)
    at += np.arange(out[-1], dtype=kind)
    return flat[at], out


class LibraryWords:
    """Ids of pre-tokenised words by the tokenizers library, many words per call."""

    def __init__(self, tokenizer, ends: np.ndarray):
        self.tokenizer, self.ends = tokenizer, ends

    def encode(self, words: list[str]):
        lines = [" ".join(words[i:i + 500]) for i in range(0, len(words), 500)]
        found = self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)
        ids = (np.concatenate([np.array(e.ids, dtype=np.int32) for e in found])
               if found else np.zeros(0, np.int32))
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words):  # a word that the library would split again: one by one
            each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
            return np.array([i for e in each for i in e], dtype=np.int32), offsets
        return ids, np.concatenate([[0], stops]).astype(np.int64)


class ChunkCoder:
    """Encodes Arrow string arrays; keeps words and chunks met before.

    ``words`` maps a list of pre-tokens to ragged ids; the default asks the
    tokenizers library. Chunks with characters outside plain Latin text, or
    with a special token's string, are left to ``_encode_odd``: here they go
    to the library whole.
    """

    def __init__(self, source: str, words=None, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        spec["truncation"] = spec["padding"] = None
        self.tokenizer = Tokenizer.from_str(json.dumps(spec))
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.tokens = [""] * size
        for t, i in vocab.items():
            self.tokens[i] = t
        for t in spec["added_tokens"]:
            self.tokens[t["id"]] = t["content"]
        self.special = [t["content"] for t in spec["added_tokens"]]
        ends = np.array([t.endswith("</w>") for t in self.tokens])
        kinds = [n.get("pattern", {}).get("Regex") for n in spec["pre_tokenizer"].get("pretokenizers", [])]
        self.plain = SPLIT in kinds
        self.words = words or LibraryWords(self.tokenizer, ends)
        self.cache_chunks = cache_chunks
        self.reset()

    def reset(self) -> None:
        self.known_words = pa.array([], pa.string())
        self.word_flat = np.zeros(0, np.int32)
        self.word_offsets = np.zeros(1, np.int64)
        self.known = None
        self.uses = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        self.offsets = np.zeros(1, np.int64)

    def _encode_chunks(self, chunks: pa.Array):
        """Ragged ids of new chunks."""
        odd = np.asarray(pc.invert(pc.match_substring_regex(chunks, PLAIN)))
        if not self.plain:
            odd = np.ones(len(chunks), dtype=bool)
        for s in self.special:
            odd = odd | np.asarray(pc.match_substring(chunks, s))
        plain = chunks.filter(pa.array(~odd)).to_pylist()
        flat, offsets = self._encode_plain(plain)
        if not odd.any():
            return flat, offsets
        odd_flat, odd_offsets = self._encode_odd(chunks.filter(pa.array(odd)).to_pylist())
        lens = np.zeros(len(chunks), dtype=np.int64)
        lens[~odd] = np.diff(offsets)
        lens[odd] = np.diff(odd_offsets)
        ends = np.concatenate([[0], np.cumsum(lens)])
        out = np.zeros(ends[-1], dtype=np.int32)
        from_plain = np.repeat(~odd, lens)
        out[from_plain] = flat
        out[~from_plain] = odd_flat
        return out, ends

    def _encode_odd(self, chunks: list[str]):
        """The same for chunks that are not plain."""
        whole = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        parts = [np.array(e.ids, dtype=np.int32) for e in whole]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _encode_plain(self, chunks: list[str]):
        """The same for chunks of Latin text: all are split at once."""
        if not chunks:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return self._encode_words(PRETOKEN.findall("\n".join([*chunks, ""]).lower()), len(chunks))

    def _encode_words(self, words: list[str], chunks: int):
        """Ragged ids of ``chunks`` chunks, given as words with a line break behind each; new words are encoded once."""
        words = pa.array(words).dictionary_encode()
        at = np.asarray(words.indices)
        found = pc.index_in(words.dictionary, value_set=self.known_words)
        missing = np.asarray(found.is_null())
        place = np.asarray(found.fill_null(0)).astype(np.int64)
        mark = words.dictionary.index("\n").as_py()  # the border between chunks
        missing[mark] = False
        place[missing] = len(self.known_words) + np.arange(int(missing.sum()))
        if missing.any():
            fresh = words.dictionary.filter(pa.array(missing))
            ids, offs = self.words.encode(fresh.to_pylist())
            self.known_words = pa.concat_arrays([self.known_words, fresh])
            self.word_flat = np.concatenate([self.word_flat, ids])
            self.word_offsets = np.concatenate([self.word_offsets, offs[1:] + self.word_offsets[-1]])
        border = at == mark
        flat, offs = ragged_take(self.word_flat, self.word_offsets, place[at[~border]])
        edge = np.flatnonzero(border) - np.arange(chunks)  # words up to each chunk's end
        return flat, offs[np.concatenate([[0], edge])]

    def codes(self, texts: pa.Array):
        """(codes of all chunks in a row, offsets of the texts among them); see ``flat`` and ``offsets``."""
        if self.known is not None and len(self.known) > self.cache_chunks:
            self.trim(np.sort(np.argsort(-self.uses, kind="stable")[:self.cache_chunks // 2]))
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()) if texts.nbytes > 1 << 30 else texts)
        bounds = np.asarray(split.offsets).astype(np.int64)
        bounds -= bounds[0]
        pieces = split.flatten()
        encoded = pieces.dictionary_encode()
        words, at = encoded.dictionary, np.asarray(encoded.indices)
        # leading or trailing white space gives empty pieces, which have no ids
        if self.known is None:
            place = np.arange(len(words), dtype=np.int32)
            fresh = words
        else:
            found = pc.index_in(words, value_set=self.known)
            missing = np.asarray(found.is_null())
            place = np.asarray(found.fill_null(0)).astype(np.int32)
            place[missing] = len(self.known) + np.arange(int(missing.sum()))
            fresh = words.filter(pa.array(missing))
        if len(fresh):
            flat, offs = self._encode_chunks(fresh)
            self.added(flat, offs)
            self.flat = np.concatenate([self.flat, flat])
            self.offsets = np.concatenate([self.offsets, offs[1:] + self.offsets[-1]])
            self.known = fresh if self.known is None else pa.concat_arrays([self.known, fresh])
        if not len(at):
            return np.zeros(0, np.int64), bounds
        codes = place[at]
        counts = np.bincount(codes, minlength=len(self.known))
        counts[:len(self.uses)] += self.uses
        self.uses = counts
        return codes, bounds

    def trim(self, keep: np.ndarray) -> None:
        """Keep only the chunks ``keep`` (ascending), and the words met first, which are the common ones."""
        self.known = self.known.take(pa.array(keep))
        self.flat, self.offsets = ragged_take(self.flat, self.offsets, keep)
        self.uses = self.uses[keep]
        words = min(len(self.known_words), self.cache_chunks // 2)
        self.known_words = self.known_words.take(pa.array(np.arange(words)))
        self.word_offsets = self.word_offsets[:words + 1].copy()
        self.word_flat = self.word_flat[:self.word_offsets[-1]].copy()

    def added(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        """Called with the ids of chunks that join the cache."""

    def encode(self, texts: pa.Array):
        """Ragged ids of the texts: (flat int32, offsets)."""
        codes, bounds = self.codes(texts)
        flat, offs = ragged_take(self.flat, self.offsets, codes)
        return flat, offs[bounds]


_CODERS: dict = {}


def worker_coder(source: str, kind=ChunkCoder, **options):
    """This worker's coder for a tokenizer; tasks that reuse the worker reuse its cache."""
    key = (kind.__name__, hash(source), tuple(sorted(options.items())))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = kind(source, **options)
    return _CODERS[key]
