"""Word and shingle hashes of whole texts, in numpy over Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once (cut at white space), so that scratch arrays stay small.
BLOCK = 512 << 10
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_PLACE = mix(np.arange(1, 6, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)


def _powers(n: int):
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        back = pow(_BASE, -1, 1 << 64)
        steps = np.full(n, _BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
        steps[1:] = back
        _INVERSES = np.multiply.accumulate(steps)
    return _POWERS, _INVERSES


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def _space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, runs of non-white-space bytes) and each document's word offsets."""
    words, starts, _ = hashed_words(buf, offsets)
    return words, np.searchsorted(starts, offsets)


def hashed_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, start bytes, end bytes) of all words of the documents that lie at ``offsets`` in ``buf``."""
    hashes, starts_of, ends_of = [], [], []
    at, n = 0, len(buf)
    borders = offsets[1:-1]
    while at < n:
        stop = min(n, at + BLOCK)
        while stop < n:  # cut at white space or at a document's start, and further on inside a longer word
            gap = np.flatnonzero(_space(buf[at:stop]))
            cut = at + int(gap[-1]) + 1 if len(gap) else 0
            k = int(np.searchsorted(borders, stop, side="right"))
            cut = max(cut, int(borders[k - 1]) if k and borders[k - 1] > at else 0)
            if cut > at:
                stop = cut
                break
            stop = min(n, at + 2 * (stop - at))
        part = buf[at:stop]
        space = _space(part)
        low = np.where((part >= 65) & (part <= 90), part + np.uint8(32), part)
        first = ~space
        first[1:] &= space[:-1]
        inner = borders[(borders > at) & (borders < stop)] - at
        first[inner] = ~space[inner]
        last = ~space
        last[:-1] &= space[1:]
        last[inner - 1] = ~space[inner - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE[low] * power[:len(part)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64)))
        starts_of.append(s + at)
        ends_of.append(e + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts_of), np.concatenate(ends_of)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than ``size`` make one shingle, no words none."""
    buf, offsets = text_bytes(texts)
    words, bounds = word_hashes(buf, offsets)
    run = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for i in range(size):
        run += words[i:len(words) - size + 1 + i] * _PLACE[i]
    run = mix(run + _U(size))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= size:
            own = np.sort(run[a:b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            short = np.zeros(1, np.uint64)
            for i in range(b - a):
                short += words[a + i:a + i + 1] * _PLACE[i:i + 1]
            out.append(mix(short + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
