"""Sets of hashed word n-grams, made from Arrow text buffers with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from textloom.llm.common import mix64, text_buffers

_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes that belong to words; texts are in lower case already.
_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
CHUNK_BYTES = 1 << 20
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_B, _INV)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def power_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of bytes times powers, and the powers' inverses: (s[b] - s[a]) * inv[a] is a hash of data[a:b]."""
    p, inv = _pow(len(data))
    s = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=s[1:])
    return s, inv


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the number of words before each text (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    m = _LETTER[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offs] = True
    prev = np.empty_like(m)
    prev[0], prev[1:] = False, m[:-1]
    start = np.flatnonzero(m & (~prev | begins[:-1]))
    nxt = np.empty_like(m)
    nxt[-1], nxt[:-1] = False, m[1:]
    end = np.flatnonzero(m & (~nxt | begins[1:])) + 1
    s, inv = power_sums(data)
    h = mix64((s[end] - s[start]) * inv[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, offs)


def shingle_sets(col: pa.Array, n: int, seen_words=None, weight_of=None) -> Iterator:
    """Of each lower-case text the sorted distinct hashes of its word n-grams.

    A text of fewer than n words, but one at least, has the one n-gram of all
    its words; a null or a text without words has none. seen_words is called
    with the hashes of many words at a time. With weight_of, a weight of each
    word by its hash, pairs are given: the hashes, and the sums of their
    words' weights.
    """
    data, offs = text_buffers(col)
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK_BYTES, side="right")) - 1)
        w, at = word_hashes(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        if seen_words:
            seen_words(w)
        k = max(0, len(w) - n + 1)
        acc = np.zeros(k, dtype=np.uint64)
        for q in range(n):
            acc = mix64(acc * _B + w[q : q + k] + np.uint64(1))
        if weight_of:
            each = weight_of(w)
            sums = np.zeros(k, dtype=each.dtype)
            for q in range(n):
                sums += each[q : q + k]
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= n:
                if weight_of:
                    s, first = np.unique(acc[a : b - n + 1], return_index=True)
                    yield s, sums[a : b - n + 1][first]
                else:
                    yield np.unique(acc[a : b - n + 1])
                continue
            s = np.zeros(min(1, b - a), np.uint64)
            if b > a:
                for q in range(a, b):
                    s = mix64(s * _B + w[q : q + 1] + np.uint64(1))
                s = mix64(s + np.uint64(b - a))
            yield (s, np.zeros(len(s), np.uint16)) if weight_of else s
        i = j


def set_print(s: np.ndarray) -> np.uint64:
    """A fingerprint of a set of hashes."""
    total = mix64(s ^ _B).sum(dtype=np.uint64, keepdims=True)
    return mix64(total * _B + np.uint64(len(s)))[0]
