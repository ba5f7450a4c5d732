"""Encodings inside the operators, against plain versions."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from textloom.llm import lm_scoring, near_dup


def test_units_are_codes_and_marked_halves():
    texts = ["", "abc", "é\x7f日本A|", "x" * 50 + "ü", ""]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.r_[0, np.cumsum([len(r) for r in raw])]
    got, at = lm_scoring.units(data, offs)
    usual = lm_scoring.USUAL
    assert len(set(usual)) == 31
    want = [[u for b in r for u in ([usual.index(bytes([b]))] if bytes([b]) in usual else [31, b // 16, b % 16])] for r in raw]
    assert [got[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want
    back = [lm_scoring.before(got, at, d) for d in (1, 3)]
    for a, b in zip(at[:-1], at[1:]):
        for d, x in zip((1, 3), back):
            assert x[a:b].tolist() == ([0] * d + got[a:b].tolist())[: b - a]


def test_packed_pairs_and_texts_come_back():
    rng = np.random.default_rng(1)
    fam = np.sort(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    low = rng.integers(1, 900, 40)
    high = low + rng.integers(0, 90, 40)
    key = np.unique(rng.integers(0, 40 * 40, 300))
    a, b = key // 40, key % 40
    shared = rng.integers(1, 70000, len(a))
    f, lo, hi, x, y, n = near_dup.unpack_pairs(near_dup.pack_pairs(fam, low, high, a, b, shared))
    assert (f[x] == fam[a]).all() and (f[y] == fam[b]).all() and (n == shared).all()
    assert all((got[q] == want[p]).all() for got, want in ((lo, low), (hi, high)) for q, p in ((x, a), (y, b)))
    texts = [b"one two three four", b"", "ü ä ö é".encode(), b"one two three four"]
    table = pa.RecordBatch.from_pydict({"t": [near_dup.squeeze(np.array([len(t)], np.int64), np.frombuffer(t, np.uint8)) for t in texts], "fp": [1, -2, 3, 4], "fam": [5, 6, 6, 5], "copies": [1, 2, 3, 4], "blocks": [[{"k": 9, "ci": 0, "cj": 1, "own": k % 2}] for k in range(4)]})
    (out,) = near_dup._texts_of(iter([table]))
    rows = list(near_dup.unpack_texts(out.column("blob")[0].as_py(), 3))
    want = list(near_dup.shingle_sets(pa.array([t.decode() for t in texts]), 3))
    assert [r[:4] for r in rows] == [(1, 5, 1, 0), (-2, 6, 2, 1), (3, 6, 3, 0), (4, 5, 4, 1)] and all((r[4] == w).all() for r, w in zip(rows, want))


def test_many_buckets_make_postings_little_larger():
    """Of a larger table a text's tokens lie in more buckets; what is known of its family isn't sent to each of them."""
    rng = np.random.default_rng(2)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 30000, 120)) for _ in range(2000)])
    known = SimpleNamespace(value=(np.zeros(1 << 10, np.uint8), np.zeros(near_dup.CELLS, np.uint16)))
    none = SimpleNamespace(value=(np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    size, seen = {}, {}
    for buckets in (8, 400):
        (out,) = near_dup._postings(3, 0.5, buckets, known, none)(iter([pa.RecordBatch.from_arrays([texts], names=["t"])]))
        size[buckets] = sum(map(len, out.column("blob").to_pylist()))
        seen[buckets] = sum(len(near_dup.unpack(x)[4]) for x in out.column("blob").to_pylist())
        assert out.column("ends").value_lengths().to_pylist() == [near_dup.together(buckets) + 1] * out.num_rows
    assert seen[8] == seen[400] == sum(near_dup.prefix_len(118, 0.5) for _ in range(2000))
    assert size[400] < 1.6 * size[8]


def test_classes_with_groups_of_buckets(spark, monkeypatch):
    """As with one bucket after the other."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 40, 30))) for k in range(60)]
    rows += [(100 + k, t + " and some more") for k, t in rows[:30]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, near_dup.near_classes(docs).collect()))
    assert max(r[2] for r in want) > 0
    monkeypatch.setattr(near_dup, "_PER_BUCKET", 8)
    assert near_dup.together(math.ceil(60 * 28 / 2 / 8)) > 1
    assert sorted(map(tuple, near_dup.near_classes(docs).collect())) == want
