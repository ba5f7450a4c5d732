"""Edge cases and brute-force versions of the document operators."""

import itertools
import math
import random
import re
import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import chat_format, exact_dedup, gam, licenses, lm_scoring, mixing, near_dup, packing, quality_rules, site_tree

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, tier double, keep boolean"


def frame(spark, rows):
    full = [(i, t, lang, src, len(t or ""), "x", 9.0, None) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ab", "cd", "efg", "hi", "jkl", "mno", "pq"]) + rng.choice(["", "x", "y", "zz", "w1"]) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, rng.choice([1, 5, 40, 80, 300])), rng.choice(["en", "de", None, "xx"]), rng.choice(["a", "b", "c", None])) for k in range(60)]
    rows += [(100, None, "en", "a"), (101, "", "en", "a"), (102, "   \n ", None, None), (103, words(rng, 9000), "en", "a"), (None, "with no id here", "en", "b"), (None, None, None, None)]
    rows += [rows[3], rows[3], (104, rows[3][1], "en", "b"), (105, rows[3][1] + " end", "en", "b"), (3, "another text of the same id", "en", "b"), (106, "", "de", "c")]
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def test_filters_keep_any_columns(spark):
    """Columns named like the operators' own, with dots and back ticks."""
    rng = random.Random(30)
    names = ["ref_c", "ref_w", "__tl_id", "__tl_k", "__tl_lang", "__tl_c", "row", "at", "file", "key", "xx", "fp", "maybe", "sieve_word", "digest", "keeper_id", "tier", "a.b", "a`c"]
    text = "The way of the man is in the house and it was for the day that we had. " * 8
    rows = [(k, text + words(rng, 50) + str(k), "en", "a", *([k] * len(names))) for k in range(20)]
    rows += [(20, rows[3][1], "en", "a", *([20] * len(names))), (21, rows[4][1] + " x", "en", "a", *([21] * len(names))), (22, "$$$ ### %%% @@@ *** " * 40, "en", "a", *([22] * len(names))), (None, None, None, None, *([None] * len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n.replace('`', '``')}` long" for n in names))
    want = {row[0]: row for row in rows}
    for fn, gone in ((quality_rules.quality_filter, {22}), (exact_dedup.dedup_filter, {20}), (near_dup.near_dup_filter, None), (lambda d: mixing.mix_filter(d, None, 1.0), None)):
        kept = fn(docs)
        assert kept.columns == docs.columns
        got = [tuple(r) for r in kept.collect()]
        assert all(r == want[r[0]] for r in got) and len(got) == len({r[0] for r in got})
        if gone is not None:
            assert set(want) - {r[0] for r in got} == gone


# Packing


def brute_pack(docs, shard_of, shards, capacity, most_open, fan_in):
    """Windows as lists of (doc, piece, start, length), by plain scans over all open windows."""

    def place(opened, done, item):
        need = sum(x[3] for x in item)
        fits = [w for w in opened if sum(x[3] for x in w) + need <= capacity]
        if fits:
            least = min(capacity - sum(x[3] for x in w) for w in fits)
            next(w for w in opened if capacity - sum(x[3] for x in w) == least).extend(item)
            return
        if len(opened) >= most_open:
            top = max(sum(x[3] for x in w) for w in opened)
            full = next(w for w in opened if sum(x[3] for x in w) == top)
            opened.remove(full)
            done.append(full)
        opened.append(list(item))

    done, left = [], {}
    for s in range(shards):
        opened = []
        for doc, n in sorted((d for d in docs if shard_of[d[0]] == s), key=lambda d: (d[0] is not None, d[0] or 0, d[1])):
            start = piece = 0
            while n - start > capacity:
                done.append([(doc, piece, start, capacity)])
                start, piece = start + capacity, piece + 1
            place(opened, done, [(doc, piece, start, n - start)])
        left[s] = opened
    level = shards
    while True:
        groups = max(1, -(-level // fan_in))
        nxt = {}
        for g in range(groups):
            opened = []
            for s in range(g * fan_in, min(level, (g + 1) * fan_in)):
                for w in left.get(s, []):
                    place(opened, done, w)
            nxt[g] = opened
        left, level = nxt, groups
        if groups == 1:
            return done + left[0]


@pytest.mark.parametrize("rows_per_shard,fan_in,most_open", [(1000, 64, 3), (7, 2, 2), (5, 64, 4)])
def test_packing_is_brute_force(spark, odd, rows_per_shard, fan_in, most_open):
    from pyspark.sql import functions as F

    got = packing.pack(odd, 100, most_open, rows_per_shard, fan_in).collect()
    shards = -(-odd.count() // rows_per_shard)
    shard_of = {r[0]: r[1] for r in odd.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).collect()}
    docs = [(r.doc_id, len(r.text.split()) + 1) for r in odd.collect() if r.text and r.text.split()]
    want = brute_pack(docs, shard_of, shards, 100, most_open, fan_in)
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.window_id, r.at)):
        assert r.at == sum(x[3] for x in mine[r.window_id])
        mine[r.window_id].append((r.doc_id, r.piece, r.start, r.length))
    assert sorted(map(str, mine.values())) == sorted(map(str, want))
    assert max(sum(x[3] for x in w) for w in mine.values()) <= 100


def test_packing_empty(empty):
    assert packing.pack(empty).collect() == []


# Mixing


def test_mix_budgets_and_nesting(odd, empty):
    got = [(r.doc_id, r.source, r.tier) for r in mixing.mix(odd, None, (0.3, 0.6, 1.0), 0.5).collect()]
    rows = [(r.doc_id, r.source, len((r.text or "").split())) for r in odd.collect()]
    total = Counter()
    for _, s, n in rows:
        total[s] += n
    budget = 0.5 * sum(total.values()) / sum(n > 0 for n in total.values())
    import hashlib

    h = lambda d: int(hashlib.md5(f"{mixing.SEED}:{'null' if d is None else d}".encode()).hexdigest()[:15], 16)
    want = []
    for d, s, n in rows:
        cum = sum(m for e, q, m in rows if q == s and h(e) <= h(d))
        tiers = [f for f in (0.3, 0.6, 1.0) if cum <= int(f * (budget if total[s] else 0))]
        if tiers:
            want.append((d, s, tiers[0]))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert mixing.mix(empty).collect() == []
    kept = mixing.mix_filter(odd, None, 0.5)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _, _ in mixing.mix(odd, None, (1.0,), 0.5).collect())


def test_mix_weights(odd):
    kept = {r.source for r in mixing.mix_filter(odd, {"a": 1.0}, 1.0).collect()}
    assert "a" in kept
    rows = [r for r in mixing.mix_filter(odd, {"a": 1.0}, 1.0).collect() if r.source == "b"]
    assert sum(len((r.text or "").split()) for r in rows) == 0


# Exact deduplication


@pytest.mark.parametrize("bits", [128, 4])
def test_dedup_by_bytes(odd, empty, bits):
    rows = odd.collect()
    got = exact_dedup.dedup(odd, bits).collect()
    assert len(got) == len(rows)
    sets = defaultdict(list)
    for r in rows:
        if r.text is not None:
            sets[r.text].append(r.doc_id)
    first = {t: min(i, key=lambda d: (d is not None, d or 0)) for t, i in sets.items()}
    want = Counter((r.doc_id, r.doc_id if r.text is None else first[r.text]) for r in rows)
    assert Counter((r.doc_id, r.keeper_id) for r in got) == want
    assert sum(r.kept for r in got) == len(sets) + sum(r.text is None for r in rows)
    kept = exact_dedup.dedup_filter(odd, bits)
    assert kept.columns == odd.columns
    texts = [r.text for r in kept.collect()]
    assert Counter(t for t in texts if t is not None) == Counter(set(sets))
    assert exact_dedup.dedup(empty, bits).collect() == []


def test_dedup_state_goes_on(spark, tmp_path):
    schema = "digest string, doc_id long, locator string"  # any type will do for a locator
    from pyspark.sql.types import _parse_datatype_string

    add = lambda rows, k: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    run = lambda: {r.digest: r.keeper.doc_id for r in exact_dedup.run_state(spark, str(tmp_path / "log"), str(tmp_path / "state"), str(tmp_path / "out"), _parse_datatype_string(schema)).collect()}
    add([("a", 5, "x"), ("b", 6, "y")], 0)
    assert run() == {}
    add([("a", 7, "x"), ("c", 8, "z")], 1)
    assert run() == {"a": 5}
    add([("c", 2, "z"), ("a", 9, "x")], 2)
    assert run() == {"a": 5, "c": 2}


# Near duplicates


def brute_sets(rows, n):
    """Of each set its ids; (id, set) of each document, the empty set for texts without words."""
    sets, docs = {}, set()
    for d, text in rows:
        w = re.findall(r"[a-z0-9\x80-\U0010FFFF]+", (text or "").lower())
        if d is not None:
            s = frozenset(([tuple(w)] if len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]) if w else [])
            docs.add((d, s))
            if s:
                sets.setdefault(s, set()).add(d)
    return sets, docs


def brute_near(rows, n, t):
    out = {}
    for (a, x), (b, y) in itertools.combinations(brute_sets(rows, n)[0].items(), 2):
        j = len(a & b) / len(a | b)
        p, q = sorted((min(x), min(y)))
        if j >= t - 1e-9 and p != q:
            out[p, q] = max(out.get((p, q), 0), round(j, 6))
    return out


def brute_classes(rows, n, t):
    """(doc_id, class_id, n_links) and the set of each document."""
    sets, docs = brute_sets(rows, n)
    kinds = list(sets)
    linked = {s: {s} for s in kinds}
    for a, b in itertools.combinations(kinds, 2):
        if len(a & b) / len(a | b) >= t - 1e-9:
            linked[a].add(b)
            linked[b].add(a)
    least, out = {}, []
    for s in kinds:
        seen, todo = {s}, [s]
        while todo:
            for x in linked[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        least[s] = min(min(sets[x]) for x in seen)
    for d, s in docs:
        out.append(((d, least.get(s, d), sum(len(sets[x]) for x in linked[s]) - 1 if s else 0), s))
    return out


@pytest.mark.parametrize("n,t", [(3, 0.5), (1, 0.6), (2, 0.9)])
def test_near_pairs_are_brute_force(odd, empty, n, t, monkeypatch):
    monkeypatch.setattr(near_dup, "_BLOCK_SETS", 3)  # cut neighbourhoods into blocks
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = {(r.doc_a, r.doc_b): r.jaccard for r in near_dup.near_pairs(odd, n, t).collect()}
    assert {k: round(v, 5) for k, v in got.items()} == {k: round(v, 5) for k, v in brute_near(rows, n, t).items()}
    assert Counter(map(tuple, near_dup.near_classes(odd, n, t).collect())) == Counter(r for r, _ in brute_classes(rows, n, t))
    assert near_dup.near_pairs(empty, n, t).collect() == [] and near_dup.near_classes(empty, n, t).collect() == []


@pytest.mark.parametrize("block,popular,gather", [(4096, 1 << 19, 1 << 22), (5, 3, 500)])
def test_classes_of_families(spark, monkeypatch, block, popular, gather):
    """Groups of copies and near copies, a passage that most have, and texts of very different lengths."""
    monkeypatch.setattr(near_dup, "_BLOCK_SETS", block)
    monkeypatch.setattr(near_dup, "POPULAR", popular)
    monkeypatch.setattr(near_dup, "_GATHER", gather)
    rng = random.Random(21)
    w = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage, rows = w(40), []
    for size in (30, 80, 200, 400):
        base = w(size)
        for _ in range(14):
            x = list(base)
            for _ in range(rng.choice([0, 0, 1, size // 20, size // 8])):
                x[rng.randrange(len(x))] = w(1)[0]
            if rng.random() < 0.4:
                at = rng.randrange(len(x))
                x[at:at] = passage
            if rng.random() < 0.2:
                x = x[: rng.randrange(3, len(x))]
            rows.append((len(rows), " ".join(x)))
    rows += [(1000 + k, " ".join(w(50) + passage)) for k in range(20)] + [(3, rows[40][1]), (rows[5][0], rows[5][1])]
    want = brute_classes(rows, 3, 0.5)
    docs = frame(spark, [(i, t, "en", "a") for i, t in rows])
    assert Counter(map(tuple, near_dup.near_classes(docs).collect())) == Counter(r for r, _ in want)
    class_of = {(r[0], s): r[1] for r, s in want}
    kept = [(i, t) for i, t in rows if class_of[i, next(s for d, s in brute_sets([(i, t)], 3)[1])] == i]
    assert Counter((r.doc_id, r.text) for r in near_dup.near_dup_filter(docs).collect()) == Counter(kept)


def test_collisions_within_a_bucket_lose_nothing():
    rng = random.Random(4)
    for t in (0.5, 0.6, 0.9):
        for _ in range(200):
            low = np.array([rng.randrange(1, 40), rng.randrange(1, 40)])
            high = low + np.array([rng.randrange(12), rng.randrange(12)])
            every = [near_dup.least_shared(np.array([x]), np.array([y]), t)[0] for x in range(low[0], high[0] + 1) for y in range(low[1], high[1] + 1) if min(x, y) >= t * max(x, y)]
            assert not every or near_dup.least_of_families(low, high, np.array([0]), np.array([1]), t)[0] <= min(every)
    fam, low, high = np.arange(3, dtype=np.uint64), np.array([4, 5, 9]), np.array([6, 5, 20])
    blob = near_dup.squeeze(np.array([3, 4], np.int64), fam, low.astype(np.uint32), high.astype(np.uint32), np.array([0, 1, 0], np.uint16), np.array([5, 0, 2, 0xFFFF0000], np.uint32), np.array([0, 1, 1, 2], np.uint16))
    got = near_dup.unpack(blob)
    assert [x.tolist() for x in got] == [[0, 1, 2], [4, 5, 9], [6, 5, 20], [0, 1, 0], [5, 5, 7, 0xFFFF0007], [0, 1, 1, 2]]


def test_workers_give_memory_back():
    """A worker that goes on, with something on top of its heap, keeps none of what a task had freed."""
    script = """
import random
import numpy as np, psutil, pyarrow as pa
from textloom.llm import near_dup
rng = random.Random(3)
words = [f"w{k}" for k in range(5000)]
batch = lambda n, k: pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array([" ".join(rng.choices(words, k=k)) for _ in range(n)])], names=["doc_id", "xx", "t"])
for _ in near_dup._facts(3)(iter([batch(2, 50)])):
    pass
free = [np.ones(8000) for _ in range(4000)]
pin = np.ones(8000)
del free
rss = lambda: psutil.Process().memory_info().rss >> 20
before = rss()
for _ in near_dup._facts(3)(iter([batch(2, 50)])):
    pass
print(before - rss())
"""
    got = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=120)
    assert int(got.stdout.split()[-1]) > 150


def test_tokens_that_are_rare_in_each_task_come_last():
    """A passage that each of many tasks has once or twice is known as frequent; other words aren't."""
    rng = random.Random(31)
    w = lambda k: " ".join(f"w{rng.randrange(10**9)}" for _ in range(k))
    passage, blobs, others = w(30), {}, []
    for k in range(60):
        others += [w(40) for _ in range(2)]
        texts = [f"{x} {passage}" for x in others[-2:]]
        b = pa.RecordBatch.from_arrays([pa.array([2 * k, 2 * k + 1], pa.int64()), pa.array([0, 0], pa.int64()), pa.array(texts)], names=["doc_id", "xx", "t"])
        for out in near_dup._facts(3)(iter([b])):
            for part, x in zip(out.column("size").to_pylist(), out.column("tokens").to_pylist()):
                if x is not None:
                    blobs.setdefault(part, []).append(x)
    bits = np.zeros(near_dup.HOT_BITS // 8, np.uint8)
    for part, x in blobs.items():
        own = near_dup.hot_bits(x)
        bits[part * len(own) : (part + 1) * len(own)] = own
    hot = near_dup.Hot(bits)
    sets = lambda texts: np.concatenate(list(near_dup.shingle_sets(pa.array(texts), 3)))
    assert hot(sets([passage])).all() and not hot(sets(others)).any()


def test_the_most_frequent_tokens_are_put_last(monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 4 * near_dup.HOT_PARTS)
    tokens = np.arange(1, 21, dtype=np.uint64) << np.uint64(38)  # of one part
    lists = [tokens[k:] for k in range(20)]  # the last comes 20 times, the first once
    hot = near_dup.Hot(np.r_[near_dup.hot_bits([near_dup.pack_sample(x)[0] for x in lists]), np.zeros((near_dup.HOT_BITS - near_dup.HOT_BITS // near_dup.HOT_PARTS) // 8, np.uint8)])
    assert hot(tokens).tolist() == [0] * 16 + [1] * 4


@pytest.mark.parametrize("cells", [1 << 22, 700])
def test_sets_of_families_are_compared_by_products(monkeypatch, cells):
    monkeypatch.setattr(near_dup, "_TILE_CELLS", cells)
    monkeypatch.setattr(near_dup, "_TILE_SETS", 7)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(60)]
    fp, fam, own = np.arange(60), np.repeat([1, 2, 3], 20), np.arange(60) % 2
    block = near_dup.Block(fp, fam, np.ones(60, np.int64), own, sets, 0.5)
    pairs = (np.array([1, 1, 2]), np.array([1, 2, 2]))
    jac = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    for ci, cj in ((0, 0), (0, 1)):
        got = Counter((*sorted((int(block.fp[i]), int(block.fp[j]))), round(float(x), 9)) for i, js, xs in block.found(pairs, ci, cj) for j, x in zip(js, xs))
        both = [(i, j) for i in range(40) for j in range(i + 1, 40) if ci == cj or own[i] != own[j]]
        assert got == Counter((i, j, round(jac(i, j), 9)) for i, j in both if jac(i, j) >= 0.5)


def test_near_filter_keeps_one_of_each_group(spark, odd, empty):
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(30):
        w = list(base)
        for _ in range(6):
            w[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "a"))
    rows += [(100 + k, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100)), "en", "a") for k in range(5)] + [(None, rows[0][1], "en", "a")]
    kept = near_dup.near_dup_filter(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [0, 100, 101, 102, 103, 104, None]))
    assert near_dup.near_dup_filter(empty).collect() == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 9), (9, 10), (10, 11), (11, 12), (7, 7), (20, 21), (21, 20)]
    got = {r.id: r.root for r in near_dup.components(spark.createDataFrame(edges, "doc_a long, doc_b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 9: 4, 10: 4, 11: 4, 12: 4, 21: 20}


# Licenses


def test_lis_is_longest():
    rng = random.Random(1)
    for _ in range(200):
        seq = [rng.randrange(12) for _ in range(rng.randrange(9))]
        got = [seq[i] for i in licenses.lis(seq)]
        best = max(k for k in range(len(seq) + 1) if any(all(a < b for a, b in zip(c, c[1:])) for c in itertools.combinations(seq, k)))
        assert len(got) == best and all(a < b for a, b in zip(got, got[1:]))


def test_patience_aligns_equal_words_in_order():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(6) for _ in range(rng.randrange(14))]
        b = [rng.randrange(6) for _ in range(rng.randrange(14))]
        p = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in p)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(p, p[1:]))
    assert licenses.patience("x a b c y".split(), "a b c".split()) == [(1, 0), (2, 1), (3, 2)]
    assert len(licenses.patience("a b a b".split(), "b a b a".split())) == 3


def plain_counts(a, b):
    """How many words patience alignment may align, over all longest increasing choices of anchors, by recursion."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    while tail < min(len(a), len(b)) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not a or not b:
        return {head + tail}
    anchors = [(a.index(w), b.index(w)) for w in set(a) & set(b) if a.count(w) == 1 and b.count(w) == 1]
    if not anchors:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return {head + tail + best[-1][-1]}
    anchors.sort(key=lambda p: p[1])
    rising = lambda c: all(x[0] < y[0] for x, y in zip(c, c[1:]))
    size = max(k for k in range(len(anchors) + 1) if any(map(rising, itertools.combinations(anchors, k))))
    found = set()
    for chosen in filter(rising, itertools.combinations(anchors, size)):
        edges = [(-1, -1), *chosen, (len(a), len(b))]
        sums = {head + tail + size}
        for p, q in zip(edges, edges[1:]):
            gap = plain_counts(a[p[0] + 1 : q[0]], b[p[1] + 1 : q[1]])
            sums = {x + y for x in sums for y in gap}
        found |= sums
    return found


def test_patience_is_the_recursion():
    rng = random.Random(41)
    for kinds in (3, 6, 12):
        for _ in range(150):
            a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(11))] for _ in range(2))
            assert len(licenses.patience(a, b)) in plain_counts(a, b)


def test_license_bounds_leave_nothing_out(spark):
    rng = random.Random(5)
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    names = sorted(licenses.TEMPLATES)
    vocab = "the of and to license version software any person this work is foo bar baz".split()
    for _ in range(60):
        text = [rng.choice(vocab) for _ in range(rng.randrange(200))]
        for name in rng.sample(names, 2):
            t = licenses.words_of(licenses.TEMPLATES[name])
            t = [w for w in t if rng.random() > 0.1]
            at = rng.randrange(len(text) + 1)
            text[at:at] = t * rng.choice([1, 1, 2])
        ids = [s.number.get(w, len(s.number)) for w in text]
        full = []
        for k, (name, t) in enumerate(s.templates):
            if b := s.best(ids, k):
                full.append((name, b[0] / len(t), *b))
        assert s.scan(" ".join(text)) == licenses.strongest(full)


def test_licenses_behind_stronger_ones(spark):
    pairs = [(f"Licensed under CC BY-{kind} 4.0.", "Licensed under CC BY 4.0.") for kind in ("NC", "SA")]
    texts = [f"{a} {'foo ' * 60}{b} {'bar ' * 60}{a}" for x in pairs for a, b in (x, x[::-1])]
    got = defaultdict(list)
    for r in licenses.scan_licenses(frame(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect():
        assert r.coverage == 1.0
        got[r.doc_id].append((r.license, r.first, r.last))
    for k, t in enumerate(texts):
        w = licenses.words_of(t)
        want = []
        for name in ("CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0"):
            x = licenses.words_of(licenses.TEMPLATES[name])
            want += [(name, i, i + len(x) - 1) for i in range(len(w)) if w[i : i + len(x)] == x]
        assert len(want) == 3 and sorted(got[k]) == sorted(want)


def test_all_license_places_without_bounds():
    rng = random.Random(15)
    s = licenses.Scanner(licenses.TEMPLATES, 0.8)
    for _ in range(20):
        text = [rng.choice("the of and to license version foo bar".split()) for _ in range(150)]
        for name in rng.sample(sorted(licenses.TEMPLATES), 3):
            at = rng.randrange(len(text) + 1)
            text[at:at] = licenses.words_of(licenses.TEMPLATES[name])
        ids = [s.number.get(w, len(s.number)) for w in text]
        full = {(name, m[0] / len(t), *m) for k, (name, t) in enumerate(s.templates) for m in s.matches(ids, k)}
        assert s.scan_all(" ".join(text)) == licenses.strongest(sorted(full))


def test_license_rows(spark, odd, empty):
    rows = [(1, "Intro.\nReleased under the MIT License.\nMore text", "en", "a"), (2, "Released under the MIT License. " * 3, "en", "a"), (3, None, "en", "a"), (None, "Licensed under CC BY-NC 4.0.", "en", "a"), (5, "x " * 5000 + licenses.TEMPLATES["MIT-text"], "en", "a")]
    got = [(r.doc_id, r.license, r.coverage) for r in licenses.scan_licenses(frame(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, "MIT", 1.0), (2, "MIT", 1.0), (None, "CC-BY-NC-4.0", 1.0), (5, "MIT-text", 1.0)]))
    assert licenses.scan_licenses(odd).collect() == [] and licenses.scan_licenses(empty).collect() == []


# Quality rules


def test_js_distance(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1.0, 3.0], [1.0, 3.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([2.0, 1.0], [1.0, 5.0])], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality_rules.js_distance(F.col("p"), F.col("q"))).collect()]
    p, q = np.array([2 / 3, 1 / 3]), np.array([1 / 6, 5 / 6])
    m = (p + q) / 2
    want = np.sqrt((p * np.log2(p / m) + q * np.log2(q / m)).sum() / 2)
    assert got[0] == 0 and got[1] == 1 and got[2] is None and abs(got[3] - want) < 1e-12


def test_quality_guards(spark, odd, empty):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count()
    assert all(r.keep and r.chars_js is None and r.words_js is None for r in got if r.doc_id in (100, 101, 102))
    assert quality_rules.judge(empty).collect() == []
    clean = "The way of the man is in the house and it was for the day that we had. " * 8
    rows = [(k, clean + str(k), "en", "a") for k in range(40)] + [(90, "$$$ ### %%% @@@ *** " * 40, "en", "a"), (91, "$$$", "en", "a"), (92, "|" * 500, None, "a")]
    docs = frame(spark, rows)
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    given = quality_rules.references(docs.filter("doc_id < 40"))
    assert [r.doc_id for r in quality_rules.judge(docs, given=given).collect() if not r.keep] == [90] and not any(r.keep is None for r in quality_rules.judge(docs, given=given.limit(0)).collect())
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 91, 92]


# Chats


def test_chats(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, 0, 1, 2]), rng.choice([None, "user", "assistant", "é"]), rng.choice([None, "", "hello", "<|im_end|>", "ü\n" * 50]), 7, "z") for _ in range(80)]
    rows += [(9, k, "user", "x" * 1000, 7, "z") for k in range(500)] + rows[:3]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int, head string")
    key = lambda r: [(x is not None, x if x is not None else 0) if i < 2 else (x is not None, (x or "").encode()) for i, x in enumerate(r)]
    want = defaultdict(list)
    for r in sorted((r[:4] for r in rows), key=key):
        want[r[0]].append(f"<|im_start|>{r[2] if r[2] is not None else 'unknown'}\n{r[3] or ''}<|im_end|>\n")
    got = {r.conv_id: (r.text, r.n_turns, r.n_bytes) for r in chat_format.format_chats(df).collect()}
    assert got == {k: ("".join(v), len(v), len("".join(v).encode())) for k, v in want.items()}
    assert chat_format.format_chats(df.limit(0)).collect() == []


def test_chats_across_batches(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat_format, "GATHER", 50)
    rows = [(k // 7, "user", f"text {k}") for k in range(100)]
    t = pa.table({"conv_id": [r[0] for r in rows], "role": [r[1] for r in rows], "text": [r[2] for r in rows]})
    parts = list(chat_format._whole(iter(t.to_batches(max_chunksize=3))))
    assert pa.concat_tables(parts).equals(t)
    ids = [set(p["conv_id"].to_pylist()) for p in parts]
    assert all(not a & b for a, b in itertools.combinations(ids, 2))


# Language-model scores


def scalar_units(text):
    out = []  # (unit, byte)
    for i, x in enumerate(text.encode()):
        k = lm_scoring.USUAL.find(bytes([x]))
        out += [(k, i)] if k >= 0 else [(31, i), (x // 16, i), (x % 16, i)]
    return out


def scalar_bits(text, found, others):
    """The coder for one text, one bit at a time; found: what follows an anchor elsewhere; others: all other texts."""
    f = np.float32
    raw, us = text.encode(), scalar_units(text)
    known = Counter()  # of the other texts: zeros and ones by the two units before and the bits so far
    for x in others:
        v = [u for u, _ in scalar_units(x)]
        for i, u in enumerate(v):
            for j in range(5):
                known[v[i - 2] if i > 1 else 0, v[i - 1] if i else 0, 1 << j | u >> (5 - j), u >> (4 - j) & 1] += 1
    guess, miss = {}, -(10**9)
    at, keys, _ = lm_scoring.anchors_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    for a, k in zip(at.tolist(), keys.view(np.int64).tolist()):
        for d, x in enumerate((found or {}).get(k, b"")[: len(raw) - a]):
            guess[a + d] = x
    state = {}
    for i in range(len(raw)):
        if i in guess:
            state[i] = 1 + sum(i - 1 - miss >= r for r in lm_scoring.RUNS)
            miss = i if guess[i] != raw[i] else miss
    n = len(us)
    slots = max(64, 1 << max(0, math.ceil(math.log2(max(n, 1)))))
    low, high = np.zeros(1024, f), np.zeros(slots, f)
    w = np.array([[list(lm_scoring.FIRST_WEIGHTS)] * 4] * 5, f)
    slope, shift = np.ones(5, f), np.zeros(5, f)
    total, sig = 0.0, lambda x: 1 / (1 + np.exp(-x))
    steps = []
    for i, (u, place) in enumerate(us):
        if i % lm_scoring.UNITS == 0:  # what was learned counts from here
            for where, at, step in steps:
                where[at] += step
            steps = []
        p1, p2, p3 = (us[i - d][0] if i >= d else 0 for d in (1, 2, 3))
        expected, s = None, state.get(place, 0)
        if s:
            own = scalar_units(bytes([raw[place]]).decode("latin-1")) if raw[place] < 128 else [(31, 0), (raw[place] // 16, 0), (raw[place] % 16, 0)]
            k = lm_scoring.USUAL.find(bytes([guess[place]]))
            g = [k] if k >= 0 else [31, guess[place] // 16, guess[place] % 16]
            nth = sum(us[q][1] == place for q in range(i)) if i and us[i - 1][1] == place else 0
            if nth < len(g) and [x for x, _ in own[:nth]] == g[:nth]:
                expected = g[nth]
        for j in range(5):
            bit, node = u >> (4 - j) & 1, 1 << j | u >> (5 - j)
            h = ((p3 << 10 | p2 << 5 | p1) * 0x9E3779B1 + node * 0x85EBCA6B) % 2**32
            h ^= h >> 15
            h = h * 0x2C1B3C6D % 2**32
            h ^= h >> 13
            c1, c3 = p1 * 32 + node, h & (slots - 1)
            odds = math.log((known[p2, p1, node, 1] + 0.4) / (known[p2, p1, node, 0] + 0.4))
            here = s if expected is not None and expected >> (5 - j) == u >> (5 - j) else 0
            m = lm_scoring.TRUST[here] * (1 if here and expected >> (4 - j) & 1 else -1)
            st = np.array([low[c1], high[c3], np.rint(np.clip(odds / lm_scoring.SCALE, -127, 127)) * lm_scoring.SCALE, m], f)
            dot = (st * w[j, here]).sum()
            p, z = sig(dot), sig(dot * slope[j] + shift[j])
            z = z * (1 - 2 * lm_scoring.LEAST) + lm_scoring.LEAST
            total -= np.log2(z if bit else 1 - z)
            step = lm_scoring.MAP_RATE * (bit - z)
            steps += [(shift, j, step), (slope, j, step * dot), (w, (j, here), st * f(lm_scoring.RATE * (bit - p)))]
            steps += [(low, c1, lm_scoring.TABLE_RATES[0] * (bit - sig(low[c1]))), (high, c3, lm_scoring.TABLE_RATES[1] * (bit - sig(high[c3])))]
    return total


def node_counts_of(texts):
    raw = [t.encode() for t in texts]
    u, at = lm_scoring.units(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    v = [lm_scoring.before(u, at, d).astype(int) for d in (2, 1)]
    return lm_scoring.node_counts(np.bincount(v[0] * 1024 + v[1] * 32 + u, minlength=1 << 15))


@pytest.mark.parametrize("units,lanes", [(32, 2048), (1, 3)])
def test_scores_are_the_scalar_coder(monkeypatch, units, lanes):
    monkeypatch.setattr(lm_scoring, "UNITS", units)
    monkeypatch.setattr(lm_scoring, "ANCHOR", 32)
    monkeypatch.setattr(lm_scoring, "LANES", lanes)
    rng = random.Random(6)
    texts = [words(rng, n) + rng.choice(["", "é ñ\x7f"]) for n in (1, 3, 10, 40, 20, 7, 900)] + ["", "a"]
    copied = words(rng, 60) + " É Ü " + words(rng, 200)
    texts += [copied, copied[:300] + "!É?" + copied[300:]]
    raw = [t.encode() for t in texts]
    found = [None] * len(texts)
    for i, j in ((-1, -2), (-2, -1)):
        at, key, _ = lm_scoring.anchors_of(np.frombuffer(raw[j], np.uint8), np.array([0, len(raw[j])]))
        found[i] = {k: raw[j][a:e] for a, e, k in zip(at.tolist(), [*at[1:].tolist(), len(raw[j])], key.view(np.int64).tolist())}
    assert len(found[-1]) > 5
    got = lm_scoring.score_batch(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), found, node_counts_of(texts))
    want = [scalar_bits(t, found[i], texts[:i] + texts[i + 1 :]) for i, t in enumerate(texts)]
    assert np.allclose(got, want, rtol=2e-3, atol=2e-2)
    alone = lm_scoring.score_batch(np.frombuffer(raw[-1], np.uint8), np.array([0, len(raw[-1])]), [None], node_counts_of(texts))
    assert got[-1] < 0.75 * alone[0]


def test_texts_with_and_without_matches_are_coded_together(monkeypatch):
    rng = random.Random(61)
    texts = [words(rng, n) for n in (400, 3, 90, 17, 230, 1)] + ["É", "abc" * 700]
    raw = [t.encode() for t in texts] * 2
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    at, key, _ = lm_scoring.anchors_of(np.frombuffer(raw[0], np.uint8), np.array([0, len(raw[0])]))
    found = [{k: raw[0][a : a + 90] for a, k in zip(at.tolist(), key.view(np.int64).tolist())} if i in (0, 8) else None for i in range(len(raw))]
    calls, coder = [], lm_scoring.code_lengths
    monkeypatch.setattr(lm_scoring, "code_lengths", lambda t, own: calls.append(len(own)) or coder(t, own))
    want = lm_scoring.score_batch(data, offs, found, node_counts_of(texts))
    assert found[0] and calls == [len(raw)] and np.allclose(want[:8], want[8:], rtol=1e-5)
    for lanes, near, stretch, blocks in ((3, 2, 1, 1), (5, 32, 3000, 4), (4096, 4, 1 << 20, 64)):
        for name, value in (("LANES", lanes), ("NEAR", near), ("STRETCH", stretch), ("MOST_BLOCKS", blocks)):
            monkeypatch.setattr(lm_scoring, name, value)
        assert np.allclose(lm_scoring.score_batch(data, offs, found, node_counts_of(texts)), want, rtol=1e-5)


def test_lanes_are_refilled(monkeypatch):
    rng = random.Random(62)
    blocks = sorted((rng.choice([1, 2, 5, 30, 200]) for _ in range(300)), reverse=True)
    lane, first, load = lm_scoring._lanes(blocks, 8)
    for k in range(8):
        own = sorted((f, n) for f, n, x in zip(first.tolist(), blocks, lane.tolist()) if x == k)
        assert [f for f, _ in own] == [0, *itertools.accumulate(n for _, n in own)][:-1] and sum(n for _, n in own) == load[k]
    assert sorted(load, reverse=True) == load.tolist() and load[0] - load[-1] <= 5
    # A text behind others in a lane has the bits that it has alone, with a match or without.
    texts = [words(rng, n).encode() for n in (300, 1, 40, 7, 150, 90, 2, 25, 60)] + [b"", "É".encode()]
    data, offs = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    at, key, _ = lm_scoring.anchors_of(data, offs)
    every = {k: bytes(data[a : a + 50]) for a, k in zip(at.tolist(), key.view(np.int64).tolist())}
    found, counts = [every if i % 2 else None for i in range(len(texts))], node_counts_of([t.decode() for t in texts])
    alone = [lm_scoring.score_batch(np.frombuffer(t, np.uint8), np.array([0, len(t)]), [f], counts)[0] for t, f in zip(texts, found)]
    for lanes in (1, 2, 3):
        monkeypatch.setattr(lm_scoring, "LANES", lanes)
        assert every and np.allclose(lm_scoring.score_batch(data, offs, found, counts), alone, rtol=1e-5)


def test_corpus_counts_and_followers(spark, odd, empty):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefgh ijk") for _ in range(n))
    passage = text(900)
    rows = [(k, text(700)) for k in range(6)] + [(10 + k, text(rng.randrange(300)) + passage + text(200)) for k in range(4)] + [(20, passage), (21, passage), (21, passage), (22, None), (23, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert (lm_scoring.node_counts(lm_scoring.corpus_counts(df))[0] == node_counts_of([t or "" for _, t in rows])[0]).all()
    got = {r.doc: {x["key"]: bytes(x["rest"]) for x in r.found} for r in lm_scoring.followers(df.selectExpr("doc_id as doc", "text")).collect()}
    of = defaultdict(dict)  # key: id: window and place
    for k, t in rows:
        raw = (t or "").encode()
        at, key, _ = lm_scoring.anchors_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for a, x in zip(at.tolist(), key.view(np.int64).tolist()):
            if a < len(raw):
                of[x].setdefault(k, raw[a - lm_scoring.WINDOW :])
    shared = {x: v for x, v in of.items() if len(v) > 1}
    assert len(shared) > 5 and {(k, x) for x, v in shared.items() for k in v} == {(k, x) for k, v in got.items() for x in v}
    for k, v in got.items():
        for x, rest in v.items():
            assert any(t[lm_scoring.WINDOW :].startswith(rest) and t[: lm_scoring.WINDOW] == shared[x][k][: lm_scoring.WINDOW] for i, t in shared[x].items() if i != k)
    assert 0 not in got and {10, 13, 20, 21} <= set(got)
    by = {r.doc_id: r.bits_per_byte for r in lm_scoring.score(df).collect()}
    assert max(by[20], by[21]) < 0.5 * min(by[k] for k in range(6))
    assert lm_scoring.score(empty).collect() == []


def test_texts_of_all_lengths_are_scored_once(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(k, words(rng, rng.choice([1, 50, 300, 700]))) for k in range(30)] + [(30, None), (31, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.bits for r in lm_scoring.score(df).collect()}
    monkeypatch.setattr(lm_scoring, "HELD", 4000)
    split = {r.doc_id: r.bits for r in lm_scoring.score(df.repartition(5)).collect()}
    assert len(split) == len(rows) and all(abs(split[k] - v) < 1e-2 + 1e-3 * v for k, v in whole.items())


def test_score_rows(odd):
    got = lm_scoring.score(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[100].bits == 0 and by[100].bits_per_byte is None and by[101].bits_per_byte is None
    assert 0 < by[103].bits_per_byte < 5


# Quality classifier


def labelled(rng, n):
    rows, labels = [], []
    for k in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        w = words(rng, 60).split()
        if bad:
            w = [x.upper() + "$$$" for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["moron", "idiot", "scum"])
        rows.append((k, " ".join(w), "en", "a"))
        labels.append((k, int(not bad), int(toxic), "x"))
    return rows, labels


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(9)
    rows, labels = labelled(rng, 600)
    docs = frame(spark, rows)
    given = spark.createDataFrame(labels[:300] + [(None, 1, 1, "x"), (5000, 1, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = {r.doc_id: r for r in gam.classify(docs, given).collect()}
    held = labels[300:]
    assert np.mean([(got[k].quality_score > 0.5) == q for k, q, _, _ in held]) > 0.97
    assert np.mean([(got[k].toxic_score > 0.5) == t for k, _, t, _ in held]) > 0.97
    assert np.mean([got[k].keep for k, q, t, _ in held if q and not t]) > 0.97


def test_all_toxic_words_count(spark):
    rows = [(f"fine {chr(97 + k % 26) * 3} good", 0) for k in range(300)] + [(f"bad{chr(97 + k // 26)}{chr(97 + k % 26)} x", 1) for k in range(100) for _ in range(5)]
    got = gam.toxic_words(spark.createDataFrame(rows, "text string, toxic int"))
    assert {f"bad{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)} <= got


def test_classifier_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = gam.classify(odd, none).collect()
    assert len(got) == odd.count() and all(r.keep for r in got)
    assert gam.classify(empty, none).collect() == []


def plain_tree(g, h, leaves, lam):
    score = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + lam)
    runs = [(0, len(g))]
    while len(runs) < leaves:
        cuts = [(score(a, c) + score(c, b) - score(a, b), q, c) for q, (a, b) in enumerate(runs) for c in range(a + 1, b)]
        if not cuts or max(x[0] for x in cuts) <= 1e-9:
            break
        _, q, c = max(cuts, key=lambda x: (round(x[0], 12), -x[1], -x[2]))
        runs[q : q + 1] = [(runs[q][0], c), (c, runs[q][1])]
    out = [0.0] * len(g)
    for a, b in runs:
        out[a:b] = [sum(g[a:b]) / (sum(h[a:b]) + lam)] * (b - a)
    return out


def plain_pair(g, h, lam):
    best = (-1.0, None)
    n, m = len(g), len(g[0])
    for i in range(1, n):
        for j in range(1, m):
            parts = [(range(x, y), range(u, v)) for x, y in ((0, i), (i, n)) for u, v in ((0, j), (j, m))]
            sums = [(sum(g[r][c] for r in rs for c in cs), sum(h[r][c] for r in rs for c in cs)) for rs, cs in parts]
            gain = sum(a * a / (b + lam) for a, b in sums)
            if gain > best[0] + 1e-12:
                best = (gain, [(rs, cs, a / (b + lam)) for (rs, cs), (a, b) in zip(parts, sums)])
    out = [[0.0] * m for _ in range(n)]
    for rs, cs, v in best[1] or []:
        for r in rs:
            for c in cs:
                out[r][c] = v
    return best[0], out


def test_boosting_is_plain_loops():
    rng = np.random.default_rng(3)
    for _ in range(20):
        g, h = rng.standard_normal(9), rng.random(9)
        assert np.allclose(gam.shallow_tree(g, h, 3, 1.0), plain_tree(g.tolist(), h.tolist(), 3, 1.0))
        g, h = rng.standard_normal((4, 5)), rng.random((4, 5))
        gain, values = plain_pair(g.tolist(), h.tolist(), 1.0)
        mine = gam._pair_tree(g, h, 1.0)
        assert np.isclose(mine[0], gain) and np.allclose(mine[1], values)
    x, y = rng.random((80, 3)).round(1), (rng.random(80) < 0.4).astype(float)
    y[x[:, 0] > 0.6] = 1.0
    head = gam.fit(x, y, rounds=3, bins=6, n_pairs=1, pair_bins=3, pair_rounds=2)
    # The same row by row.
    base = math.log(y.mean() / (1 - y.mean()))
    cuts = lambda k, n: sorted({float(np.quantile(x[:, k], q)) for q in np.linspace(0, 1, n + 1)[1:-1]})
    fine, coarse = [cuts(k, 6) for k in range(3)], [cuts(k, 3) for k in range(3)]
    bin_of = lambda edges, v: sum(v >= e for e in edges)
    scores, tables = [base] * len(y), [[0.0] * (len(e) + 1) for e in fine]
    sig = lambda v: 1 / (1 + math.exp(-v))
    for _ in range(3):
        for k in range(3):
            g, h = [0.0] * len(tables[k]), [0.0] * len(tables[k])
            for r in range(len(y)):
                q = bin_of(fine[k], x[r, k])
                g[q] += y[r] - sig(scores[r])
                h[q] += sig(scores[r]) * (1 - sig(scores[r]))
            step = [0.1 * v for v in plain_tree(g, h, 3, 1.0)]
            tables[k] = [a + b for a, b in zip(tables[k], step)]
            scores = [s + step[bin_of(fine[k], x[r, k])] for r, s in enumerate(scores)]
    assert all(np.allclose(a, b) for a, b in zip(head.tables, tables))

    def sums(i, j):
        g, h = ([[0.0] * (len(coarse[j]) + 1) for _ in range(len(coarse[i]) + 1)] for _ in range(2))
        for r in range(len(y)):
            a, b = bin_of(coarse[i], x[r, i]), bin_of(coarse[j], x[r, j])
            g[a][b] += y[r] - sig(scores[r])
            h[a][b] += sig(scores[r]) * (1 - sig(scores[r]))
        return g, h

    _, i, j = max((plain_pair(*sums(i, j), 1.0)[0], i, j) for i, j in ((0, 1), (0, 2), (1, 2)))
    table = np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))
    for _ in range(2):
        step = 0.1 * np.array(plain_pair(*sums(i, j), 1.0)[1])
        table += step
        scores = [s + step[bin_of(coarse[i], x[r, i]), bin_of(coarse[j], x[r, j])] for r, s in enumerate(scores)]
    assert [(a, b) for a, b, _ in head.pairs] == [(i, j)] and np.allclose(head.pairs[0][2], table)
    assert np.allclose(head.score(x), [sig(s) for s in scores])


def test_pairs_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(gam.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    head = gam.fit(x, y)
    assert (2, 5) in [(i, j) for i, j, _ in head.pairs]
    assert ((head.score(x) > 0.5) == y).mean() > 0.9


# HTML


def test_parse_broken_html():
    t = site_tree.parse("<html><head><title>no</title></head><body><p>one<p>two <b>bold<br>x</p></i><script>var a='</p>';</script><!-- c --><ul><li>a<li>b</ul>&amp; end")
    assert site_tree.text_of(t, frozenset()) == "one\ntwo bold\nx\na\nb\n& end"
    assert site_tree.text_of(site_tree.parse(None), frozenset()) == ""
    assert site_tree.text_of(site_tree.parse("a < b <"), frozenset()).split() == ["a", "<", "b", "<"]


def page(k, rng):
    return f"<html><body><div class='nav'><a href=/>Home</a><a href=/x>About us</a></div><article><h1>T{k} {words(rng, 3)}</h1><p>{words(rng, 30)}</p></article><div class=foot>All rights reserved</div></body></html>"


def plain_texts(pages, threshold, gamma, least):
    """Extraction over nested dictionaries of a host's pages, by recursion; pages: parsed trees, each different."""
    if len(pages) < least:
        return [site_tree.text_of(p, frozenset()) for p in pages]

    def kids(node):
        """The node's style and its children with their number in it."""
        runs, out = [], []
        for k in node.kids:
            if not runs or runs[-1] != k.label:
                runs.append(k.label)
            out.append((len(runs) - 1, k))
        return tuple(runs), out

    merged = {}  # path: pages, styles with their pages, contents with their pages

    def walk(node, path, page):
        m = merged.setdefault(path, {"pages": set(), "styles": defaultdict(set), "contents": defaultdict(set)})
        m["pages"].add(page)
        if not node.kids:
            m["contents"][node.text or node.label].add(page)
            return
        style, own = kids(node)
        m["styles"][style].add(page)
        for i, k in own:
            walk(k, (*path, (style, i, k.label)), page)

    for n, p in enumerate(pages):
        walk(p, (), n)

    def entropy(sizes, m):
        total = sum(sizes)
        return 1.0 if m <= 1 else -sum(s / total * math.log(s / total) for s in sizes) / math.log(m)

    def importance(path):
        m = merged[path]
        many, parts = len(m["pages"]), []
        if m["styles"]:
            sizes = {s: len(x) for s, x in m["styles"].items()}
            total, node = sum(sizes.values()), min(1.0, entropy(sizes.values(), many))
            lower = 0.0
            for s, n in sizes.items():
                below = [importance(p) for p in merged if len(p) == len(path) + 1 and p[:-1] == path and p[-1][0] == s]
                lower += n / total * (sum(below) / len(below) if below else node)
            share = gamma ** len(sizes)
            parts.append((total, (1 - share) * node + share * lower))
        if m["contents"]:
            sizes = [len(x) for x in m["contents"].values()]
            # 1 less the mean of log n over the contents, against the log of the pages.
            own = 1.0 if many <= 1 else 1 - sum(math.log(s) for s in sizes) / len(sizes) / math.log(many)
            parts.append((max(1.0, many - sum(len(x) for x in m["styles"].values())), own))
        return sum(w * x for w, x in parts) / sum(w for w, _ in parts)

    good = {p for p in merged if importance(p) >= threshold}
    alive = {p[:k] for p in good for k in range(len(p) + 1)}

    def cut(node, path):
        out = site_tree.Node(node.label, node.text)
        style, own = kids(node)
        out.kids = [cut(k, (*path, (style, i, k.label))) for i, k in own if (*path, (style, i, k.label)) in alive]
        return out

    return [site_tree.text_of(cut(p, ()), frozenset()) if () in alive else "" for p in pages]


def test_extraction_is_a_plain_tree(spark):
    rng = random.Random(40)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Home", "About", words(rng, 3), words(rng, 8), "<br>", ""])
        tag = rng.choice(["div", "p", "ul", "span class=x", "section"])
        return f"<{tag}>" + "".join(part(depth - 1) for _ in range(rng.randrange(4))) + f"</{tag.split()[0]}>"

    shared = [part(3) for _ in range(4)]
    pages = [(k, f"http://h{k % 3}.org/{k}", "<body>" + "".join(rng.choice([part(3), *shared]) if rng.random() < 0.5 else shared[q] for q in range(4)) + f"<p>{words(rng, 12)}</p>" * rng.randrange(2) + "<footer>end</footer></body>") for k in range(40)]
    pages.append((99, "http://h0.org/deep", "<div>" * 300 + "deep" + "</div>" * 300))
    df = spark.createDataFrame(pages + pages[:5], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_tree.extract(df).collect()}
    for h in range(3):
        own = {}
        for k, url, x in pages:
            if url.startswith(f"http://h{h}."):
                own.setdefault(x, []).append(k)
        for (x, ids), text in zip(own.items(), plain_texts([site_tree.parse(x) for x in own], site_tree.THRESHOLD, site_tree.GAMMA, site_tree.MIN_PAGES)):
            assert all(got[k] == text for k in ids), (x, text, [got[k] for k in ids])


def test_site_tree_cuts_boilerplate(spark):
    rng = random.Random(7)
    rows = [(k, f"http://User@A.example.com:80/{k}", page(k, rng), "c") for k in range(20)] + [(50, "http://b.example.com/1", page(50, rng), "c"), (51, None, page(51, rng), "c"), (52, "http://b.example.com/2", None, "c"), (53, "http://c.example.com/", "", "c")]
    rows += [(60, "http://d.example.com/1", rows[0][2], "c")] * 2 + [(61, "http://d.example.com/2", rows[0][2], "c")] + [rows[5]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = defaultdict(list)
    for r in site_tree.extract(df).collect():
        got[r.page_id].append(r.text)
    assert sum(map(len, got.values())) == len(rows)
    for k in range(20):
        assert f"T{k} " in got[k][0] and "About us" not in got[k][0] and "rights" not in got[k][0]
    assert "About us" in got[50][0] and "About us" in got[51][0] and got[52] == [""] and got[53] == [""]
    assert all("T0 " in t for t in got[60] + got[61]) and len(got[5]) == 2
    assert site_tree.extract(df.limit(0)).collect() == []
