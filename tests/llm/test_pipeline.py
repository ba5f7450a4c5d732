"""The whole pipeline against plain Python."""

import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import corpus_pipeline
from test_small_operators import brute_classes, brute_pack, frame

from textloom.llm import mixing, near_dup, packing
from textloom.llm import quality_rules as q


def chars(text):
    c = Counter("upper" if unicodedata.category(x) == "Lu" else "lower" if unicodedata.category(x) == "Ll" else "digit" if x in "0123456789" else "space" if x in " \t\n\r" else "mark" if x in ".,;:!?'\"()-" else "rest" for x in text)
    return [c[k] for k in q.CLASSES]


def common(text, lang):
    if lang not in q.COMMON_WORDS:
        return None
    w = [x for x in re.split(r"[ \t\n\r.,;:!?]+", text.lower()) if x]
    own = [w.count(x) for x in q.COMMON_WORDS[lang]]
    return [*own, len(w) - sum(own)]


def js(p, r):
    if not sum(p) or not sum(r):
        return 0
    p, r = [x / sum(p) for x in p], [x / sum(r) for x in r]
    return math.sqrt(max(0, sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0) for a, b in zip(p, r)) / 2))


def brute_quality(docs):
    refs = {}
    for fn in (chars, common):
        for d in docs:
            h = fn(d["text"] or "") if fn is chars else fn(d["text"] or "", d["lang"])
            if h:
                old = refs.get((fn, d["lang"]))
                refs[fn, d["lang"]] = [a + b for a, b in zip(old, h)] if old else h
    kept = []
    for d in docs:
        c, w = chars(d["text"] or ""), common(d["text"] or "", d["lang"])
        bad = sum(c) >= q.MIN_CHARS and round(js(c, refs[chars, d["lang"]]), 6) > q.MAX_CHARS_JS
        bad |= w is not None and sum(w) >= q.MIN_WORDS and round(js(w, refs[common, d["lang"]]), 6) > q.MAX_WORDS_JS
        kept += [] if bad else [d]
    return kept


def brute_exact(docs):
    first = {}
    for d in docs:
        if d["text"] is not None:
            first[d["text"]] = min(first.get(d["text"], d["doc_id"]), d["doc_id"])
    return [d for d in docs if d["text"] is None or first[d["text"]] == d["doc_id"]]


def brute_groups(docs):
    first = {r[0] for r, _ in brute_classes([(d["doc_id"], d["text"]) for d in docs], near_dup.N, near_dup.THRESHOLD) if r[0] == r[1]}
    return [d for d in docs if d["doc_id"] in first]


def brute_mix(docs):
    tokens, by = Counter(), defaultdict(list)
    for d in docs:
        n = len((d["text"] or "").split())
        tokens[d["source"]] += n
        by[d["source"]].append((int(hashlib.md5(f"{mixing.SEED}:{d['doc_id']}".encode()).hexdigest()[:15], 16), n, d))
    each = mixing.SHARE * sum(tokens.values()) / max(1, sum(n > 0 for n in tokens.values()))
    out = []
    for s, rows in by.items():
        total = 0
        for _, n, d in sorted(rows, key=lambda r: r[0]):
            total += n
            if total <= math.floor(each if tokens[s] else 0):
                out.append(d)
    return out


def test_pipeline_is_brute_force(spark, tmp_path):
    rng = random.Random(5)
    some = ["the", "of", "and", "to", "a", "in", "is", "that"]

    def prose(n):
        return " ".join(rng.choice(some) if rng.random() < 0.4 else "".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)) + "."

    rows = [(k, prose(rng.choice([20, 90, 150])), "en", rng.choice(["web", "web", "web", "books", None])) for k in range(50)]
    rows += [(60 + k, rows[k][1], "en", "books") for k in range(6)]
    rows += [(70 + k, rows[10 + k][1] + " one more", "en", "web") for k in range(6)]
    rows += [(80, "$$$ ### %%% @@@ " * 40, "en", "web"), (81, None, "en", "web"), (82, "", None, "web"), (83, "kurz", "xx", "books"), (84, prose(5000), "en", "books")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    docs = [{"doc_id": i, "text": t, "lang": lang, "source": s} for i, t, lang, s in rows]
    left = [len(docs)]
    for step in (brute_quality, brute_exact, brute_groups, brute_mix):
        docs = step(docs)
        left.append(len(docs))
    assert all(a > b for a, b in zip(left, left[1:])), left  # each stage has something to do
    items = [(d["doc_id"], len(d["text"].split()) + 1) for d in docs if (d["text"] or "").split()]
    want = brute_pack(items, {d: 0 for d, _ in items}, 1, packing.CAPACITY, packing.OPEN_WINDOWS, packing.FAN_IN)
    mine = defaultdict(list)
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.window_id, r.at)):
        mine[r.window_id].append((r.doc_id, r.piece, r.start, r.length))
    assert sorted(map(str, mine.values())) == sorted(map(str, want))
    assert len(corpus_pipeline.STAGES) == 5
