"""Python steps on batches: in parts of a bounded size, with the results of plain versions."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from textloom.functions import hooks
from textloom.functions.batches import PART_BYTES, PART_ELEMENTS, in_parts, parts
from textloom.functions.stopwords import STOPWORDS


def test_parts_are_bounded():
    long = "x" * (PART_BYTES // 3)
    assert [(p.start, p.stop) for p in parts(pa.array([long, None, long, long, long * 9, ""]))] == [(0, 4), (4, 5), (5, 6)]
    rows = pa.array([[1] * (PART_ELEMENTS // 2)] * 5 + [None])
    assert [(p.start, p.stop) for p in parts(rows[1:])] == [(0, 2), (2, 5)]
    assert list(parts(pa.array([], pa.string()))) == []


def test_workers_get_parts_of_batches(spark):
    """One batch of 12 MB of texts, and of lists: no part has all of its rows."""
    t = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 4000).alias("t")).withColumn("a", F.array_repeat(F.col("id"), 1000))
    rows = in_parts("long", lambda a: pa.array([len(a)] * len(a), pa.int64()))
    both = in_parts("long", lambda a, b: pa.array([len(b)] * len(a), pa.int64()))
    got = t.select(rows("t").alias("x"), rows("a").alias("y"), both("a", "id").alias("z")).collect()
    assert len(got) == 3000
    assert max(r.x for r in got) <= PART_BYTES // 4000 and max(max(r.y, r.z) for r in got) <= PART_ELEMENTS // 1000


def test_yake_of_many_texts_is_that_of_each():
    rng = random.Random(1)
    texts = [None, "", "the of", "...", "A b. C d! the THE The? x-y it's ΑΣ ΑΣ. İstanbul İstanbul", "\n\n a \n b"]
    texts += ["".join(rng.choice("aAbB theTHE.!?\n'-Σİß ") for _ in range(rng.randrange(80))) for _ in range(500)]
    texts += [" ".join(rng.choice(["Alpha", "beta", "of", "the", "Gamma", "delta.", "of!"]) for _ in range(300)) for _ in range(5)]
    stop = frozenset(STOPWORDS["en"])
    for cut in (texts, texts[:6], texts[1:2], texts[:1]):
        want = [None if t is None else [p for p, _ in hooks.yake_scores(t, stop)] for t in cut]
        assert hooks.yake_phrases(pa.array(cut, pa.string()), stop).to_pylist() == want
    assert hooks.yake_phrases(pa.array(texts[:9], pa.string())[3:], stop, 2).to_pylist() == [[p for p, _ in hooks.yake_scores(t, stop, 2)] for t in texts[3:9]]
