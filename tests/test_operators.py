"""Fields, vocabularies, datasets, batches, trees, vectors, features, experiments."""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.fields import Field, MultilabelField, MultioutputField, Schema, label_field
from textloom.functions import hooks
from textloom.operators import batching, dataset, experiment, features, tree, vectors
from textloom.operators import vocab as V
from textloom.operators.dataset import Dataset
from textloom.operators.lookup import replace_tokens
from textloom.operators.numbering import numbered

SEVEN = "a b c|a|a b c d|a|d b|d c g|b b b b b b".split("|")


@pytest.fixture(scope="module")
def seven(spark):
    df = spark.createDataFrame([(i, t, None if i == 3 else t) for i, t in enumerate(SEVEN)], "row long, text string, gap string")
    return df


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Numbering and vocabularies


def test_numbers_are_dense(spark):
    df = spark.range(1000).withColumn("k", F.md5(F.col("id").cast("string")))
    got = rows(numbered(df, F.desc("k")).select("n", "k"), "n")
    assert [g[0] for g in got] == list(range(1000)) and [g[1] for g in got] == sorted((g[1] for g in got), reverse=True)
    assert numbered(df.limit(0), "k").collect() == []


def plain_vocab(texts, specials, max_size=None, min_freq=1):
    c = Counter(w for t in texts for w in t.split())
    own = [w for w, n in sorted(c.items(), key=lambda x: -x[1]) if n >= min_freq]
    return specials + own[: None if max_size is None else max_size - len(specials)]


@pytest.mark.parametrize("max_size,min_freq", [(None, 1), (5, 1), (None, 2), (2, 1)])
def test_vocab_is_by_frequency_then_first_seen(seven, max_size, min_freq):
    t = seven.select("row", F.split("text", " ").alias("t"))
    v = V.Vocab(V.VocabSpec(max_size, min_freq)).update(t, "t", "row").finalize()
    assert [r[1] for r in rows(v.table, "idx")] == plain_vocab(SEVEN, ["<UNK>", "<PAD>"], max_size, min_freq)
    assert [r[0] for r in rows(v.table, "idx")] == list(range(len(v)))


def test_vocab_errors(spark, seven):
    with pytest.raises(ValueError):
        V.VocabSpec(specials=(V.UNK, V.Special("unk", "<X>")))
    with pytest.raises(ValueError):
        V.VocabSpec(max_size=1)
    v = V.Vocab()
    with pytest.raises(RuntimeError):
        v.table  # noqa: B018
    with pytest.raises(RuntimeError):
        v.finalize()
    t = seven.select("row", F.split("text", " ").alias("t"))
    with pytest.raises(RuntimeError):
        V.Vocab().update(t, "t", "row").finalize().update(t, "t", "row")
    with pytest.raises(ValueError):
        V.padding_index(V.from_tokens(spark, ["a"]))
    with pytest.raises(Exception, match="too large"):
        V.counts(spark.createDataFrame([(1 << 40, ["a"])], "row long, t array<string>"), "t", "row").collect()


def test_vocab_merge(spark):
    a, b, c = (spark.createDataFrame(x, "row long, t array<string>") for x in ([(0, ["w1", "w2", "w3"]), (1, ["w1"])], [(0, ["a2", "a1", "a2"])], [(0, ["z", "w3"])]))
    va, vb, vc = (V.Vocab().update(x, "t", "row") for x in (a, b, c))
    assert {r["token"]: r["freq"] for r in (va + vb).freqs().collect()} == dict(zip("w1 a2 w2 w3 a1".split(), (2, 2, 1, 1, 1)))
    assert [r[1] for r in rows((va + vb).finalize().table, "idx")] == ["<UNK>", "<PAD>", "w1", "a2", "w2", "w3", "a1"]
    assert [r[1] for r in rows((va + vb + vc).finalize().table, "idx")] == ["<UNK>", "<PAD>", "w1", "w3", "a2", "w2", "a1", "z"]
    both = V.merge_finalized([va.finalize().table, vc.finalize().table])
    assert [r[1] for r in rows(both, "idx")] == ["<UNK>", "<PAD>", "w3", "w1", "w2", "z"]
    spec = V.VocabSpec(10, 3).merged(V.VocabSpec(None, 2, (V.UNK, V.BOS)))
    assert (spec.max_size, spec.min_freq, [s.kind for s in spec.specials]) == (None, 2, ["unk", "pad", "bos"])


def test_lookups_by_hash_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame([(0, ["b", "x", "a", None]), (1, []), (2, None), (3, ["<UNK>", "x"])], "row long, t array<string>")
    with_unk, without = V.from_tokens(spark, [V.UNK, V.PAD, "a", "b"]), V.from_tokens(spark, ["a", "b"])
    for _ in range(2):
        assert rows(V.numericalize(df, "t", with_unk, "row").select("row", "ids"), "row") == [(0, [3, 0, 2, 0]), (1, []), (2, None), (3, [0, 0])]
        assert rows(V.numericalize(df, "t", without, "row").select("row", "ids"), "row") == [(0, [1, 0]), (1, []), (2, None), (3, [])]
        monkeypatch.setattr(V, "BROADCAST_BYTES", 0)


def test_specials_are_known_by_place(spark, monkeypatch):
    v = V.from_tokens(spark, [V.UNK, V.PAD, V.BOS, V.EOS, "a"])
    df = spark.createDataFrame([(0, ["a", "<BOS>"]), (1, [])], "row long, t array<string>").withColumn("t", V.with_specials(F.col("t"), (V.BOS, V.EOS)))
    for _ in range(2):
        assert rows(V.numericalize(df, "t", v, "row", specials=(V.BOS, V.EOS)).select("row", "ids"), "row") == [(0, [2, 4, 0, 3]), (1, [2, 3])]
        monkeypatch.setattr(V, "BROADCAST_BYTES", 0)


def test_reverse_and_single_lookups(spark):
    v = V.from_tokens(spark, [V.UNK, "a", "b"])
    df = spark.createDataFrame([([1, 0, 2, 9],), (None,), ([],)], "ids array<long>")
    assert [r[0] for r in V.reverse(df, "ids", v).select("words").collect()] == [["a", "<UNK>", "b", None], None, []]
    assert [r[0] for r in V.reverse(df, "ids", v, drop_unk=True).select("words").collect()] == [["a", "b", None], None, []]
    assert V.index_at(v, "b") == 2 and V.token_at(v, 1) == "a"
    with pytest.raises(KeyError):
        V.index_at(v, "zz")
    with pytest.raises(IndexError):
        V.token_at(v, 7)
    assert [r[1] for r in rows(V.from_indices(spark, {"a": 0, "c": 2}), "idx")] == ["a", None, "c"]
    assert V.same(v, V.from_tokens(spark, [V.UNK, "a", "b"])) and not V.same(v, V.from_tokens(spark, [V.UNK, "b", "a"]))


def test_replace_tokens(spark):
    df = spark.createDataFrame([(0, ["books", "x"]), (1, []), (2, None)], "row long, t array<string>")
    table = spark.createDataFrame([("books", "book"), ("books", "booking")], "form string, lemma string")
    assert rows(replace_tokens(df, "t", "row", table), "row") == [(0, ["book", "x"]), (1, []), (2, None)]


# Fields


def test_missing_data(seven):
    with pytest.raises(Exception, match="missing data"):
        Schema({"gap": Field("gap")}).apply(seven, "row").collect()
    f = Field("gap", vocab=V.Vocab(), allow_missing_data=True, keep_raw=True, hooks=(hooks.LOWERCASE,))
    ds = Dataset.read(seven.select("row", "gap"), {"gap": f}, "row")
    got = {r["row"]: r for r in ds.df.collect()}
    assert got[3]["gap"] is None and got[3]["gap_raw"] is None and got[0]["gap"] == ["a", "b", "c"]
    ids = f.numbers(ds.df, "row")
    padded = {r["row"]: r["x"] for r in ids.select("row", f.padded(F.col("gap_ids"), 4).alias("x")).collect()}
    assert padded[3] == [-1] * 4 and padded[0][3] == 1


def test_schemas(spark, seven):
    out = Schema([Field("words"), None]).apply(seven, "row")
    assert out.columns == ["row", "words"]
    assert Schema({"absent": Field("x", allow_missing_data=True)}).apply(seven, "row").first()["x"] is None
    with pytest.raises(ValueError):
        Schema([Field("words")]).apply(seven, "row")
    two = MultioutputField((Field("w"), Field("up", hooks=(hooks.per_token(hooks.pre(F.upper)),))))
    first = Schema({"text": two}).apply(seven, "row").orderBy("row").first()
    assert (first["w"], first["up"]) == (["a", "b", "c"], ["A", "B", "C"])
    assert len(two.with_output(Field("z")).own()) == 3
    for bad in (lambda: Field(""), lambda: Field("x", fixed_length=0), lambda: Field("x", include_lengths=True, disable_batch_matrix=True), lambda: label_field("x", V.Vocab())):
        with pytest.raises(ValueError):
            bad()
    f = Field("x").with_hooks(hooks.LOWERCASE, hooks.stem())
    assert [h.kind for h in f.without_hooks("pre").hooks] == ["post"] and f.without_hooks().hooks == ()


def test_shared_vocab_and_labels(spark):
    df = spark.createDataFrame([(0, "a b", "b c", "x"), (1, "a", "c", "y"), (2, "", "", "y")], "row long, l string, r string, y string")
    shared = V.Vocab()
    ds = Dataset.read(df, {"l": Field("l", vocab=shared), "r": Field("r", vocab=shared), "y": label_field("y")}, "row")
    assert [r[1] for r in rows(shared.table, "idx")] == ["<UNK>", "<PAD>", "a", "b", "c"]
    assert [r["y_ids"] for r in ds.numericalized().orderBy("row").collect()] == [[1], [0], [0]]


def test_multilabel(spark):
    df = spark.createDataFrame([(0, ["a", "b"]), (1, ["b"]), (2, None)], "row long, t array<string>")
    f = MultilabelField("t", None, V.Vocab(V.VocabSpec(specials=())), allow_missing_data=True)
    s = Schema({"t": f}).finalize(df, row_id="row")
    assert [r["t_ids"] for r in f.numbers(s.apply(df, "row"), "row").orderBy("row").collect()] == [[1, 1], [1, 0], None]
    few = MultilabelField("t", None, f.vocab, num_of_classes=1)
    with pytest.raises(ValueError):
        few.classes()


# Datasets


def twelve(spark):
    df = spark.createDataFrame([(i, f"t{i}", 1 if i < 3 else 0) for i in range(12)], "row long, text string, y long")
    return Dataset(df, Schema({"text": Field("text", None), "y": Field("y", None, is_target=True)}), "row")


@pytest.mark.parametrize(
    "ratio,sizes",
    [(0.4, [5, 7]), (0.42, [5, 7]), (0.35, [4, 8]), (0.1, [1, 11]), (0.9, [11, 1]), ((0.4, 0.2, 0.4), [5, 2, 5]), ((6, 1, 5), [6, 1, 5]), ((1, 1, 1), [4, 4, 4]), ((0.84, 0.08, 0.08), [10, 1, 1]), ((0.08, 0.84, 0.08), [1, 10, 1])],
)
def test_split_sizes(spark, ratio, sizes):
    d = twelve(spark)
    parts = d.split(ratio)
    found = [[r["row"] for r in p.df.collect()] for p in parts]
    assert [len(f) for f in found] == sizes and sorted(sum(found, [])) == list(range(12))


def test_split_options(spark):
    d = twelve(spark)
    kept = [sorted(r["row"] for r in p.df.collect()) for p in d.split(0.5, seed=None)]
    assert kept == [list(range(6)), list(range(6, 12))]
    a, b = d.split(2 / 3, stratified=True)
    assert Counter(r["y"] for r in a.df.collect()) == {1: 2, 0: 6} and Counter(r["y"] for r in b.df.collect()) == {1: 1, 0: 3}
    for bad in (0, 1.0, (1,), (1, 2, 3, 4), (1, -1)):
        with pytest.raises(ValueError):
            dataset.check_ratio(bad)
    with pytest.raises(ValueError):
        d.split(0.01)
    with pytest.raises(ValueError):
        Dataset(d.df, Schema({}), "row").split(0.5, stratified=True)


def names(d):
    return [r["text"] for r in d.df.orderBy("row").collect()]


def test_rows_by_place(spark):
    d, plain = twelve(spark), [f"t{i}" for i in range(12)]
    for s in (slice(2, 9), slice(None, None, 3), slice(-4, None), slice(None, None, -1), slice(9, 1, -3), slice(5, 5)):
        assert names(d[s]) == plain[s]
    assert names(d[[3, -1, 3, 0]]) == ["t3", "t11", "t3", "t0"] and names(d[4]) == ["t4"]
    with pytest.raises(IndexError):
        d[[12]]
    assert names(d.sorted("y")) == plain[3:] + plain[:3] and names(d.sorted("y", reverse=True)) == plain
    mixed = names(d.shuffled(3))
    assert mixed != plain and sorted(mixed) == sorted(plain) and mixed == names(d.shuffled(3)) and mixed != names(d.shuffled(4))
    assert len(d.filter("y = 1")) == 3
    assert d.as_dict()["text"] == plain


def test_concat(spark):
    d = twelve(spark)
    assert names(d.concat(d)) == [f"t{i}" for i in range(12)] * 2
    one, two = (spark.createDataFrame([(1, 2)], c) for c in ("a int, b int", "b int, c int"))
    assert rows(dataset.concat([one, two])) == [(0, 2), (1, 1)]
    assert rows(dataset.concat([one, (two, {"c": "a"})]), "src") == [(0, 1, 2), (1, 2, 1)]
    with pytest.raises(ValueError):
        dataset.concat([one.select("a"), two])
    f = [Field("text", vocab=V.Vocab()) for _ in range(2)]
    x = [Dataset.read(spark.createDataFrame([(0, t)], "row long, text string"), {"text": g}, "row") for t, g in zip("ab", f)]
    with pytest.raises(ValueError, match="differ"):
        x[0].concat(x[1])


def test_from_pandas_and_files(spark, tmp_path):
    d = Dataset.from_pandas(spark, pd.DataFrame({"t": ["a b", "c"]}, index=["i", "j"]), {"t": Field("t", vocab=V.Vocab()), "id": Field("id", None)}, index_field="id")
    assert d.to_pandas()["t"].map(list).tolist() == [["a", "b"], ["c"]] and d.to_pandas()["id"].tolist() == ["i", "j"]
    with pytest.raises(KeyError):
        Dataset.from_pandas(spark, pd.DataFrame({"t": ["a"]}), {"u": Field("u")})
    d.write(str(tmp_path / "x"))
    with pytest.raises(Exception, match="(?i)exist"):
        d.write(str(tmp_path / "x"))


# Batches


def read_seven(seven, **options):
    return Dataset.read(seven.select("row", "text"), {"text": Field("text", vocab=V.Vocab(), **options)}, "row")


def widths(it):
    return [b["text"].shape[1] if not isinstance(b["text"], tuple) else b["text"][0].shape[1] for b in it]


def test_batches_are_padded_to_their_longest(seven):
    d = read_seven(seven)
    it = batching.BatchIterator(d, 2, shuffle=False)
    assert widths(it) == [3, 4, 3, 6] and len(it) == 4
    assert [len(batching.BatchIterator(d, b)) for b in (1, 2, 3, 4, 6, 7, 10)] == [7, 4, 3, 2, 2, 1, 1]
    assert widths(it.resumed(2)) == [3, 6]
    assert widths(batching.BatchIterator(d, 3, "single", shuffle=False)) == [6]
    lengths = next(iter(batching.BatchIterator(read_seven(seven, include_lengths=True), 3, shuffle=False)))["text"][1]
    assert lengths.tolist() == [3, 1, 4]
    one, two = ([b["text"].tolist() for b in batching.BatchIterator(d, 2, seed=5, epoch=e)] for e in (0, 1))
    assert one != two and one == [b["text"].tolist() for b in batching.BatchIterator(d, 2, seed=5)]


@pytest.mark.parametrize("fixed", [1, 3, 5, 7])
def test_fixed_lengths(seven, fixed):
    assert widths(batching.BatchIterator(read_seven(seven, fixed_length=fixed), 7, shuffle=False)) == [fixed]


@pytest.mark.parametrize("ahead,want", [(1, [3, 4, 3, 6]), (2, [1, 4, 3, 6]), (4, [1, 3, 4, 6]), (8, [1, 3, 4, 6])])
def test_buckets(seven, ahead, want):
    it = batching.BatchIterator(read_seven(seven), 2, "bucket", length=F.size("text"), look_ahead=ahead)
    assert widths(it) == want


def test_padding_share(seven):
    n = seven.select("row", F.size(F.split("text", " ")).cast("long").alias("n"))
    assert rows(batching.padding_share(n, batching.assign(n, "row", 2), "row", "n")) == [(6, 26, 0.230769)]
    assert rows(batching.padding_share(n.limit(0), batching.assign(n.limit(0), "row", 2), "row", "n")) == [(0, 0, None)]
    with pytest.raises(ValueError):
        batching.assign(n, "row", 0)


# Trees

TREE = '[{"name": "a", "number": 1, "children": [{"number": 2, "children": [{"number": 3}]}, {"number": 4}]}, {"number": 5, "children": [{"number": 6}, {"number": 7}, {"number": 8, "children": [{"number": 9}]}, {"number": 10}]}]'


def brute_context(nodes, n, levels):
    """Walk up, then from the top down: earlier siblings of each node of the path, and the path."""
    by = {x["node_id"]: x for x in nodes}
    path, at, left = [n], n, levels if levels is not None else 99
    while by[at]["parent_id"] is not None and left >= 0:
        at = by[at]["parent_id"]
        path.insert(0, at)
        left -= 1
    out = [path[0]] if len(path) > 1 else []
    for p in path[1:]:
        out += sorted(x["node_id"] for x in nodes if x["parent_id"] == by[p]["parent_id"] and x["node_id"] < p)
        out += [p] if p != n else []
    return out


def test_tree(spark):
    docs = spark.createDataFrame([(7, TREE), (8, "[]"), (9, None)], "doc long, j string")
    nodes = tree.flatten_json(docs, "j", row_id="doc").filter("doc = 7").drop("doc").cache()
    facts = [r.asDict() for r in nodes.orderBy("node_id").collect()]
    assert [x["parent_id"] for x in facts] == [None, 0, 1, 0, None, 4, 4, 4, 7, 4]
    assert [x["depth"] for x in facts] == [0, 1, 2, 1, 0, 1, 1, 1, 2, 1] and tree.depth(nodes) == 2
    for levels in (None, 0, 1):
        got = dict(rows(tree.contexts(nodes, levels)))
        assert got == {x["node_id"]: sorted(brute_context(facts, x["node_id"], levels)) for x in facts}
    b = rows(batching.hierarchical(tree.contexts(nodes), 4, 2), "node_id")
    assert b[8][3] == [6, 7, 8] and [x[0] for x in b] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    for bad in ('[{"a": 1', '{"a": 1}'):
        with pytest.raises(Exception):  # noqa: B017
            tree.flatten_json(spark.createDataFrame([(bad,)], "j string"), "j").collect()


# Vectors


def test_vectors(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("3 3\nthe 1 2 3\ncat 4 5 6\ndog 7 8 9\n")
    v = vectors.load(spark, str(p))
    assert rows(v, "token")[0] == ("cat", [4.0, 5.0, 6.0]) and vectors.dimension(v) == 3
    assert [r[0] for r in vectors.load(spark, str(p), max_vectors=2).collect()] == ["the", "cat"]
    vocab = V.from_tokens(spark, [V.UNK, "dog", "fox"])
    assert rows(vectors.matrix(vocab, v), "idx") == [(0, [0.0] * 3), (1, [7.0, 8.0, 9.0]), (2, [0.0] * 3)]
    assert [r[0] for r in vectors.for_vocab(v, vocab).collect()] == ["dog"]
    with pytest.raises(Exception, match="no vector"):
        vectors.matrix(vocab, v, None).collect()
    r = [x[1] for x in rows(vectors.matrix(vocab, v, vectors.random_normal(3)), "idx")]
    assert r[0] != r[2] and r == [x[1] for x in rows(vectors.matrix(vocab, v, vectors.random_normal(3)), "idx")]
    (tmp_path / "bad.txt").write_text("a 1 2\nb 1\n")
    (tmp_path / "gap.txt").write_text("a 1 2\n\nb 1 2\n")
    for name in ("bad", "gap"):
        with pytest.raises(ValueError):
            vectors.load(spark, str(tmp_path / f"{name}.txt"))
    (tmp_path / "latin.txt").write_bytes("café 1 2\n".encode("latin-1"))
    assert vectors.nlpl(spark, str(tmp_path / "latin.txt")).first()["token"] == "café"
    with pytest.raises(ValueError):
        vectors.glove(spark, "/tmp", "glove-wikipedia", 7)


def test_random_vectors_are_normal(spark):
    x = np.array([r[0] for r in spark.range(400).select(vectors.random_normal(1)(F.col("id").cast("string"), 10)).collect()]).ravel()
    assert abs(x.mean()) < 0.06 and abs(x.std() - 1) < 0.06


# Features

FOUR = "this is the first document|this document is the second document|and this is the third one|is this the first document".split("|")


@pytest.fixture(scope="module")
def four(spark):
    df = spark.createDataFrame([(i, t.split()) for i, t in enumerate(FOUR)], "row long, t array<string>")
    v = V.Vocab().update(df, "t", "row").finalize().table
    return v, V.numericalize(df, "t", v, "row").select("row", "ids")


def dense(df, values, width):
    out = np.zeros((4, width))
    for r in df.collect():
        out[r["row"], r["cols"]] = r[values]
    return out


COUNTS = [[int(n) for n in row] for row in "111110000 111201000 111000111 111110000".split()]


def test_counts(four, monkeypatch):
    v, ids = four
    for _ in range(2):
        assert dense(features.CountVectorizer(v).transform(ids, "ids", "row"), "tf", 9).tolist() == COUNTS
        got = dense(features.CountVectorizer(v, (V.PAD, "this", "first")).transform(ids, "ids", "row"), "tf", 8)
        assert got[:, 1:].tolist() == np.delete(np.array(COUNTS), [0, 4], axis=1).tolist()
        monkeypatch.setattr(features, "BROADCAST_BYTES", 0)


@pytest.mark.parametrize("norm", ["l2", "l1", None])
@pytest.mark.parametrize("smooth,sublinear,use", [(True, False, True), (False, True, True), (True, True, False)])
def test_tfidf_is_the_formula(four, norm, smooth, sublinear, use):
    v, ids = four
    c = np.array(COUNTS, float)
    df = (c > 0).sum(axis=0)
    idf = np.log(5 / (1 + df)) + 1 if smooth else np.log(4 / df) + 1
    w = np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) if sublinear else c
    w = w * idf if use else w
    if norm:
        w = w / (np.sqrt((w * w).sum(axis=1, keepdims=True)) if norm == "l2" else w.sum(axis=1, keepdims=True))
    got = dense(features.TfIdf(v, norm, use, smooth, sublinear).fit_transform(ids, "ids", "row"), "values", 9)
    assert np.allclose(got, w, atol=1e-9)
    with pytest.raises(ValueError):
        features.TfIdf(v, "l3")
    with pytest.raises(RuntimeError):
        features.TfIdf(v).transform(ids, "ids", "row")


def test_tfidf_joins_when_large(four, monkeypatch):
    v, ids = four
    want = dense(features.TfIdf(v).fit_transform(ids, "ids", "row"), "values", 9)
    monkeypatch.setattr(features, "BROADCAST_BYTES", 0)
    assert np.allclose(dense(features.TfIdf(v).fit_transform(ids, "ids", "row"), "values", 9), want)


# Experiments


@pytest.mark.parametrize("n,k", [(10, 3), (9, 3), (7, 7)])
def test_folds(spark, n, k):
    got = [r[1] for r in rows(experiment.folds(spark.range(n), "id", k), "id")]
    assert got == sorted(got) and [got.count(i) for i in range(k)] == [n // k + (i < n % k) for i in range(k)]
    with pytest.raises(ValueError):
        experiment.folds(spark.range(2), "id", 3)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1)], "y int, p int")
    got = {a: tuple(experiment.classification_metrics(df, "y", "p", a).first()) for a in experiment.AVERAGES}
    assert got["micro"] == (0.5, 0.5, 0.5, 0.5)
    p, r = [2 / 3, 1 / 3, 0], [2 / 3, 1 / 2, 0]
    f = [2 * a * b / (a + b) if a + b else 0 for a, b in zip(p, r)]
    assert got["macro"] == (0.5, *(round(sum(x) / 3, 6) for x in (p, r, f)))
    assert got["weighted"] == (0.5, *(round((3 * x[0] + 2 * x[1]) / 6, 6) for x in (p, r, f)))
    assert got["binary"] == (0.5, round(1 / 3, 6), 0.5, 0.4)


def test_models(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(i, Vectors.dense([i % 2 * 2.0 - 1, 0.1 * (i % 3)]), float(i % 2), [i % 2, 1, 0]) for i in range(24)], ["row_id", "features", "label", "labels"])
    e = experiment.Experiment(experiment.linear_svc(maxIter=5))
    with pytest.raises(RuntimeError):
        e.predict(df)
    score = lambda p: experiment.classification_metrics(p, "label", "prediction").first()["accuracy"]
    assert experiment.k_fold_validation(e, df, "row_id", 2, score) == 1.0
    best, params = experiment.grid_search(e, df, "row_id", {"regParam": [0.0, 0.01]}, 2, score)
    assert best == 1.0 and params == {"regParam": 0.0}
    with pytest.raises(ValueError):
        experiment.grid_search(e, df, "row_id", [], 2, score)
    raw = experiment.RawPipeline(lambda x: x.select("features", "label"), e).fit(df)
    assert score(raw.predict(df)) == 1.0
    m = experiment.MultilabelSVM(params={"maxIter": 5}).fit(df)
    assert m.models[1:] == (None, None)
    out = m.predict(df)
    assert all(r["prediction"][0] == r["labels"][0] and r["prediction"][1:] == [0, 0] for r in out.collect())
    assert experiment.multilabel_metrics(out).first()["macro_recall"] == round(1 / 3, 6)
    assert math.isclose(experiment.multilabel_metrics(out).first()["micro_recall"], round(12 / 36, 6))


def test_context_in_tiles(spark, monkeypatch):
    """Many siblings, and siblings with nodes below them, in runs and tasks of their own."""
    monkeypatch.setattr(tree, "_TILE_NODES", 7)
    monkeypatch.setattr(tree, "_TILE_KIDS", 3)
    facts = [(0, None, [])]
    for _ in range(40):
        top = len(facts)
        facts.append((top, 0, [0]))
        facts += [(top + 1 + k, top, [0, top]) for k in range(top % 4)]
    nodes = spark.createDataFrame(facts, "node_id long, parent_id long, path array<long>")
    for levels in (None, 0):
        got = tree.context(nodes, levels)
        want = set()
        for n, _, path in facts[1:]:
            up = path if levels is None else path[-levels - 1 :]
            want |= {(n, up[0])} | {(n, m) for m, p, _ in facts if p in up and m < n}
        found = [tuple(r) for r in got.collect()]
        assert len(found) == len(want) and set(found) == want
        assert len({r[0] for r in got.select(F.spark_partition_id()).distinct().collect()}) > 4
