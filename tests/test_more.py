"""Fields in one pass, overrides, caches, converted tables, nested batches, presets, and plans beyond a broadcast."""

import pytest
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from textloom.fields import Field, Schema, label_field
from textloom.functions import tokenize
from textloom.operators import batching, experiment, features, tree
from textloom.operators import vocab as V
from textloom.operators.dataset import Dataset, unique
from textloom.sources import files, records
from textloom.storage import fresh_path, spread


def test_white_space_is_pythons(spark):
    odd = "a\x1cb\x1dc\x1ed\x1fe\x85f\xa0g h i j k l m n　o\tp\x0bq\x0cr\rs\nt​u﻿v é\x00w\x7f"
    rows = [odd, odd * 2, " a b ", "", None, "\x1c"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(tokenize.whitespace(F.col("t"))).collect()]
    assert got == [None if t is None else t.split() for t in rows]


def test_vocabularies_are_counted_in_one_pass(spark):
    df = spark.createDataFrame([(0, "b a b", "x", "p"), (1, "a c", "y", "q"), (2, "c c d", "x", None)], "r long, text string, tag string, other string")
    words = V.Vocab()
    make = lambda w: {"text": Field("text", vocab=w), "tag": label_field("tag"), "other": Field("other", None, w, allow_missing_data=True)}
    s = Schema(make(words)).finalize(df, row_id="r")
    table = lambda v: [(r.idx, r.token, r.freq) for r in v.table.orderBy("idx").collect()]
    assert table(words) == [(0, "<UNK>", 0), (1, "<PAD>", 0), (2, "c", 3), (3, "b", 2), (4, "a", 2), (5, "p", 1), (6, "q", 1), (7, "d", 1)]
    assert table(s["tag"].vocab) == [(0, "x", 2), (1, "y", 1)]
    two = Schema(make(V.Vocab()))
    two.finalize(df.filter("r < 2"), df.filter("r = 2"), row_id="r")
    assert {t: n for _, t, n in table(two["text"].vocab)} == {t: n for _, t, n in table(words)}


def test_concat_with_overrides(spark):
    a = Dataset.read(spark.createDataFrame([(0, "a b", "x"), (1, "b", "y")], "r long, text string, tag string"), {"text": Field("text", vocab=V.Vocab()), "tag": label_field("tag")}, "r")
    b = Dataset.read(spark.createDataFrame([(0, "c b", "x")], "r long, text string, tag string"), {"text": Field("text", vocab=V.Vocab()), "tag": Field("tag", None)}, "r")
    with pytest.raises(ValueError):
        a.concat(b)
    own = Field("text", vocab=V.Vocab())
    both = a.concat_with([b], {"text": own, "tag": Field("tag", None)})
    assert len(both) == 3 and {r.token for r in own.vocab.table.filter("special is null").collect()} == {"a", "b", "c"}
    ids = [list(r.text_ids) for r in both.materialized().orderBy("r").collect()]
    assert ids == [[3, 2], [2], [4, 2]] and unique("abcab") == ["a", "b", "c"]


def test_cache_is_deleted(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    files.write_cache(spark.range(3).toDF("a"), path, {"x": 1})
    assert files.read_cache(spark, path)[0].count() == 3
    assert files.delete_cache(spark, path) and not (tmp_path / "c").exists() and not files.delete_cache(spark, path)
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError):
        files.delete_cache(spark, f"file://{tmp_path}/other")


def test_columnar_tables_are_converted(spark):
    schema = "id long, name string, label string, pair struct<en:string,fr:string>, n array<long>"
    train = spark.createDataFrame([(1, "the cat", "x", ("one", "un"), [1, 2]), (None, "a cat", "y", ("two", "deux"), None)], schema)
    parts = files.convert({"train": train, "test": train.filter("id = 1")})
    assert set(parts) == {"train", "test"} and len(parts["test"]) == 1
    names = {f.name for f in parts["train"].schema.all()}
    assert names == {"id", "name", "label", "pair_en", "pair_fr", "n"}
    r = parts["test"].numericalized().first()
    assert list(r.name_ids) == [3, 2] and list(r.label_ids) == [0] and list(r.n) == [1, 2] and r.pair_fr == ["un"]
    assert len(files.convert(train)) == 2


def test_presets_fit_their_corpora(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"gold_label":"x","sentence1":"a b","sentence2":"b","sentence1_parse":"(S (A a) (B b))","sentence2_parse":"b","sentence1_binary_parse":"( a b )","sentence2_binary_parse":"b"}\n')
    pairs = Dataset.read(files.sentence_pairs(spark, str(tmp_path / "p.jsonl")), files.pair_fields(), "row_id")
    r = pairs.numericalized().first()
    assert list(r.sentence1_ids) == [3, 2] and list(r.sentence2_ids) == [2] and list(r.gold_label_ids) == [0]
    full = files.pair_fields(simple=False)
    assert {"annotator_labels", "captionID", "pairID", "sentence2_binary_parse"} <= set(full)
    (tmp_path / "t.txt").write_text("(3 (2 good) (2 film))\n(1 (2 bad))\n(2 (2 so))\n")
    t = Dataset.read(files.sentiment_trees(spark, str(tmp_path / "t.txt")), files.sentiment_fields(), "row_id")
    assert sorted(x.text for x in t.df.collect()) == [["bad"], ["good", "film"]]
    (tmp_path / "c.conllu").write_text("# x\n1\tThe\tthe\tDET\tDT\tA=b\t2\tdet\t_\t_\n2\tcat\tcat\tNOUN\tNN\t_\t0\troot\t_\tSpaceAfter=No\n\n1\tGo\tgo\tVERB\tVB\t_\t0\troot\t_\t_\n\n")
    c = Dataset.read(files.conllu(spark, str(tmp_path / "c.conllu")), files.conllu_fields(), "row_id")
    assert sorted(len(x.form_ids) for x in c.numericalized().collect()) == [1, 2]
    assert list(files.dialog_fields()) == ["statement", "reply"] and files.dialog_fields()["reply"].is_target and list(files.review_fields()) == ["text", "label"]


def test_sequences_without_brackets(spark):
    rows = ["( ( a b ) c )", "a", "", None, "(a)"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(rows)), "i int, t string").orderBy("i").select(records.sequence_leaves(F.col("t"))).collect()]
    assert got == [["a", "b", "c"], ["a"], [], None, ["a"]]


def forest(spark, parents):
    """A table of nodes from each node's parent (numbers in preorder)."""
    paths = {}
    rows = []
    for n, p in enumerate(parents):
        paths[n] = [] if p is None else [*paths[p], p]
        rows.append((n, p, len(paths[n]), paths[n]))
    return spark.createDataFrame(rows, "node_id long, parent_id long, depth int, path array<long>")


@pytest.mark.parametrize("levels", [None, 0, 1])
@pytest.mark.parametrize("longest", [1, 2, 3, 50])
def test_last_of_a_context(spark, levels, longest):
    nodes = forest(spark, [None, 0, 1, 1, 1, 0, 5, 5, 7, 7, 7, 0, None, 12, 12, 12])
    want = {r.node_id: r.context[-longest:] for r in tree.contexts(nodes, levels).collect()}
    assert {r.node_id: list(r.context) for r in tree.contexts(nodes, levels, longest).collect()} == want


def test_nested_matrices(spark):
    nodes = forest(spark, [None, 0, 0])
    v = V.Vocab().update(spark.createDataFrame([(0, ["a", "a", "b"])], "r long, t array<string>"), "t", "r").finalize()
    f = Field("text", vocab=v)
    ids = spark.createDataFrame([(0, [2, 3, 2]), (1, [3]), (2, [2, 2])], "node_id long, text_ids array<long>")
    got = {r.node_id: [list(x) for x in r.text] for r in batching.hierarchical_matrices(tree.contexts(nodes), ids, f, batch_size=2).collect()}
    assert got == {0: [[2, 3, 2]], 1: [[2, 3, 2], [3, 1, 1]], 2: [[2, 3, 2], [3, 1, 1], [2, 2, 1]]}


def test_large_vocabularies_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [f"w{(k * j) % 17}" for j in range(k % 7)] if k % 5 else None) for k in range(40)], "r long, t array<string>")
    v = V.Vocab().update(rows, "t", "r").finalize().table
    want = {r.r: r.ids for r in V.numericalize(rows, "t", v, "r").collect()}
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(V, "HOT_WORDS", 5)
    assert {r.r: r.ids for r in V.numericalize(rows, "t", v, "r").collect()} == want


def test_vectors_for_models(spark):
    rows = spark.createDataFrame([(0, [1, 3], [0.5, 2.0]), (1, [], [])], "r long, cols array<long>, values array<double>")
    got = {r.r: r.features for r in features.to_vectors(rows, "r", 5).collect()}
    assert got == {0: SparseVector(5, [1, 3], [0.5, 2.0]), 1: SparseVector(5, [], [])}


def test_going_on_from_weights(spark):
    data = spark.createDataFrame([(k, float(k % 2), [0, 1], [float(k % 2), 1.0]) for k in range(20)], "r long, label double, cols array<long>, values array<double>")
    df = features.to_vectors(data, "r", 2).join(data.select("r", "label"), "r")
    e = experiment.Experiment(experiment.perceptron([2, 2], maxIter=1, seed=1))
    once = e.partial_fit(df)
    later = once.partial_fit(df).partial_fit(df)
    assert list(later.model.weights) != list(once.model.weights)
    with pytest.raises(TypeError):
        experiment.Experiment(experiment.linear_svc(maxIter=1)).fit(df).partial_fit(df)


def test_small_inputs_are_spread(spark):
    path = fresh_path(spark, "one")
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert spread(df, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread(df, "id").count() == 100
