"""Readers, record parsers, the stored form, streaming, and the entry points."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.fields import Field
from textloom.sources import files, records
from textloom.streaming import vocab_stream

ROOT = Path(__file__).resolve().parent.parent


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,rating,source\n"a, ""quoted"" one",1,x\n,2,y\n')
    df = files.tabular(spark, str(tmp_path / "a.csv"))
    assert rows(df.select("text", "rating", "source"), "row_id") == [('a, "quoted" one', "1", "x"), (None, "2", "y")]
    by_place = files.tabular(spark, str(tmp_path / "a.csv"), columns=["t", None, "s"], skip_header=True)
    assert rows(by_place.select("t", "s"), "row_id")[1] == (None, "y")
    (tmp_path / "b.tsv").write_text("a b\t1\nc\t2\n")
    assert rows(files.tabular(spark, str(tmp_path / "b.tsv"), "tsv", columns=["t", "n"]).select("t", "n"), "row_id") == [("a b", "1"), ("c", "2")]
    (tmp_path / "c.json").write_text('{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert rows(files.tabular(spark, str(tmp_path / "c.json"), "json").select("a", "b"), "row_id") == [(1, "x"), (2, None)]
    parse = records.line_parser(lambda x: x.split("|"), T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType())]))
    (tmp_path / "d.txt").write_text("a|b\nc|d\n")
    assert rows(files.tabular(spark, str(tmp_path / "d.txt"), line_parser=parse).select("x", "y"), "row_id") == [("a", "b"), ("c", "d")]
    for bad in ({"format": "json", "skip_header": True}, {"skip_header": True}, {"format": "xls"}):
        with pytest.raises(ValueError):
            files.tabular(spark, str(tmp_path / "a.csv"), **bad)


def test_records(spark):
    x = spark.createDataFrame([(1, "<r><a>1</a><b/></r>"), (2, "<a>7</a>")], "i int, x string")
    assert [r["a"] for r in records.parse(x, "x", "xml", names=["a"]).orderBy("i").collect()] == ["1", "7"]
    with pytest.raises(Exception, match="no z"):
        records.parse(x, "x", "xml", names=["z"]).collect()
    with pytest.raises(Exception):  # noqa: B017
        records.parse(x, "x", "json", schema="a int").collect()
    with pytest.raises(ValueError):
        records.parse(x, "x", "yaml")


TREES = ["(3 (2 It) (4 (3 (2 's) (3 good)) (2 .)))", "(1 (2 not) (1 bad))"]


def test_trees(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TREES)), "i int, t string")
    assert rows(records.tree_rows(df, "t"), "i") == [(0, "It 's good .", "3"), (1, "not bad", "1")]
    sub = rows(records.tree_rows(df, "t", subtrees=True), "i", "at")
    assert [(x[2], x[3]) for x in sub[:8]] == [("It 's good .", "3"), ("It", "2"), ("'s good .", "4"), ("'s good", "3"), ("'s", "2"), ("good", "3"), (".", "2"), ("not bad", "1")]
    for bad in ("(1 a", "(1 a))", "x (1 a)"):
        with pytest.raises(ValueError):
            records.subtrees_of(bad)
    (tmp_path / "t.txt").write_text("\n".join([*TREES, "(2 meh)"]) + "\n")
    assert [r["label"] for r in files.sentiment_trees(spark, str(tmp_path / "t.txt")).orderBy("row_id").collect()] == ["positive", "negative"]
    assert len(rows(files.sentiment_trees(spark, str(tmp_path / "t.txt"), fine_grained=True))) == 3
    # "s", "not" and others are neutral.
    assert len(rows(files.sentiment_trees(spark, str(tmp_path / "t.txt"), subtrees=True))) == 6


def test_labelled_texts_and_pairs(spark, tmp_path):
    for label in ("pos", "neg"):
        (tmp_path / label).mkdir()
        for k in range(2):
            (tmp_path / label / f"{k}.txt").write_text(f"{label} text\n{k}")
    got = files.labelled_texts(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r["label"] for r in got] == ["pos", "pos", "neg", "neg"] and sorted(r["text"] for r in got)[0] == "neg text\n0"
    (tmp_path / "p.jsonl").write_text(json.dumps({"gold_label": "neutral", "sentence1": "a", "sentence2": "b", "pairID": "9"}) + "\n")
    assert rows(files.sentence_pairs(spark, str(tmp_path / "p.jsonl")).drop("row_id")) == [("neutral", "a", "b")]
    assert files.sentence_pairs(spark, str(tmp_path / "p.jsonl"), simple=False).first()["pairID"] == "9"


CONLLU = "# text = They buy\n1\tThey\tthey\tPRON\tPRP\tCase=Nom|Number=Plur\t2\tnsubj\t2:nsubj\t_\n2\tbuy\tbuy\tVERB\tVBP\t_\t0\troot\t0:root\tSpaceAfter=No\n\n# x\n1\tNo\tno\tDET\tDT\t_\t0\troot\t_\t_\n"


def test_conllu(spark, tmp_path):
    (tmp_path / "c.conllu").write_text(CONLLU)
    got = files.conllu(spark, str(tmp_path / "c.conllu")).orderBy("row_id").collect()
    assert [r["form"] for r in got] == [["They", "buy"], ["No"]] and got[0]["head"] == [2, 0]
    assert got[0]["feats"] == [{"Case": "Nom", "Number": "Plur"}, None] and got[1]["xpos"] == ["DT"]
    (tmp_path / "bad.conllu").write_text("1\tThey\tthey\n")
    with pytest.raises(Exception, match="ten columns"):
        files.conllu(spark, str(tmp_path / "bad.conllu")).collect()


def test_dialogs(spark, tmp_path):
    sep = " +++$+++ "
    put = lambda name, lines: (tmp_path / name).write_bytes("\n".join(sep.join(x) for x in lines).encode("latin-1"))
    put("movie_lines.txt", [("L1", "u0", "m0", "A", "Hi é"), ("L2", "u1", "m0", "B", "Hello"), ("L3", "u0", "m0", "A", ""), ("L4", "u1", "m0", "B", "So?")])
    put("movie_conversations.txt", [("u0", "u1", "m0", "['L1', 'L2', 'L3', 'L4']"), ("u0", "u1", "m0", "['L4']"), ("u1", "u0", "m0", "['L4', 'L1', 'L9']")])
    put("movie_titles_metadata.txt", [("m0", "a film", "1999", "6.9", "10", "['comedy', 'romance']")])
    lines, talks = (files.dialog_table(spark, str(tmp_path), n) for n in ("lines", "conversations"))
    assert rows(files.dialog_pairs(talks, lines).select("row_id", "statement", "reply"), "row_id", "at") == [(0, "Hi é", "Hello"), (2, "So?", "Hi é")]
    assert files.dialog_table(spark, str(tmp_path), "titles").first()["genres"] == ["comedy", "romance"]


def test_fields_of_a_schema():
    text, number = T.StringType(), T.IntegerType()
    schema = T.StructType([T.StructField(n, t) for n, t in (("name", text), ("label", text), ("n", number), ("vec", T.ArrayType(number)), ("skip", text))])
    got = files.fields_of(schema, ["skip"])
    assert list(got) == ["name", "label", "n", "vec"] and got["label"].is_target and got["n"].tokenizer is None
    with pytest.raises(TypeError):
        files.fields_of(T.StructType().add("x", T.CalendarIntervalType()))


def test_stored_tables_and_fields(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"]), (2, None)], "i int, t array<string>")
    f = Field("t", keep_raw=True, fixed_length=3)
    files.write_cache(df, str(tmp_path / "c"), {"fields": [files.field_spec(f)]})
    back, about = files.read_cache(spark, str(tmp_path / "c"))
    assert rows(back, "i") == rows(df, "i") and files.field_from_spec(about["fields"][0]) == f
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_cache(df, str(tmp_path / "c"))
    with pytest.raises(TypeError):
        files.write_cache(df.withColumn("v", F.lit(None)), str(tmp_path / "d"))
    with pytest.raises(TypeError):
        files.field_spec(Field("t", str.split))


def test_counts_of_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(k, ["a", f"w{k}"])], "row long, t array<string>").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("row long, t array<string>").parquet(str(src))
        vocab_stream.to_table(stream, "t", "row", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["token"]: (r["freq"], r["first"]) for r in vocab_stream.freqs(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == {"a": (3, 0), "w0": (1, 1), "w1": (1, (1 << 24) + 1), "w2": (1, (2 << 24) + 1)}


def test_entry_points_without_the_optional_part(tmp_path):
    """The library imports where the optional subpackage and the pipeline aren't there."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split('.')[:2] == ['textloom', 'llm'] or name == 'corpus_pipeline':
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 60 and set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_xml_is_read_once_for_all_names(spark):
    texts = ["<a><name>x &amp; y</name><brand/></a>", "<name>top<brand>b</brand></name>", "<a><brand>z</brand><name></name><name>2</name></a>", "<a><name> sp\n</name><brand><i>q</i>r</brand></a>"]
    x = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    parsed = records.parse(x, "x", "xml", names=["name", "brand"])
    assert [(r["name"], r["brand"]) for r in parsed.orderBy("i").collect()] == [("x & y", ""), ("topb", "b"), ("", "z"), (" sp\n", "qr")]
    assert parsed._jdf.queryExecution().optimizedPlan().toString().lower().count("(xpath") == 1


def test_labelled_texts_are_written_by_many_tasks(spark, tmp_path):
    from pathlib import Path

    from textloom.plans import catalogue

    spark.range(400).selectExpr("id as s_suppkey", "concat('s', id) as s_name", "cast(id % 3 - 1 as double) as s_acctbal").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.QUERIES["read_labelled_texts"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((f"s{k}", "pos" if k % 3 else "neg") for k in range(400))
    files = [Path(f).name for f in got.inputFiles()]
    assert len(files) == 400 and len({f.split("-")[1] for f in files}) > 8
