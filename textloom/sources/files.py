"""Readers and writers of files. All read with a schema where the format has none of its own, and in parts."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.fields import Field, label_field
from textloom.functions.tokenize import get_tokenizer
from textloom.operators.vocab import PAD, Vocab, VocabSpec
from textloom.sources import records


def numbered_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """value and row_id: ids go up in the files' order; they have gaps where files are read in parts."""
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.text(path).select("value", F.monotonically_increasing_id().alias("row_id"))


def tabular(
    spark: SparkSession, path: str, format: str = "csv", columns: Sequence[str | None] | None = None, schema: str | None = None, skip_header: bool = False, delimiter: str | None = None, line_parser: Callable[[DataFrame, str], DataFrame] | None = None, options: Mapping[str, str] | None = None
) -> DataFrame:
    """A table of csv, tsv or json lines, with row_id.

    columns: names by place, where the file has no header (None skips one); without, the first line has the names.
    skip_header leaves out a first line where columns are given; with json, or names from the header, it's an error.
    Empty cells are null. line_parser reads lines of any other kind.
    """
    if line_parser:
        lines = numbered_lines(spark, path)
        return line_parser(lines, "value").withColumn("row_id", F.monotonically_increasing_id())
    if format not in ("csv", "tsv", "json"):
        raise ValueError("format is csv, tsv or json")
    if skip_header and (format == "json" or columns is None):
        raise ValueError("skip_header is for files whose columns are named by place")
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if format == "json":
        df = reader.json(path)
    else:
        reader = reader.option("sep", delimiter or ("," if format == "csv" else "\t")).option("quote", '"').option("escape", '"').option("multiLine", "true")
        for k, v in (options or {}).items():
            reader = reader.option(k, v)
        df = reader.option("header", str(columns is None or skip_header).lower()).csv(path)
    if columns is not None and format != "json":
        if len(columns) != len(df.columns):
            raise ValueError(f"{len(columns)} names for {len(df.columns)} columns")
        df = df.toDF(*(c or f"__{i}" for i, c in enumerate(columns))).select(*(c for c in columns if c))
    return df.withColumn("row_id", F.monotonically_increasing_id())


def labelled_texts(spark: SparkSession, path: str, labels: Sequence[str] = ("pos", "neg")) -> DataFrame:
    """text, label, row_id of folders of texts, one file each; a label's folder has its name. Labels in their order."""
    files = spark.read.text([f"{path}/{label}" for label in labels], wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    label = F.element_at(F.split("file", "/"), -2)
    rank = F.array_position(F.lit(list(labels)), label)
    out = files.select(F.col("value").alias("text"), label.alias("label"), (F.shiftleft(rank.cast("long"), 55) + F.pmod(F.xxhash64("file"), F.lit(1 << 55))).alias("row_id"))
    return out


SENTIMENTS = dict(zip("01234", "very negative,negative,neutral,positive,very positive".split(",")))
COARSE = {k: v.removeprefix("very ") for k, v in SENTIMENTS.items()}


def sentiment_trees(spark: SparkSession, path: str, fine_grained: bool = False, subtrees: bool = False) -> DataFrame:
    """row_id, [at,] text, label of a bracketed tree a line. Neutral texts go unless fine_grained."""
    rows = records.tree_rows(numbered_lines(spark, path), "value", subtrees, SENTIMENTS if fine_grained else COARSE)
    return rows if fine_grained else rows.filter(F.col("label") != "neutral")


_PAIRS = "gold_label string, sentence1 string, sentence2 string"
_PAIRS_FULL = f"annotator_labels array<string>, captionID string, pairID string, {_PAIRS}, sentence1_parse string, sentence2_parse string, sentence1_binary_parse string, sentence2_binary_parse string"


def sentence_pairs(spark: SparkSession, path: str, simple: bool = True) -> DataFrame:
    """Pairs and their label from JSON lines; not simple: ids, annotators' labels and parse trees too."""
    return spark.read.schema(_PAIRS if simple else _PAIRS_FULL).json(path).withColumn("row_id", F.monotonically_increasing_id())


CONLLU = tuple("id form lemma upos xpos feats head deprel deps misc".split())


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sentence: row_id and an array over its tokens for each of the ten columns.

    _ is null. feats and misc are maps; head is a number. Lines that don't have ten columns are an error.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).select("value", F.monotonically_increasing_id().alias("row_id"))
    return conllu_blocks(blocks)


def conllu_blocks(blocks: DataFrame) -> DataFrame:
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (x != "") & ~x.startswith("#"))
    t = blocks.select("row_id", F.transform(lines, lambda x: F.split(x, "\t")).alias("t")).filter(F.size("t") > 0)
    bad = F.exists("t", lambda x: F.size(x) != 10)
    t = t.withColumn("t", F.when(bad, F.raise_error(F.lit("a line doesn't have ten columns")).cast("array<array<string>>")).otherwise(F.col("t")))

    def column(i: int, name: str):
        own = F.transform("t", lambda x: F.nullif(x[i], F.lit("_")))
        if name in ("feats", "misc"):
            own = F.transform(own, lambda x: F.when(x.isNotNull(), F.str_to_map(x, F.lit(r"\|"), F.lit("="))))
        if name == "head":
            own = F.transform(own, lambda x: x.cast("int"))
        return own.alias(name)

    return t.select("row_id", *(column(i, n) for i, n in enumerate(CONLLU)))


# Dialogs of films

_DIALOG = {
    "titles": ("movie_titles_metadata.txt", tuple("movieID title year rating votes genres".split())),
    "conversations": ("movie_conversations.txt", tuple("character1ID character2ID movieID utteranceIDs".split())),
    "lines": ("movie_lines.txt", tuple("lineID characterID movieID character text".split())),
    "characters": ("movie_characters_metadata.txt", tuple("characterID character movieID title gender position".split())),
    "urls": ("raw_script_urls.txt", tuple("movieID title url".split())),
}


def dialog_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the five tables: values between ' +++$+++ ', in ISO-8859-1; lists are read as arrays."""
    file, columns = _DIALOG[name]
    text = F.decode("content", "ISO-8859-1")
    lines = spark.read.format("binaryFile").load(f"{folder}/{file}").select(F.posexplode(F.split(text, r"\r?\n")).alias("row_id", "value")).filter("value <> ''")
    parts = F.split("value", r" \+\+\+\$\+\+\+ ?", -1)
    out = []
    for i, c in enumerate(columns):
        x = F.get(parts, i)
        out.append((F.regexp_extract_all(x, F.lit("'([^']*)'"), F.lit(1)) if c in ("genres", "utteranceIDs") else x).alias(c))
    return lines.select(F.col("row_id").cast("long"), *out)


def dialog_pairs(conversations: DataFrame, lines: DataFrame) -> DataFrame:
    """row_id, at, statement, reply of utterances that follow each other; not where either is missing or empty."""
    pairs = conversations.filter(F.size("utteranceIDs") > 1).select("row_id", F.posexplode(F.arrays_zip(F.slice("utteranceIDs", 1, F.size("utteranceIDs") - 1).alias("s"), F.slice("utteranceIDs", 2, F.size("utteranceIDs") - 1).alias("r"))).alias("at", "x"))
    text = lines.select("lineID", "text").filter("text <> ''")
    s = text.select(F.col("lineID").alias("s"), F.col("text").alias("statement"))
    r = text.select(F.col("lineID").alias("r"), F.col("text").alias("reply"))
    return pairs.select("row_id", "at", "x.s", "x.r").join(s, "s").join(r, "r").select("row_id", "at", "statement", "reply")


def turn_pairs(turns: DataFrame, conversation: str, turn: str, text: str) -> DataFrame:
    """The same of a table of turns: each with the next one of its conversation."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(conversation).orderBy(turn)
    next_one = turns.select(conversation, turn, F.col(text).alias("statement"), F.lead(text).over(w).alias("reply"))
    return next_one.filter("statement <> '' and reply <> ''")


# Columnar data and pandas


def fields_of(schema: T.StructType, ignore: Sequence[str] = ()) -> dict[str, Field]:
    """Fields for a table's columns: strings are tokenized and have a vocabulary, `label` is a target; numbers and arrays stay as they are; others are an error."""
    out: dict[str, Field] = {}
    for c in schema.fields:
        if c.name in ignore:
            continue
        kind = c.dataType.typeName()
        if kind == "string":
            f = label_field(c.name) if c.name == "label" else Field(c.name, vocab=Vocab())
        elif isinstance(c.dataType, T.NumericType) or kind in ("boolean", "array", "struct", "map", "binary", "date", "timestamp", "timestamp_ntz"):
            f = Field(c.name, None, is_target=c.name == "label", disable_batch_matrix=not isinstance(c.dataType, T.NumericType), allow_missing_data=True)
        else:
            raise TypeError(f"column {c.name} is of {kind}, for which there is no field")
        out[c.name] = f
    return out


def convert(tables: DataFrame | Mapping[str, DataFrame], fields: Mapping[str, Field] | None = None, row_id: str = "row_id", finalize: bool = True):
    """A Dataset of a columnar table, or one for each named part; vocabularies are counted over the first part (train).

    Columns of one struct of strings (translations) become a column for each of its members.
    """
    from textloom.operators.dataset import Dataset

    parts = {"": tables} if isinstance(tables, DataFrame) else dict(tables)
    flat = {}
    for name, df in parts.items():
        out = []
        for c in df.schema.fields:
            if isinstance(c.dataType, T.StructType) and all(isinstance(m.dataType, T.StringType) for m in c.dataType.fields):
                out += [F.col(f"`{c.name}`.`{m.name}`").alias(f"{c.name}_{m.name}") for m in c.dataType.fields]
            else:
                out.append(F.col(f"`{c.name}`"))
        flat[name] = df.select(*out) if row_id in df.columns else df.select(*out, F.monotonically_increasing_id().alias(row_id))
    first = next(iter(flat.values()))
    own = dict(fields) if fields is not None else fields_of(first.schema, [row_id])
    done = {}
    for i, (name, df) in enumerate(flat.items()):
        done[name] = Dataset.read(df, own, row_id, finalize and i == 0)
    return done[""] if isinstance(tables, DataFrame) else done


# Fields that go with the corpora above.

def sentiment_fields() -> dict[str, Field]:
    return {"text": Field("text", vocab=Vocab()), "label": label_field("label")}


def review_fields() -> dict[str, Field]:
    """Words and punctuation apart."""
    return {"text": Field("text", "moses", vocab=Vocab()), "label": label_field("label")}


def pair_fields(simple: bool = True) -> dict[str, Field]:
    """Both sentences share a vocabulary; not simple: ids and labels as they are, trees as their words."""
    words = Vocab()
    out = {"gold_label": label_field("gold_label"), "sentence1": Field("sentence1", vocab=words), "sentence2": Field("sentence2", vocab=words)}
    if simple:
        return out
    trees = {f"sentence{i}{kind}_parse": Field(f"sentence{i}{kind}_parse", records.sequence_leaves, disable_batch_matrix=True) for i in (1, 2) for kind in ("", "_binary")}
    ids = {c: Field(c, None, disable_batch_matrix=True) for c in ("annotator_labels", "captionID", "pairID")}
    return out | ids | trees


def dialog_fields() -> dict[str, Field]:
    words = Vocab()
    return {"statement": Field("statement", vocab=words), "reply": Field("reply", vocab=words, is_target=True)}


def conllu_fields() -> dict[str, Field]:
    """Words, lemmas and tags have vocabularies; ids, heads and maps stay as they are."""
    plain = {c: Field(c, None, disable_batch_matrix=True, allow_missing_data=True) for c in ("id", "feats", "head", "deps", "misc")}
    counted = {c: Field(c, None, Vocab(), allow_missing_data=True) for c in ("form", "lemma")}
    tags = {c: Field(c, None, Vocab(VocabSpec(specials=(PAD,))), allow_missing_data=True) for c in ("upos", "xpos", "deprel")}
    every = plain | counted | tags
    return {c: every[c] for c in CONLLU}


def delete_cache(spark: SparkSession, path: str) -> bool:
    """Remove what write_cache wrote; whether there was anything. A folder of anything else is an error."""
    j = spark.sparkContext._jvm
    folder = j.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return False
    if not fs.exists(j.org.apache.hadoop.fs.Path(f"{path}/_about")):
        raise ValueError(f"{path} is no cache")
    return bool(fs.delete(folder, True))


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A table that write_cache wrote, and what was said about it."""
    about = spark.read.text(f"{path}/_about").first()
    return spark.read.parquet(f"{path}/rows"), json.loads(about[0]) if about else {}


def write_cache(df: DataFrame, path: str, about: Mapping | None = None) -> None:
    """As Parquet with a JSON note beside it; never over what is there. Columns without a type are an error."""
    void = [c for c, kind in df.dtypes if kind == "void"]
    if void:
        raise TypeError(f"no type is known for {void}; cast them")
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(json.dumps(dict(about or {})),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/_about")


def field_spec(f: Field) -> dict:
    """A field as JSON: its tokenizer must have a name, and hooks are written down by whoever made them."""
    if callable(f.tokenizer):
        raise TypeError("a tokenizer that is a function has no name to store")
    plain = ("name", "tokenizer", "keep_raw", "is_target", "include_lengths", "fixed_length", "allow_missing_data", "disable_batch_matrix", "padding_token", "missing_data_token")
    return {k: getattr(f, k) for k in plain}


def field_from_spec(spec: Mapping, **others) -> Field:
    get_tokenizer(spec["tokenizer"])
    return Field(**spec, **others)


BUILTIN = {"labelled texts": labelled_texts, "sentiment trees": sentiment_trees, "sentence pairs": sentence_pairs, "film dialogs": dialog_table, "CoNLL-U": conllu}


def list_builtin() -> list[str]:
    return sorted(BUILTIN)


def splits(read: Callable[[str], DataFrame], paths: Mapping[str, str]) -> dict[str, DataFrame]:
    """Predefined parts (train, validation, test) by name, each from a path of its own."""
    return {name: read(p) for name, p in paths.items()}
