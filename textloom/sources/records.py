"""Parsers of single records: a text Column becomes the columns of a schema."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.arrays import let

FORMATS = ("list", "dict", "csv", "json", "xml", "tree")


def from_dict(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns by name; one that isn't there is null."""
    return df.select(*(F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string").alias(n) for n in names))


def from_list(df: DataFrame, column: str, names: Sequence[str | None]) -> DataFrame:
    """An array's values by place; None skips one. Too few values are null."""
    return df.select(*[c for c in df.columns if c != column], *(F.get(F.col(column), i).alias(n) for i, n in enumerate(names) if n is not None))


def from_json(text: Column, schema: str | T.StructType) -> Column:
    """A struct; keys that aren't there are null. Broken JSON is an error."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def from_csv(text: Column, schema: str, delimiter: str = ",") -> Column:
    """A struct of one line's values."""
    return F.from_csv(text, F.lit(schema), {"sep": delimiter, "mode": "FAILFAST"})


def from_xml(text: Column, names: Sequence[str]) -> Column:
    """A struct of the first element of each name below the root, or of the root itself; one that's missing is an error."""

    # One expression of all that is asked, so that a text is read once. XML can't have the separator.
    asked = [x for n in names for x in (f"boolean(/*/{n} | /{n})", f"/*/{n}[1]", f"/{n}")]
    found = F.split(F.xpath_string(text, F.lit("concat(" + ", '\x01', ".join([*asked, "''"]) + ")")), "\x01", -1)

    def value(p: Column, i: int, n: str) -> Column:
        known = F.coalesce(F.nullif(F.get(p, i + 1), F.lit("")), F.get(p, i + 2))
        return F.when(F.get(p, i) == "true", known).otherwise(F.raise_error(F.lit(f"the XML has no {n}")).cast("string")).alias(n)

    return let(found, lambda p: F.struct(*(value(p, 3 * k, n) for k, n in enumerate(names))))


# Trees in brackets


def tree_leaves(text: Column) -> Column:
    """Leaves of a bracketed tree, joined by spaces."""
    return F.array_join(F.regexp_extract_all(text, F.lit(r"([^()\s]+)\s*\)"), F.lit(1)), " ")


def tree_label(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*\(\s*([^()\s]+)", 1)


_PART = re.compile(r"\(|\)|[^()\s]+")


def subtrees_of(text: str) -> list[tuple[str, str]]:
    """(leaves, label) of each subtree, a node before those below it."""
    out: list[list] = []
    stack: list[int] = []
    leaves: list[str] = []
    fresh = False
    for p in _PART.findall(text):
        if p == "(":
            stack.append(len(out))
            out.append([len(leaves), None, ""])
            fresh = True
        elif p == ")":
            if not stack:
                raise ValueError("the tree has a bracket too many")
            own = out[stack.pop()]
            own[1], fresh = len(leaves), False
        elif fresh:
            out[stack[-1]][2], fresh = p, False
        else:
            if not stack:
                raise ValueError("there is text outside of the tree")
            leaves.append(p)
    if stack:
        raise ValueError("the tree lacks a bracket")
    return [(" ".join(leaves[a:b]), label) for a, b, label in out]


def sequence_leaves(text: Column) -> Column:
    """The words of a bracketed sequence of any depth without labels; a text without brackets is one by itself."""
    return F.filter(F.split(F.regexp_replace(text, r"[()]", " "), r"\s+"), lambda x: x != "")


def tree_rows(df: DataFrame, column: str, subtrees: bool = False, label_map: Mapping[str, str] | None = None) -> DataFrame:
    """df without the column, with text and label: of the tree, or (in Arrow batches) of each subtree, and its place."""
    others = [c for c in df.columns if c != column]
    if not subtrees:
        out = df.select(*others, tree_leaves(F.col(column)).alias("text"), tree_label(F.col(column)).alias("label"))
    else:

        @F.pandas_udf("array<struct<text:string,label:string>>")
        def parse(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: None if t is None else [{"text": a, "label": b} for a, b in subtrees_of(t)])

        out = df.select(*others, F.posexplode(parse(column)).alias("at", "x")).select(*others, "at", "x.text", "x.label")
    if label_map is None:
        return out
    flat = [F.lit(x) for pair in label_map.items() for x in pair]
    return out.withColumn("label", F.try_element_at(F.create_map(*flat), "label"))


def parse(df: DataFrame, column: str, kind: str, **options) -> DataFrame:
    """df's column in one of FORMATS, as columns."""
    kind = kind.lower()
    if kind not in FORMATS:
        raise ValueError(f"the format {kind} isn't one of {', '.join(FORMATS)}")
    if kind == "list":
        return from_list(df, column, options["names"])
    if kind == "tree":
        return tree_rows(df, column, **options)
    if kind == "dict":
        x = F.col(column)
        own = [F.try_element_at(x, F.lit(n)).alias(n) if df.schema[column].dataType.typeName() == "map" else x[n].alias(n) for n in options["names"]]
        return df.select(*[c for c in df.columns if c != column], *own)
    made = {"csv": lambda: from_csv(F.col(column), **options), "json": lambda: from_json(F.col(column), **options), "xml": lambda: from_xml(F.col(column), **options)}[kind]()
    return df.withColumn("__x", made).select(*[c for c in df.columns if c != column], "__x.*")


def line_parser(fn: Callable[[str], Sequence], schema: T.StructType) -> Callable[[DataFrame, str], DataFrame]:
    """Rows from a Python function of a line, in Arrow batches."""

    def apply(df: DataFrame, column: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([tuple(fn(x)) for x in b.iloc[:, 0]], columns=schema.names)

        return df.select(column).mapInPandas(run, schema)

    return apply
