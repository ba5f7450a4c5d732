"""Token lookups by a table of any size: lemmas and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.storage import if_small


def replace_tokens(df: DataFrame, tokens: str, row_id: str, table: DataFrame, form: str = "form", to: str = "lemma") -> DataFrame:
    """df with tokens replaced by table's value for them; others stay. A form that is there twice takes the least value."""
    known = table.groupBy(F.col(form).alias("__f")).agg(F.min(to).alias("__l"))
    flat = df.select(row_id, F.posexplode(tokens).alias("__p", "__t")).join(if_small(known, 96), F.col("__t") == F.col("__f"), "left")
    rows = flat.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("__p"), F.coalesce("__l", "__t").alias("__v")))), lambda x: x["__v"]).alias("__new"))
    return df.join(rows, row_id, "left").withColumn(tokens, F.when(F.col(tokens).isNotNull(), F.coalesce("__new", F.array().cast("array<string>")))).drop("__new")
