"""Count and TF-IDF features: a row's columns and values as a pair of arrays, or in long form.

A row's tokens lie in one row of the table, so counting needs no shuffle; only
document frequencies are aggregated over rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.batches import in_parts
from textloom.operators import vocab as V
from textloom.storage import BROADCAST_BYTES, written


def columns_of(vocab: DataFrame, specials: Iterable[V.Special | str] | None = None) -> DataFrame:
    """idx and col: the vocabulary's rows as matrix columns, without gaps. Left out are all its specials, or those given (words too)."""
    if specials is None:
        kept = vocab.filter("special is null")
        before = vocab.filter("special is not null").select("idx")
    else:
        kinds = [s.kind for s in specials if isinstance(s, V.Special)]
        words = [s for s in specials if isinstance(s, str)]
        out = F.col("special").isin(kinds) if kinds else F.lit(False)
        out = F.coalesce(out, F.lit(False)) | (F.col("special").isNull() & (F.col("token").isin(words) if words else F.lit(False)))
        kept, before = vocab.filter(~out), vocab.filter(out).select("idx")
    # The gaps are few: special tokens.
    gaps = sorted(r[0] for r in before.collect())
    less = sum((F.when(F.col("idx") > g, 1).otherwise(0) for g in gaps), F.lit(0))
    return kept.select("idx", (F.col("idx") - less).cast("long").alias("col"))


def counts(df: DataFrame, ids: str, columns: DataFrame, row_id: str) -> DataFrame:
    """row_id, cols, tf: of each row the columns its numbers have, in order, and how often."""
    spark = df.sparkSession
    n = columns.count()
    if n * 16 > BROADCAST_BYTES:
        flat = df.select(row_id, F.explode(ids).alias("idx")).join(columns, "idx").groupBy(row_id, "col").agg(F.count("*").alias("tf"))
        rows = flat.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("col", "tf"))).alias("x"))
        empty = F.array().cast("array<long>")
        return df.select(row_id).join(rows, row_id, "left").select(row_id, F.coalesce(F.col("x.col"), empty).alias("cols"), F.coalesce(F.col("x.tf"), empty).alias("tf"))
    table = columns.orderBy("idx").toArrow()
    idx, col = table["idx"].to_numpy(), table["col"].to_numpy()
    known = spark.sparkContext.broadcast((idx, col))

    def run(rows: pa.Array) -> pa.Array:
        idx, col = known.value
        lengths = np.asarray(pc.fill_null(pc.list_value_length(rows), 0))
        flat = np.asarray(pc.list_flatten(rows)).astype(np.int64)
        row = np.repeat(np.arange(len(rows)), lengths)
        at = np.searchsorted(idx, flat)
        ok = at < len(idx)
        ok[ok] = idx[at[ok]] == flat[ok]
        row, c = row[ok], col[at[ok]]
        order = np.lexsort((c, row))
        row, c = row[order], c[order]
        start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (c[1:] != c[:-1])]) if len(row) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[start, len(row)])
        offs = pa.array(np.r_[0, np.cumsum(np.bincount(row[start], minlength=len(rows)))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offs, pa.array(v, pa.int64())) for v in (c[start], tf)]
        return pa.StructArray.from_arrays(lists, names=["cols", "tf"])

    return df.select(row_id, in_parts("struct<cols:array<long>,tf:array<long>>", run)(F.col(ids)).alias("x")).select(row_id, "x.cols", "x.tf")


def long_form(rows: DataFrame, row_id: str, values: str = "tf", name: str = "value") -> DataFrame:
    """row_id, col and value, one row for each cell that isn't 0."""
    return rows.select(row_id, F.explode(F.arrays_zip("cols", values)).alias("x")).select(row_id, F.col("x.cols").alias("col"), F.col(f"x.{values}").alias(name))


@dataclass(frozen=True)
class CountVectorizer:
    """Counts of a vocabulary's words; specials: what has no column (by default the vocabulary's special tokens)."""

    vocab: DataFrame
    specials: tuple[V.Special | str, ...] | None = None

    def transform(self, df: DataFrame, ids: str, row_id: str) -> DataFrame:
        return counts(df, ids, columns_of(self.vocab, self.specials), row_id)


@dataclass(frozen=True)
class TfIdf:
    """TF-IDF as in scikit-learn's manual: idf = ln((1 + n) / (1 + df)) + 1, or ln(n / df) + 1 without smoothing.

    norm: l2, l1 or None. sublinear_tf: 1 + ln(tf).
    """

    vocab: DataFrame
    norm: str | None = "l2"
    use_idf: bool = True
    smooth_idf: bool = True
    sublinear_tf: bool = False
    specials: tuple[V.Special | str, ...] | None = None
    idf: DataFrame | None = None

    def __post_init__(self) -> None:
        if self.norm not in ("l2", "l1", None):
            raise ValueError("norm is l2, l1 or None")

    def _counts(self, df: DataFrame, ids: str, row_id: str) -> DataFrame:
        return counts(df, ids, columns_of(self.vocab, self.specials), row_id)

    def fit(self, df: DataFrame, ids: str, row_id: str) -> TfIdf:
        """Document frequencies of df; cols without any aren't in idf's table."""
        rows = self._counts(df, ids, row_id)
        n = df.count()
        found = rows.select(F.explode("cols").alias("col")).groupBy("col").agg(F.count("*").alias("df"))
        value = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1 if self.smooth_idf else F.log(F.lit(float(n)) / F.col("df")) + 1
        idf = written(found.select("col", value.alias("idf")), "idf")
        return TfIdf(self.vocab, self.norm, self.use_idf, self.smooth_idf, self.sublinear_tf, self.specials, idf)

    def transform(self, df: DataFrame, ids: str, row_id: str) -> DataFrame:
        """row_id, cols, values. Words that no fitted row has weigh ln(1 + n) + 1 with smoothing; without, they're left out."""
        if self.use_idf and self.idf is None:
            raise RuntimeError("fit first")
        rows = self._counts(df, ids, row_id)
        tf = F.transform("tf", lambda x: (F.lit(1.0) + F.log(x.cast("double"))) if self.sublinear_tf else x.cast("double"))
        rows = rows.select(row_id, "cols", tf.alias("values"))
        if self.use_idf:
            rows = self._weighted(rows, row_id)
        if self.norm is None:
            return rows
        size = F.aggregate("values", F.lit(0.0), lambda a, x: a + (x * x if self.norm == "l2" else F.abs(x)))
        rows = rows.withColumn("__n", F.sqrt(size) if self.norm == "l2" else size)
        return rows.select(row_id, "cols", F.when(F.col("__n") > 0, F.transform("values", lambda x: x / F.col("__n"))).otherwise(F.col("values")).alias("values"))

    def _weighted(self, rows: DataFrame, row_id: str) -> DataFrame:
        spark = rows.sparkSession
        if self.idf.count() * 16 > BROADCAST_BYTES:
            flat = long_form(rows, row_id, "values").join(self.idf, "col").withColumn("v", F.col("value") * F.col("idf"))
            x = flat.groupBy(row_id).agg(F.array_sort(F.collect_list(F.struct("col", "v"))).alias("x"))
            return rows.select(row_id).join(x, row_id, "left").select(row_id, F.coalesce(F.col("x.col"), F.array().cast("array<long>")).alias("cols"), F.coalesce(F.col("x.v"), F.array().cast("array<double>")).alias("values"))
        table = self.idf.orderBy("col").toArrow()
        width = columns_of(self.vocab, self.specials).count()
        dense = np.full(width, np.nan)
        dense[table["col"].to_numpy()] = table["idf"].to_numpy()
        known = spark.sparkContext.broadcast(dense)

        def run(cols: pa.Array, values: pa.Array) -> pa.Array:
            lengths = np.asarray(pc.fill_null(pc.list_value_length(cols), 0))
            row = np.repeat(np.arange(len(cols)), lengths)
            c, v = np.asarray(pc.list_flatten(cols)).astype(np.int64), np.asarray(pc.list_flatten(values)).astype(np.float64)
            w = known.value[c] * v if len(c) else v
            ok = ~np.isnan(w)
            offs = pa.array(np.r_[0, np.cumsum(np.bincount(row[ok], minlength=len(cols)))].astype(np.int32))
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offs, pa.array(c[ok])), pa.ListArray.from_arrays(offs, pa.array(w[ok]))], names=["cols", "values"])

        return rows.select(row_id, in_parts("struct<cols:array<long>,values:array<double>>", run)("cols", "values").alias("x")).select(row_id, "x.cols", "x.values")

    def fit_transform(self, df: DataFrame, ids: str, row_id: str) -> DataFrame:
        return self.fit(df, ids, row_id).transform(df, ids, row_id)


def to_vectors(rows: DataFrame, row_id: str, width: int, values: str = "values") -> DataFrame:
    """row_id and features, a sparse vector for pyspark.ml: put together in the JVM as the struct that its type is, and read as that."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    parts = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(width).alias("size"), F.col("cols").cast("array<int>").alias("indices"), F.col(values).cast("array<double>").alias("values"))
    plain = written(rows.select(row_id, parts.alias("features")), "vectors")
    kind = StructType([plain.schema[row_id], StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(kind).parquet(*plain.inputFiles()) if plain.inputFiles() else rows.sparkSession.createDataFrame([], kind)
