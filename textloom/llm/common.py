"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.batches import give_back  # noqa: F401
from textloom.storage import fresh_path, if_small as maybe_broadcast, shared_dir, written  # noqa: F401


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def row_of(docs: DataFrame):
    """All columns of docs as one, named row, so that no helper column can clash with them; `row.*` gives them back."""
    return F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")


#: Words of 64 bits that a sieve has at most; as a broadcast table they take some 32 MB.
SIEVE_WORDS = 1 << 20


def _sieved(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df with the column maybe: false only where none of keys (a written table) can be the row's.

    A bit map of the keys' hashes, of a size with a fixed bound, is broadcast, so rows with
    other keys needn't be shuffled. Beyond 64 keys a word it lets more and more rows pass.
    """
    words = min(SIEVE_WORDS, 1 << max(4, keys.count()).bit_length())
    h = F.xxhash64(*on)
    bit = F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({', '.join(map(quoted, on))}), 32) & 63 as int))")
    bits = keys.select(F.pmod(h, F.lit(words)).alias("sieve_word"), bit.alias("bit")).groupBy("sieve_word").agg(F.bit_or("bit").alias("sieve_bits"))
    j = df.withColumn("sieve_word", F.pmod(h, F.lit(words))).join(F.broadcast(bits), "sieve_word", "left")
    return j.withColumn("maybe", F.coalesce(F.col("sieve_bits"), F.lit(0).cast("long")).bitwiseAND(bit) != 0).drop("sieve_word", "sieve_bits")


def possible(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows of df that the sieve of keys (a written table) lets pass."""
    return _sieved(df, keys, on).filter("maybe").drop("maybe")


def split_possible(df: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of df that the sieve of keys (a written table) lets pass, and the others."""
    j = _sieved(df, keys, on)
    return j.filter("maybe").drop("maybe"), j.filter("not maybe").drop("maybe")


def matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of df with keys (a written table): only rows that the sieve lets pass are shuffled."""
    return possible(df, keys, on).join(keys, on)


def partly_joined(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The left join of df with keys (a written table, each key once): only rows that the sieve lets pass are shuffled."""
    j = _sieved(df, keys, on)
    kept = j.filter("not maybe").drop("maybe").withColumns({f.name: F.lit(None).cast(f.dataType) for f in keys.schema if f.name not in on})
    return j.filter("maybe").drop("maybe").join(keys, on, "left").unionByName(kept)


def without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df without the rows that have one of keys (a written table); nulls match nothing. Only rows that the sieve lets pass are shuffled."""
    j = _sieved(df, keys, on)
    kept = j.filter("not maybe").drop("maybe")
    return kept.unionByName(j.filter("maybe").drop("maybe").join(keys, on, "left_anti").select(*kept.columns))


def n_words(text):
    """Words of a text: runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def batches_by_key(
    batches: Iterator[pa.RecordBatch], key: str, most_rows: int = 1 << 62
) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of equal keys is cut."""
    kept: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(key)
        last = col[b.num_rows - 1]
        first_kept = kept[-1].column(key)[0] if kept else None
        cut = b.num_rows
        while cut and col[cut - 1] == last:
            cut -= 1
        if kept and (cut or first_kept != last):
            # The run held back ends within this batch.
            head = 0
            while head < cut and col[head] == first_kept:
                head += 1
            yield pa.Table.from_batches([*kept, b.slice(0, head)] if head else kept)
            kept = []
            if cut > head:
                yield pa.Table.from_batches([b.slice(head, cut - head)])
        elif not kept and cut:
            yield pa.Table.from_batches([b.slice(0, cut)])
        kept.append(b.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    base = int(offs[0]) if len(offs) else 0
    return data[base : int(offs[-1]) if len(offs) else 0], offs - base


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finisher of splitmix64: a bijection of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def table_query(fn: Callable[[DataFrame], DataFrame], table: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
