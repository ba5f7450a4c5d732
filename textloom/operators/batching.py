"""Batches: rows of one batch_id, padded to the longest of them; buckets that keep lengths alike."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.fields import Field
from textloom.functions.arrays import last_of
from textloom.operators.dataset import Dataset, positions
from textloom.operators.numbering import numbered, seeded_order


def batch_count(rows: int, batch_size: int) -> int:
    return -(-rows // batch_size)


def assign(df: DataFrame, row_id: str, batch_size: int = 32, seed: int | None = None, sort_key: Column | None = None) -> DataFrame:
    """row_id, batch_id, pos: rows in their order, or shuffled by a seed; sort_key orders within a batch.

    Only ids and keys are numbered. The last batch may be short.
    """
    if batch_size < 1:
        raise ValueError("batch_size is at least 1")
    own = df.select(F.col(row_id), *([sort_key.alias("__sort")] if sort_key is not None else []))
    order = [row_id] if seed is None else [seeded_order(row_id, seed), F.col(row_id)]
    n = numbered(own, *order, name="__n").withColumn("batch_id", (F.col("__n") / batch_size).cast("long"))
    if sort_key is None:
        return n.select(row_id, "batch_id", F.pmod("__n", F.lit(batch_size)).alias("pos"))
    w = Window.partitionBy("batch_id").orderBy("__sort", "__n")
    return n.select(row_id, "batch_id", (F.row_number().over(w) - 1).cast("long").alias("pos"))


def assign_buckets(df: DataFrame, row_id: str, length: Column, batch_size: int = 32, look_ahead: int = 100) -> DataFrame:
    """row_id, batch_id, pos: chunks of batch_size * look_ahead rows are sorted by length, then cut into batches.

    Sorting stays within a chunk, of a size of its own: no step sees all rows at once.
    """
    if batch_size < 1 or look_ahead < 1:
        raise ValueError("batch_size and look_ahead are at least 1")
    own = df.select(row_id, length.alias("__len"))
    n = numbered(own, row_id, name="__n").withColumn("__bucket", (F.col("__n") / (batch_size * look_ahead)).cast("long"))
    w = Window.partitionBy("__bucket").orderBy("__len", "__n")
    k = n.withColumn("__k", (F.row_number().over(w) - 1).cast("long"))
    return k.select(row_id, (F.col("__bucket") * look_ahead + (F.col("__k") / batch_size).cast("long")).alias("batch_id"), F.pmod("__k", F.lit(batch_size)).alias("pos"))


def padded(df: DataFrame, batches: DataFrame, row_id: str, fields: dict[str, Field], pad_left: bool = False, truncate_left: bool = False) -> DataFrame:
    """batch_id, pos, row_id and each field's padded numbers; with lengths before padding where a field asks for them.

    df has the numbers of field f in the column fields names for it.
    """
    t = df.join(batches, row_id)
    w = Window.partitionBy("batch_id")
    out = [F.col("batch_id"), F.col("pos"), F.col(row_id)]
    for column, f in fields.items():
        ids = F.col(column)
        if f.disable_batch_matrix:
            out.append(ids.alias(f.name))
            continue
        width = F.lit(f.fixed_length) if f.fixed_length else F.max(F.coalesce(F.size(ids), F.lit(1))).over(w)
        t = t.withColumn(f"__w_{f.name}", width)
        out.append(f.padded(ids, F.col(f"__w_{f.name}"), pad_left, truncate_left).alias(f.name))
        if f.include_lengths:
            out.append(F.size(ids).cast("long").alias(f"{f.name}_length"))
    return t.select(*out)


def padding_share(lengths: DataFrame, batches: DataFrame, row_id: str, length: str) -> DataFrame:
    """One row: cells that are padding, all cells, and the share."""
    widths = lengths.join(batches, row_id).groupBy("batch_id").agg(F.max(length).alias("w"), F.count("*").alias("n"), F.sum(length).alias("used"))
    total = widths.agg(F.coalesce(F.sum(F.col("w") * F.col("n")), F.lit(0)).cast("long").alias("cells"), F.coalesce(F.sum("used"), F.lit(0)).cast("long").alias("used"))
    return total.select((F.col("cells") - F.col("used")).alias("padding"), "cells", F.round(F.when(F.col("cells") > 0, (F.col("cells") - F.col("used")) / F.col("cells")), 6).alias("share"))


@dataclass(frozen=True)
class BatchIterator:
    """Batches of a dataset, as a table or one after the other in the driver.

    kind: plain, bucket or single. epoch and at say where a later run goes on; each epoch has its own order.
    """

    dataset: Dataset
    batch_size: int = 32
    kind: str = "plain"
    shuffle: bool = True
    seed: int = 1
    sort_key: Column | None = None
    length: Column | None = None
    look_ahead: int = 100
    epoch: int = 0
    at: int = 0
    pads: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in ("plain", "bucket", "single"):
            raise ValueError("kind is plain, bucket or single")
        if self.kind == "bucket" and self.length is None:
            raise ValueError("buckets need a length")

    def __len__(self) -> int:
        return min(1, len(self.dataset)) if self.kind == "single" else batch_count(len(self.dataset), self.batch_size)

    def on(self, dataset: Dataset) -> BatchIterator:
        return replace(self, dataset=dataset, epoch=0, at=0)

    def next_epoch(self) -> BatchIterator:
        return replace(self, epoch=self.epoch + 1, at=0)

    def resumed(self, at: int) -> BatchIterator:
        return replace(self, at=at)

    def batches(self) -> DataFrame:
        d = self.dataset
        if self.kind == "single":
            return positions(d.df, d.row_id, row_id=d.row_id, name="pos").withColumn("batch_id", F.lit(0).cast("long"))
        if self.kind == "bucket":
            return assign_buckets(d.df, d.row_id, self.length, self.batch_size, self.look_ahead)
        return assign(d.df, d.row_id, self.batch_size, self.seed + self.epoch if self.shuffle else None, self.sort_key)

    def table(self) -> DataFrame:
        """All batches from `at` on."""
        d = self.dataset
        b = self.batches()
        b = b.filter(F.col("batch_id") >= self.at) if self.at else b
        return padded(d.numericalized(), b, d.row_id, {f"{f.name}_ids": f for f in d.schema.all()}, **self.pads)

    def __iter__(self) -> Iterator[dict]:
        """Each batch's matrices by field; partitions come to the driver one at a time."""
        rows, current = [], None
        for r in self.table().orderBy("batch_id", "pos").toLocalIterator():
            if current is not None and r["batch_id"] != current:
                yield self._matrices(rows)
                rows = []
            current = r["batch_id"]
            rows.append(r)
        if rows:
            yield self._matrices(rows)

    def _matrices(self, rows: list) -> dict:
        out = {}
        for f in self.dataset.schema.all():
            values = [r[f.name] for r in rows]
            out[f.name] = values if f.disable_batch_matrix else np.array(values)
            if f.include_lengths:
                out[f.name] = (out[f.name], np.array([r[f"{f.name}_length"] for r in rows]))
        return out


def hierarchical(contexts: DataFrame, batch_size: int = 32, longest: int | None = None, seed: int | None = None) -> DataFrame:
    """batch_id, pos, node_id and rows: each node's context, the last `longest` of it, and the node itself.

    contexts: node_id and context (an array of node ids in order), as of operators.tree.
    """
    ctx = F.col("context") if longest is None else last_of(F.col("context"), longest)
    rows = contexts.select("node_id", F.concat(ctx, F.array("node_id")).alias("rows"))
    return assign(rows, "node_id", batch_size, seed).join(rows, "node_id").select("batch_id", "pos", "node_id", "rows")


def hierarchical_matrices(contexts: DataFrame, ids: DataFrame, of: Field, name: str | None = None, batch_size: int = 32, longest: int | None = None, seed: int | None = None) -> DataFrame:
    """batch_id, pos, node_id and a matrix for each node: the padded numbers of its context's rows and its own, in order.

    ids: node_id and the field's numbers. Within a node's matrix all rows have the length of its longest, or fixed_length.
    """
    name = name or f"{of.name}_ids"
    rows = hierarchical(contexts, batch_size, longest, seed)
    flat = rows.select("batch_id", "pos", F.col("node_id").alias("__n"), F.posexplode("rows").alias("__at", "node_id")).join(ids.select("node_id", name), "node_id")
    lists = flat.groupBy("batch_id", "pos", F.col("__n").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", name))), lambda x: x[name]).alias("__l"))
    width = F.lit(of.fixed_length) if of.fixed_length else F.coalesce(F.array_max(F.transform("__l", lambda x: F.coalesce(F.size(x), F.lit(0)))), F.lit(0))
    pad = of.pad_symbol
    wide = lists.withColumn("__w", F.greatest(width, F.lit(1)))
    return wide.select("batch_id", "pos", "node_id", F.transform("__l", lambda x: of.padded(x, F.col("__w"), pad=pad)).alias(of.name))
