"""Forests as tables: node_id in preorder, parent_id, depth, path (the ancestors' ids, from the root down)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered
from textloom.storage import written


def flatten_json(docs: DataFrame, column: str, children: str = "children", row_id: str | None = None, parser: Callable[[dict], tuple[dict, list]] | None = None) -> DataFrame:
    """Nodes of JSON documents that are lists of trees: [row_id,] node_id, parent_id, depth, path, data (JSON).

    Preorder starts at 0 in each document. A document that is broken or no list is an error. One document
    is parsed in one task; documents are parsed side by side.
    """
    key = f"{row_id} {docs.schema[row_id].dataType.simpleString()}, " if row_id else ""

    def nodes(text: str) -> list[tuple]:
        roots = json.loads(text)
        if not isinstance(roots, list):
            raise ValueError("the root of the JSON isn't a list")
        out: list[tuple] = []
        stack = [(r, None, 0, []) for r in reversed(roots)]
        while stack:
            node, parent, depth, path = stack.pop()
            if parser:
                own, below = parser(node)
            else:
                own, below = {k: v for k, v in node.items() if k != children}, node.get(children) or []
            me = len(out)
            out.append((me, parent, depth, path, json.dumps(own, ensure_ascii=False)))
            stack += [(c, me, depth + 1, [*path, me]) for c in reversed(below)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r[-1] is not None:
                    rows += [(*r[:-1], *x) for x in nodes(r[-1])]
            names = [*([row_id] if row_id else []), "node_id", "parent_id", "depth", "path", "data"]
            out = pd.DataFrame(rows, columns=names)
            out["parent_id"] = out["parent_id"].astype("Int64")
            yield out

    return docs.select(*([row_id] if row_id else []), column).mapInPandas(run, f"{key}node_id long, parent_id long, depth int, path array<long>, data string")


def from_levels(levels: Sequence[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """A forest of tables that refer to the one before by a foreign key: node_id, parent_id, depth, path, level, key.

    levels: (table, key, foreign key to the level above; None at the top). Siblings go by key.
    """
    paths, above = [], None
    for depth, (df, key, foreign) in enumerate(levels):
        k = F.col(key).cast("long")
        if above is None:
            own = df.select(k.alias("key"), F.array(k).alias("keys"))
        else:
            up = above.select(F.col("key").alias("__up"), F.col("keys").alias("__keys"))
            own = df.join(up, F.col(foreign).cast("long") == F.col("__up")).select(k.alias("key"), F.concat("__keys", F.array(k)).alias("keys"))
        paths.append(own.withColumn("depth", F.lit(depth)))
        above = own
    union = paths[0]
    for p in paths[1:]:
        union = union.unionByName(p)
    # Arrays compare from the front, and a prefix is less: that is preorder.
    n = numbered(union, "keys", name="node_id")
    ids = n.select(F.col("keys").alias("__k"), F.col("node_id").alias("__id"))
    links = n.select("node_id", "keys", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("keys")), lambda i: F.slice("keys", 1, i))).alias("__at", "__k"))
    path = links.filter(F.col("__at") < F.size("keys") - 1).join(ids, "__k").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__id"))), lambda x: x["__id"]).alias("path"))
    out = n.join(path, "node_id", "left").withColumn("path", F.coalesce("path", F.array().cast("array<long>")))
    return out.select("node_id", F.when(F.col("depth") > 0, F.element_at("path", -1)).alias("parent_id"), "depth", "path", F.element_at("keys", -1).alias("key"))


def depth(nodes: DataFrame) -> int:
    """The greatest depth; -1 for no nodes."""
    found = nodes.agg(F.max("depth")).first()[0]
    return -1 if found is None else found


#: Nodes and children that are paired in one tile.
_TILE_NODES, _TILE_KIDS = 2048, 256


def _runs(df: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """key, column (a sorted array) and its first and last value: each key's values in order, cut into runs of a size."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(column))
    runs = df.withColumn("__run", F.floor((n - 1) / size)).groupBy(key, "__run").agg(F.sort_array(F.collect_list(column)).alias(column))
    return runs.select(key, F.col(column), F.get(column, 0).alias(f"{column}_first"), F.element_at(column, -1).alias(f"{column}_last"))


def context(nodes: DataFrame, levels: int | None = None) -> DataFrame:
    """node_id, ctx_id: what precedes each node within its surroundings, in long form.

    These are the ancestor levels + 1 steps up (or the root) and, below it, all ancestors and their earlier
    siblings, and the node's own earlier siblings. A child of an ancestor with a smaller number is an
    ancestor or an earlier sibling, as numbers are in preorder.

    Pairs are as many as the squares of the numbers of siblings. They are made in tiles of runs of a parent's
    children and of the nodes below it, spread over all tasks; in a tile each node has the same few ids, so
    what is written of them is small.
    """
    spark = nodes.sparkSession
    path = F.col("path") if levels is None else F.slice("path", F.greatest(F.size("path") - levels, F.lit(1)), levels + 1)
    near = nodes.filter(F.size("path") > 0).select("node_id", path.alias("up"))
    start = near.select("node_id", F.element_at("up", 1).alias("ctx_id"))
    kids = nodes.filter("parent_id is not null").select(F.col("node_id").alias("ctx_id"), F.col("parent_id").alias("__p"))
    below = written(_runs(near.select("node_id", F.explode("up").alias("__p")), "__p", "node_id", _TILE_NODES), "below")
    runs = written(_runs(kids, "__p", "ctx_id", _TILE_KIDS), "kids")
    tiles = below.join(runs, "__p").filter(F.col("ctx_id_first") < F.col("node_id_last"))
    tasks = 4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tasks = max(1, min(tasks, tiles.count()))
    tiles = tiles.repartition(tasks, "__p", "node_id_first", "ctx_id_first")
    # Generated code holds all rows that it makes of one. Coalescing to as many tasks ends it, so that this is a node's part of a tile, not a tile.
    each = tiles.select(F.explode("node_id").alias("node_id"), "ctx_id").coalesce(tasks).select("node_id", F.explode("ctx_id").alias("ctx_id"))
    return start.unionByName(each.filter(F.col("ctx_id") < F.col("node_id")))


def contexts(nodes: DataFrame, levels: int | None = None, longest: int | None = None) -> DataFrame:
    """node_id, context: the same as sorted arrays; empty for roots.

    longest: only the last ones of each. A parent's last children before a node are found by its place among its
    siblings, so a node of many children isn't joined with all pairs of them.
    """
    if longest is not None:
        near = _nearest(nodes, levels, longest)
    else:
        near = context(nodes, levels)
    found = near.groupBy("node_id").agg(F.sort_array(F.collect_list("ctx_id")).alias("context"))
    rows = nodes.select("node_id").join(found, "node_id", "left").select("node_id", F.coalesce("context", F.array().cast("array<long>")).alias("context"))
    return rows if longest is None else rows.withColumn("context", F.slice("context", F.greatest(F.size("context") - longest + 1, F.lit(1)), longest))


def _nearest(nodes: DataFrame, levels: int | None, longest: int) -> DataFrame:
    """node_id, ctx_id as of context, but of each parent on the way only its last `longest` children so far."""
    path = F.col("path") if levels is None else F.slice("path", F.greatest(F.size("path") - levels, F.lit(1)), levels + 1)
    near = nodes.filter(F.size("path") > 0).select("node_id", path.alias("up"))
    start = near.select("node_id", F.element_at("up", 1).alias("ctx_id"))
    kids = nodes.filter("parent_id is not null").select("node_id", F.col("parent_id").alias("__p"))
    # Each child with those before it: a frame of fixed length.
    frame = Window.partitionBy("__p").orderBy("node_id").rowsBetween(-longest, -1)
    earlier = kids.withColumn("__before", F.collect_list("node_id").over(frame)).select(F.col("node_id").alias("__kid"), "__p", "__before")
    # On the way from the top to a node: of each parent the child that leads on, and the node itself at the end.
    steps = near.select("node_id", F.posexplode("up").alias("__at", "__p"), F.slice(F.concat("up", F.array("node_id")), 2, F.size("up")).alias("__kids"))
    steps = steps.select("node_id", "__p", F.element_at("__kids", F.col("__at") + 1).alias("__kid"))
    leads = steps.filter(F.col("__kid") < F.col("node_id")).select("node_id", F.col("__kid").alias("ctx_id"))
    before = steps.join(earlier, ["__p", "__kid"]).select("node_id", F.explode("__before").alias("ctx_id"))
    return start.unionByName(leads).unionByName(before)
