"""Dense numbers for rows in an order, without a window over one partition."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.storage import written


def _desc_of(order: Column | str) -> Column:
    return F.col(order) if isinstance(order, str) else order


def numbered(df: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """df with 0, 1, 2, ... in the given order, which should have no ties.

    One range shuffle, written to the shared folder, so that a second reading
    sees the same cuts; each partition then starts at the sum of the rows of
    those before it. The driver holds one number for each partition.
    """
    spark = df.sparkSession
    keys = [_desc_of(o) for o in order]
    at = f"__at_{uuid.uuid4().hex[:8]}"
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    held = written(ranged.withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(at), 33)
    sizes = sorted((r["p"], r["c"]) for r in held.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect())
    offsets, before = [], 0
    for p, c in sizes:
        offsets.append((p, before))
        before += c
    within = F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    if not offsets:
        return held.withColumn(name, F.lit(0).cast("long")).drop(at)
    starts = [0] * (offsets[-1][0] + 1)
    for p, b in offsets:
        starts[p] = b
    start = F.element_at(F.lit(starts).cast("array<long>"), (part + 1).cast("int"))
    return held.withColumn(name, (start + within).cast("long")).drop(at)


def seeded_order(row_id: str, seed: int | str) -> Column:
    """A key that shuffles rows: the digest of the id and a seed, the same in any engine and on any cluster."""
    return F.md5(F.concat(F.col(row_id).cast("string"), F.lit(f"-{seed}")))
