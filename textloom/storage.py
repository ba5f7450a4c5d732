"""Where intermediate tables go, and the size checks before a broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only where it is unset and Spark is local, one of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths that were given out, for those who know when their tables aren't read any more.
_given: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _given.append(f"{shared_dir(spark)}/textloom-{name}-{uuid.uuid4().hex}")
    return _given[-1]


def mark() -> int:
    """For drop_since: what is written from here on."""
    return len(_given)


def drop_since(spark: SparkSession, since: int, *kept: DataFrame) -> None:
    """Delete the tables written since a mark but for those that kept read."""
    used = [f for df in kept for f in df.inputFiles()]
    j = spark.sparkContext._jvm
    for path in _given[since:]:
        name = path.rsplit("/", 1)[1]
        if not any(f"/{name}/" in f for f in used):
            folder = j.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    _given[since:] = [p for p in _given[since:] if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in used)]


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder, and read it again."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """A broadcast hint if df is counted (df should be a written table, or rows be known) and found small."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A small input over all cores: read files of few row groups give few tasks work, whatever their splits.

    Only an input whose estimated size leaves less than a usual partition for each core is shuffled, by keys.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if size < cores * (128 << 20) and len(df.inputFiles()) < cores else df
