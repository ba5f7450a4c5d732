"""Exact deduplication by a stateful stream with disk-backed keyed state.

The stream reads a log of (digest, stable identifier, content locator), one
row for each document. Its state, kept by RocksDB without expiry, has for
each digest the identifier and locator of its keeper and the number of rows
seen. A locator says in which file (by a hash of its path) and at which row
the content lies. Digests that the state has met more than once are hits: the
contents of their rows and of the state's keeper are looked up by their
locators, and their full bytes compared, so that a collision of digests can't
remove a document. Rows with other bytes than the keeper are grouped by their
whole text. Only keys and the texts of hits are shuffled; keepers are joined
to the other rows, so a text that many rows have can be split.

Documents that aren't rows of Parquet files are written into the shared
folder first, and located there.

Defined results: documents are copies if their texts have the same bytes. The
keeper of a set of copies is the one with the smallest doc_id (null before
all), whatever the order of arrival, so a run that resumes or is cut into
other batches gives the same rows. Empty texts are copies of each other; null
texts are copies of nothing. Of fully repeated rows, which have one doc_id,
`dedup` gives each a row with itself as keeper's id, marked kept for one of
them; `dedup_filter` keeps one of them. Other columns are ignored by `dedup`
and kept by `dedup_filter`, for repeated ids those of any one of the rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.common import fresh_path, matching, row_of, without, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCH_BYTES = 8 << 30


def digest_of(text, bits: int = 128):
    """md5 of the bytes, cut to the given number of bits; null for null."""
    return F.substring(F.md5(text), 1, max(1, bits // 4))


def run_state(spark: SparkSession, log_dir: str, state_dir: str, out_dir: str, schema, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Feed what is new in log_dir to the state; returns the digests met more than once so far: digest, keeper.

    The state lives in state_dir. A second call with more files in log_dir
    goes on from it. log rows: digest, doc_id, locator.
    """
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        log = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(batch_bytes)).parquet(log_dir).filter("digest is not null")
        state = log.groupBy("digest").agg(F.min(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("n"))

        def keep(batch: DataFrame, n: int) -> None:
            batch.filter("n > 1").select("digest", "keeper", "n").write.mode("overwrite").parquet(f"{out_dir}/batch={n:09d}")

        q = state.writeStream.outputMode("update").option("checkpointLocation", state_dir).foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    shape = f"digest string, keeper struct<doc_id:{schema['doc_id'].dataType.simpleString()},locator:{schema['locator'].dataType.simpleString()}>, n long, batch long"
    try:
        seen = spark.read.schema(shape).parquet(out_dir)
    except Exception as e:  # nothing was ever written: an empty log has no batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], shape).select("digest", "keeper")
    # A digest's latest batch has its state.
    return seen.groupBy("digest").agg(F.max_by("keeper", "batch").alias("keeper")).select("digest", "keeper")


def _located(docs: DataFrame) -> DataFrame:
    """row (all columns), text, doc_id, and the locator's file and at."""
    columns = [row_of(docs), F.col("text"), F.col("doc_id")]
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    try:
        return docs.select(*columns, *place)
    except AnalysisException:  # not the rows of Parquet files
        return written(docs.select(*columns), "contents").select("row", "text", "doc_id", *place)


def _verdicts(rows: DataFrame, bits: int, batch_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The log (digest, doc_id, locator) of all rows, and file, at, keeper_id, kept of the rows whose digests came again; written tables."""
    spark = rows.sparkSession
    root = fresh_path(spark, "dedup")
    log = rows.select(digest_of(F.col("text"), bits).alias("digest"), "doc_id", F.struct("file", "at").alias("locator"))
    log.write.option("compression", "zstd").parquet(f"{root}/log")
    hits = written(run_state(spark, f"{root}/log", f"{root}/state", f"{root}/out", log.schema, batch_bytes), "hits")
    log = spark.read.schema(log.schema).parquet(f"{root}/log")
    again = matching(log, hits, ["digest"]).select(
        "digest", "doc_id", "locator.*", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.locator.file").alias("keeper_file"), F.col("keeper.locator.at").alias("keeper_at")
    )
    again = written(again, "again")
    texts = matching(rows.select("file", "at", "text"), again, ["file", "at"])
    is_keeper = (F.col("file") == F.col("keeper_file")) & (F.col("at") == F.col("keeper_at"))
    keepers = texts.filter(is_keeper).select("keeper_file", "keeper_at", F.col("text").alias("keeper_text"))
    held = written(texts.filter(~is_keeper).join(keepers, ["keeper_file", "keeper_at"]).withColumn("same", F.col("text") == F.col("keeper_text")).select(
        "file", "at", "digest", "doc_id", "keeper_id", "same", F.when(~F.col("same"), F.col("text")).alias("text")
    ), "held")
    # True collisions are told apart by their whole texts.
    first = Window.partitionBy("digest", "text").orderBy(F.col("doc_id").asc_nulls_first(), "file", "at")
    other = held.filter("not same").select("file", "at", F.first("doc_id").over(first).alias("keeper_id"), (F.row_number().over(first) == 1).alias("kept"))
    own = again.filter(is_keeper).select("file", "at", "keeper_id", F.lit(True).alias("kept"))
    return log, written(own.unionByName(held.filter("same").select("file", "at", "keeper_id", F.lit(False).alias("kept"))).unionByName(other), "verdicts")


def dedup(docs: DataFrame, bits: int = 128, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, keeper_id, kept: one row for each row of docs."""
    log, verdicts = _verdicts(_located(docs.select("doc_id", "text")), bits, batch_bytes)
    judged = log.select("doc_id", "locator.*").join(verdicts, ["file", "at"], "left")
    return judged.select("doc_id", F.when(F.col("kept").isNull(), F.col("doc_id")).otherwise(F.col("keeper_id")).alias("keeper_id"), F.coalesce("kept", F.lit(True)).alias("kept"))


def dedup_filter(docs: DataFrame, bits: int = 128, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """The kept rows of docs, with their columns."""
    rows = _located(docs)
    gone = written(_verdicts(rows, bits, batch_bytes)[1].filter("not kept").select("file", "at"), "gone")
    return without(rows.select("row", "file", "at"), gone, ["file", "at"]).select("row.*")


DEDUP_SQL = """
SELECT doc_id, first_value(doc_id) OVER w AS keeper_id, row_number() OVER w = 1 AS kept FROM documents
WINDOW w AS (PARTITION BY text, CASE WHEN text IS NULL THEN doc_id END ORDER BY doc_id NULLS FIRST)"""
