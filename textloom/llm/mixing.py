"""Mixing sources to target weights by nested hash thresholds.

Every document has a hash that depends on its id alone. A source's part of a
budget is the longest run of its documents, by hash from below, whose tokens
fit: documents whose hash is under a threshold. The threshold is found by
histograms: tokens are summed by source and the hash's top bits; only the
bucket in which a budget ends is looked into with the next bits, and so on.
No documents are sorted, and smaller budgets are subsets of larger ones.

Defined results: tokens are words (runs without white space), 0 for null
texts. A null source is a source of its own. Rows with equal doc_id (also
null) have equal hashes: they are kept or left together. A source without
tokens, or with a weight of 0, has a budget of 0, so of it only documents
before the first token in hash order are kept. A source shorter than its
budget is kept whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import maybe_broadcast, n_words, row_of, written

SEED, FRACTIONS, SHARE = "mix-1", (0.25, 0.5, 1.0), 0.8
BITS, LEVELS = 12, 5
_NULL = "\u0001null"


def doc_hash(doc_id, seed: str = SEED):
    """60 bits of the md5 of the seed and the id, as a bigint."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def _sub(h, level: int):
    return F.shiftright(h, BITS * (LEVELS - 1 - level)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def thresholds(narrow: DataFrame, weights: Mapping[str, float] | None, fractions: Sequence[float], share: float) -> DataFrame:
    """narrow: k (source), h, n. One row for each source and fraction: k, f, limit (null: all of it)."""
    hist = written(narrow.groupBy("k", _sub(F.col("h"), 0).alias("b")).agg(F.sum("n").alias("n")), "mix")
    totals = hist.groupBy("k").agg(F.sum("n").alias("total"))
    if weights is None:
        w = F.lit(1.0)
    else:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in weights.items() for x in (p[0], float(p[1]))]), F.col("k")), F.lit(0.0)) if weights else F.lit(0.0)
    totals = totals.withColumn("w", F.when(F.col("total") > 0, w).otherwise(0.0))
    every = totals.agg(F.sum("total").alias("every"), F.sum("w").alias("w_sum"))
    fr = F.explode(F.array(*[F.lit(float(f)) for f in fractions])).alias("f")
    goals = (
        totals.crossJoin(F.broadcast(every))  # one row
        .select("k", fr, F.when(F.col("w_sum") > 0, F.floor(F.col("f") * (F.lit(float(share)) * F.col("every") * F.col("w") / F.col("w_sum")))).otherwise(F.lit(0)).cast("long").alias("budget"))
    )
    edge = _edge(hist, goals.withColumn("base", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long")))
    found = written(edge, "mix")
    rows = None
    for level in range(1, LEVELS):
        open_ = found.filter("b is not null").select("k", "f", "budget", "base", "prefix")
        at = F.shiftright(F.col("h"), BITS * (LEVELS - level))
        src = narrow if rows is None else rows
        side = maybe_broadcast(open_, 64)
        keys = open_.select("k", "prefix").distinct()
        rows = written(src.withColumn("prefix", at).join(F.broadcast(keys) if side is not open_ else keys, ["k", "prefix"], "left_semi").select("k", "h", "n"), "mix")
        sub = rows.groupBy("k", at.alias("prefix"), _sub(F.col("h"), level).alias("b")).agg(F.sum("n").alias("n"))
        found = written(_edge(sub, open_).unionByName(found.filter("b is null")), "mix")
    return found.select("k", "f", F.when(F.col("b").isNotNull(), F.col("prefix")).alias("limit"))


def _edge(hist: DataFrame, goals: DataFrame) -> DataFrame:
    """Of each goal the first bucket in which the running sum passes the budget; b is null where none does."""
    run = Window.partitionBy("k", *(["prefix"] if "prefix" in hist.columns else [])).orderBy("b")
    cum = hist.withColumn("cum", F.sum("n").over(run))
    on = ["k", "prefix"] if "prefix" in hist.columns else ["k"]
    over = goals.join(cum, on, "left").groupBy("k", "f", "budget", "base", "prefix").agg(
        F.min(F.when(F.col("base") + F.col("cum") > F.col("budget"), F.struct("b", F.col("base").alias("x") + F.col("cum") - F.col("n")))).alias("hit")
    )
    return over.select(
        "k", "f", "budget",
        F.coalesce(F.col("hit.col2"), F.col("base")).alias("base"),
        F.when(F.col("hit").isNull(), F.col("prefix")).otherwise(F.col("prefix") * (1 << BITS) + F.col("hit.b")).cast("long").alias("prefix"),
        F.col("hit.b").alias("b"),
    )


def _with_tier(docs: DataFrame, weights, fractions, share, seed) -> DataFrame:
    """row (all columns of docs) and tier, where there is one."""
    key = F.coalesce(F.col("source"), F.lit(_NULL))
    narrow = docs.select(key.alias("k"), doc_hash(F.col("doc_id"), seed).alias("h"), n_words(F.col("text")).alias("n"))
    limits = thresholds(narrow, weights, fractions, share)
    by = written(
        limits.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("f", "limit"))).alias("__tl_limits")).withColumnRenamed("k", "__tl_k"),
        "mix",
    )
    by = maybe_broadcast(by, 64 + 32 * len(fractions))
    fits = F.filter("__tl_limits", lambda x: x["limit"].isNull() | (F.col("__tl_h") < x["limit"]))
    return (
        docs.select(row_of(docs), key.alias("__tl_k"), doc_hash(F.col("doc_id"), seed).alias("__tl_h"))
        .join(by, "__tl_k", "left")
        .withColumn("tier", F.try_element_at(F.transform(fits, lambda x: x["f"]), F.lit(1)))
        .filter("tier is not null")
    )


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, fractions: Sequence[float] = FRACTIONS, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """doc_id, source and tier, the smallest fraction of the budget that holds the document; rows in none are left out.

    weights: target weight by source (None: the same for all); a source of
    weight w may have w / sum(w) * share of all tokens. fractions: nested
    budgets as parts of that.
    """
    out = _with_tier(docs.select("doc_id", "source", "text"), weights, fractions, share, seed)
    return out.select("row.doc_id", "row.source", "tier")


def mix_filter(docs: DataFrame, weights: Mapping[str, float] | None = None, share: float = SHARE, seed: str = SEED) -> DataFrame:
    """The documents within the whole budget, with their columns."""
    return _with_tier(docs, weights, [1.0], share, seed).select("row.*")


def mix_sql(fractions: Sequence[float] = FRACTIONS, share: float = SHARE, seed: str = SEED, table: str = "documents") -> str:
    """The same for equal weights, by sorting."""
    values = ", ".join(f"({f}::DOUBLE)" for f in fractions)
    return f"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, chr(1) || 'null') AS k,
         ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT AS h,
         coalesce(len(regexp_extract_all(text, '\\S+')), 0)::BIGINT AS n
  FROM {table}),
t AS (SELECT k, sum(n)::BIGINT AS total FROM d GROUP BY k),
a AS (SELECT sum(total)::DOUBLE AS every, sum(CASE WHEN total > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS w_sum FROM t),
fr(f) AS (VALUES {values}),
g AS (SELECT k, f, CASE WHEN w_sum > 0 THEN floor(f * ({float(share)}::DOUBLE * every * (CASE WHEN total > 0 THEN 1.0::DOUBLE ELSE 0.0 END) / w_sum)) ELSE 0 END AS budget
      FROM t, a, fr),
c AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum FROM d)
SELECT c.doc_id, c.source, x.tier FROM c, LATERAL (SELECT min(f) AS tier FROM g WHERE g.k = c.k AND c.cum <= g.budget) x
WHERE x.tier IS NOT NULL"""
