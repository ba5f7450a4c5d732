"""Vocabularies: tables of tokens by descending frequency, and lookups in them.

A finalized vocabulary is a table (idx, token, freq, special). Special tokens
are rows of their own, told apart by their kind in `special`, so a word of
the text that is spelled like one isn't taken for it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.batches import in_parts
from textloom.operators.numbering import numbered
from textloom.storage import BROADCAST_BYTES, if_small, written


@dataclass(frozen=True)
class Special:
    """A special token; `place` says where it's added to a row's tokens: first, last or nowhere."""

    kind: str
    text: str
    place: str = ""

    def apply(self, tokens: Column) -> Column:
        own = F.array(F.lit(self.text))
        return F.concat(own, tokens) if self.place == "first" else F.concat(tokens, own) if self.place == "last" else tokens


UNK, PAD = Special("unk", "<UNK>"), Special("pad", "<PAD>")
BOS, EOS = Special("bos", "<BOS>", "first"), Special("eos", "<EOS>", "last")


def with_specials(tokens: Column, specials: Sequence[Special]) -> Column:
    """Specials put on rows of tokens, in their order."""
    return reduce(lambda t, s: s.apply(t), specials, tokens)


@dataclass(frozen=True)
class VocabSpec:
    """max_size counts special tokens too. ties: first_seen (the row, then the place) or token (code points)."""

    max_size: int | None = None
    min_freq: int = 1
    specials: tuple[Special, ...] = (UNK, PAD)
    ties: str = "first_seen"

    def __post_init__(self) -> None:
        kinds = [s.kind for s in self.specials]
        if len(set(kinds)) < len(kinds):
            raise ValueError("two specials are of one kind")
        if self.ties not in ("first_seen", "token"):
            raise ValueError("ties is first_seen or token")
        if self.max_size is not None and self.max_size < len(kinds):
            raise ValueError("max_size is less than the special tokens need")

    def merged(self, other: VocabSpec) -> VocabSpec:
        """min of min_freq; sum of max_size, none if either has none; specials of both, by kind."""
        size = None if self.max_size is None or other.max_size is None else self.max_size + other.max_size
        own = {s.kind for s in self.specials}
        return replace(self, max_size=size, min_freq=min(self.min_freq, other.min_freq), specials=self.specials + tuple(s for s in other.specials if s.kind not in own))


# Rows up to 2^39 and places up to 2^24 fit one long, whose minimum is aggregated by hash; a struct's would need a sort.
_PLACES = 24


def _place() -> Column:
    """Where a token is, of r and pos."""
    fits = F.col("r").between(0, (1 << (63 - _PLACES)) - 1) & (F.col("pos") < (1 << _PLACES))
    return F.when(fits, F.shiftleft("r", _PLACES) + F.col("pos")).otherwise(F.raise_error(F.lit("a row id or place is too large for first_seen; number the rows")).cast("long"))


def counts(df: DataFrame, tokens: Sequence[str] | str, row_id: str) -> DataFrame:
    """token, freq, first: how often tokens of one or more columns come and where first, in one pass over df.

    Row ids are 0 to 2^39 - 1. Columns come one after the other within a row. Nulls aren't counted.
    Specials are put on rows after counting.
    """
    columns = [tokens] if isinstance(tokens, str) else list(tokens)
    values = F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns)) if len(columns) > 1 else F.col(columns[0])
    t = df.select(F.col(row_id).cast("long").alias("r"), F.posexplode(values).alias("pos", "token")).filter("token is not null")
    return t.groupBy("token").agg(F.count("*").alias("freq"), F.min(_place()).alias("first"))


def _tagged(k: int):
    return lambda t, i: F.struct(F.lit(k).alias("vocab"), i.alias("pos"), t.alias("token"))


def counts_of_several(df: DataFrame, columns: Sequence[Sequence[str]], row_id: str) -> list[DataFrame]:
    """The counts of several vocabularies, each of one or more columns, in one pass over df."""
    if len(columns) == 1:
        return [counts(df, columns[0], row_id)]
    tagged = []
    for k, own in enumerate(columns):
        values = F.concat(*(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in own))
        tagged.append(F.transform(values, _tagged(k)))
    t = df.select(F.col(row_id).cast("long").alias("r"), F.inline(F.concat(*tagged))).filter("token is not null")
    all_counts = written(t.groupBy("vocab", "token").agg(F.count("*").alias("freq"), F.min(_place()).alias("first")), "counts")
    return [all_counts.filter(F.col("vocab") == k).select("token", "freq", "first") for k in range(len(columns))]


def finalize(freqs: DataFrame, spec: VocabSpec = VocabSpec()) -> DataFrame:
    """idx, token, freq, special, from token, freq and first."""
    spark = freqs.sparkSession
    k = len(spec.specials)
    ties = ["first", "token"] if spec.ties == "first_seen" else ["token"]
    order = [F.desc("freq"), *(F.asc(x) for x in ties)]
    kept = freqs.filter(F.col("freq") >= spec.min_freq) if spec.min_freq > 1 else freqs
    if spec.max_size is not None:
        # A top-k whose size is the vocabulary's own limit: each partition sends its k best.
        kept = kept.orderBy(*order).limit(spec.max_size - k)
    words = numbered(kept.select("token", "freq", *(x for x in ties if x != "token")), *order, name="idx")
    words = words.select((F.col("idx") + k).alias("idx"), "token", "freq", F.lit(None).cast("string").alias("special"))
    if not k:
        return words
    rows = [(i, s.text, 0, s.kind) for i, s in enumerate(spec.specials)]
    return spark.createDataFrame(rows, "idx long, token string, freq long, special string").unionByName(words)


def merge(parts: Iterable[DataFrame]) -> DataFrame:
    """The sums of token, freq, first of several counts; the earlier part's tokens are seen first."""
    ranked = [p.select("token", "freq", F.col("first"), F.lit(i).alias("part")) for i, p in enumerate(parts)]
    union = reduce(DataFrame.unionByName, ranked)
    # The first part's order, then the next one's: parts fit beside the place as a second minimum.
    by_part = union.groupBy("token").agg(F.sum("freq").alias("freq"), F.min("part").alias("part"), F.min(F.when(F.col("part") == 0, F.col("first"))).alias("f0"), F.min("first").alias("f"))
    if len(ranked) <= 2:
        return by_part.select("token", "freq", "part", F.coalesce("f0", "f").alias("first"))
    first = union.join(by_part.select("token", "part"), ["token", "part"]).groupBy("token").agg(F.min("first").alias("first"))
    return by_part.select("token", "freq", "part").join(first, "token")


def finalize_merged(merged: DataFrame, spec: VocabSpec = VocabSpec()) -> DataFrame:
    """As finalize, where ties go by the part first."""
    top = merged.agg(F.max("first")).first()[0] or 0
    shifted = merged.withColumn("first", (F.col("part").cast("decimal(38,0)") * F.lit(top + 1).cast("decimal(38,0)") + F.col("first")).cast("decimal(38,0)"))
    return finalize(shifted, spec)


def merge_finalized(vocabs: Iterable[DataFrame], spec: VocabSpec = VocabSpec()) -> DataFrame:
    """Vocabularies of which no frequencies are kept: each counts its tokens once."""
    parts = [v.filter("special is null").select("token", F.lit(1).cast("long").alias("freq"), F.col("idx").alias("first")) for v in vocabs]
    return finalize_merged(merge(parts), spec)


def from_tokens(spark: SparkSession, tokens: Sequence[str | Special | None]) -> DataFrame:
    """A vocabulary from a list; the place in it is the idx."""
    rows = [(i, t.text if isinstance(t, Special) else t, 0, t.kind if isinstance(t, Special) else None) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "idx long, token string, freq long, special string")


def from_indices(spark: SparkSession, indices: dict[str, int]) -> DataFrame:
    """A vocabulary from token to idx; gaps have a null token."""
    by = {i: t for t, i in indices.items()}
    return from_tokens(spark, [by.get(i) for i in range(max(by, default=-1) + 1)])


def index_of(vocab: DataFrame, special: Special | str) -> int | None:
    kind = special if isinstance(special, str) else special.kind
    row = vocab.filter(F.col("special") == kind).select("idx").first()
    return None if row is None else row[0]


def padding_index(vocab: DataFrame) -> int:
    found = index_of(vocab, PAD)
    if found is None:
        raise ValueError("the vocabulary has no token for padding")
    return found


def token_at(vocab: DataFrame, idx: int) -> str:
    row = vocab.filter(F.col("idx") == idx).select("token").first()
    if row is None:
        raise IndexError(idx)
    return row[0]


def index_at(vocab: DataFrame, token: str) -> int:
    """The idx of a word; KeyError if it isn't there (numericalize has a default, this hasn't)."""
    row = vocab.filter(F.col("token") == token).orderBy(F.col("special").isNotNull()).select("idx").first()
    if row is None:
        raise KeyError(token)
    return row[0]


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two vocabularies give the same numbers to the same tokens."""
    cols = ["idx", "token", "special"]
    return a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


# Numericalizing

#: Words of a vocabulary that is too large to be broadcast, which are: it is in the order of their frequency.
HOT_WORDS = 1 << 16


def _bytes(vocab: DataFrame) -> int:
    return vocab.agg(F.coalesce(F.sum(F.octet_length("token") + 24), F.lit(0))).first()[0]


def numericalize(df: DataFrame, tokens: str, vocab: DataFrame, row_id: str, out: str = "ids", specials: Sequence[Special] = ()) -> DataFrame:
    """df with the numbers of its tokens; others have UNK's number, or go if the vocabulary has no UNK.

    specials: those that with_specials has put on the rows; they're found by their place, not by their text.
    A vocabulary of up to BROADCAST_BYTES is sent to the executors, where a hash index looks up parts of
    Arrow batches and nothing is shuffled; a larger one is joined.
    """
    if _bytes(vocab) <= BROADCAST_BYTES:
        return df.withColumn(out, lookup(df.sparkSession, vocab, specials)(F.col(tokens)))
    unk = index_of(vocab, UNK)
    words = vocab.filter("special is null").select(F.col("token").alias("__t"), F.col("idx").alias("__i"))
    n = F.size(tokens)
    heads, tails = [s for s in specials if s.place == "first"], [s for s in specials if s.place == "last"]
    # The most frequent words are broadcast, so that no task gets all of one; the others are joined.
    hot = if_small(written(words.filter(F.col("__i") < HOT_WORDS), "hot"), 64)
    flat = df.select(row_id, n.alias("__n"), F.posexplode(tokens).alias("__p", "__t")).join(hot, "__t", "left")
    flat = flat.filter("__i is not null").unionByName(flat.filter("__i is null").drop("__i").join(words, "__t", "left"))
    idx = F.coalesce("__i", F.lit(unk))
    for k, s in enumerate(reversed(heads)):
        idx = F.when(F.col("__p") == k, F.lit(index_of(vocab, s))).otherwise(idx)
    for k, s in enumerate(reversed(tails)):
        idx = F.when(F.col("__p") == F.col("__n") - 1 - k, F.lit(index_of(vocab, s))).otherwise(idx)
    found = flat.withColumn("__i", idx).filter("__i is not null")
    rows = found.groupBy(row_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__i"))), lambda x: x["__i"]).alias(out))
    joined = df.join(rows, row_id, "left")
    return joined.withColumn(out, F.when(F.col(tokens).isNotNull(), F.coalesce(out, F.array().cast("array<long>"))))


def lookup(spark: SparkSession, vocab: DataFrame, specials: Sequence[Special] = ()):
    """A function on Columns of ARRAY<STRING>. The vocabulary is collected: numericalize checks its size first."""
    table = vocab.orderBy("idx").select("idx", "token", "special").toArrow()
    kinds = dict(zip(table["special"].to_pylist(), table["idx"].to_pylist()))
    words = table.filter(pc.is_null(table["special"]))
    known = spark.sparkContext.broadcast((words["token"].combine_chunks().cast(pa.string()), words["idx"].to_numpy()))
    unk = kinds.get("unk")
    heads = [kinds.get(s.kind, unk) for s in reversed([s for s in specials if s.place == "first"])]
    tails = [kinds.get(s.kind, unk) for s in reversed([s for s in specials if s.place == "last"])]

    def run(tokens: pa.Array) -> pa.Array:
        words, numbers = known.value
        offs = np.zeros(len(tokens) + 1, np.int64)
        null = np.asarray(tokens.is_null())
        np.cumsum(np.where(null, 0, np.nan_to_num(np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)))), out=offs[1:])
        flat = pc.list_flatten(tokens)
        at = pc.index_in(flat.cast(pa.string()), words) if len(words) else pa.nulls(len(flat), pa.int32())
        hit = np.asarray(at.is_valid())
        ids = np.where(hit, numbers[np.asarray(at.fill_null(0))], -1 if unk is None else unk) if len(words) else np.full(len(flat), -1 if unk is None else unk, np.int64)
        some = offs[1:] > offs[:-1]
        for k, i in enumerate(heads):
            ids[offs[:-1][some] + k] = -1 if i is None else i
        for k, i in enumerate(tails):
            ids[offs[1:][some] - 1 - k] = -1 if i is None else i
        if unk is None:
            keep = ids >= 0
            offs = np.r_[0, np.cumsum(keep)][offs]
            ids = ids[keep]
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids, pa.int64()), mask=pa.array(null))

    return in_parts("array<long>", run)


def numericalize_value(df: DataFrame, column: str, vocab: DataFrame, out: str = "id") -> DataFrame:
    """The number of a scalar column's value, as labels have it; null for null; for others UNK's, or null."""
    unk = index_of(vocab, UNK)
    words = vocab.filter("special is null").select(F.col("token").alias("__t"), F.col("idx").alias("__i"))
    joined = df.withColumn("__v", F.col(column).cast("string")).join(if_small(words, 96), F.col("__v") == F.col("__t"), "left")
    return joined.withColumn(out, F.when(F.col(column).isNotNull(), F.coalesce("__i", F.lit(unk).cast("long")))).drop("__t", "__i", "__v")


def reverse(df: DataFrame, ids: str, vocab: DataFrame, out: str = "words", drop_unk: bool = False) -> DataFrame:
    """df with the tokens of its numbers; an idx beyond the vocabulary has null."""
    if _bytes(vocab) > BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to send to the executors; join it on idx")
    table = vocab.orderBy("idx").select("idx", "token", "special").toArrow()
    known = df.sparkSession.sparkContext.broadcast((table["token"].combine_chunks().cast(pa.string()), table["idx"].combine_chunks()))
    unk = next((i for i, s in zip(table["idx"].to_pylist(), table["special"].to_pylist()) if s == "unk"), None)

    def run(rows: pa.Array) -> pa.Array:
        words, numbers = known.value
        flat = pc.list_flatten(rows)
        offs = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(rows), 0)), out=offs[1:])
        if drop_unk and unk is not None:
            keep = np.asarray(pc.fill_null(pc.not_equal(flat, unk), True))
            offs = np.r_[0, np.cumsum(keep)][offs]
            flat = flat.filter(pa.array(keep))
        got = words.take(pc.index_in(flat.cast(pa.int64()), numbers))
        return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), got, mask=rows.is_null())

    return df.withColumn(out, in_parts("array<string>", run)(F.col(ids)))


class Vocab:
    """A vocabulary that is counted over any number of tables, then finalized."""

    def __init__(self, spec: VocabSpec = VocabSpec()):
        self.spec, self._parts, self._table, self._counts = spec, [], None, None

    def update(self, df: DataFrame, tokens: Sequence[str] | str, row_id: str) -> Vocab:
        if self._table is not None:
            raise RuntimeError("the vocabulary is finalized")
        self._parts.append(counts(df, tokens, row_id))
        return self

    def add_counts(self, freqs: DataFrame) -> Vocab:
        """What counts has made of a table."""
        if self._table is not None:
            raise RuntimeError("the vocabulary is finalized")
        self._parts.append(freqs)
        return self

    def __add__(self, other: Vocab) -> Vocab:
        """Counts of both; of two finalized vocabularies, those they were made from."""
        out = Vocab(self.spec.merged(other.spec))
        out._parts = self._parts + other._parts
        return out

    def freqs(self) -> DataFrame:
        if not self._parts:
            raise RuntimeError("nothing has been counted")
        if self._counts is None or self._counts[0] != len(self._parts):
            one = self._parts[0] if len(self._parts) == 1 else merge(self._parts)
            self._counts = (len(self._parts), written(one, "counts"))
        return self._counts[1]

    def finalize(self) -> Vocab:
        if self._table is None:
            f = self.freqs()
            self._table = written(finalize_merged(f, self.spec) if "part" in f.columns else finalize(f, self.spec), "vocab")
        return self

    @property
    def is_finalized(self) -> bool:
        return self._table is not None

    @property
    def table(self) -> DataFrame:
        if self._table is None:
            raise RuntimeError("finalize the vocabulary first")
        return self._table

    def __len__(self) -> int:
        return self.table.count()
