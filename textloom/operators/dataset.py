"""Datasets: tables with an order. Every operator keeps plans lazy but where rows must be numbered."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.fields import AnyField, Field, Schema
from textloom.operators import vocab as V
from textloom.operators.numbering import numbered, seeded_order
from textloom.storage import if_small, written


def positions(df: DataFrame, *order: Column | str, row_id: str, name: str = "position") -> DataFrame:
    """row_id and position: only the keys are sorted, not the rows."""
    return numbered(df.select(row_id, *(o if isinstance(o, Column) else F.col(o) for o in order if o != row_id)), *order, name=name).select(row_id, name)


def check_ratio(ratio: float | Sequence[float]) -> tuple[float, ...]:
    """A number in (0, 1), or two or three positive ones, to shares of 1; three are train, validation, test."""
    if isinstance(ratio, (int, float)):
        if not 0 < ratio < 1:
            raise ValueError("a ratio is between 0 and 1")
        return (float(ratio), 1.0 - ratio)
    shares = tuple(map(float, ratio))
    if len(shares) not in (2, 3) or any(s <= 0 for s in shares):
        raise ValueError("ratios are two or three positive numbers")
    return tuple(s / sum(shares) for s in shares)


def cuts(shares: Sequence[float], n: Column) -> list[Column]:
    """Sizes of the parts; halves are rounded to even, and what is left goes to the last of two parts, or the middle of three."""
    train = F.bround(F.lit(shares[0]) * n).cast("long")
    if len(shares) == 2:
        return [train, n - train]
    test = F.bround(F.lit(shares[2]) * n).cast("long")
    return [train, n - train - test, test]


def _part(pos: Column, sizes: Sequence[Column]) -> Column:
    out, edge = F.lit(len(sizes) - 1), None
    for k, s in reversed(list(enumerate(sizes[:-1]))):
        edge = reduce(lambda a, b: a + b, sizes[: k + 1])
        out = F.when(pos < edge, F.lit(k)).otherwise(out)
    return out.cast("int")


def split_parts(df: DataFrame, row_id: str, ratio: float | Sequence[float] = 0.7, seed: int | None = 42, strata: str | None = None) -> DataFrame:
    """row_id and part (0, 1, 2): exact sizes, in a seeded order (seed None: the order of row_id).

    With strata, each value's rows are split alone; a stratum is numbered by a range sort too, so
    one that holds most rows isn't brought together.
    """
    shares = check_ratio(ratio)
    key = F.col(row_id) if seed is None else seeded_order(row_id, seed)
    own = df.select(row_id, key.alias("__key"), *([F.col(strata).alias("__s")] if strata else []))
    pos = numbered(own, *(["__s"] if strata else []), "__key", *([row_id] if seed is not None else []), name="__pos")
    if strata:
        sizes = pos.groupBy(F.col("__s").alias("__v")).agg(F.count("*").alias("__n"), F.min("__pos").alias("__from"))
        joined = pos.join(if_small(sizes, 64), F.col("__s").eqNullSafe(F.col("__v")))
        out = joined.select(row_id, _part(F.col("__pos") - F.col("__from"), cuts(shares, F.col("__n"))).alias("part"))
    else:
        out = pos.select(row_id, _part(F.col("__pos"), cuts(shares, F.lit(pos.count()))).alias("part"))
    return out


def take(df: DataFrame, row_id: str, places: Sequence[int] | DataFrame, order: Sequence[Column | str] | None = None) -> DataFrame:
    """Rows at places of the order, as often and in the sequence they're asked for: df with `ord` and `position`.

    Negative places count from the end. places can be a table (ord, position) of any size.
    """
    pos = positions(df, *(order or [row_id]), row_id=row_id)
    if not isinstance(places, DataFrame):
        n = pos.count()
        if bad := [p for p in places if not -n <= p < n]:
            raise IndexError(f"no such rows: {bad[:5]}")
        places = df.sparkSession.createDataFrame([(i, p % n) for i, p in enumerate(places)], "ord long, position long")
    wanted = if_small(places, 32)
    return df.join(pos.join(wanted, "position"), row_id)


def slice_rows(df: DataFrame, row_id: str, start: int | None = None, stop: int | None = None, step: int | None = None, order: Sequence[Column | str] | None = None) -> DataFrame:
    """As Python's slices; df with `ord`, the place in the slice."""
    pos = positions(df, *(order or [row_id]), row_id=row_id)
    lo, hi, by = slice(start, stop, step).indices(pos.count())
    p = F.col("position")
    if by > 0:
        kept = pos.filter((p >= lo) & (p < hi) & (F.pmod(p - lo, F.lit(by)) == 0)).withColumn("ord", ((p - lo) / by).cast("long"))
    else:
        kept = pos.filter((p <= lo) & (p > hi) & (F.pmod(F.lit(lo) - p, F.lit(-by)) == 0)).withColumn("ord", ((F.lit(lo) - p) / -by).cast("long"))
    return df.join(kept.select(row_id, "ord"), row_id)


def unique(values: Iterable[str]) -> list[str]:
    """Each value once, in the order of the first."""
    return list(dict.fromkeys(values))


def concat(tables: Sequence[tuple[DataFrame, Mapping[str, str]]] | Sequence[DataFrame], row_id: str | None = None) -> DataFrame:
    """The rows of all tables, on the columns that all have, in the first one's order; `src` is the table's place.

    A table can come with a dict that renames its columns first.
    """
    frames = []
    for t in tables:
        df, names = t if isinstance(t, tuple) else (t, {})
        frames.append(df.withColumnsRenamed(dict(names)) if names else df)
    if not frames:
        raise ValueError("there is nothing to concatenate")
    common = unique(c for c in frames[0].columns if all(c in f.columns for f in frames))
    if not common:
        raise ValueError("the tables have no column in common")
    return reduce(DataFrame.unionAll, (f.select(F.lit(i).alias("src"), *common) for i, f in enumerate(frames)))


@dataclass(frozen=True)
class Dataset:
    """A table of processed rows in the order of row_id, and its fields. Nothing changes in place."""

    df: DataFrame
    schema: Schema
    row_id: str

    @classmethod
    def read(cls, df: DataFrame, fields: Mapping[str, AnyField] | Sequence[AnyField], row_id: str, finalize: bool = True) -> Dataset:
        """Process df's columns with fields; finalize counts vocabularies first."""
        schema = fields if isinstance(fields, Schema) else Schema(fields)
        if finalize:
            schema.finalize(df, row_id=row_id)
        return cls(schema.apply(df, row_id), schema, row_id)

    @classmethod
    def from_pandas(cls, spark: SparkSession, pdf, fields, index_field: str | None = None, row_id: str = "row_id") -> Dataset:
        own = pdf.reset_index(names=index_field or "index") if index_field else pdf.reset_index(drop=True)
        unknown = [c for c in fields if c not in own.columns] if isinstance(fields, Mapping) else []
        if unknown:
            raise KeyError(f"no such columns: {unknown}")
        own = own.assign(**{row_id: range(len(own))})
        return cls.read(spark.createDataFrame(own), fields, row_id)

    def _with(self, df: DataFrame) -> Dataset:
        return replace(self, df=df)

    def filter(self, condition: Column | str) -> Dataset:
        return self._with(self.df.filter(condition))

    def sorted(self, key: Column | str, reverse: bool = False) -> Dataset:
        """By key; equal keys keep their order, in reverse too."""
        key = F.col(key) if isinstance(key, str) else key
        return self.ordered(key.desc() if reverse else key.asc(), self.row_id)

    def shuffled(self, seed: int = 1) -> Dataset:
        return self.ordered(seeded_order(self.row_id, seed), self.row_id)

    def ordered(self, *order: Column | str) -> Dataset:
        """Numbered anew by an order."""
        out = numbered(self.df, *order, name="__new")
        return self._with(out.drop(self.row_id).withColumnRenamed("__new", self.row_id).select(*self.df.columns))

    def __len__(self) -> int:
        return self.df.count()

    def __getitem__(self, key):
        if isinstance(key, slice):
            out = slice_rows(self.df, self.row_id, key.start, key.stop, key.step)
        else:
            out = take(self.df, self.row_id, [key] if isinstance(key, int) else list(key)).drop("position")
        return self._with(out.drop(self.row_id).withColumnRenamed("ord", self.row_id).select(*self.df.columns))

    def column(self, name: str) -> DataFrame:
        return self.df.select(self.row_id, name)

    def split(self, ratio: float | Sequence[float] = 0.7, stratified: bool = False, strata: str | None = None, seed: int | None = 42) -> list[Dataset]:
        """Parts of exact sizes; an empty one is an error."""
        if stratified and strata is None:
            if not self.schema.targets:
                raise ValueError("no field is a target, so name the field to stratify by")
            strata = self.schema.targets[0].name
        parts = split_parts(self.df, self.row_id, ratio, seed, strata if stratified else None)
        n = len(check_ratio(ratio))
        found = {r["part"] for r in parts.groupBy("part").count().collect()}
        if not stratified and len(found) < n:
            raise ValueError("a part would be empty")
        tagged = self.df.join(parts, self.row_id)
        return [self._with(tagged.filter(F.col("part") == k).drop("part")) for k in range(n) if k in found]

    def concat(self, *others: Dataset) -> Dataset:
        """On common fields; their vocabularies must be equal."""
        common = [c for c in self.df.columns if all(c in o.df.columns for o in others)]
        for f in self.schema.all():
            if f.name in common and isinstance(f.vocab, V.Vocab):
                for o in others:
                    v = o.schema[f.name].vocab
                    if v is not f.vocab and not V.same(f.vocab.table, v.table):
                        raise ValueError(f"the vocabularies of {f.name} differ")
        both = concat([d.df for d in (self, *others)])
        out = numbered(both, "src", self.row_id, name="__new").drop("src", self.row_id).withColumnRenamed("__new", self.row_id)
        return replace(self, df=out.select(self.row_id, *(c for c in common if c != self.row_id)), schema=Schema([f for f in self.schema.all() if f.name in common]))

    def concat_with(self, others: Sequence[Dataset], overrides: Mapping[str, Field]) -> Dataset:
        """On common fields, some of which get a field of their own: its vocabulary, if it isn't finalized, is counted over all rows."""
        free = [replace(d, schema=Schema([f for f in d.schema.all() if f.name not in overrides])) for d in (self, *others)]
        both = free[0].concat(*free[1:])
        own = [f for f in overrides.values() if f.name in both.df.columns]
        for f in own:
            if isinstance(f.vocab, V.Vocab) and not f.vocab.is_finalized:
                f.vocab.update(both.df, f.name, self.row_id).finalize()
        names = [c for c in both.df.columns if c != self.row_id]
        common = [f for f in self.schema.all() if f.name in names and f.name not in overrides]
        return replace(both, schema=Schema([*common, *own]))

    def materialized(self) -> DataFrame:
        """The numbers of all fields, written once: later batches read them instead of making them again."""
        return written(self.numericalized(), "numbers")

    def numericalized(self) -> DataFrame:
        df = self.df
        for f in self.schema.all():
            df = f.numbers(df, self.row_id)
        return df

    # Out of the engine

    def to_pandas(self, include_raw: bool = False):
        names = [f.name for f in self.schema.all()]
        raw = [f"{n}_raw" for n in names if include_raw and f"{n}_raw" in self.df.columns]
        return self.df.orderBy(self.row_id).select(*names, *raw).toPandas()

    def as_dict(self, include_raw: bool = False) -> dict[str, list]:
        return {k: list(v) for k, v in self.to_pandas(include_raw).items()}

    def write(self, path: str) -> None:
        """As Parquet; never over what is there."""
        self.df.write.mode("errorifexists").parquet(path)


def stratum_shares(df: DataFrame, column: str) -> DataFrame:
    """Each value's rows and share of all."""
    n = df.groupBy(column).agg(F.count("*").alias("rows"))
    return n.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()), 6))
