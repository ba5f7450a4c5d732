"""Fields: how a column becomes tokens and numbers. A schema of fields compiles to one select."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import multi_hot, pad_to
from textloom.functions.hooks import Hook
from textloom.functions.tokenize import Tokenizer, get_tokenizer
from textloom.operators import vocab as V


@dataclass(frozen=True)
class Field:
    """A column's processing: pre hooks, tokenizer, post hooks, specials; then numbers and padding.

    vocab: a Vocab, a function of the tokens Column, or None for values that are numbers already.
    A null is an error unless allow_missing_data; it stays null, and its row in a batch is filled
    with missing_data_token. Pads are the vocabulary's padding index, else padding_token.
    """

    name: str
    tokenizer: str | Tokenizer | None = "split"
    vocab: V.Vocab | Callable[[Column], Column] | None = None
    keep_raw: bool = False
    is_target: bool = False
    include_lengths: bool = False
    fixed_length: int | None = None
    allow_missing_data: bool = False
    disable_batch_matrix: bool = False
    padding_token: int = -999
    missing_data_token: int = -1
    hooks: tuple[Hook, ...] = ()

    def __post_init__(self) -> None:
        if not isinstance(self.name, str) or not self.name:
            raise ValueError("a field needs a name")
        if self.fixed_length is not None and self.fixed_length < 1:
            raise ValueError("fixed_length is at least 1")
        if self.include_lengths and self.disable_batch_matrix:
            raise ValueError("lengths are given beside a matrix; allow one")
        get_tokenizer(self.tokenizer)

    # Hooks: fields don't change, so these return another one.

    def with_hooks(self, *hooks: Hook) -> Field:
        return replace(self, hooks=self.hooks + hooks)

    def without_hooks(self, kind: str | None = None) -> Field:
        return replace(self, hooks=tuple(h for h in self.hooks if kind and h.kind != kind))

    @property
    def specials(self) -> tuple[V.Special, ...]:
        return tuple(s for s in self.vocab.spec.specials if s.place) if isinstance(self.vocab, V.Vocab) else ()

    def _checked(self, column: Column) -> Column:
        if self.allow_missing_data:
            return column
        return F.when(column.isNull(), F.raise_error(F.lit(f"field {self.name} has missing data, which it doesn't allow"))).otherwise(column)

    def raw(self, column: Column) -> Column:
        """The value after the pre hooks."""
        text = self._checked(column)
        for h in self.hooks:
            if h.kind == "pre":
                text = h(text)
        return text

    def tokens(self, raw: Column) -> tuple[Column, Column]:
        """The raw value and its tokens, without specials."""
        tokenize = get_tokenizer(self.tokenizer)
        tokens = tokenize(raw) if tokenize else raw
        for h in self.hooks:
            if h.kind == "post":
                raw, tokens = h(raw, tokens)
        return raw, tokens

    def compile(self, column: Column) -> list[Column]:
        raw, tokens = self.tokens(self.raw(column))
        tokens = V.with_specials(tokens, self.specials) if self.specials else tokens
        return [*([raw.alias(f"{self.name}_raw")] if self.keep_raw else []), tokens.alias(self.name)]

    def compile_uncounted(self, column: Column) -> Column:
        """Tokens as the vocabulary counts them: without the specials put on rows."""
        return self.tokens(self.raw(column))[1].alias(self.name)

    def numbers(self, df: DataFrame, row_id: str, out: str | None = None) -> DataFrame:
        """df with the field's numbers, a list."""
        out = out or f"{self.name}_ids"
        if isinstance(self.vocab, V.Vocab):
            if self.tokenizer is None and df.schema[self.name].dataType.simpleString() != "array<string>":
                one = V.numericalize_value(df, self.name, self.vocab.table, out)
                return one.withColumn(out, F.when(F.col(out).isNotNull(), F.array(out)))
            return V.numericalize(df, self.name, self.vocab.table, row_id, out, self.specials)
        if callable(self.vocab):
            return df.withColumn(out, self.vocab(F.col(self.name)))
        is_list = df.schema[self.name].dataType.typeName() == "array"
        return df.withColumn(out, F.col(self.name) if is_list else F.when(F.col(self.name).isNotNull(), F.array(self.name)))

    @property
    def pad_symbol(self) -> int:
        if isinstance(self.vocab, V.Vocab):
            found = V.index_of(self.vocab.table, V.PAD)
            if found is not None:
                return found
        return self.padding_token

    def padded(self, ids: Column, length: Column | int, pad_left: bool = False, truncate_left: bool = False, pad: int | None = None) -> Column:
        """Lists of one length; missing rows are filled with missing_data_token."""
        length = F.lit(length) if isinstance(length, int) else length
        pad = self.pad_symbol if pad is None else pad
        return F.when(ids.isNull(), F.array_repeat(F.lit(self.missing_data_token).cast("long"), length)).otherwise(pad_to(ids.cast("array<long>"), length, F.lit(pad).cast("long"), pad_left, truncate_left))


def label_field(name: str, vocab: V.Vocab | Callable[[Column], Column] | None = None, **options) -> Field:
    """One label for each row: no tokenizer, length 1, a target; its vocabulary has no specials."""
    if vocab is None:
        vocab = V.Vocab(V.VocabSpec(specials=()))
    if isinstance(vocab, V.Vocab) and vocab.spec.specials:
        raise ValueError("a label's vocabulary has no special tokens")
    return Field(name, None, vocab, fixed_length=1, is_target=options.pop("is_target", True), **options)


@dataclass(frozen=True)
class MultilabelField(Field):
    """A set of labels as a row of zeros and ones, one place for each class; null for null."""

    num_of_classes: int | None = None
    is_target: bool = True

    def __post_init__(self) -> None:
        super().__post_init__()
        if isinstance(self.vocab, V.Vocab) and self.vocab.spec.specials:
            raise ValueError("labels have no special tokens")

    def classes(self) -> int:
        if not isinstance(self.vocab, V.Vocab):
            if self.num_of_classes is None:
                raise ValueError("num_of_classes is needed where there is no vocabulary")
            return self.num_of_classes
        found = len(self.vocab)
        if self.num_of_classes is not None and found > self.num_of_classes:
            raise ValueError(f"{found} classes were found; {self.num_of_classes} are allowed")
        return self.num_of_classes or found

    def numbers(self, df: DataFrame, row_id: str, out: str | None = None) -> DataFrame:
        out = out or f"{self.name}_ids"
        ids = super().numbers(df, row_id, out)
        return ids.withColumn(out, multi_hot(F.col(out), self.classes()))


@dataclass(frozen=True)
class MultioutputField:
    """Several fields from one column: pre hooks and tokenizer are shared, post hooks and vocabularies their own."""

    outputs: tuple[Field, ...]
    tokenizer: str | Tokenizer | None = "split"
    hooks: tuple[Hook, ...] = ()

    def with_output(self, out: Field) -> MultioutputField:
        return replace(self, outputs=(*self.outputs, out))

    def own(self) -> list[Field]:
        pre = tuple(h for h in self.hooks if h.kind == "pre")
        return [replace(f, tokenizer=self.tokenizer, hooks=pre + tuple(h for h in f.hooks if h.kind == "post")) for f in self.outputs]


AnyField = Field | MultioutputField | Sequence[Field] | None


def unpacked(fields: Mapping[str, AnyField] | Sequence[AnyField]) -> list[Field]:
    """All fields, without those that ignore a column."""
    values = fields.values() if isinstance(fields, Mapping) else fields
    out: list[Field] = []
    for f in values:
        if isinstance(f, MultioutputField):
            out += f.own()
        elif isinstance(f, Field):
            out.append(f)
        elif f is not None:
            out += unpacked(list(f))
    return out


@dataclass(frozen=True)
class Schema:
    """Fields by input column: a dict, or a list that goes by the columns' order; None ignores a column."""

    fields: Mapping[str, AnyField] | Sequence[AnyField]
    extra: dict = field(default_factory=dict)

    def pairs(self, columns: Sequence[str]) -> list[tuple[str, Field]]:
        if isinstance(self.fields, Mapping):
            items = list(self.fields.items())
        else:
            if len(self.fields) != len(columns):
                raise ValueError(f"{len(self.fields)} fields for {len(columns)} columns")
            items = list(zip(columns, self.fields))
        return [(c, f) for c, fs in items for f in unpacked([fs])]

    def all(self) -> list[Field]:
        return unpacked(self.fields)

    def __getitem__(self, name: str) -> Field:
        for f in self.all():
            if f.name == name:
                return f
        raise KeyError(name)

    @property
    def targets(self) -> list[Field]:
        return [f for f in self.all() if f.is_target]

    def _columns(self, df: DataFrame, row_id: str, of: Callable[[Field, Column], list[Column]]) -> DataFrame:
        columns = [c for c in df.columns if c != row_id]
        out = [F.col(row_id)]
        for c, f in self.pairs(columns):
            # A column that isn't there is missing data.
            out += of(f, F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string"))
        return df.select(*out)

    def apply(self, df: DataFrame, row_id: str) -> DataFrame:
        """The fields' tokens (and raw values, where they're kept), by row_id."""
        return self._columns(df, row_id, lambda f, c: f.compile(c))

    def finalize(self, *tables: DataFrame, row_id: str) -> Schema:
        """Count and finalize all vocabularies that aren't yet. Tables are of this schema's input columns.

        Fields that share a Vocab are counted together; all are counted in one pass over each table.
        """
        open_vocabs: dict[int, tuple[V.Vocab, list[Field]]] = {}
        for f in self.all():
            if isinstance(f.vocab, V.Vocab) and not f.vocab.is_finalized:
                open_vocabs.setdefault(id(f.vocab), (f.vocab, []))[1].append(f)
        for df in tables if open_vocabs else ():
            plain = self._columns(df, row_id, lambda f, c: [f.compile_uncounted(c)])
            of = {f.name: F.when(F.col(f.name).isNotNull(), F.col(f.name) if plain.schema[f.name].dataType.typeName() == "array" else F.array(F.col(f.name).cast("string"))) for _, fs in open_vocabs.values() for f in fs}
            lists = plain.select(row_id, *(c.alias(name) for name, c in of.items()))
            found = V.counts_of_several(lists, [[f.name for f in fs] for _, fs in open_vocabs.values()], row_id)
            for (v, _), own in zip(open_vocabs.values(), found):
                v.add_counts(own)
        for v, _ in open_vocabs.values():
            v.finalize()
        return self
