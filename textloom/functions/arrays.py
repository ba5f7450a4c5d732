"""Array expressions: padding, truncation, n-grams, multi-hot rows. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is evaluated once, however often fn has it."""
    return F.get(F.transform(F.array(value), fn), 0)


def pad_to(ids: Column, length: Column | int, pad: Column | int, pad_left: bool = False, truncate_left: bool = False) -> Column:
    """ids cut or filled to a length. Null stays null; see fields.Field for rows of missing data."""
    length = length if isinstance(length, Column) else F.lit(length)
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    n = F.size(ids)
    start = F.greatest(n - length + F.lit(1), F.lit(1)) if truncate_left else F.lit(1)
    cut = F.slice(ids, start, length)
    fill = F.array_repeat(pad, F.greatest(length - n, F.lit(0)))
    return F.concat(fill, cut) if pad_left else F.concat(cut, fill)


def ngrams(tokens: Column, low: int, high: int, sep: str = " ") -> Column:
    """All n-grams for n from low to high, by n and then by place; none where tokens are fewer than n."""

    def of(t: Column, n: int) -> Column:
        if n == 1:
            return t
        # Shifted copies side by side, rather than a slice for each gram.
        many = F.size(t) - (n - 1)
        shifted = F.arrays_zip(*(F.slice(t, i + 1, F.greatest(many, F.lit(0))).alias(f"t{i}") for i in range(n)))
        grams = F.transform(shifted, lambda x: F.concat_ws(sep, *(x[f"t{i}"] for i in range(n))))
        return F.when(F.size(t) >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(tokens, lambda t: F.when(t.isNotNull(), F.concat(*(of(t, n) for n in range(low, high + 1)))))


def multi_hot(ids: Column, classes: int) -> Column:
    """1 at the ids that are there, 0 elsewhere; null for null."""
    if classes < 1:
        return F.when(ids.isNotNull(), F.array().cast("array<int>"))
    return let(ids, lambda a: F.when(a.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(a, i.cast("long")).cast("int"))))


def last_of(values: Column, k: int) -> Column:
    """The last k elements, or all if they are fewer."""
    if k < 1:
        return F.slice(values, 1, 0)
    return F.slice(values, F.greatest(F.size(values) - k + 1, F.lit(1)), k)
