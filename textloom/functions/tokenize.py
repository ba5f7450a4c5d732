"""Tokenizers and sentence splitting as Column expressions.

A tokenizer maps a text Column to an ARRAY<STRING> Column. It is named by a
string, of which what follows the first hyphen is the argument, or is given
as a callable. Null texts have null tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.batches import in_parts, lists

#: White space as Python's str.split() has it.
SPACE = r"\t-\r \x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run without it: Unicode's white space and four control characters; an intersection is much faster than a list of ranges.
WORD = r"(?U)[\S&&[^\x1c-\x1f]]+"

Tokenizer = Callable[[Column], Column]


def whitespace(text: Column) -> Column:
    """Runs without white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def separated(sep: str) -> Tokenizer:
    """Parts between separators, empty ones too."""
    if not sep:
        raise ValueError("the separator is empty")
    return lambda text: F.split(text, "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def chain(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """One rule after the other; those without signs of regular expressions replace bytes."""
    for pattern, put in rules:
        plain = pattern and not set(pattern) & set("\\.[]{}()*+?^$|") and not set(put) & set("\\$")
        text = F.replace(text, F.lit(pattern), F.lit(put)) if plain else F.regexp_replace(text, pattern, put)
    return text


# What stands before a sign is looked at behind it, so that a search goes from one sign to the next.

#: A definition of our own: punctuation apart from words, but for points and commas within numbers and abbreviations.
_TOKTOK = [
    (r"[ ]", " "),
    (r"([،;؛¿!\"\])}»›”؟¡%٪°±©®।॥…])", " $1 "),
    (r"([({\[“‘„‚«‹「『])", " $1 "),
    (r"([?/\\|&@#$€£¥])", " $1 "),
    (r",(?:(?<![.,\d],)(?!\d)|(?<=\d,)(?!\d)|(?<!\d,)(?=\d))", " , "),
    (r"'(?=\s|$)", " ' "),
    (r"'(?<=(?:\s|^)')", " ' "),
    (r"(\.{2,})", " $1 "),
    (r"\.(?<![.\s]\.)(?=\s*$)", " ."),
]


def toktok(text: Column) -> Column:
    return whitespace(chain(text, _TOKTOK))


_MOSES = [
    (r"[\x00-\x1f]", " "),
    (r"([^\p{L}\p{N}\s.'`,\-])", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r",(?:(?<!\p{N},)|(?!\p{N}))", " , "),
    (r"'(?:(?<!\p{L}')|(?!\p{L}))", " ' "),
    (r"(\p{L})'(\p{L})", "$1 '$2"),
    (r"\.(?<![.\s\p{Lu}]\.)(?=\s*$)", " ."),
]


def moses(text: Column) -> Column:
    """Words and punctuation apart, English contractions cut before the apostrophe (a definition of our own)."""
    return whitespace(chain(text, _MOSES))


_NAMED: dict[str, Tokenizer] = {"chars": characters, "toktok": toktok, "moses": moses}


def python_tokenizer(fn: Callable[[str], Iterable[str]]) -> Tokenizer:
    """A tokenizer from a Python function of one text; it runs in Arrow batches, outside the JVM."""

    return in_parts("array<string>", lists(lambda texts: [None if t is None else [str(x) for x in fn(t)] for t in texts], pa.list_(pa.string())))


def get_tokenizer(spec: str | Tokenizer | None) -> Tokenizer | None:
    """None leaves the column as it is."""
    if spec is None or callable(spec):
        return spec
    if not isinstance(spec, str):
        raise ValueError(f"a tokenizer is a name or a callable, not {spec!r}")
    name, hyphen, arg = spec.partition("-")
    if name == "split":
        return separated(arg) if hyphen else whitespace
    if name in _NAMED:
        return _NAMED[name]
    raise ValueError(f"there is no tokenizer {spec!r}; known: split, split-<separator>, {', '.join(_NAMED)}")


def sentences(text: Column) -> Column:
    """Sentences end with . ! or ? before white space: an approximation without a language model."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")
