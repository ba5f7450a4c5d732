"""Quality rules by divergence from references of the language.

Two histograms of a document are compared with its language's: of character
classes (lower case, upper case, digits, white space, sentence punctuation,
the rest) and of common words (the language's function words, and all other
words). The references are those of all documents of the language together,
or given ones. Histograms are made once and kept; a filter's decisions are
those of (language, hash of the text), by which the rejected rows are found.
The measure is the Jensen-Shannon distance with base 2, from 0 to 1. A
document is rejected if a distance passes its threshold; a histogram of too
few characters or words isn't judged.

Defined results: a null text counts as an empty one. Texts under the minimum
lengths aren't judged and are kept. A null language is a language of its own.
A language without a list of common words is judged by characters only. If a
language's documents have no characters (or words) at all, there is nothing
to judge. Rows are judged one by one: repeated rows give repeated rows.
Distances that aren't judged are null. Other columns are ignored by `judge`,
kept by `quality_filter`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import maybe_broadcast, row_of, without, written

MIN_CHARS, MIN_WORDS, MAX_CHARS_JS, MAX_WORDS_JS = 300, 60, 0.25, 0.345

COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "was", "with", "on", "are", "this", "by", "at", "from", "or"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "dans", "qui", "par", "pour", "au", "sur", "pas", "avec"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"),
}

#: Patterns of all that is not in the class, by class; lower case and the rest follow from them.
_NOT = {"upper": r"[^\p{Lu}]+", "lower": r"[^\p{Ll}]+", "digit": r"[^0-9]+", "space": r"[^ \t\n\r]+", "mark": "[^.,;:!?'\"()-]+"}
CLASSES = (*_NOT, "rest")


def _char_counts(text: Column) -> Column:
    parts = [F.length(F.regexp_replace(text, p, "")).cast("double") for p in _NOT.values()]
    rest = F.length(text).cast("double")
    for p in parts:
        rest = rest - p
    return F.array(*parts, rest)


def _padded(text: Column) -> Column:
    """Words between spaces; doubled, so that neighbours don't share one."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[ \t\n\r.,;:!?]+", "  "), F.lit(" "))


def _common(padded: Column, lang: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """The text's words that are common in its language, found in one pass."""
    out = F.lit(None).cast("array<string>")
    for code, w in words.items():
        pattern = " (" + "|".join(f"\\Q{x}\\E" for x in w) + ") "
        out = F.when(lang == code, F.regexp_extract_all(padded, F.lit(pattern), F.lit(1))).otherwise(out)
    return out


def _word_counts(common: Column, every: Column, lang: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """Counts of the language's common words, and of all words."""
    own = F.lit(None).cast("array<string>")
    for code, w in words.items():
        own = F.when(lang == code, F.array(*map(F.lit, w))).otherwise(own)
    counts = F.transform(own, lambda w: (F.size(common) - F.size(F.array_remove(common, w))).cast("double"))
    return F.concat(counts, F.array(every.cast("double")))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if one is null or all 0."""
    sp, sq = (_sum(x) for x in (p, q))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2.0 * a / (a + b))).otherwise(0.0)

    parts = F.zip_with(F.transform(p, lambda v: v / sp), F.transform(q, lambda v: v / sq), lambda a, b: (term(a, b) + term(b, a)) / 2.0)
    js = _sum(parts)
    return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(js, F.lit(0.0))))


def _sum(x) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _histograms(docs: DataFrame, words) -> DataFrame:
    """__tl_lang, __tl_c and __tl_w; the last word count is of all words, of which the common ones are taken off."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lang = F.coalesce(F.col("lang"), F.lit("\u0001null"))
    h = docs.withColumns({"__tl_lang": lang, "__tl_c": _char_counts(text), "__tl_p": _padded(text)})
    h = h.withColumns({"__tl_x": _common(F.col("__tl_p"), F.col("__tl_lang"), words), "__tl_n": F.regexp_count("__tl_p", F.lit(r"[^ ]+"))}).drop("__tl_p")
    h = h.withColumn("__tl_w", _word_counts(F.col("__tl_x"), F.col("__tl_n"), F.col("__tl_lang"), words)).drop("__tl_x", "__tl_n")
    own = F.slice("__tl_w", 1, F.size("__tl_w") - 1)
    return h.withColumn("__tl_w", F.concat(own, F.array(F.element_at("__tl_w", -1) - _sum(own))))


def _references(h: DataFrame, words: Mapping[str, Sequence[str]]) -> DataFrame:
    most = max([0, *map(len, words.values())]) + 1
    c = [F.sum(F.col("__tl_c")[i]) for i in range(len(CLASSES))]
    w = [F.sum(F.try_element_at("__tl_w", F.lit(i + 1))) for i in range(most)]
    return h.groupBy("__tl_lang").agg(F.array(*c).alias("ref_c"), F.filter(F.array(*w), lambda x: x.isNotNull()).alias("ref_w"))


def references(docs: DataFrame, words: Mapping[str, Sequence[str]] = COMMON_WORDS) -> DataFrame:
    """One row for each language: lang, ref_c and ref_w, the sums of its documents' histograms."""
    return _references(_histograms(docs.select("text", "lang"), words), words).withColumnRenamed("__tl_lang", "lang")


def _judged(docs: DataFrame, words, min_chars, min_words, max_chars_js, max_words_js, given: DataFrame | None) -> DataFrame:
    """docs (with lang and text) without the text, and __tl_jc, __tl_jw and __tl_keep; of a table of histograms."""
    h = written(_histograms(docs, words).drop("text"), "histograms")
    refs = written(_references(h, words) if given is None else given.select(F.coalesce("lang", F.lit("\u0001null")).alias("__tl_lang"), "ref_c", "ref_w"), "refs")
    j = h.join(maybe_broadcast(refs, 600), "__tl_lang", "left")
    n_chars, n_words = _sum("__tl_c"), _sum("__tl_w")
    j = j.withColumns({
        "__tl_jc": F.when(n_chars >= min_chars, F.round(js_distance(F.col("__tl_c"), F.col("ref_c")), 6)),
        "__tl_jw": F.when(n_words >= min_words, F.round(js_distance(F.col("__tl_w"), F.col("ref_w")), 6)),
    })
    bad = (F.coalesce(F.col("__tl_jc"), F.lit(0.0)) > max_chars_js) | (F.coalesce(F.col("__tl_jw"), F.lit(0.0)) > max_words_js)
    return j.withColumn("__tl_keep", ~bad)


def judge(docs: DataFrame, words: Mapping[str, Sequence[str]] = COMMON_WORDS, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS, max_chars_js: float = MAX_CHARS_JS, max_words_js: float = MAX_WORDS_JS, given: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, chars_js, words_js, keep: one row for each document. given: references to use, as `references` makes them."""
    j = _judged(docs.select("doc_id", "lang", "text"), words, min_chars, min_words, max_chars_js, max_words_js, given)
    return j.select("doc_id", "lang", F.col("__tl_jc").alias("chars_js"), F.col("__tl_jw").alias("words_js"), F.col("__tl_keep").alias("keep"))


def quality_filter(docs: DataFrame, **limits) -> DataFrame:
    """The documents that aren't rejected, with their columns."""
    p = {"words": COMMON_WORDS, "min_chars": MIN_CHARS, "min_words": MIN_WORDS, "max_chars_js": MAX_CHARS_JS, "max_words_js": MAX_WORDS_JS, "given": None} | limits
    # A row is found again by its language and by its text's hash and length.
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = [F.coalesce("lang", F.lit("\u0001null")).alias("k"), F.xxhash64(text).alias("xx"), F.octet_length(text).alias("n")]
    judged = _judged(docs.select("lang", "text", *keys), **p)
    gone = written(judged.filter("not __tl_keep").select("k", "xx", "n").distinct(), "gone")
    return without(docs.select(row_of(docs), *keys), gone, ["k", "xx", "n"]).select("row.*")


def rules_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    not_ = ", ".join(f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))::DOUBLE AS c{i}" for i, p in enumerate(_NOT.values()))
    cs = "[" + ", ".join(f"c{i}" for i in range(len(_NOT))) + ", length(t)" + "".join(f" - c{i}" for i in range(len(_NOT))) + "]"
    cases = ""
    for code, own in COMMON_WORDS.items():
        n = [f"(length(p) - length(replace(p, ' {w} ', '')))::DOUBLE / {len(w) + 2}" for w in own]
        cases += f" WHEN k = '{code}' THEN [{', '.join(n)}, every - ({' + '.join(n)})]"
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0 END"
    js = lambda p, q: f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN round(sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: ({term(f'({p}[i] / list_sum({p}))', f'({q}[i] / list_sum({q}))')} + {term(f'({q}[i] / list_sum({q}))', f'({p}[i] / list_sum({p}))')}) / 2.0)), 0.0)), 6) END"
    return f"""
WITH a AS (SELECT doc_id, lang, coalesce(lang, chr(1) || 'null') AS k, coalesce(text, '') AS t FROM {table}),
b AS (SELECT *, ' ' || regexp_replace(lower(t), '[ \\t\\n\\r.,;:!?]+', '  ', 'g') || ' ' AS p, {not_} FROM a),
e AS (SELECT *, len(regexp_extract_all(p, '[^ ]+'))::DOUBLE AS every FROM b),
h AS (SELECT doc_id, lang, k, {cs} AS c, CASE{cases} END AS w FROM e),
rc AS (SELECT k, list(s ORDER BY i) AS rc FROM (SELECT k, i, sum(c[i]) AS s FROM h, range(1, {len(CLASSES) + 1}) r(i) GROUP BY k, i) GROUP BY k),
rw AS (SELECT k, list(s ORDER BY i) AS rw FROM (SELECT k, i, sum(w[i]) AS s FROM h, range(1, {max(map(len, COMMON_WORDS.values())) + 2}) r(i) WHERE w[i] IS NOT NULL GROUP BY k, i) GROUP BY k),
j AS (SELECT doc_id, lang,
  CASE WHEN list_sum(c) >= {MIN_CHARS} THEN {js('c', 'rc')} END AS chars_js,
  CASE WHEN list_sum(w) >= {MIN_WORDS} THEN {js('w', 'rw')} END AS words_js
  FROM h LEFT JOIN rc USING (k) LEFT JOIN rw USING (k))
SELECT doc_id, lang, chars_js, words_js, NOT (coalesce(chars_js, 0) > {MAX_CHARS_JS} OR coalesce(words_js, 0) > {MAX_WORDS_JS}) AS keep FROM j"""
