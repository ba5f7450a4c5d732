"""Hooks: functions on raw texts before tokenizing (pre), or on tokens after it (post).

A pre hook maps a text Column to a text Column, a post hook a pair of Columns
(raw text, tokens) to such a pair. Null stays null. All but those that say so
are Column expressions and stay in the JVM.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Literal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import ngrams
from textloom.functions.batches import in_parts, lists
from textloom.functions.stemmer import STEMMERS
from textloom.functions.stopwords import STOPWORDS
from textloom.functions.tokenize import SPACE, chain
from textloom.storage import written


@dataclass(frozen=True)
class Hook:
    """A function and where it belongs."""

    fn: Callable
    kind: Literal["pre", "post"]

    def __call__(self, *columns: Column):
        return self.fn(*columns)


def pre(fn: Callable[[Column], Column]) -> Hook:
    return Hook(fn, "pre")


def post(fn: Callable[[Column, Column], tuple[Column, Column]]) -> Hook:
    return Hook(fn, "post")


def on_tokens(fn: Callable[[Column], Column]) -> Hook:
    """A post hook that looks at the tokens alone."""
    return post(lambda raw, tokens: (raw, fn(tokens)))


def per_token(hook: Hook) -> Hook:
    """A pre hook used on each token."""
    if hook.kind != "pre":
        raise ValueError("only a pre hook can be applied to each token")
    return on_tokens(lambda tokens: F.transform(tokens, hook.fn))


# Raw texts

LOWERCASE = pre(F.lower)


def java_replacement(text: str) -> str:
    """A replacement in Python's notation (\\1, \\g<name>) in Java's."""
    out = text.replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else f"${{{m[1]}}}", out)
    return re.sub(r"\\(\d+)", r"$\1", out)


def regex_replace(rules: Iterable[tuple[str, str]]) -> Hook:
    """Replace one pattern after the other; replacements as Python writes them."""
    java = [(re.sub(r"\(\?P<", "(?<", p), java_replacement(r)) for p, r in rules]
    return pre(lambda text: chain(text, java))


PUNCT = r"[\p{P}\p{S}]"
_URL = r"(?i)(?=[hfw])(?:https?://|ftp://|www\.)[^\s<>\"]*[^\s<>\".,;:!?)\]}']"
#: From the start of a run, or where the last match ended: elsewhere in a run none begins that doesn't begin before.
_EMAIL = r"(?i)(?:(?<![a-z0-9._%+\-])|\G)[a-z0-9._%+\-]++@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+"
_PHONE = r"(?=[+(\d])(?<![\w.])(?:\+?\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{3})[ .\-]\d{3,4}[ .\-]\d{3,4}(?![\w])"
_NUMBER = r"(?=[+\-\d])(?<![\w.,])[+\-]?(?:\d+(?:[.,]\d+)*)(?![\w])"
_MOJIBAKE = [("â€™", "’"), ("â€œ", "“"), ("â€\u009d", "”"), ("â€“", "–"), ("â€”", "—"), ("Ã©", "é"), ("Ã¨", "è"), ("Ã¼", "ü"), ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã±", "ñ")]
_PLAIN = {
    "áàâãåāăąÁÀÂÃÅĀĂĄ": "aaaaaaaaAAAAAAAA", "çćčÇĆČ": "cccCCC", "ďđĎĐ": "ddDD", "éèêëēėęěÉÈÊËĒĖĘĚ": "eeeeeeeeEEEEEEEE", "íìîïīįÍÌÎÏĪĮ": "iiiiiiIIIIII", "ñńňÑŃŇ": "nnnNNN",
    "óòôõōőÓÒÔÕŌŐ": "ooooooOOOOOO", "řŘ": "rR", "śšŚŠ": "ssSS", "ťŤ": "tT", "úùûūůűųÚÙÛŪŮŰŲ": "uuuuuuuUUUUUUU", "ýÿÝŸ": "yyYY", "źżžŹŻŽ": "zzzZZZ", "łŁ": "lL",
    "‘’‚“”„–—−…\u00a0": "'''\"\"\"---.\u0020",
}
_LONG = {"en": [("[äÄ]", "a"), ("[öÖ]", "o"), ("[üÜ]", "u")], "de": [("ä", "ae"), ("Ä", "Ae"), ("ö", "oe"), ("Ö", "Oe"), ("ü", "ue"), ("Ü", "Ue")]}


def to_ascii(text: Column, language: str = "en") -> Column:
    """Letters without their marks; what has no such form goes."""
    rules = _LONG[language] if language == "de" else [("ä", "a"), ("Ä", "A"), ("ö", "o"), ("Ö", "O"), ("ü", "u"), ("Ü", "U")]
    text = chain(text, [*rules, ("ß", "ss"), ("[æÆ]", "ae"), ("[œŒ]", "oe"), ("[øØ]", "o"), ("€", "EUR")])
    text = F.translate(text, "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.regexp_replace(text, r"[^\x00-\x7f]", "")


def cleanup(
    language: str = "en",
    *,
    remove_punct: bool = False,
    remove_line_breaks: bool = False,
    ascii: bool = True,
    fix_unicode: bool = True,
    replace_url: str | None = None,
    replace_email: str | None = None,
    replace_phone_number: str | None = None,
    replace_number: str | None = None,
    replace_digit: str | None = None,
    replace_currency_symbol: str | None = None,
) -> Hook:
    """Replace kinds of text in a fixed order, then even out white space."""
    if language not in _LONG:
        raise ValueError(f"language {language} isn't known here")
    rules = _MOJIBAKE + [("\ufeff|\u200b", "")] if fix_unicode else []
    rules = list(rules)
    # Currency before letters lose their marks, else its signs are gone.
    if replace_currency_symbol is not None:
        rules.append((r"\p{Sc}", java_replacement(replace_currency_symbol)))
    later = [(p, java_replacement(x)) for p, x in ((_URL, replace_url), (_EMAIL, replace_email), (_PHONE, replace_phone_number), (_NUMBER, replace_number), (r"\d", replace_digit)) if x is not None]
    if remove_punct:
        kept = "".join(re.escape(c) for x in (replace_url, replace_email, replace_phone_number, replace_number, replace_digit, replace_currency_symbol) for c in x or "" if not c.isalnum())
        later.append((f"(?![{kept}]){PUNCT}" if kept else PUNCT, ""))
    later += [(r"\s*[\r\n]+\s*", " ")] if remove_line_breaks else [(r"[^\S\r\n]*+(?:\r\n|\r|\n)\s*", "\n")]
    later += [(r"[^\S\r\n]+", " ")]

    def run(text: Column) -> Column:
        text = chain(text, rules)
        text = to_ascii(text, language) if ascii else text
        return F.btrim(chain(text, later), F.lit(" \n\r\t"))

    return pre(run)


_MOSES_COMMON = [
    (r"\r", ""), (r"\(", " ("), (r"\)", ") "), (r" +", " "), (r"\) ([.!:?;,])", ")$1"), (r"\( ", "("), (r" \)", ")"), (r"(\d) %", "$1%"), (r" ([:;])", "$1"),
    ("[`´‘’‚]", "'"), ("[“”„«»]|''", '"'), ("[–]", "-"), ("—", " - "), ("…", "..."), ("\u00a0", " "), (r" +", " "),
]


def moses_normalize(language: str = "en") -> Hook:
    """Punctuation and spaces in one form; in English, commas and points go before closing quotes."""
    quotes = [(r'"([,.]+)', '$1"')] if language == "en" else [(r',"', '",')]
    return pre(lambda text: F.btrim(chain(text, _MOSES_COMMON + quotes)))


# Tokens


def remove_punct(tokens_only: str = PUNCT) -> Hook:
    """Tokens without punctuation; those that are nothing else go."""
    return on_tokens(lambda tokens: F.filter(F.transform(tokens, lambda t: F.regexp_replace(t, tokens_only, "")), lambda t: t != ""))


def remove_stopwords(language: str = "en", words: Iterable[str] | None = None) -> Hook:
    """Without tokens that are stop words, compared as they are; repeated tokens stay repeated."""
    if words is None and language not in STOPWORDS:
        raise ValueError(f"no stop words for {language}; known: {', '.join(sorted(STOPWORDS))}")
    stop = sorted(set(STOPWORDS[language] if words is None else words))
    return on_tokens(lambda tokens: F.filter(tokens, lambda t: ~t.isin(stop)))


def ngram(low: int, high: int, sep: str = " ") -> Hook:
    return on_tokens(lambda tokens: ngrams(tokens, low, high, sep))


def stem(language: str = "en") -> Hook:
    """Stems (Porter's for en, Snowball's for da, de, no, sv), in parts of Arrow batches: each distinct token of a part is stemmed once."""
    if language not in STEMMERS:
        raise ValueError(f"no stemmer for {language}; there are {', '.join(STEMMERS)}")
    stemmer = STEMMERS[language]

    def run(rows: pa.Array) -> pa.Array:
        flat = pc.list_flatten(rows).cast(pa.string()).dictionary_encode()
        stems = pa.array([None if t is None else stemmer(t) for t in flat.dictionary.to_pylist()], pa.string())
        offs = np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(rows), 0)))].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offs), stems.take(flat.indices), mask=rows.is_null())

    return on_tokens(in_parts("array<string>", run))


def lemmatize(lookup: Mapping[str, str]) -> Hook:
    """Lemmas from a table of forms that fits in a closure; other tokens stay. For larger tables: operators.lookup."""
    if not lookup:
        return on_tokens(lambda tokens: tokens)
    if len(lookup) <= 64:
        flat = [F.lit(x) for pair in lookup.items() for x in pair]
        return on_tokens(lambda tokens: F.transform(tokens, lambda t: F.coalesce(F.try_element_at(F.create_map(*flat), t), t)))
    table = dict(lookup)

    return on_tokens(in_parts("array<string>", lists(lambda rows: [None if row is None else [table.get(t, t) for t in row] for row in rows], pa.list_(pa.string()))))


# Casing

#: Words of a casing model that are sent to all tasks.
_HOT_WORDS = 1 << 16


def truecase_model(df: DataFrame, tokens: str, row_id: str) -> DataFrame:
    """lower, best, freq: of each word the casing that comes most; ties: the first by code points.

    First words of rows aren't counted, as their casing is that of a sentence's start.
    """
    t = df.select(F.posexplode(F.col(tokens)).alias("pos", "t")).filter("pos > 0")
    counts = t.groupBy(F.lower("t").alias("lower"), "t").agg(F.count("*").alias("n"))
    top = counts.groupBy("lower").agg(F.max("n").alias("freq"))
    return counts.join(top, "lower").filter("n = freq").groupBy("lower").agg(F.min("t").alias("best"), F.first("freq").alias("freq"))


def truecase(df: DataFrame, tokens: str, row_id: str, model: DataFrame, oov: str = "title") -> DataFrame:
    """row_id, pos, token: tokens in the model's casing; others in title case, lower case, or as they are."""
    if oov not in ("title", "lower", "as-is"):
        raise ValueError("oov is title, lower or as-is")
    other = {"title": F.initcap(F.col("t")), "lower": F.lower("t"), "as-is": F.col("t")}[oov]
    t = df.select(row_id, F.posexplode(F.col(tokens)).alias("pos", "t")).withColumn("lower", F.lower("t"))
    # The most frequent words are broadcast, so that their tokens aren't shuffled; the others are joined.
    hot = F.broadcast(written(model.orderBy(F.desc("freq"), "lower").limit(_HOT_WORDS).select("lower", "best"), "hot"))
    t = t.join(hot, "lower", "left")
    rare = t.filter("best is null").drop("best").join(model.select("lower", "best"), "lower", "left")
    return t.filter("best is not null").unionByName(rare).select(row_id, "pos", F.coalesce("best", other).alias("token"))


# Key phrases


def rake_scores(text: str, stop: frozenset[str]) -> list[tuple[str, float]]:
    """Phrases between stop words and punctuation, by the sum of their words' degree over frequency.

    Ties are in alphabetical order (Rose et al., 2010).
    """
    phrases: list[tuple[str, ...]] = []
    for part in re.split(r"[^\w\s'\-]+|[\r\n]+", text.lower()):
        run: list[str] = []
        for w in part.split():
            if w in stop or not any(c.isalnum() for c in w):
                if run:
                    phrases.append(tuple(run))
                run = []
            else:
                run.append(w)
        if run:
            phrases.append(tuple(run))
    freq: Counter[str] = Counter()
    degree: Counter[str] = Counter()
    for p in phrases:
        for w in p:
            freq[w] += 1
            degree[w] += len(p)
    scores = {" ".join(p): sum(degree[w] / freq[w] for w in p) for p in phrases}
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def yake_scores(text: str, stop: frozenset[str], longest: int = 3) -> list[tuple[str, float]]:
    """Phrases of up to longest words by YAKE's score (Campos et al., 2020); the smallest come first."""
    sentences = [re.findall(r"[\w'\-]+", s) for s in re.split(r"[.!?\n]+", text)]
    sentences = [s for s in sentences if s]
    tf: Counter[str] = Counter()
    upper: Counter[str] = Counter()
    places: dict[str, list[int]] = defaultdict(list)
    left: dict[str, Counter[str]] = defaultdict(Counter)
    right: dict[str, Counter[str]] = defaultdict(Counter)
    for k, s in enumerate(sentences):
        low = [w.lower() for w in s]
        for i, w in enumerate(low):
            tf[w] += 1
            upper[w] += bool(i and s[i][0].isupper())
            places[w].append(k)
            if i:
                left[w][low[i - 1]] += 1
                right[low[i - 1]][w] += 1
    content = [n for w, n in tf.items() if w not in stop]
    if not content:
        return []
    mean = sum(content) / len(content)
    spread = math.sqrt(sum((n - mean) ** 2 for n in content) / len(content))
    most = max(tf.values())

    def word(w: str) -> float:
        n = tf[w]
        case = upper[w] / (1 + math.log(n))
        where = math.log(math.log(3 + sorted(places[w])[len(places[w]) // 2]))
        dl = len(left[w]) / max(1, sum(left[w].values()))
        dr = len(right[w]) / max(1, sum(right[w].values()))
        related = 1 + (dl + dr) * n / most
        sentence_share = len(set(places[w])) / len(sentences)
        return related * where / (case + n / (mean + spread) / related + sentence_share / related)

    score = {w: word(w) for w in tf}
    found: Counter[tuple[str, ...]] = Counter()
    for s in sentences:
        low = [w.lower() for w in s]
        for i in range(len(low)):
            for n in range(1, longest + 1):
                g = tuple(low[i : i + n])
                if len(g) == n and g[0] not in stop and g[-1] not in stop:
                    found[g] += 1
    out = []
    for g, n in found.items():
        own = [score[w] for w in g if w not in stop]
        out.append((" ".join(g), math.prod(own) / (n * (1 + sum(own)))))
    return sorted(out, key=lambda x: (x[1], x[0]))


def rake_phrases(texts: pa.Array, stop: frozenset[str]) -> pa.Array:
    """The phrases of rake_scores, of each text."""
    return pa.array([None if t is None else [p for p, _ in rake_scores(t, stop)] for t in texts.to_pylist()], pa.list_(pa.string()))


_YAKE_PART = re.compile(r"[\w'\-]+|[.!?\n]+")
#: Words of texts that are held side by side, at most: three of them fit one long.
_YAKE_WORDS = (1 << 21) - 2


def _logs(n: int, of: Callable[[int], float]) -> np.ndarray:
    return np.array([0.0, *(of(k) for k in range(1, n + 1))])


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def yake_phrases(texts: pa.Array, stop: frozenset[str], longest: int = 3) -> pa.Array:
    """The phrases of yake_scores, of each text, by the same operations on arrays of all texts' words."""
    one_by_one = lambda: pa.array([None if t is None else [p for p, _ in yake_scores(t, stop, longest)] for t in texts.to_pylist()], pa.list_(pa.string()))
    if longest != 3:
        return one_by_one()
    parts = [_YAKE_PART.findall(t) if t is not None else [] for t in texts.to_pylist()]
    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    coded = pa.array([w for p in parts for w in p], pa.string()).dictionary_encode()
    surface, code = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    del parts, coded
    is_word = np.array([w[0] not in ".!?\n" for w in surface], dtype=bool)[code]
    # Sentences are the words between marks; those without words don't count.
    begin = np.r_[True, ~is_word[:-1] | (doc[1:] != doc[:-1])][is_word] if len(code) else np.zeros(0, bool)
    doc, code = doc[is_word], code[is_word]
    total = len(code)
    if not total:
        return pa.array([[] if ok else None for ok in texts.is_valid().to_pylist()], pa.list_(pa.string()))
    low = [w.lower() for w in surface]
    names = sorted(set(low))
    rank = {w: k for k, w in enumerate(names)}
    name = np.array([rank[w] for w in low], np.int64)[code]
    stops = np.array([w in stop for w in names], dtype=bool)
    sentence = np.cumsum(begin) - 1
    first_of = np.searchsorted(doc, np.arange(len(texts)))
    place = sentence - np.r_[sentence, 0][first_of][doc]
    n_sentences = np.bincount(doc[begin], minlength=len(texts))
    # A text's words, by text and then in the order of their code points.
    pairs, first, u, tf = np.unique(doc * len(names) + name, return_index=True, return_inverse=True, return_counts=True)
    if len(pairs) > _YAKE_WORDS:
        return one_by_one()
    of, is_stop = pairs // len(names), stops[pairs % len(names)]
    upper = np.bincount(u[np.array([w[:1].isupper() for w in surface], dtype=bool)[code] & ~begin], minlength=len(pairs))
    by_word = np.argsort(u, kind="stable")
    start = np.cumsum(tf) - tf
    middle = place[by_word[start + tf // 2]]
    n_places = np.bincount(u[by_word][_firsts(u[by_word], place[by_word])], minlength=len(pairs))
    at = np.flatnonzero(~begin)

    def around(word: np.ndarray, beside: np.ndarray) -> np.ndarray:
        """How many different words are beside one, over how many there are."""
        kinds = np.unique(word * len(pairs) + beside) // len(pairs)
        return np.bincount(kinds, minlength=len(pairs)) / np.maximum(1, np.bincount(word, minlength=len(pairs)))

    dl, dr = around(u[at], u[at - 1]), around(u[at - 1], u[at])
    own = np.flatnonzero(~is_stop)
    own = own[np.argsort(first[own], kind="stable")]
    edges = np.searchsorted(of[own], np.arange(len(texts) + 1))
    usual, counted = np.zeros(len(texts)), tf[own].tolist()
    for d in np.unique(of[own]).tolist():
        content = counted[edges[d] : edges[d + 1]]
        mean = sum(content) / len(content)
        usual[d] = mean + math.sqrt(sum((n - mean) ** 2 for n in content) / len(content))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, of, tf)
    case = upper / (1 + _logs(int(tf.max()), math.log)[tf])
    where = _logs(int(middle.max()) + 3, lambda k: math.log(math.log(k)) if k > 1 else 0.0)[middle + 3]
    related = 1 + (dl + dr) * tf / most[of]
    with np.errstate(divide="ignore"):  # texts of stop words alone, which have no phrases
        score = related * where / (case + tf / usual[of] / related + n_places / n_sentences[of] / related)
    # Phrases by their words' numbers; they come out by text and in alphabetical order, as no letter comes before the space.
    sent_end = np.r_[np.flatnonzero(begin)[1:], total][sentence]
    grams = []
    good = ~is_stop[u]
    for n in (1, 2, 3):
        i = np.flatnonzero(good[: total - n + 1] & good[n - 1 :] & (np.arange(n, total + 1) <= sent_end[: total - n + 1]))
        words = [u[i + k] + 1 if k < n else np.zeros(len(i), np.int64) for k in range(3)]
        grams.append((words[0] << 42) | (words[1] << 21) | words[2])
    grams, n = np.unique(np.concatenate(grams), return_counts=True)
    words = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], axis=1) - 1
    there = words >= 0
    counts = there & ~is_stop[words]
    s = np.where(counts, score[words], 0.0)
    product = np.where(counts[:, 0], s[:, 0], 1.0) * np.where(counts[:, 1], s[:, 1], 1.0) * np.where(counts[:, 2], s[:, 2], 1.0)
    # The sum as Python's sum() has it, with what is lost by rounding.
    total2 = s[:, 0] + s[:, 1]
    lost = np.where(s[:, 0] >= s[:, 1], (s[:, 0] - total2) + s[:, 1], (s[:, 1] - total2) + s[:, 0])
    total3 = total2 + s[:, 2]
    lost += np.where(total2 >= s[:, 2], (total2 - total3) + s[:, 2], (s[:, 2] - total3) + total2)
    value = product / (n * (1 + (total3 + lost)))
    text = of[words[:, 0]]
    order = np.lexsort((value, text))
    there = there[order]
    each = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32)), pa.array(names, pa.string()).take(pa.array(pairs[words[order][there]] % len(names))))
    phrases = pc.binary_join(each, " ")
    offs = np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), phrases, mask=texts.is_null())


def keywords(method: str = "rake", language: str = "en", **options) -> Hook:
    """The tokens become the raw text's phrases, best first. In parts of Arrow batches, outside the JVM."""
    scorers = {"rake": rake_phrases, "yake": yake_phrases}
    if method not in scorers:
        raise ValueError("method is rake or yake")
    stop, fn = frozenset(STOPWORDS[language]), scorers[method]

    run = in_parts("array<string>", lambda raw: fn(raw, stop, **options))
    return post(lambda raw, tokens: (raw, run(raw)))
