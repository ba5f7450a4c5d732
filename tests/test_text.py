"""Tokenizers, hooks and array expressions."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.fields import Field, Schema
from textloom.functions import arrays, hooks, tokenize
from textloom.functions.stemmer import porter


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def many(spark, texts, fn):
    return [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_split_is_pythons(spark):
    rng = random.Random(1)
    space = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0       　"
    texts = ["", "  ", *("".join(rng.choice(space + "abcé​日") for _ in range(40)) for _ in range(50))]
    assert many(spark, texts, tokenize.get_tokenizer("split")) == [t.split() for t in texts]


def test_separators_keep_empty_parts(spark):
    texts = ["a,b,,c,", "", ",", "a.b"]
    assert many(spark, texts, tokenize.get_tokenizer("split-,")) == [t.split(",") for t in texts]
    assert many(spark, ["a-b--c"], tokenize.get_tokenizer("split--")) == [["a", "b", "", "c"]]
    assert many(spark, ["a\\Eb"], tokenize.get_tokenizer("split-\\E")) == [["a", "b"]]


def test_characters_and_functions(spark):
    assert many(spark, ["aé😀b", ""], tokenize.get_tokenizer("chars")) == [["a", "é", "😀", "b"], []]
    assert many(spark, ["a b", None], tokenize.python_tokenizer(list)) == [["a", " ", "b"], None]
    assert one(spark, None, tokenize.get_tokenizer("split")) is None


@pytest.mark.parametrize("spec", ["split-", "unknown", 3])
def test_no_such_tokenizer(spec):
    with pytest.raises(ValueError):
        tokenize.get_tokenizer(spec)


def test_punctuation_tokenizers(spark):
    assert one(spark, "Don't stop, (3,5 or 3.5) at once!", tokenize.moses) == ["Don", "'t", "stop", ",", "(", "3,5", "or", "3.5", ")", "at", "once", "!"]
    assert one(spark, "Is it 9.5, or not?", tokenize.toktok) == ["Is", "it", "9.5", ",", "or", "not", "?"]


def test_sentences(spark):
    assert one(spark, "One. Two?  Three!\nFour", tokenize.sentences) == ["One.", "Two?", "Three!", "Four"]


@pytest.mark.parametrize(
    "options,text,want",
    [
        ({"remove_line_breaks": True}, "two\n lines \n", "two lines"),
        ({"remove_punct": True}, "so -- what?!", "so what"),
        ({"replace_url": "_U_"}, "at https://example.org, or", "at _U_, or"),
        ({"replace_email": "_E_"}, "to jane.roe@example.com.", "to _E_."),
        ({"replace_phone_number": "_P_"}, "call (030) 555 0199 or 555-123-4567", "call _P_ or _P_"),
        ({"replace_number": "_N_"}, "7 x 1,000.5 is -3, x9", "_N_ x _N_ is _N_, x9"),
        ({"replace_digit": "#"}, "a 12 b3", "a ## b#"),
        ({"replace_currency_symbol": "_C_"}, "5€ or $6", "5_C_ or _C_6"),
        ({"remove_punct": True, "replace_url": "<URL>"}, "see: www.example.org!", "see <URL>"),
        ({"language": "de"}, "Äpfel für Süße", "Aepfel fuer Suesse"),
        ({"language": "en"}, "naïve  “café”", 'naive "cafe"'),
        ({"ascii": False}, "a \n\n b", "a\nb"),
    ],
)
def test_cleanup(spark, options, text, want):
    assert one(spark, text, hooks.cleanup(**options)) == want


def test_unknown_languages():
    for make in (lambda: hooks.cleanup("xx"), lambda: hooks.stem("xx"), lambda: hooks.remove_stopwords("xx")):
        with pytest.raises(ValueError):
            make()


def test_regex_replace_as_python_writes_it(spark):
    assert one(spark, "costs  20$ now", hooks.regex_replace([(r"[0-9]+", "<N>"), (r"\s+", "_")])) == "costs_<N>$_now"
    assert one(spark, "ab", hooks.regex_replace([(r"(?P<x>a)(b)", r"\2\g<x>$1")])) == "ba$1"


def test_token_hooks(spark):
    df = spark.createDataFrame([(["The", "the", "cat", "cat", "..", "a.b"],), (None,), ([],)], "t array<string>")

    def run(hook):
        return [r[0] for r in df.select(hook(F.lit("raw"), F.col("t"))[1]).collect()]

    assert run(hooks.remove_stopwords("en")) == [["The", "cat", "cat", "..", "a.b"], None, []]
    assert run(hooks.remove_punct()) == [["The", "the", "cat", "cat", "ab"], None, []]
    assert run(hooks.per_token(hooks.LOWERCASE))[0][:2] == ["the", "the"]
    assert run(hooks.lemmatize({"cat": "CAT"}))[0][2] == "CAT"
    assert run(hooks.lemmatize({f"x{i}": "y" for i in range(99)} | {"cat": "c"}))[0][2] == "c"
    assert run(hooks.stem())[1:] == [None, []]
    with pytest.raises(ValueError):
        hooks.per_token(hooks.stem())


@pytest.mark.parametrize(
    "word,want",
    [
        ("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"),
        ("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
        ("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("digitizer", "digit"), ("vietnamization", "vietnam"), ("predication", "predic"), ("operator", "oper"), ("feudalism", "feudal"),
        ("decisiveness", "decis"), ("hopefulness", "hope"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("formative", "form"), ("goodness", "good"), ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"),
    ],
)
def test_porters_examples(word, want):
    assert porter(word) == want


def test_rake_by_hand():
    found = dict(hooks.rake_scores("linear constraints over natural numbers, and linear systems", frozenset({"and", "over"})))
    # linear: degree 4, twice; constraints, systems: 2, once; natural, numbers: 2, once.
    assert found == {"linear constraints": 4.0, "linear systems": 4.0, "natural numbers": 4.0}
    assert hooks.rake_scores("", frozenset()) == [] and hooks.yake_scores(" \n", frozenset()) == []


def test_yake_puts_what_the_text_is_about_first():
    text = "Spark plans queries. Spark runs queries on many machines. A plan is a tree. Spark keeps plans small."
    found = [p for p, _ in hooks.yake_scores(text, frozenset({"a", "is", "on", "many"}))]
    assert "spark" in found[:3] and all(w in text.lower() for p in found for w in p.split())


def test_keywords_take_the_tokens_place(spark):
    df = spark.createDataFrame([("good plans, good trees",), (None,)], "t string")
    got = [r[0] for r in df.select(hooks.keywords("rake")(F.col("t"), F.array(F.lit("x")))[1]).collect()]
    assert got == [["good plans", "good trees"], None]


def test_truecase(spark):
    rows = [(1, ["The", "Paris", "metro"]), (2, ["paris", "Paris", "the", "city"]), (3, ["UNSEEN", "metro"])]
    df = spark.createDataFrame(rows, "i int, t array<string>")
    model = hooks.truecase_model(df, "t", "i")
    for oov, last in (("title", "Unseen"), ("lower", "unseen"), ("as-is", "UNSEEN")):
        got = {(r["i"], r["pos"]): r["token"] for r in hooks.truecase(df, "t", "i", model, oov).collect()}
        assert got[1, 0] == "the" and got[2, 0] == "Paris" and got[3, 0] == last


def test_moses_normalize(spark):
    assert one(spark, "“What´s up” ( a ) – 5 %", hooks.moses_normalize()) == '"What\'s up" (a) - 5%'


def test_padding(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],), (None,)], "a array<int>")

    def run(*options):
        return [r[0] for r in df.select(arrays.pad_to(F.col("a"), *options)).collect()]

    assert run(5, 0) == [[1, 2, 3, 0, 0], [0] * 5, None]
    assert run(5, 0, True) == [[0, 0, 1, 2, 3], [0] * 5, None]
    assert run(2, 0) == [[1, 2], [0, 0], None]
    assert run(2, 0, False, True) == [[2, 3], [0, 0], None]


def test_ngrams_and_multi_hot(spark):
    df = spark.createDataFrame([(["a", "b", "c"], [0, 2]), (["a"], []), ([], [1]), (None, None)], "t array<string>, i array<long>")
    got = [tuple(r) for r in df.select(arrays.ngrams(F.col("t"), 1, 3), arrays.multi_hot(F.col("i"), 3), arrays.last_of(F.col("i"), 1)).collect()]
    assert got == [(["a", "b", "c", "a b", "b c", "a b c"], [1, 0, 1], [2]), (["a"], [0, 0, 0], []), ([], [0, 1, 0], [1]), (None, None, None)]


def test_stems_of_other_languages(spark):
    from textloom.functions.stemmer import STEMMERS

    cases = {
        "de": "aufeinander aufeinand aufeinanderfolge aufeinanderfolg aufeinanderfolgend aufeinanderfolg aufeinanderfolgenden aufeinanderfolg kategorie kategori kategorien kategori kater kat katers kat katze katz katzen katz kätzchen katzch straße strass freundlichkeit freundlich häuser haus",
        "sv": "jakten jakt jaktkarlar jaktkarl jaktkarlarne jaktkarl jaktkarlens jaktkarl kloka klok klokare klok klokast klok klokaste klok klokhet klok klokheten klok klo klo",
        "no": "havnedistriktene havnedistrikt havnedistrikter havnedistrikt opninga opning hesten hest hestene hest",
        "da": "underste underst undersåtter undersåt undersåtterne undersåt indtagelse indtag hesten hest",
    }
    for language, words in cases.items():
        words = words.split()
        assert [STEMMERS[language](w) for w in words[::2]] == words[1::2], language
    rows = spark.createDataFrame([(["häuser", "katzen", "häuser"],)], "t array<string>")
    f = Field("t", None, hooks=(hooks.stem("de"),))
    assert Schema({"t": f}).apply(rows.withColumn("r", F.lit(1)), "r").first().t == ["haus", "katz", "haus"]
    assert all(fn("") == "" and fn("a") == "a" for fn in STEMMERS.values())


def test_rules_without_expressions_replace_bytes(spark):
    """Plain ones aren't compiled; signs that are rare are searched for, not what stands before them."""
    df = spark.createDataFrame([("aÃ©b ä$",)], "t string")
    out = df.select(tokenize.chain(F.col("t"), [("Ã©", "é"), ("ä", "ae"), (r"\$", "!"), ("b", r"\$")]).alias("x"))
    assert out.first()["x"] == "aé$ ae!"
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 2
    texts = ["a,b", "1,2", "1,b", "a,2", ",", "x,", ".,5", "'a' b'c d' '", "end.", "end..", "A.", "a .", "a'b'c", "9'", "''"]
    assert many(spark, texts, tokenize.toktok) == [["a", ",", "b"], ["1,2"], ["1", ",", "b"], ["a", ",", "2"], [","], ["x", ","], [".", ",", "5"], ["'", "a", "'", "b'c", "d", "'", "'"], ["end", "."], ["end", ".."], ["A", "."], ["a", "."], ["a'b'c"], ["9", "'"], ["'", "'"]]
    mails = "a@b.cd+x@y.zz a@b.cd_%x@y.zz .@. x@y @q.de a@b.c-d@e.f"
    assert one(spark, mails, hooks.cleanup(replace_email="E")) == "EE EE .@. x@y @q.de E@e.f"


def test_truecase_with_one_frequent_word(spark, monkeypatch):
    """Frequent words are broadcast, the others are joined; tokens of neither stay."""
    monkeypatch.setattr(hooks, "_HOT_WORDS", 1)
    df = spark.createDataFrame([(1, ["X", "the", "the", "Paris", "Paris", "paris"]), (2, ["THE", "PARIS", "new", None])], "i long, t array<string>")
    model = hooks.truecase_model(df.filter("i = 1"), "t", "i")
    out = hooks.truecase(df, "t", "i", model, "lower")
    assert "ResolvedHint" in out._jdf.queryExecution().analyzed().toString()
    got = {(r["i"], r["pos"]): r["token"] for r in out.collect()}
    assert got == {(1, 0): "x", (1, 1): "the", (1, 2): "the", (1, 3): "Paris", (1, 4): "Paris", (1, 5): "Paris", (2, 0): "the", (2, 1): "Paris", (2, 2): "new", (2, 3): None}
