"""The registered queries over the driver's tables, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.fields import Field, MultilabelField, MultioutputField, Schema, label_field
from textloom.functions import arrays, hooks, tokenize
from textloom.functions.stopwords import STOPWORDS
from textloom.operators import batching, dataset, experiment, features, tree, vectors
from textloom.operators import vocab as V
from textloom.operators.dataset import Dataset
from textloom.sources import files, records
from textloom.storage import fresh_path, spread, written
from textloom.streaming import vocab_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"), "doc_id")


def joined(ids) -> F.Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), " ")


# What queries have in common: tokens of the documents in lower case and their vocabulary.

WORD = r"[^\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
LOW = f"low AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)"
TK = f"{LOW}, tk AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM low)"
COUNTED = "c AS (SELECT token, count(*) AS freq, min(doc_id * 16777216 + pos) AS first FROM tk GROUP BY token)"
SIZE, MIN_FREQ = 5000, 2
VOCAB = f"""{TK}, {COUNTED},
v AS (SELECT CAST(row_number() OVER (ORDER BY freq DESC, first) + 1 AS BIGINT) AS idx, token, freq FROM c WHERE freq >= {MIN_FREQ} ORDER BY freq DESC, first LIMIT {SIZE - 2})"""
IDS = f"{VOCAB}, ids AS (SELECT low.doc_id, coalesce(list(coalesce(v.idx, 0) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS ids FROM low LEFT JOIN tk USING (doc_id) LEFT JOIN v USING (token) GROUP BY low.doc_id)"
SPEC = V.VocabSpec(max_size=SIZE, min_freq=MIN_FREQ)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", tokenize.whitespace(F.lower("text")).alias("tokens"))


def vocabulary(spark: SparkSession, d: str, spec: V.VocabSpec = SPEC) -> DataFrame:
    return written(V.finalize(V.counts(tokens(spark, d), "tokens", "doc_id"), spec), "vocab")


def numbers(spark: SparkSession, d: str, vocab: DataFrame | None = None) -> DataFrame:
    return V.numericalize(tokens(spark, d), "tokens", vocabulary(spark, d) if vocab is None else vocab, "doc_id").select("doc_id", "ids")


def long(df: DataFrame, row_id: str, values: str, name: str = "token") -> DataFrame:
    return df.select(row_id, F.posexplode(values).alias("pos", name)).withColumn("pos", F.col("pos").cast("long"))


# Tokenizers


@query(f"SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t FROM documents)")
def tokenize_split(spark, d):
    return long(docs(spark, d).select("doc_id", tokenize.get_tokenizer("split")(F.col("text")).alias("t")), "doc_id", "t")


@query("SELECT event_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT event_id, string_split(props, ': ') AS t FROM events)")
def tokenize_sep(spark, d):
    return long(table(spark, d, "events").select("event_id", tokenize.get_tokenizer("split-: ")(F.col("props")).alias("t")), "event_id", "t")


@query("SELECT p_partkey, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT p_partkey, string_split(p_name, '') AS t FROM part)")
def tokenize_chars(spark, d):
    return long(table(spark, d, "part").select("p_partkey", tokenize.get_tokenizer("chars")(F.col("p_name")).alias("t")), "p_partkey", "t")


@query(r"""SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id,
  list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '') AS t FROM documents)""")
def sentences_regex(spark, d):
    return long(docs(spark, d).select("doc_id", tokenize.sentences(F.col("text")).alias("t")), "doc_id", "t")


@query()
def tokenize_moses(spark, d):
    return long(docs(spark, d).select("doc_id", tokenize.moses(F.col("text")).alias("t")), "doc_id", "t")


@query()
def tokenize_toktok(spark, d):
    return long(docs(spark, d).select("doc_id", tokenize.toktok(F.col("text")).alias("t")), "doc_id", "t")


# Hooks


def hooked(spark, d, *own, tokenizer: str | None = "split", keep_raw: bool = False):
    f = Field("t", tokenizer, hooks=own, keep_raw=keep_raw)
    return Schema({"text": f}).apply(docs(spark, d).select("doc_id", "text"), "doc_id")


@query("SELECT doc_id, lower(text) AS t FROM documents")
def hook_lowercase(spark, d):
    return hooked(spark, d, hooks.LOWERCASE, tokenizer=None)


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([0-9])[0-9]+', '<\1NUM>', 'g'), '\s+', '_', 'g') AS t FROM documents")
def hook_regex_replace(spark, d):
    return hooked(spark, d, hooks.regex_replace([(r"([0-9])[0-9]+", r"<\1NUM>"), (r"\s+", "_")]), tokenizer=None)


@query(rf"""SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id,
  list_filter(list_transform(regexp_extract_all(text, '{WORD}'), lambda x: regexp_replace(x, '[\pP\pS]', '', 'g')), lambda x: x <> '') AS t FROM documents)""")
def hook_remove_punct(spark, d):
    return long(hooked(spark, d, hooks.remove_punct()), "doc_id", "t")


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS["en"])


@query(f"""SELECT doc_id, token, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS BIGINT) AS pos FROM
  (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents)) WHERE token NOT IN ({_STOP})""")
def hook_stopwords(spark, d):
    return long(hooked(spark, d, hooks.LOWERCASE, hooks.remove_stopwords("en")), "doc_id", "t")


@query(rf"""SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id,
  list_transform(regexp_extract_all(text, '{WORD}'), lambda x: regexp_replace(lower(x), '[aeiou]', '*', 'g')) AS t FROM documents)""")
def hook_per_token(spark, d):
    return long(hooked(spark, d, hooks.per_token(hooks.LOWERCASE), hooks.per_token(hooks.regex_replace([("[aeiou]", "*")]))), "doc_id", "t")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '(?i)(?:https?://|ftp://|www\.)[^\s<>"]*[^\s<>".,;:!?)\]}'']', '<URL>', 'g'),
  '(?i)[a-z0-9._%+\-]+@[a-z0-9\-]+(?:\.[a-z0-9\-]+)+', '<EMAIL>', 'g'), '[0-9]', '<DIGIT>', 'g'), '\s*[\r\n]+\s*', ' ', 'g'), '[\t\f ]+', ' ', 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS t FROM documents""")
def hook_cleanup_url_email_digit(spark, d):
    return hooked(spark, d, hooks.cleanup(fix_unicode=False, ascii=False, remove_line_breaks=True, replace_url="<URL>", replace_email="<EMAIL>", replace_digit="<DIGIT>"), tokenizer=None)


@query()
def hook_cleanup_full(spark, d):
    """Numbers and phones need what SQL's expressions can't say (a look behind); tests have the cases."""
    return hooked(spark, d, hooks.cleanup("de", remove_punct=True, replace_url="<URL>", replace_email="<EMAIL>", replace_phone_number="<PHONE>", replace_number="<NUM>", replace_currency_symbol="<CUR>"), tokenizer=None)


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '{WORD}') AS t FROM conversations),
g AS (SELECT conv_id, turn, list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), lambda i: array_to_string(t[i:i + 1], ' ')) ELSE [] END,
  CASE WHEN len(t) >= 3 THEN list_transform(range(1, len(t) - 1), lambda i: array_to_string(t[i:i + 2], ' ')) ELSE [] END) AS g FROM t)
SELECT conv_id, turn, unnest(g) AS token, unnest(range(len(g))) AS pos FROM g""")
def hook_ngrams(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", arrays.ngrams(tokenize.whitespace(F.col("text")), 1, 3).alias("t"))
    return t.select("conv_id", "turn", F.posexplode("t").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@query(f"""WITH tk AS (SELECT doc_id, unnest(t) AS t, unnest(range(len(t))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS t FROM documents)),
n AS (SELECT lower(t) AS l, t, count(*) AS n FROM tk WHERE pos > 0 GROUP BY ALL),
best AS (SELECT l, min(t) AS best FROM (SELECT *, max(n) OVER (PARTITION BY l) AS m FROM n) WHERE n = m GROUP BY l)
SELECT doc_id, pos, coalesce(best, lower(t)) AS token FROM tk LEFT JOIN best ON lower(t) = l""")
def hook_truecase(spark, d):
    t = written(hooked(spark, d), "tokens")
    model = written(hooks.truecase_model(t, "t", "doc_id"), "truecase")
    return hooks.truecase(t, "t", "doc_id", model, "lower").withColumn("pos", F.col("pos").cast("long"))


@query()
def hook_rake_keywords(spark, d):
    return long(hooked(spark, d, hooks.keywords("rake")), "doc_id", "t", "phrase")


@query()
def hook_yake_keywords(spark, d):
    return long(hooked(spark, d, hooks.keywords("yake")), "doc_id", "t", "phrase")


@query()
def hook_porter_stem(spark, d):
    return long(hooked(spark, d, hooks.LOWERCASE, hooks.stem("en")), "doc_id", "t")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '\r', '', 'g'), '\(', ' (', 'g'), '\)', ') ', 'g'), ' +', ' ', 'g'), '\) ([.!:?;,])', ')\1', 'g'), '\( ', '(', 'g'), ' \)', ')', 'g'), '([0-9]) %', '\1%', 'g'), ' ([:;])', '\1', 'g'), '[`´‘’‚]', '''', 'g'), '[“”„«»]|''''', '"', 'g'), '–', '-', 'g'), '—', ' - ', 'g'), '…', '...', 'g'), '\x{a0}', ' ', 'g'), ' +', ' ', 'g'), '"([,.]+)', '\1"', 'g'), 'a^', '', 'g'), ' ') AS t FROM documents""")
def hook_moses_normalize(spark, d):
    return hooked(spark, d, hooks.moses_normalize("en"), tokenizer=None)


@query(f"""{'WITH ' + TK} SELECT doc_id, pos, CASE token WHEN 'the' THEN 'THE' WHEN 'of' THEN 'OF' ELSE token END AS token FROM tk""")
def hook_lemmatize_lookup(spark, d):
    return long(hooked(spark, d, hooks.LOWERCASE, hooks.lemmatize({"the": "THE", "of": "OF"})), "doc_id", "t")


# Vocabularies


@query(f"""WITH {TK}, t AS (SELECT doc_id, token, pos + 1 AS pos FROM tk UNION ALL SELECT doc_id, '<BOS>', 0 FROM low UNION ALL SELECT doc_id, '<EOS>', len(t) + 1 FROM low)
SELECT doc_id, token, CAST(pos AS BIGINT) AS pos FROM t""")
def specials_bos_eos(spark, d):
    return long(tokens(spark, d).select("doc_id", V.with_specials(F.col("tokens"), (V.BOS, V.EOS)).alias("t")), "doc_id", "t")


_SPECIAL_ROWS = "SELECT CAST(0 AS BIGINT) AS idx, '<UNK>' AS token, CAST(0 AS BIGINT) AS freq, 'unk' AS special UNION ALL SELECT 1, '<PAD>', 0, 'pad' UNION ALL"


@query(f"WITH {TK}, {COUNTED} {_SPECIAL_ROWS} SELECT row_number() OVER (ORDER BY freq DESC, first) + 1, token, freq, NULL FROM c")
def vocab_build(spark, d):
    return V.finalize(V.counts(tokens(spark, d), "tokens", "doc_id"))


@query(f"WITH {VOCAB} {_SPECIAL_ROWS} SELECT idx, token, freq, NULL FROM v")
def vocab_min_freq_max_size(spark, d):
    return vocabulary(spark, d)


@query(f"""WITH t AS (SELECT doc_id, list_concat(regexp_extract_all(lower(text), '{WORD}'), [lang], [source]) AS t FROM documents),
tk AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM t), {COUNTED}
SELECT CAST(row_number() OVER (ORDER BY freq DESC, first) - 1 AS BIGINT) AS idx, token, freq FROM c""")
def vocab_shared_fields(spark, d):
    shared = V.Vocab(V.VocabSpec(specials=()))
    fields = {"text": Field("text", hooks=(hooks.LOWERCASE,), vocab=shared), "lang": Field("lang", None, shared), "source": Field("source", None, shared)}
    Schema(fields).finalize(docs(spark, d).select("doc_id", "text", "lang", "source"), row_id="doc_id")
    return shared.table.select("idx", "token", "freq")


@query(f"""WITH {LOW}, tk AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos, CASE lang WHEN 'en' THEN 0 ELSE 1 END AS part FROM low JOIN documents USING (doc_id)),
a AS (SELECT token, part, count(*) AS freq, min(doc_id * 16777216 + pos) AS first FROM tk GROUP BY ALL),
m AS (SELECT token, sum(freq) AS freq, min(part) AS part, arg_min(first, part) AS first FROM a GROUP BY token)
SELECT CAST(row_number() OVER (ORDER BY freq DESC, part, first) + 1 AS BIGINT) AS idx, token, CAST(freq AS BIGINT) AS freq FROM m""")
def vocab_merge(spark, d):
    t = docs(spark, d).select("doc_id", "lang", tokenize.whitespace(F.lower("text")).alias("tokens"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    a, b = (V.Vocab().update(t.filter(x), "tokens", "doc_id") for x in (english, ~english))
    return (a + b).finalize().table.filter("special is null").select("idx", "token", "freq")


@query("SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey)) - 1 AS BIGINT) AS idx, o_orderpriority AS token, count(*) AS freq FROM orders GROUP BY o_orderpriority")
def vocab_label(spark, d):
    schema = Schema({"o_orderpriority": label_field("priority")}).finalize(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), row_id="o_orderkey")
    return schema["priority"].vocab.table.select("idx", "token", "freq")


# Numbers


@query(f"WITH {VOCAB} SELECT doc_id, pos, CAST(coalesce(idx, 0) AS BIGINT) AS id FROM tk LEFT JOIN v USING (token)")
def numericalize_unk(spark, d):
    return long(numbers(spark, d), "doc_id", "ids", "id")


@query(f"WITH {VOCAB} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, idx - 2 AS id FROM tk JOIN v USING (token)")
def numericalize_drop(spark, d):
    v = vocabulary(spark, d, V.VocabSpec(max_size=SIZE - 2, min_freq=MIN_FREQ, specials=()))
    return long(numbers(spark, d, v), "doc_id", "ids", "id")


@query(f"WITH {VOCAB} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, token FROM tk JOIN v USING (token)")
def reverse_numericalize(spark, d):
    v = vocabulary(spark, d)
    return long(V.reverse(numbers(spark, d, v), "ids", v, drop_unk=True), "doc_id", "words")


@query(f"""WITH f AS (SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS t, count(*) AS n FROM lineitem GROUP BY l_orderkey),
tk AS (SELECT l_orderkey AS doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM f), {COUNTED}, v AS (SELECT token, row_number() OVER (ORDER BY freq DESC, first) AS i FROM c)
SELECT l_orderkey, array_to_string(list_transform((SELECT list(token ORDER BY i) FROM v), lambda x: CASE WHEN list_contains(t, x) THEN '1' ELSE '0' END), ' ') AS hot FROM f""")
def multihot_labels(spark, d):
    flags = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_returnflag")).alias("flags"))
    f = MultilabelField("flags", None, V.Vocab(V.VocabSpec(specials=())))
    schema = Schema({"flags": f}).finalize(flags, row_id="l_orderkey")
    return f.numbers(schema.apply(flags, "l_orderkey"), "l_orderkey").select("l_orderkey", joined("flags_ids").alias("hot"))


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS words, upper(array_to_string(string_split(p_name, ' '), '|')) AS loud FROM part")
def multioutput_words(spark, d):
    loud = Field("loud", hooks=(hooks.per_token(hooks.pre(F.upper)),))
    both = MultioutputField((Field("words"), loud))
    out = Schema({"p_name": both}).apply(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return out.select("p_partkey", F.array_join("words", "|").alias("words"), F.array_join("loud", "|").alias("loud"))


@query("SELECT p_partkey, array_to_string(string_split(p_name, ' '), '|') AS words, array_to_string(string_split(p_name, ''), '|') AS chars FROM part")
def fanout_words_chars(spark, d):
    out = Schema({"p_name": (Field("words"), Field("chars", "chars"))}).apply(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey")
    return out.select("p_partkey", F.array_join("words", "|").alias("words"), F.array_join("chars", "|").alias("chars"))


@query("""WITH q AS (SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)),
v AS (SELECT quality, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) - 1 AS i FROM q WHERE quality IS NOT NULL GROUP BY quality)
SELECT doc_id, CAST(coalesce(i, -1) AS BIGINT) AS id FROM q LEFT JOIN v USING (quality)""")
def missing_data_fill(spark, d):
    q = docs(spark, d).select("doc_id").join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("quality")), "doc_id", "left")
    f = label_field("quality", allow_missing_data=True)
    schema = Schema({"quality": f}).finalize(q, row_id="doc_id")
    ids = f.numbers(schema.apply(q, "doc_id"), "doc_id")
    return ids.select("doc_id", F.explode(f.padded(F.col("quality_ids"), 1)).alias("id"))


def _padded(pad_left: bool, truncate_left: bool) -> Query:
    def run(spark, d):
        return numbers(spark, d).select("doc_id", joined(arrays.pad_to(F.col("ids"), 100, F.lit(1).cast("long"), pad_left, truncate_left)).alias("ids"))

    return run


_CUT = "CASE WHEN len(ids) >= 100 THEN ids[{}] ELSE {} END"
_FILL = "list_transform(range(100 - len(ids)), lambda i: CAST(1 AS BIGINT))"
for _name, _left, _cut_left in (("pad_right", False, False), ("pad_left", True, False), ("truncate_left", False, True)):
    _body = _CUT.format("len(ids) - 99:" if _cut_left else "1:100", f"list_concat({_FILL}, ids)" if _left else f"list_concat(ids, {_FILL})")
    query(f"WITH {IDS} SELECT doc_id, array_to_string({_body}, ' ') AS ids FROM ids", _name)(_padded(_left, _cut_left))


# Rows


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 1000")
def filter_rows(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY' and c_acctbal > 1000").select("c_custkey", "c_name", "c_acctbal")


def customers(spark, d) -> Dataset:
    fields = {"c_name": Field("c_name", None), "c_acctbal": Field("c_acctbal", None)}
    return Dataset.read(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), fields, "c_custkey")


@query("SELECT c_name, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) - 1 AS c_custkey FROM customer")
def sort_rows(spark, d):
    return customers(spark, d).sorted("c_acctbal", reverse=True).df


@query("SELECT c_name, c_acctbal, row_number() OVER (ORDER BY md5(concat(CAST(c_custkey AS VARCHAR), '-7')), c_custkey) - 1 AS c_custkey FROM customer")
def shuffle_rows(spark, d):
    return customers(spark, d).shuffled(7).df


@query("""SELECT c_name, c_acctbal, CAST((p - 10) // 3 AS BIGINT) AS c_custkey FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer)
WHERE p >= 10 AND p < n - 5 AND (p - 10) % 3 = 0""")
def slice_rows(spark, d):
    return customers(spark, d)[10:-5:3].df


@query("""SELECT c_name, c_acctbal, w.ord AS c_custkey FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS p, count(*) OVER () AS n FROM customer) c
JOIN (VALUES (CAST(0 AS BIGINT), 5), (1, -1), (2, 5), (3, 0), (4, 77)) AS w(ord, i) ON p = CASE WHEN i < 0 THEN n + i ELSE i END""")
def take_rows(spark, d):
    return customers(spark, d)[[5, -1, 5, 0, 77]].df


@query("""SELECT 0 AS src, text FROM documents UNION ALL SELECT 1, text FROM conversations UNION ALL SELECT 2, text FROM benchmark""")
def concat_common_fields(spark, d):
    return dataset.concat([docs(spark, d), (table(spark, d, "conversations"), {"conv_id": "conv"}), table(spark, d, "benchmark")])


_R = "row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-42')), doc_id) - 1 AS p, count(*) OVER () AS n"


@query(f"SELECT doc_id, CASE WHEN p < CAST(round_even(CAST(0.7 AS DOUBLE) * n, 0) AS BIGINT) THEN 0 ELSE 1 END AS part FROM (SELECT doc_id, {_R} FROM documents)")
def split_random(spark, d):
    return dataset.split_parts(docs(spark, d), "doc_id", 0.7)


@query(f"""SELECT doc_id, CASE WHEN p < CAST(round_even(CAST(0.5 AS DOUBLE) * n, 0) AS BIGINT) THEN 0 WHEN p < n - CAST(round_even(CAST(0.2 AS DOUBLE) * n, 0) AS BIGINT) THEN 1 ELSE 2 END AS part
FROM (SELECT doc_id, {_R} FROM documents)""")
def split_three_way(spark, d):
    return dataset.split_parts(docs(spark, d), "doc_id", (5, 3, 2))


@query("""SELECT doc_id, CASE WHEN p < CAST(round_even(CAST(0.7 AS DOUBLE) * n, 0) AS BIGINT) THEN 0 ELSE 1 END AS part FROM (SELECT doc_id,
  row_number() OVER (PARTITION BY quality ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-42')), doc_id) - 1 AS p, count(*) OVER (PARTITION BY quality) AS n FROM labels)""")
def split_stratified(spark, d):
    return dataset.split_parts(table(spark, d, "labels"), "doc_id", 0.7, strata="quality")


@query("SELECT quality, count(*) AS rows, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM labels GROUP BY quality")
def stratum_shares(spark, d):
    return dataset.stratum_shares(table(spark, d, "labels"), "quality")


# Batches

LEN = f"{LOW}, l AS (SELECT doc_id, len(t) AS n FROM low)"


def lengths(spark, d) -> DataFrame:
    return docs(spark, d).select("doc_id", F.regexp_count("text", F.lit(tokenize.WORD)).cast("long").alias("n"))


@query("SELECT doc_id, CAST((p - 1) // 32 AS BIGINT) AS batch_id, CAST((p - 1) % 32 AS BIGINT) AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents)")
def batch_fixed(spark, d):
    return batching.assign(docs(spark, d), "doc_id", 32)


@query("SELECT doc_id, CAST((p - 1) // 32 AS BIGINT) AS batch_id, CAST((p - 1) % 32 AS BIGINT) AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS VARCHAR), '-1')), doc_id) AS p FROM documents)")
def batch_shuffled(spark, d):
    return batching.assign(docs(spark, d), "doc_id", 32, seed=1)


@query("""SELECT doc_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY n_chars DESC, p) - 1 AS pos
FROM (SELECT doc_id, n_chars, p, CAST((p - 1) // 32 AS BIGINT) AS batch_id FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS p FROM documents))""")
def batch_sorted(spark, d):
    return batching.assign(docs(spark, d), "doc_id", 32, sort_key=-F.col("n_chars"))


def _plain(batch: int) -> str:
    return f"b AS (SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // {batch} AS BIGINT) AS batch_id FROM l)"


def _bucketed(batch: int, ahead: int) -> str:
    return f"""k AS (SELECT doc_id, n, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM l), kk AS (SELECT *, row_number() OVER (PARTITION BY p // {batch * ahead} ORDER BY n, p) - 1 AS q FROM k),
b AS (SELECT doc_id, CAST((p // {batch * ahead}) * {ahead} + q // {batch} AS BIGINT) AS batch_id, CAST(q % {batch} AS BIGINT) AS pos FROM kk)"""


_SHARE = "SELECT CAST(sum(m - n) AS BIGINT) AS padding, CAST(sum(m) AS BIGINT) AS cells, round(sum(m - n) / sum(m), 6) AS share FROM (SELECT n, max(n) OVER (PARTITION BY batch_id) AS m FROM b JOIN l USING (doc_id))"


@query(f"WITH {LEN}, {_bucketed(32, 10)} SELECT * FROM b")
def batch_bucketed(spark, d):
    return batching.assign_buckets(lengths(spark, d), "doc_id", F.col("n"), 32, 10)


@query(f"WITH {LEN}, {_plain(32)} {_SHARE}")
def padding_share_plain(spark, d):
    n = written(lengths(spark, d), "lengths")
    return batching.padding_share(n, batching.assign(n, "doc_id", 32), "doc_id", "n")


@query(f"WITH {LEN}, {_bucketed(32, 100)} {_SHARE}")
def padding_share_bucketed(spark, d):
    n = written(lengths(spark, d), "lengths")
    return batching.padding_share(n, batching.assign_buckets(n, "doc_id", F.col("n"), 32, 100), "doc_id", "n")


@query(f"""WITH {IDS}, l AS (SELECT doc_id, len(ids) AS n FROM ids), {_bucketed(32, 10)},
w AS (SELECT doc_id, batch_id, pos, ids, len(ids) AS text_length, max(greatest(len(ids), 0)) OVER (PARTITION BY batch_id) AS m FROM b JOIN ids USING (doc_id))
SELECT doc_id, batch_id, pos, text_length, array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda i: CAST(1 AS BIGINT))), ' ') AS ids FROM w""")
def batch_padded_lengths(spark, d):
    """The flagship: tokens, vocabulary, numbers, buckets, padded batches with lengths."""
    f = Field("text", hooks=(hooks.LOWERCASE,), vocab=V.Vocab(SPEC), include_lengths=True)
    ds = Dataset.read(docs(spark, d).select("doc_id", "text"), {"text": f}, "doc_id")
    ids = written(f.numbers(ds.df, "doc_id").select("doc_id", "text_ids"), "ids")
    b = batching.assign_buckets(ids, "doc_id", F.size("text_ids"), 32, 10)
    return batching.padded(ids, b, "doc_id", {"text_ids": f}).select("doc_id", "batch_id", "pos", "text_length", joined("text").alias("ids"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_padded_lengths(spark, sf_dir)


# Trees

_TREE = """k AS (SELECT [CAST(r_regionkey AS BIGINT)] AS k FROM region UNION ALL SELECT [n_regionkey, n_nationkey] FROM nation UNION ALL SELECT [n_regionkey, n_nationkey, c_custkey] FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS node_id, len(k) - 1 AS depth FROM k),
t AS (SELECT a.node_id, a.depth, a.k, p.node_id AS parent_id, CASE a.depth WHEN 0 THEN [] WHEN 1 THEN [p.node_id] ELSE [g.node_id, p.node_id] END AS path
  FROM o a LEFT JOIN o p ON a.depth > 0 AND p.k = a.k[1:a.depth] LEFT JOIN o g ON a.depth > 1 AND g.k = a.k[1:1])"""


def forest(spark, d) -> DataFrame:
    return tree.from_levels([(table(spark, d, "region"), "r_regionkey", None), (table(spark, d, "nation"), "n_nationkey", "n_regionkey"), (table(spark, d, "customer"), "c_custkey", "c_nationkey")])


@query(f"WITH {_TREE} SELECT node_id, parent_id, CAST(depth AS INTEGER) AS depth, array_to_string(path, ' ') AS path, k[-1] AS key FROM t")
def tree_flatten(spark, d):
    return forest(spark, d).select("node_id", "parent_id", "depth", joined("path").alias("path"), "key")


@query(f"WITH {_TREE} SELECT CAST(max(depth) AS INTEGER) AS depth FROM t")
def tree_depth(spark, d):
    return forest(spark, d).agg(F.max("depth").alias("depth"))


def _context_sql(up: str) -> str:
    return f"WITH {_TREE}, u AS (SELECT node_id, {up} AS up FROM t WHERE depth > 0) SELECT u.node_id, m.node_id AS ctx_id FROM u JOIN t m ON m.node_id < u.node_id AND (m.node_id = u.up[1] OR list_contains(u.up, m.parent_id))"


@query(_context_sql("path"))
def tree_context(spark, d):
    return tree.context(written(forest(spark, d), "forest"))


@query(_context_sql("path[-1:]"))
def tree_context_level0(spark, d):
    return tree.context(written(forest(spark, d), "forest"), 0)


@query(f"""WITH {_TREE}, c AS (SELECT u.node_id, m.node_id AS ctx_id FROM (SELECT node_id, path[-1:] AS up FROM t WHERE depth > 0) u JOIN t m ON m.node_id < u.node_id AND (m.node_id = u.up[1] OR list_contains(u.up, m.parent_id))),
g AS (SELECT t.node_id, coalesce(list(ctx_id ORDER BY ctx_id) FILTER (ctx_id IS NOT NULL), []) AS ctx FROM t LEFT JOIN c USING (node_id) GROUP BY t.node_id)
SELECT node_id, CAST(node_id // 16 AS BIGINT) AS batch_id, CAST(node_id % 16 AS BIGINT) AS pos, array_to_string(list_append(ctx[-3:], node_id), ' ') AS rows FROM g""")
def batch_hierarchical(spark, d):
    c = written(tree.contexts(written(forest(spark, d), "forest"), 0, 3), "contexts")
    return batching.hierarchical(c, 16, 3).withColumn("rows", joined("rows"))


@query("""SELECT user_id, node_id, CASE WHEN node_id > 0 THEN CAST(0 AS BIGINT) END AS parent_id, CAST(node_id > 0 AS INTEGER) AS depth, event_id FROM
  (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS node_id FROM events)""")
def tree_from_json(spark, d):
    """Each user's events as one JSON document: the first is the root, the others are its children."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("e"))
    node = lambda x: F.struct(x.alias("event_id"))
    doc = F.to_json(F.array(F.struct(F.get("e", 0).alias("event_id"), F.transform(F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))), node).alias("children"))))
    nodes = tree.flatten_json(e.select("user_id", doc.alias("doc")), "doc", row_id="user_id")
    return nodes.select("user_id", "node_id", "parent_id", "depth", F.get_json_object("data", "$.event_id").cast("long").alias("event_id"))


# Sources


@query("""SELECT conv_id, turn, statement, reply FROM (SELECT conv_id, turn, text AS statement, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) WHERE statement <> '' AND reply <> ''""")
def dialog_pairs(spark, d):
    return files.turn_pairs(table(spark, d, "conversations"), "conv_id", "turn", "text")


@query("""SELECT conv_id AS row_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS at, statement, reply FROM (SELECT conv_id, turn, text AS statement, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) WHERE statement <> '' AND reply <> ''""")
def dialog_pairs_by_id(spark, d):
    """Conversations as lists of line ids, which are looked up in the lines."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "text", F.concat_ws("-", "conv_id", "turn").alias("lineID"))
    c = t.groupBy(F.col("conv_id").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "lineID"))), lambda x: x["lineID"]).alias("utteranceIDs"))
    return files.dialog_pairs(c, t)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, d):
    return records.parse(table(spark, d, "events").select("event_id", "props"), "props", "json", schema="k long")


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance FROM customer")
def csv_line_parse(spark, d):
    lines = table(spark, d, "customer").select("c_custkey", F.concat(F.lit('"'), "c_name", F.lit('";'), F.col("c_acctbal").cast("string")).alias("line"))
    return records.parse(lines, "line", "csv", schema="name string, balance double", delimiter=";")


@query("SELECT p_partkey, p_name AS name, p_brand AS brand FROM part")
def xml_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("<part><name>"), "p_name", F.lit("</name><brand>"), "p_brand", F.lit("</brand></part>")).alias("x"))
    return records.parse(p, "x", "xml", names=["name", "brand"])


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def dict_parse(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("x"))
    return records.parse(n, "x", "dict", names=["name", "region"])


@query("SELECT p_partkey, string_split(p_name, ' ')[1] AS first, string_split(p_name, ' ')[3] AS third FROM part")
def list_parse(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("x"))
    return records.parse(p, "x", "list", names=["first", None, "third"])


@query(r"SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))


def _trees(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    w = F.transform(F.split("p_name", " "), lambda x: F.concat(F.lit("(2 "), x, F.lit(")")))
    return p.select("p_partkey", F.concat(F.lit("("), F.pmod("p_size", F.lit(5)).cast("string"), F.lit(" "), F.array_join(w, " "), F.lit(")")).alias("tree"))


_SENT = "['very negative', 'negative', 'neutral', 'positive', 'very positive']"


@query(f"SELECT p_partkey, p_name AS text, {_SENT}[p_size % 5 + 1] AS label FROM part")
def sexpr_tree_parse(spark, d):
    return records.tree_rows(_trees(spark, d), "tree", label_map=files.SENTIMENTS)


@query("""SELECT p_partkey, 0 AS at, p_name AS text, CAST(p_size % 5 AS VARCHAR) AS label FROM part UNION ALL
SELECT p_partkey, CAST(unnest(range(1, len(w) + 1)) AS INTEGER), unnest(w), '2' FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def sexpr_subtrees(spark, d):
    return records.tree_rows(_trees(spark, d), "tree", subtrees=True)


@query("SELECT p_partkey AS row_id, array_to_string(string_split(p_name, ' '), '|') AS form, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x)), '|') AS lemma, len(string_split(p_name, ' ')) AS n FROM part")
def conllu_sentences(spark, d):
    line = lambda x: F.concat_ws("\t", F.lit("1"), x, F.upper(x), *[F.lit("_")] * 3, F.lit("0"), *[F.lit("_")] * 3)
    blocks = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("# text\n"), F.array_join(F.transform(F.split("p_name", " "), line), "\n")).alias("value"))
    return files.conllu_blocks(blocks).select("row_id", F.array_join("form", "|").alias("form"), F.array_join("lemma", "|").alias("lemma"), F.size("head").cast("long").alias("n"))


@query("SELECT doc_id, text, lang FROM documents")
def cache_roundtrip(spark, d):
    path = fresh_path(spark, "cache")
    files.write_cache(docs(spark, d).select("doc_id", "text", "lang"), path, {"fields": ["text", "lang"]})
    return files.read_cache(spark, path)[0]


# Files: written from the driver's tables, and read again


def _folder(spark, name: str) -> str:
    return fresh_path(spark, name)


@query("SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier")
def read_csv(spark, d):
    """With a header; quotes and separators within values."""
    path = _folder(spark, "csv")
    table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat("s_name", F.lit(', "x"')).alias("name"), F.col("s_acctbal").alias("balance")).write.option("escape", '"').csv(path, header=True)
    t = files.tabular(spark, path, schema="id long, name string, balance double")
    return t.select("id", F.regexp_replace("name", ', "x"$', "").alias("name"), "balance")


@query("SELECT conv_id, turn, role, text FROM conversations")
def read_tsv(spark, d):
    """Columns named by place, one of them left out; texts of several lines."""
    path = _folder(spark, "tsv")
    table(spark, d, "conversations").select("conv_id", F.lit("x").alias("none"), "turn", "role", "text").write.option("escape", '"').option("quoteAll", "true").csv(path, sep="\t")
    t = files.tabular(spark, path, "tsv", columns=["conv_id", None, "turn", "role", "text"], schema="a long, b string, c long, d string, e string")
    return t.select("conv_id", "turn", "role", "text")


@query("SELECT doc_id, text, lang, source FROM documents")
def read_json_lines(spark, d):
    path = _folder(spark, "json")
    docs(spark, d).select("doc_id", "text", "lang", "source").write.json(path)
    return files.tabular(spark, path, "json", schema="doc_id long, text string, lang string, source string").select("doc_id", "text", "lang", "source")


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders")
def read_custom_lines(spark, d):
    path = _folder(spark, "lines")
    table(spark, d, "orders").select(F.concat_ws("::", "o_orderkey", "o_orderpriority")).write.text(path)
    parse = lambda df, c: df.select(F.split(c, "::")[0].cast("long").alias("id"), F.split(c, "::")[1].alias("priority"))
    return files.tabular(spark, path, line_parser=parse).select("id", "priority")


@query("SELECT s_name AS text, CASE WHEN s_acctbal >= 0 THEN 'pos' ELSE 'neg' END AS label FROM supplier")
def read_labelled_texts(spark, d):
    """A folder for each label, a file for each text."""
    path = _folder(spark, "texts")
    c = table(spark, d, "supplier").select(F.col("s_name").alias("value"), F.when(F.col("s_acctbal") >= 0, "pos").otherwise("neg").alias("label"))
    for label in ("pos", "neg"):
        own = c.filter(F.col("label") == label).select("value").repartition(4 * spark.sparkContext.defaultParallelism)
        # Files of one row each, as such a corpus has them; tasks put them in their place, not the driver.
        own.write.option("maxRecordsPerFile", "1").option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("lineSep", "\u0001").text(f"{path}/{label}")
    return files.labelled_texts(spark, path).select(F.rtrim("text", F.lit("\u0001")).alias("text"), "label")


@query(f"SELECT p_name AS text, {_SENT}[p_size % 5 + 1] AS label FROM part WHERE p_size % 5 <> 2")
def read_sentiment_trees(spark, d):
    """A tree a line; very positive and very negative become coarse, neutral ones go."""
    path = _folder(spark, "trees")
    _trees(spark, d).select("tree").write.text(path)
    coarse = files.sentiment_trees(spark, path)
    fine = files.sentiment_trees(spark, path, fine_grained=True).filter("label <> 'neutral'")
    j = fine.select("row_id", "text", F.col("label").alias("fine")).join(coarse.select("row_id", "label"), "row_id")
    return j.filter(F.endswith("fine", "label")).select("text", F.col("fine").alias("label"))


@query("""SELECT CASE WHEN turn % 3 = 0 THEN 'neutral' ELSE 'entailment' END AS gold_label, text AS sentence1, role AS sentence2, '( ' || role || ' )' AS parse,
  role AS leaves FROM conversations""")
def read_sentence_pairs(spark, d):
    """JSON lines with parse trees, bare words among them."""
    path = _folder(spark, "pairs")
    t = table(spark, d, "conversations")
    t.select(F.when(F.col("turn") % 3 == 0, "neutral").otherwise("entailment").alias("gold_label"), F.col("text").alias("sentence1"), F.col("role").alias("sentence2"), F.concat(F.lit("( "), "role", F.lit(" )")).alias("sentence1_binary_parse"), F.col("role").alias("sentence2_binary_parse")).write.json(path)
    p = files.sentence_pairs(spark, path, simple=False)
    leaves = F.array_join(records.sequence_leaves(F.col("sentence2_binary_parse")), " ")
    return p.select("gold_label", "sentence1", "sentence2", F.col("sentence1_binary_parse").alias("parse"), leaves.alias("leaves"))


@query("SELECT p_partkey AS row_id, string_split(p_name, ' ')[1] AS first, len(string_split(p_name, ' ')) AS n FROM part")
def read_conllu(spark, d):
    path = _folder(spark, "conllu")
    line = lambda x, i: F.concat_ws("\t", (i + 1).cast("string"), x, F.upper(x), *[F.lit("_")] * 3, F.lit("0"), *[F.lit("_")] * 2, F.concat(F.lit("key="), "k"))
    blocks = table(spark, d, "part").withColumn("k", F.col("p_partkey").cast("string")).select(F.concat(F.lit("# text\n"), F.array_join(F.transform(F.split("p_name", " "), line), "\n")).alias("value"))
    blocks.write.option("lineSep", "\n\n").text(path)
    t = files.conllu(spark, path)
    return t.select(F.element_at(F.col("misc")[0], "key").cast("long").alias("row_id"), F.element_at("form", 1).alias("first"), F.size("id").cast("long").alias("n"))


@query("""SELECT conv_id, statement, reply FROM (SELECT conv_id, turn, text AS statement, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM
  (SELECT conv_id, turn, trim(regexp_replace(text, '[^a-zA-Z0-9 ]+', ' ', 'g'), ' ') AS text FROM conversations)) WHERE statement <> '' AND reply <> ''""")
def read_film_dialogs(spark, d):
    """Lines and conversations in the corpus's own form."""
    path = _folder(spark, "films")
    sep = " +++$+++ "
    text = F.trim(F.regexp_replace("text", "[^a-zA-Z0-9 ]+", " "))
    t = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"), F.concat(F.lit("L"), F.concat_ws("-", "conv_id", "turn")).alias("id"))
    t.select(F.concat_ws(sep, "id", F.lit("u0"), F.lit("m0"), F.lit("SAM"), "text")).coalesce(1).write.text(f"{path}/movie_lines.txt")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda x: F.concat(F.lit("'"), x["id"], F.lit("'")))
    c = t.groupBy("conv_id").agg(F.array_join(ids, ", ").alias("ids"))
    c.select(F.concat_ws(sep, F.lit("u0"), F.lit("u1"), F.concat(F.lit("m"), "conv_id"), F.concat(F.lit("["), "ids", F.lit("]")))).coalesce(1).write.text(f"{path}/movie_conversations.txt")
    talks = files.dialog_table(spark, path, "conversations")
    pairs = files.dialog_pairs(talks, files.dialog_table(spark, path, "lines"))
    return pairs.join(talks.select("row_id", F.substring("movieID", 2, 20).cast("long").alias("conv_id")), "row_id").select("conv_id", "statement", "reply")


@query("SELECT 'w' || vec_id AS token, dim, CAST(embedding[dim + 1] AS DOUBLE) AS value FROM (SELECT *, unnest(range(64)) AS dim FROM embeddings)")
def read_word_vectors(spark, d):
    path = _folder(spark, "vectors")
    _vectors(spark, d).select(F.concat_ws(" ", "token", F.transform("vec", lambda x: x.cast("string")))).write.text(path)
    return long(vectors.load(spark, path), "token", "vec", "value").withColumnRenamed("pos", "dim")


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id % 5 < 4 UNION ALL SELECT doc_id, text, lang FROM documents WHERE doc_id % 5 = 4")
def read_splits(spark, d):
    """Predefined parts from paths of their own."""
    path = _folder(spark, "parts")
    t = docs(spark, d).select("doc_id", "text", "lang")
    t.filter("doc_id % 5 < 4").write.parquet(f"{path}/train")
    t.filter("doc_id % 5 = 4").write.parquet(f"{path}/test")
    parts = files.splits(lambda p: spark.read.schema("doc_id long, text string, lang string").parquet(p), {"train": f"{path}/train", "test": f"{path}/test"})
    return parts["train"].unionByName(parts["test"])


# Vectors and features

def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("token"), F.col("embedding").cast("array<double>").alias("vec"))


_DIM = "unnest(range(64)) AS dim"


@query(f"""SELECT doc_id, dim, coalesce(CAST(embedding[dim + 1] AS DOUBLE), 0.0) AS value FROM (SELECT doc_id, {_DIM} FROM documents) LEFT JOIN embeddings ON vec_id = doc_id""")
def embedding_lookup(spark, d):
    keys = docs(spark, d).select("doc_id", F.concat(F.lit("w"), F.col("doc_id").cast("string")).alias("token"))
    return long(vectors.lookup(keys, "token", _vectors(spark, d)), "doc_id", "vec", "value").withColumnRenamed("pos", "dim")


@query(f"""WITH v AS (SELECT CAST(0 AS BIGINT) AS idx, NULL AS label UNION ALL SELECT row_number() OVER (ORDER BY count(*) DESC, min(vec_id)), label FROM embeddings GROUP BY label)
SELECT idx, dim, coalesce(CAST(embedding[dim + 1] AS DOUBLE), 0.0) AS value FROM (SELECT idx, label AS word, {_DIM} FROM v) LEFT JOIN embeddings ON vec_id = word""")
def embedding_matrix(spark, d):
    """Labels as words, their vectors those of the rows of that number; UNK has the default."""
    e = table(spark, d, "embeddings").select("vec_id", F.array(F.concat(F.lit("w"), F.col("label").cast("string"))).alias("t"))
    v = V.Vocab(V.VocabSpec(specials=(V.UNK,))).update(e, "t", "vec_id").finalize()
    return long(vectors.matrix(v.table, _vectors(spark, d)), "idx", "vec", "value").withColumnRenamed("pos", "dim")


@query(f"WITH {VOCAB} SELECT doc_id, idx - 2 AS col, count(*) AS value FROM tk JOIN v USING (token) GROUP BY ALL")
def count_matrix(spark, d):
    v = vocabulary(spark, d)
    return features.long_form(features.CountVectorizer(v).transform(numbers(spark, d, v), "ids", "doc_id"), "doc_id")


@query(f"""WITH {VOCAB}, s AS (SELECT CAST(1 AS BIGINT) AS idx UNION ALL SELECT idx FROM v WHERE token IN ('the', 'of')),
a AS (SELECT doc_id, CAST(coalesce(idx, 0) AS BIGINT) AS idx FROM tk LEFT JOIN v USING (token))
SELECT doc_id, idx - (SELECT count(*) FROM s WHERE s.idx < a.idx) AS col, count(*) AS value FROM a WHERE idx NOT IN (SELECT idx FROM s) GROUP BY ALL""")
def count_matrix_specials(spark, d):
    v = vocabulary(spark, d)
    return features.long_form(features.CountVectorizer(v, (V.PAD, "the", "of")).transform(numbers(spark, d, v), "ids", "doc_id"), "doc_id")


def _tfidf_sql(tf: str, idf: str, norm: str, fit: str = "true", use: str = "true") -> str:
    div = {"l2": "/ sqrt(sum(w * w) OVER (PARTITION BY doc_id))", "l1": "/ sum(abs(w)) OVER (PARTITION BY doc_id)", "": ""}[norm]
    return f"""WITH {VOCAB}, x AS (SELECT doc_id, idx - 2 AS col, count(*) AS c FROM tk JOIN v USING (token) GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents WHERE {fit}), f AS (SELECT col, count(*) AS df FROM x WHERE {fit} GROUP BY col),
y AS (SELECT doc_id, col, {tf} * {idf} AS w FROM x JOIN f USING (col), n WHERE {use})
SELECT doc_id, col, round(w {div}, 6) AS value FROM y"""


_SMOOTH = "(ln((1.0 + n) / (1.0 + df)) + 1.0)"


def _tfidf(**options) -> Query:
    def run(spark, d):
        v = vocabulary(spark, d)
        n = written(numbers(spark, d, v), "ids")
        return features.long_form(features.TfIdf(v, **options).fit_transform(n, "ids", "doc_id"), "doc_id", "values").withColumn("value", F.round("value", 6))

    return run


query(_tfidf_sql("c", _SMOOTH, "l2"), "tfidf_l2")(_tfidf())
query(_tfidf_sql("(1.0 + ln(c))", _SMOOTH, "l1"), "tfidf_l1_sublinear")(_tfidf(norm="l1", sublinear_tf=True))
query(_tfidf_sql("c", "(ln(CAST(n AS DOUBLE) / df) + 1.0)", "l2"), "tfidf_no_smooth")(_tfidf(smooth_idf=False))
query(_tfidf_sql("c", "1.0", "l2"), "tfidf_no_idf")(_tfidf(use_idf=False))


@query(_tfidf_sql("c", "(ln(CAST(n AS DOUBLE) / df) + 1.0)", "", "lang = 'en'", "lang <> 'en'").replace("SELECT doc_id, idx - 2 AS col, count(*) AS c FROM tk", "SELECT doc_id, lang, idx - 2 AS col, count(*) AS c FROM tk JOIN documents USING (doc_id)"))
def tfidf_fit_transform_split(spark, d):
    """Fitted on English documents, used on the others."""
    v = vocabulary(spark, d)
    n = written(numbers(spark, d, v).join(docs(spark, d).select("doc_id", "lang"), "doc_id"), "ids")
    model = features.TfIdf(v, norm=None, smooth_idf=False).fit(n.filter("lang = 'en'"), "ids", "doc_id")
    return features.long_form(model.transform(n.filter("lang <> 'en'"), "ids", "doc_id"), "doc_id", "values").withColumn("value", F.round("value", 6))


# Experiments


@query("""SELECT doc_id, CAST(CASE WHEN p < (n % 7) * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE n % 7 + (p - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM labels)""")
def kfold_assign(spark, d):
    return experiment.folds(table(spark, d, "labels"), "doc_id", 7)


_C = "x AS (SELECT quality AS y, 1 - toxic AS p FROM labels), k AS (SELECT unnest([0, 1]) AS c), m AS (SELECT c, count(*) FILTER (y = c) AS r, count(*) FILTER (p = c) AS s, count(*) FILTER (y = c AND p = c) AS h FROM k, x GROUP BY c), e AS (SELECT c, r, CASE WHEN s > 0 THEN h / s ELSE 0 END AS p, CASE WHEN r > 0 THEN h / r ELSE 0 END AS q FROM m), f AS (SELECT *, CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END AS f FROM e)"
_ACC = "(SELECT round(avg(CAST(y = p AS INTEGER)), 6) FROM x) AS accuracy"


def _metrics(average: str) -> Query:
    return lambda spark, d: experiment.classification_metrics(table(spark, d, "labels").withColumn("p", 1 - F.col("toxic")), "quality", "p", average)


query(f"WITH {_C} SELECT {_ACC}, round(avg(p), 6) AS precision, round(avg(q), 6) AS recall, round(avg(f), 6) AS fscore FROM f", "metrics_macro")(_metrics("macro"))
query(f"WITH {_C} SELECT {_ACC}, round(sum(p * r) / sum(r), 6) AS precision, round(sum(q * r) / sum(r), 6) AS recall, round(sum(f * r) / sum(r), 6) AS fscore FROM f", "metrics_weighted")(_metrics("weighted"))
query(f"WITH {_C} SELECT {_ACC}, round(sum(p), 6) AS precision, round(sum(q), 6) AS recall, round(sum(f), 6) AS fscore FROM f WHERE c = 1", "metrics_binary")(_metrics("binary"))
query(f"WITH {_C}, z AS (SELECT sum(h) / sum(s) AS v FROM m) SELECT {_ACC}, round(v, 6) AS precision, round(v, 6) AS recall, round(v, 6) AS fscore FROM z", "metrics_micro")(_metrics("micro"))


def _labelled(spark, d) -> DataFrame:
    v = vocabulary(spark, d, V.VocabSpec(max_size=1002, min_freq=MIN_FREQ))
    n = written(numbers(spark, d, v).join(table(spark, d, "labels"), "doc_id"), "ids")
    rows = features.TfIdf(v).fit_transform(n, "ids", "doc_id")
    x = features.to_vectors(rows, "doc_id", v.filter("special is null").count())
    return written(x.join(n.select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id"), "features")


@query()
def svm_tfidf(spark, d):
    """Cross-validated scores of a linear SVM on TF-IDF features."""
    e = experiment.Experiment(experiment.linear_svc(maxIter=10))
    found = experiment.k_fold_classification_metrics(e, _labelled(spark, d), "doc_id", 3, "macro", seed=1)
    return spark.createDataFrame([{k: float(v) for k, v in found.items()}])


@query()
def svm_grid_search(spark, d):
    e = experiment.Experiment(experiment.linear_svc(maxIter=5))
    score = lambda p: experiment.classification_metrics(p, "label", "prediction", "macro").first()["fscore"]
    best, params = experiment.grid_search(e, _labelled(spark, d), "doc_id", {"regParam": [0.01, 0.1]}, 2, score, seed=1)
    return spark.createDataFrame([(float(best), params["regParam"])], "fscore double, regParam double")


# Streaming: an extension


@query("SELECT event_type AS token, count(*) AS freq, min(event_id * 16777216) AS first FROM events GROUP BY event_type")
def stream_vocab_counts(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    path = fresh_path(spark, "stream")
    q = vocab_stream.to_table(stream.select("event_id", F.array("event_type").alias("t")), "t", "event_id", f"{path}/parts", f"{path}/state")
    q.awaitTermination()
    return vocab_stream.freqs(spark.read.parquet(f"{path}/parts"))
