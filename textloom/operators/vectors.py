"""Word vectors: tables (token, vec), lookups and matrices in a vocabulary's order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.storage import if_small

Default = Callable[[Column, int], Column]


def zeros(token: Column, dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def random_normal(seed: int = 1) -> Default:
    """Values of a standard normal distribution that depend on the token and the seed alone (Box and Muller)."""

    def make(token: Column, dim: int) -> Column:
        def value(i: Column) -> Column:
            u = [(F.pmod(F.xxhash64(token, i, F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1) for k in (0, 1)]
            return F.sqrt(F.lit(-2.0) * F.log(u[0])) * F.cos(F.lit(2 * 3.141592653589793) * u[1])

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), value)

    return make


def load(spark: SparkSession, path: str, max_vectors: int | None = None, encoding: str = "UTF-8", checked: bool = True) -> DataFrame:
    """token, vec of a text file of lines `token v1 ... vd`; a first line of two numbers is skipped.

    An empty line and vectors of different lengths are errors. max_vectors keeps the first ones of the file.
    """
    reader = spark.read
    if encoding.upper() == "UTF-8":
        lines = reader.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    else:
        lines = reader.option("encoding", encoding).option("sep", "\u0001").option("quote", "").schema("value string").option("ignoreLeadingWhiteSpace", "false").csv(path).select("value", F.monotonically_increasing_id().alias("at"))
    parts = F.split(F.rtrim("value"), " ")
    # In files of several parts only the first line of the first is a header.
    rows = lines.select("at", F.element_at(parts, 1).alias("token"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("raw"), "value")
    rows = rows.filter(~((F.col("at") == 0) & (F.size("raw") == 1)))
    if max_vectors is not None:
        rows = rows.orderBy("at").limit(max_vectors)
    if checked:
        facts = rows.agg(F.min(F.size("raw")).alias("least"), F.max(F.size("raw")).alias("most"), F.max((F.trim("value") == "").cast("int")).alias("blank")).first()
        if facts["blank"]:
            raise ValueError("the file has an empty line")
        if facts["least"] is not None and (facts["least"] != facts["most"] or facts["least"] < 1):
            raise ValueError(f"vectors have {facts['least']} to {facts['most']} values")
    return rows.select("token", F.transform("raw", lambda x: x.cast("double")).alias("vec"))


def glove(spark: SparkSession, folder: str, name: str = "glove-wikipedia", dim: int = 300, **options) -> DataFrame:
    """A set of GloVe's published files from a local folder."""
    files = {"glove-wikipedia": ("glove.6B", (50, 100, 200, 300)), "glove-twitter": ("glove.twitter.27B", (25, 50, 100, 200)), "glove-common-crawl-small": ("glove.42B", (300,)), "glove-common-crawl-large": ("glove.840B", (300,))}
    if name not in files:
        raise ValueError(f"known: {', '.join(files)}")
    stem, dims = files[name]
    if dim not in dims:
        raise ValueError(f"{name} has vectors of {dims}")
    return load(spark, f"{folder}/{stem}.{dim}d.txt", **options)


def nlpl(spark: SparkSession, path: str, **options) -> DataFrame:
    """A text model as the NLPL repository has them (ISO-8859-1)."""
    return load(spark, path, encoding="ISO-8859-1", **options)


def dimension(vectors: DataFrame) -> int:
    row = vectors.select(F.size("vec")).first()
    if row is None:
        raise ValueError("there are no vectors")
    return row[0]


def for_vocab(vectors: DataFrame, vocab: DataFrame) -> DataFrame:
    """The vectors of a vocabulary's words."""
    return vectors.join(vocab.filter("special is null").select("token").distinct(), "token", "left_semi")


def lookup(df: DataFrame, token: str, vectors: DataFrame, default: Default | None = zeros, dim: int | None = None, out: str = "vec") -> DataFrame:
    """df with each token's vector, or the default's; with default None others are an error."""
    dim = dim or dimension(vectors)
    if default is None:
        other = F.raise_error(F.concat(F.lit("no vector for "), F.coalesce(F.col(token), F.lit("null")))).cast("array<double>")
    else:
        other = default(F.col(token), dim)
    v = vectors.select(F.col("token").alias("__t"), F.col("vec").alias("__v"))
    return df.join(if_small(v, 64 + 8 * dim), F.col(token) == F.col("__t"), "left").withColumn(out, F.coalesce("__v", other)).drop("__t", "__v")


def matrix(vocab: DataFrame, vectors: DataFrame, default: Default | None = zeros, dim: int | None = None) -> DataFrame:
    """idx, vec: one row for each of the vocabulary's, specials too; ids are the row numbers."""
    return lookup(vocab.select("idx", "token"), "token", vectors, default, dim).select("idx", "vec")


def save(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("errorifexists").parquet(path)

