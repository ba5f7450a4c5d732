"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; the model is a lookup table by bin for each
feature, and one by pair of bins for a few pairs. The tables are learned by
cyclic boosting: in each round every feature in turn gets a shallow tree on
its bins, fitted to the residuals and added at a small rate. Pairs are chosen
by how much a cut in both features still explains, and boosted in the same
way. Scores are sums of table entries, looked up for whole batches.

There are two heads on the same features: quality and toxicity. Toxic words
are learned as well: those that are much more frequent in toxic rows.

The model is fitted on at most `most_labels` labelled documents, those with
the smallest md5 of their ids; the bound is a parameter and documented in the
README. Scoring is over all documents.

Defined results: null texts count as empty. Null labels, and labels with a
null id, aren't used; of repeated labels of an id the greatest counts, of
several texts of an id the smallest is fitted.
Repeated rows give repeated scores. Without labels of both kinds a head gives
the share of 1s (0.5 without labels; 0 for toxicity), whatever the text.
Documents are kept if quality is at least MIN_QUALITY and toxicity under
MAX_TOXIC; a head without labels of both kinds rejects nothing. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import written

MOST_LABELS, MIN_QUALITY, MAX_TOXIC = 20_000, 0.4, 0.6
LEXICON_DF = 4
FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "bar", "mark", "newline", "distinct", "repeats", "copied_lines", "common", "toxic_share", "toxic_kinds",
)
COMMON = frozenset(
    "the of and to a in is that for it as was with on are this by at from or der die und den von zu das mit sich des auf ist im dem nicht ein eine de la le et les en un du une que est dans qui par pour au sur el los se las por con no su al".split()
)
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b"#$%&*+<=>@[]^_`{}~\\/")] = 3
_CLASS[ord("|")] = 4
_CLASS[list(b".,;:!?'\"()-")] = 5
_CLASS[ord("\n")] = 6
_WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None, lexicon: frozenset[str]) -> tuple[float, ...]:
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = max(1, len(raw))
    c = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=7)
    words = _WORDS.findall(text.lower())
    k = max(1, len(words))
    kinds = set(words)
    lines = text.split("\n")
    hits = kinds & lexicon
    return (
        float(np.log1p(len(words))),
        sum(map(len, words)) / k,
        c[1] / n, c[2] / n, c[3] / n, c[4] / n, c[5] / n, c[6] / n,
        len(kinds) / k**0.8,
        sum(map(str.__eq__, words, words[1:])) / k,
        1 - len(set(lines)) / len(lines),
        sum(map(COMMON.__contains__, words)) / k,
        (sum(map(hits.__contains__, words)) / k) if hits else 0.0,
        float(len(hits)),
    )


@dataclass
class Head:
    """Tables of one label."""

    base: float = 0.0
    constant: bool = True
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.full(len(x), self.base)
        if not self.constant:
            for k, t in enumerate(self.tables):
                s += t[np.searchsorted(self.edges[k], x[:, k], side="right")]
            for i, j, t in self.pairs:
                s += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-s))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray, lam: float) -> np.ndarray:
    return g * g / (h + lam)


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, lam: float) -> np.ndarray:
    """Values by bin of a tree with a few leaves, each a run of bins; g, h: sums by bin."""
    runs = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for q, (a, b) in enumerate(runs):
            if b - a > 1:
                c = np.arange(a + 1, b)
                x = _gain(cg[c] - cg[a], ch[c] - ch[a], lam) + _gain(cg[b] - cg[c], ch[b] - ch[c], lam) - _gain(cg[b] - cg[a], ch[b] - ch[a], lam)
                m = int(x.argmax())
                if x[m] > best[0]:
                    best = (x[m], q, int(c[m]))
        if best[1] is None:
            break
        a, b = runs[best[1]]
        runs[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.empty(len(g))
    for a, b in runs:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + lam)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, lam: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut in both directions; g, h: sums by pair of bins."""
    G, H = np.zeros(np.add(g.shape, 1)), np.zeros(np.add(h.shape, 1))
    G[1:, 1:], H[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = -1.0, None
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            q = [(G[i, j], H[i, j]), (G[i, -1] - G[i, j], H[i, -1] - H[i, j]), (G[-1, j] - G[i, j], H[-1, j] - H[i, j])]
            q.append((G[-1, -1] - sum(x for x, _ in q), H[-1, -1] - sum(x for _, x in q)))
            gain = sum(a * a / (b + lam) for a, b in q)
            if gain > best:
                best, at = gain, (i, j, [a / (b + lam) for a, b in q])
    out = np.zeros(g.shape)
    if at:
        i, j, v = at
        out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, bins: int = 32, n_pairs: int = 4, pair_bins: int = 6, pair_rounds: int = 40, lam: float = 1.0, empty: float = 0.5) -> Head:
    """Cyclic boosting of one head."""
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else empty
        p = min(max(p, 1e-6), 1 - 1e-6)
        return Head(base=float(np.log(p / (1 - p))))
    p = float(y.mean())
    head = Head(base=float(np.log(p / (1 - p))), constant=False)
    k = x.shape[1]
    head.edges = [_cuts(x[:, q], bins) for q in range(k)]
    head.coarse = [_cuts(x[:, q], pair_bins) for q in range(k)]
    at = [np.searchsorted(head.edges[q], x[:, q], side="right") for q in range(k)]
    low = [np.searchsorted(head.coarse[q], x[:, q], side="right") for q in range(k)]
    head.tables = [np.zeros(len(e) + 1) for e in head.edges]
    s = np.full(len(y), head.base)
    for _ in range(rounds):
        for q in range(k):
            if len(head.tables[q]) > 1:
                pr = 1 / (1 + np.exp(-s))
                n = len(head.tables[q])
                step = rate * shallow_tree(np.bincount(at[q], y - pr, n), np.bincount(at[q], pr * (1 - pr), n), 3, lam)
                head.tables[q] += step
                s += step[at[q]]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(head.coarse[i]) + 1, len(head.coarse[j]) + 1)
        cell = low[i] * shape[1] + low[j]
        pr = 1 / (1 + np.exp(-s))
        return np.bincount(cell, y - pr, shape[0] * shape[1]).reshape(shape), np.bincount(cell, pr * (1 - pr), shape[0] * shape[1]).reshape(shape)

    able = [q for q in range(k) if len(head.coarse[q])]
    ranked = sorted(((_pair_tree(*sums(i, j), lam)[0], i, j) for i in able for j in able if i < j), reverse=True)
    head.pairs = [(i, j, np.zeros((len(head.coarse[i]) + 1, len(head.coarse[j]) + 1))) for _, i, j in ranked[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, t in head.pairs:
            step = rate * _pair_tree(*sums(i, j), lam)[1]
            t += step
            s += step[low[i], low[j]]
    return head


def _feature_rows(lexicon: frozenset[str], extra: list[str]):
    schema = pa.schema([*((c, pa.float64()) for c in extra), *((f, pa.float64()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, lexicon) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(c).cast(pa.float64()) for c in extra), *map(pa.array, x.T)], schema=schema)

    return run


def labelled(docs: DataFrame, labels: DataFrame, most_labels: int) -> DataFrame:
    """text, quality and toxic of the labelled documents that the model is fitted on; a written table."""
    own = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = own.filter("quality is not null or toxic is not null").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most_labels)
    # The sample has a fixed bound, so it can always be broadcast. Of several texts of an id the smallest counts.
    found = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    return written(found.select("text", "quality", "toxic"), "labelled")


def toxic_words(sample: DataFrame, least: int = LEXICON_DF) -> frozenset[str]:
    """Words whose documents are much more often toxic than others."""
    rows = sample.filter("toxic is not null")
    n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    if not n["pos"]:
        return frozenset()
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).filter("w <> ''")
    odds = F.log((F.col("pos") + 0.5) / (n["pos"] + 1.0)) - F.log((F.col("df") - F.col("pos") + 0.5) / (n["n"] - n["pos"] + 1.0))
    least = max(least, n["pos"] // 100)
    found = words.groupBy("w").agg(F.sum("toxic").alias("pos"), F.count("*").alias("df")).filter(F.col("pos") >= least)
    return frozenset(r["w"] for r in found.withColumn("odds", odds).filter("odds > 1.5").collect())


def train(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> tuple[frozenset[str], Head, Head]:
    sample = labelled(docs, labels, most_labels)
    lexicon = toxic_words(sample)
    ddl = ", ".join(f"{c} double" for c in ("quality", "toxic", *FEATURES))
    rows = sample.mapInArrow(_feature_rows(lexicon, ["quality", "toxic"]), ddl).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    heads = []
    for label, empty in (("quality", 0.5), ("toxic", 0.0)):
        own = rows[rows[label].notna()]
        heads.append(fit(own[list(FEATURES)].to_numpy(), (own[label].to_numpy() > 0).astype(float), empty=empty))
    return lexicon, *heads


def classify(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC) -> DataFrame:
    """doc_id, quality_score, toxic_score, keep: one row for each document."""
    lexicon, quality, toxic = train(docs, labels, most_labels)
    schema = pa.schema([("doc_id", pa.int64()), ("quality_score", pa.float64()), ("toxic_score", pa.float64()), ("keep", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t, lexicon) for t in b.column("text").to_pylist()]).reshape(b.num_rows, len(FEATURES))
            q, t = quality.score(x), toxic.score(x)
            keep = ((q >= min_quality) | quality.constant) & ((t < max_toxic) | toxic.constant)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(q), pa.array(t), pa.array(keep)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, quality_score double, toxic_score double, keep boolean")
