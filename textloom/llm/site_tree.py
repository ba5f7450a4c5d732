"""Extraction of main text with a style tree for each site.

The DOMs of a host's pages are merged: elements at the same place, under the
same styles, are one node. A style is the sequence of an element's children;
neighbours with the same label (tag and class) are one child. Importance is
by entropy, as in Yi, Liu and Li (2003): a presentation node is important if
its pages use many styles, a leaf if its contents differ from page to page;
an inner node also has its part of the importance of what is below it. A
branch is noise if none of its nodes reaches the threshold; noise is cut out
of every page, and the rest is the page's text.

The merged trees are aggregates (a row for each node and style or content);
no host's pages are brought together, so a host with most of the pages is no
hot spot. Of a host's noise only the tops of the branches are kept; where they
are too many to be broadcast, pages are joined with them by host, a join in
which Spark splits hosts of many pages.

Defined results: one row for each row of pages. A host is the URL's, in lower
case, without user and port. Pages without a host, and hosts of fewer than
MIN_PAGES different pages, are left whole. Pages of a host with the same HTML
count once, so copies don't make content look like boilerplate. Null and
empty HTML has an empty text. Broken HTML is read as browsers roughly do: end
tags without start are ignored, open paragraphs and list items end where the
next begins. Scripts, styles, comments and the head aren't text. Other
columns are ignored.
"""

from __future__ import annotations

import html as htmllib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import maybe_broadcast, split_possible, written

THRESHOLD, GAMMA, MIN_PAGES = 0.3, 0.9, 3

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
_CLASS = re.compile(r"\bclass\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
#: What a start tag ends, up to what stops it.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SPACE = re.compile(r"\s+")
_HEAD = re.compile(r"<head\b.*?(?:</head\s*>|(?=<body\b)|\Z)", re.S | re.I)


class Node:
    __slots__ = ("label", "kids", "text")

    def __init__(self, label: str, text: str | None = None):
        self.label, self.text, self.kids = label, text, []


def parse(page: str | None) -> Node:
    """The tree of a page's body; leaves with a text have the label #text."""
    root = Node("#page")
    if not page:
        return root
    page = _HEAD.sub("", page, count=1)
    stack: list[tuple[str, Node]] = [("#page", root)]
    for m in _TOKEN.finditer(page):
        text = m.group(5)
        if text is not None:
            text = _SPACE.sub(" ", htmllib.unescape(text)).strip()
            if text:
                stack[-1][1].kids.append(Node("#text", text))
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in ("html", "body"):
            continue
        if tag in _BLOCK:
            ends, stop = _ENDS.get(tag, ({"p"}, {"table", "td", "li", "div", "article", "section", "body"}))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in ends:
                    del stack[i:]
                    break
                if stack[i][0] in stop:
                    break
        attrs = m.group(4)
        label = tag
        if attrs and (c := _CLASS.search(attrs)):
            label += "." + ".".join(sorted(c.group(1).strip("\"'").split()))
        node = Node(label)
        stack[-1][1].kids.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            stack.append((tag, node))
    return root


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def places(root: Node) -> Iterator[tuple[Node, int, int, int, int, int]]:
    """Each node with its place's id, its parent's place and style, its own style, and its depth."""
    todo = [(root, _hash("#page"), 0, 0, 0)]
    while todo:
        node, place, parent, above, depth = todo.pop()
        runs: list[str] = []
        nth = []
        for k in node.kids:
            if not runs or runs[-1] != k.label:
                runs.append(k.label)
            nth.append(len(runs) - 1)
        style = _hash("|".join(runs)) if runs else 0
        yield node, place, parent, above, style, depth
        for k, i in zip(node.kids, nth):
            todo.append((k, _hash(f"{place}/{style}/{i}/{k.label}"), place, style, depth + 1))


STYLE, CONTENT, PAGE = 0, 1, 2


def page_facts(root: Node) -> set[tuple[int, int, int, int, int, int]]:
    """(place, kind, key, parent, parent's style, depth) of a page, each once."""
    out = set()
    for node, place, parent, above, style, depth in places(root):
        out.add((place, PAGE, 0, parent, above, depth))
        if node.kids:
            out.add((place, STYLE, style, parent, above, depth))
        else:
            # An element without children has itself as its content.
            out.add((place, CONTENT, _hash(node.text or node.label), parent, above, depth))
    return out


def importances(rows: pd.DataFrame, gamma: float) -> tuple[dict[int, float], dict[int, int]]:
    """Importance and parent of each place. rows: place, kind, key, parent, above, depth, n, and for contents logs and kinds."""
    pages, parent, depth_of, above_of = {}, {}, {}, {}
    styles: dict[int, list[tuple[int, float]]] = defaultdict(list)
    contents: dict[int, tuple[float, float]] = {}
    for r in rows.itertuples(index=False):
        parent[r.place], above_of[r.place], depth_of[r.place] = r.parent, r.above, r.depth
        if r.kind == PAGE:
            pages[r.place] = r.n
        elif r.kind == STYLE:
            styles[r.place].append((r.key, float(r.n)))
        else:
            contents[r.place] = (r.logs, r.kinds)
    below: dict[tuple[int, int], list[float]] = defaultdict(list)
    out: dict[int, float] = {}
    for place in sorted(depth_of, key=lambda x: -depth_of[x]):
        m = pages.get(place, 1)
        parts: list[tuple[float, float]] = []  # weight, importance
        if own := styles.get(place):
            total = sum(n for _, n in own)
            node = 1.0 if m <= 1 else min(1.0, -sum(n / total * math.log(n / total) for _, n in own) / math.log(m))
            share = gamma ** len(own)
            lower = sum(n / total * float(np.mean(below[place, s] or [node])) for s, n in own)
            parts.append((total, (1 - share) * node + share * lower))
        if place in contents:
            logs, kinds = contents[place]
            parts.append((max(1.0, float(m) - sum(n for _, n in own or [])), 1.0 if m <= 1 else 1.0 - logs / kinds / math.log(m)))
        total = sum(wt for wt, _ in parts)
        out[place] = sum(wt * x for wt, x in parts) / total if total else 1.0
        below[parent[place], above_of[place]].append(out[place])
    return out, parent


def noisy(importance: dict[int, float], parent: dict[int, int], threshold: float) -> set[int]:
    """Places under the threshold with all that is below them; only the topmost, at which a page's branches are cut."""
    alive = set()
    for place, x in importance.items():
        if x >= threshold:
            while place in importance and place not in alive:
                alive.add(place)
                place = parent[place]
    return {p for p in importance if p not in alive and (parent[p] in alive or parent[p] not in importance)}


def text_of(root: Node, noise: set[int] | frozenset[int]) -> str:
    """Texts outside of noise, with a new line at each block."""
    lines: list[str] = []
    line: list[str] = []

    def end() -> None:
        if line:
            lines.append(" ".join(line))
            line.clear()

    # Depth first, with block ends as their own entries.
    todo: list = [(root, _hash("#page"))]
    while todo:
        node, place = todo.pop()
        if node is None:
            end()
            continue
        if place in noise:
            continue
        if node.text is not None:
            line.append(node.text)
            continue
        tag = node.label.split(".", 1)[0]
        block = tag in _BLOCK or tag == "br"
        if block:
            end()
            todo.append((None, 0))
        runs: list[str] = []
        nth = []
        for k in node.kids:
            if not runs or runs[-1] != k.label:
                runs.append(k.label)
            nth.append(len(runs) - 1)
        style = _hash("|".join(runs)) if runs else 0
        for k, i in zip(reversed(node.kids), reversed(nth)):
            todo.append((k, _hash(f"{place}/{style}/{i}/{k.label}")))
    end()
    return "\n".join(lines)


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("place", "kind", "key", "parent", "above", "depth", "n"))])

    def out(counts: Counter) -> pa.RecordBatch:
        cols = zip(*((h, *f, n) for (h, f), n in counts.items()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    counts: Counter = Counter()
    for b in batches:
        for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
            counts.update((host, f) for f in page_facts(parse(page)))
            if len(counts) > 1 << 17:
                yield out(counts)
                counts = Counter()
    if counts:
        yield out(counts)


def _noise_of_host(threshold: float, gamma: float, min_pages: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        pages = int(rows.loc[(rows.kind == PAGE) & (rows.depth == 0), "n"].max())
        found = set() if pages < min_pages else noisy(*importances(rows, gamma), threshold)
        return pd.DataFrame({"host": rows.host.iloc[:1], "noise": [np.array(sorted(found), np.int64).tobytes()]})

    return run


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, frozenset[int]] = {}
    for b in batches:
        texts = []
        for page, blob in zip(b.column("html"), b.column("noise")):
            blob = blob.as_py() or b""
            if blob not in known:
                if len(known) > 256:
                    known.clear()
                known[blob] = frozenset(np.frombuffer(blob, np.int64).tolist())
            texts.append(text_of(parse(page.as_py()), known[blob]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), pa.array(texts, pa.string())], names=["page_id", "host", "text"])


def host_of(url):
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def extract(pages: DataFrame, threshold: float = THRESHOLD, gamma: float = GAMMA, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, text: one row for each page."""
    src = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), "html")
    known = src.filter("host is not null and html is not null").withColumn("xx", F.xxhash64("html"))
    # Of copies one counts; only pages that may have some are shuffled.
    repeated = written(known.groupBy("host", "xx").count().filter("count > 1").select("host", "xx"), "repeated")
    again, alone = split_possible(known.select("host", "xx", "html"), repeated, ["host", "xx"])
    counted = alone.select("host", "html").unionByName(again.groupBy("host", "xx").agg(F.any_value("html").alias("html")).select("host", "html"))
    facts = counted.mapInArrow(_collect, "host string, place long, kind long, key long, parent long, above long, depth long, n long")
    facts = facts.groupBy("host", "place", "kind", "key", "parent", "above", "depth").agg(F.sum("n").alias("n"))
    # Contents come down to what their entropy needs.
    content = F.col("kind") == CONTENT
    short = facts.groupBy("host", "place", "kind", F.when(~content, F.col("key")).alias("key"), "parent", "above", "depth").agg(
        F.sum("n").alias("n"), F.sum(F.when(content, F.log("n")).otherwise(0.0)).alias("logs"), F.count("*").cast("double").alias("kinds")
    )
    noise = written(short.fillna({"key": 0}).groupBy("host").applyInPandas(_noise_of_host(threshold, gamma, min_pages), "host string, noise binary"), "noise")
    size = noise.agg(F.coalesce(F.sum(F.octet_length("noise")), F.lit(0)), F.count("*")).first()
    noise = maybe_broadcast(noise, 64 + size[0] // max(1, size[1]), size[1])
    return src.join(noise, "host", "left").select("page_id", "host", "html", "noise").mapInArrow(_extract, "page_id long, host string, text string")
