"""Bounded-space online packing of documents into windows of fixed capacity.

Documents are spread over logical shards by a hash of their id, so that the
result doesn't depend on how the input files were cut. Within a shard they
come in the order of their ids. A fixed number of windows is open at a time: a
piece goes into the open window that it fills best; if it fits in none and no
further window may be opened, the fullest is emitted. What is still open at
the end of a shard is merged with the other shards' leftovers by the same
rule, in a tree of groups of shards, until one group is left.

Defined results: the length of a document is its number of words (runs
without white space) plus one for a separator. Null, empty and blank texts
have no words and aren't packed. A document longer than a window is cut: its
full pieces are windows of their own, the rest is packed as usual. Repeated
rows are packed as often as they come. A null doc_id is kept as null. Ties
between open windows go to the one opened first. Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import n_words, written

CAPACITY, OPEN_WINDOWS, ROWS_PER_SHARD, FAN_IN = 2048, 32, 8192, 64

_COLS = ["shard", "seq", "open", "at", "doc_id", "piece", "start", "length"]
_ARROW = pa.schema(
    [("shard", pa.int64()), ("seq", pa.int64()), ("open", pa.bool_()), ("at", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]
)
_DDL = "shard long, seq long, open boolean, at long, doc_id long, piece long, start long, length long"


class Packer:
    """Open windows of one shard. An item is (length, pieces); a piece is (doc_id, piece, start, length)."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.seq = 0
        self.room: list[tuple[int, int]] = []  # (room left, seq), sorted
        self.pieces: dict[int, list[tuple]] = {}

    def new_seq(self) -> int:
        self.seq += 1
        return self.seq - 1

    def add(self, length: int, pieces: list[tuple]) -> tuple[int, list[tuple]] | None:
        """Place an item; returns a window that had to be emitted."""
        i = bisect.bisect_left(self.room, (length, -1))
        out = None
        if i < len(self.room):
            left, seq = self.room.pop(i)
        else:
            if len(self.room) >= self.most_open:
                _, full = self.room.pop(0)
                out = (full, self.pieces.pop(full))
            left, seq = self.capacity, self.new_seq()
            self.pieces[seq] = []
        self.pieces[seq].extend(pieces)
        bisect.insort(self.room, (left - length, seq))
        return out

    def leftovers(self) -> Iterator[tuple[int, list[tuple]]]:
        for seq in sorted(self.pieces):
            yield seq, self.pieces[seq]


def rows_of(shard: int, seq: int, is_open: bool, pieces: Iterable[tuple]) -> Iterator[tuple]:
    at = 0
    for doc, piece, start, length in pieces:
        yield shard, seq, is_open, at, doc, piece, start, length
        at += length


def pack_shard(shard: int, docs: Iterable[tuple[int | None, int]], capacity: int, most_open: int) -> Iterator[tuple]:
    """Rows of one shard; docs: (doc_id, length) in order."""
    p = Packer(capacity, most_open)
    for doc, length in docs:
        piece = start = 0
        while length - start > capacity:
            yield from rows_of(shard, p.new_seq(), False, [(doc, piece, start, capacity)])
            piece, start = piece + 1, start + capacity
        if done := p.add(length - start, [(doc, piece, start, length - start)]):
            yield from rows_of(shard, done[0], False, done[1])
    for seq, pieces in p.leftovers():
        yield from rows_of(shard, seq, True, pieces)


def _batched(rows: Iterable[tuple], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def pack(
    docs: DataFrame, capacity: int = CAPACITY, most_open: int = OPEN_WINDOWS, rows_per_shard: int = ROWS_PER_SHARD, fan_in: int = FAN_IN
) -> DataFrame:
    """Columns: window_id, at (offset in the window), doc_id, piece, start (word offset in the document), length."""
    from itertools import groupby

    shards = max(1, -(-docs.count() // rows_per_shard))
    narrow = docs.select(
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(shards)).cast("long").alias("shard"),
        F.col("doc_id").cast("long").alias("doc_id"),
        (n_words(F.col("text")) + 1).alias("length"),
    ).filter("length > 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for shard, own in groupby(_runs(batches), key=lambda r: r[0]):
                yield from pack_shard(shard, ((d, n) for _, d, n in own), capacity, most_open)

        yield from _batched(rows())

    placed = written(
        narrow.repartition("shard").sortWithinPartitions("shard", "doc_id", "length").mapInArrow(run, _DDL),
        "pack",
    )
    done = [placed.filter("not open")]
    left = placed.filter("open")
    base, level = shards, shards
    while True:
        groups = max(1, -(-level // fan_in))
        left = written(_merge(left, base - level, base, fan_in, capacity, most_open, groups == 1), "pack")
        done.append(left.filter("not open"))
        base, level = base + groups, groups
        if groups == 1:
            break
        left = left.filter("open")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select((F.col("shard") * (1 << 32) + F.col("seq")).alias("window_id"), "at", "doc_id", "piece", "start", "length")


def merge_group(shard: int, rows: Iterable[tuple], capacity: int, most_open: int, last: bool) -> Iterator[tuple]:
    """Rows of one group; rows: as in _COLS, sorted by shard, seq and at."""
    from itertools import groupby

    p = Packer(capacity, most_open)
    for _, own in groupby(rows, key=lambda r: (r[0], r[1])):
        pieces = [r[4:8] for r in own]
        if done := p.add(sum(x[3] for x in pieces), pieces):
            yield from rows_of(shard, done[0], False, done[1])
    for seq, pieces in p.leftovers():
        yield from rows_of(shard, seq, not last, pieces)


def _merge(left: DataFrame, low: int, base: int, fan_in: int, capacity: int, most_open: int, last: bool) -> DataFrame:
    from itertools import groupby

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g, own in groupby(_runs(batches), key=lambda r: r[8]):
                yield from merge_group(base + g, own, capacity, most_open, last)

        yield from _batched(rows())

    group = F.floor((F.col("shard") - low) / fan_in).cast("long").alias("g")
    return left.select(*_COLS, group).repartition("g").sortWithinPartitions("g", "shard", "seq", "at").mapInArrow(run, _DDL)
