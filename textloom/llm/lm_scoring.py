"""Language-model scores by online logistic context mixing.

Texts are coded bit by bit. Predictors give the log-odds of the next bit: two
learn from the text itself, by the last unit and by a hash of the last three;
one has the whole corpus's counts after the last two, without those of the
text itself; one follows a place of another document that has the same bytes
just before. They are combined by weights, of which the bit's place in its
unit and the state of the match choose a set.
The result is refined by an adaptive logistic map. Weights, tables and map
learn from every bit of the text, UNITS units at a time. The score is the sum
of the bits' code lengths, over the bytes of the text.

A unit has 5 bits: one for each of the 31 most usual bytes, and three for any
other byte (a mark and its two halves). Many texts are coded side by side in
lanes, from their first unit to their last: numpy does as many units of all
lanes at a time. A lane whose text has ended goes on with another. The hashed table of a text has as many slots as the
text has units, at least.

What is gathered from the corpus: counts of units by the two before, of all
documents, added up by tasks; and anchors, the places of texts where a hash of
the last WINDOW bytes ends in zeros (one in 64, whatever the text around it).
Each is sent with its document and the bytes up to the document's next anchor.
Anchors that several documents have are joined: a document gets the bytes that
follow in another one. Both grow with the corpus; nothing of it that grows is
broadcast or sent to the driver.

Defined results: null and empty texts have 0 bits and no bits per byte. Rows
are scored one by one, so repeated rows give repeated scores; rows of one id
and text are one document, which doesn't predict itself. Scores don't depend
on which rows are neighbours. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import mix64, partly_joined, text_buffers, matching, written
from textloom.llm.shingles import power_sums

#: The bytes of one unit each.
USUAL = b" etaoinshrdlcumfpgwybvkxjqz\n.,-"
RARE, PLACES = 31, 5
WINDOW, ANCHOR = 24, 64
HELD, LANES = 12 << 20, 64
#: Units after which weights, tables and map learn what they have seen.
UNITS = 32
#: Bits of several blocks, side by side, that are prepared together.
STRETCH, MOST_BLOCKS = 1 << 18, 64
#: Lanes whose tables learn together.
NEAR = 64
COUNT_PARTS, SLICES = 32, 64
#: Rates of the weights, of the two tables by order, and of the map.
RATE, TABLE_RATES, MAP_RATE = 0.02, (0.35, 1.1), 0.005
FIRST_WEIGHTS, TRUST = (0.3, 0.4, 0.6, 1.0), (0.0, 1.0, 2.5, 5.0)
#: Bytes since the last miss of a match, by state.
RUNS = (8, 32)
SCALE, LEAST = 1 / 15.0, 1 / 4096

_CODE = np.full(256, RARE, np.uint8)
_CODE[list(USUAL)] = np.arange(len(USUAL))
#: Shifts that leave the bits before a place, with a mark in front, and the place's own bit.
_DOWN = np.arange(PLACES, 0, -1, dtype=np.uint8)[:, None]
_LEAD = (1 << np.arange(PLACES)).astype(np.uint8)[:, None]
_NEXT = _DOWN - np.uint8(1)
#: Of each unit the nodes of its bits.
_PATH = ((np.arange(32) >> _DOWN) | _LEAD).T.astype(np.int64)
_NODE_MULT, _HASH_MULT = np.uint32(0x85EBCA6B), np.uint32(0x2C1B3C6D)


def units_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """5-bit units of bytes, and the first unit of each byte (one more at the end)."""
    rare = _CODE[data] == RARE
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(1 + 2 * rare.astype(np.int64), out=at[1:])
    out = np.empty(int(at[-1]), np.uint8)
    out[at[:-1]] = _CODE[data]
    pos = at[:-1][rare]
    out[pos + 1], out[pos + 2] = data[rare] >> 4, data[rare] & 15
    return out, at


def units(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """5-bit units of each text, and their offsets."""
    out, at = units_at(data)
    return out, at[offs]


def before(u: np.ndarray, offs: np.ndarray, d: int) -> np.ndarray:
    """The unit d places before each; 0 where the text has none."""
    out = np.zeros_like(u)
    out[d:] = u[:-d] if d < len(u) else 0
    for e in range(d):
        first = offs[:-1] + e
        out[first[first < offs[1:]]] = 0
    return out


# The corpus: counts by the last two units.

def _unit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 15, np.int64)
    for b in batches:
        data, offs = text_buffers(b.column(0))
        for i in range(0, b.num_rows, 512):
            o = offs[i : i + 513]
            u, at = units(data[o[0] : o[-1]], o - o[0])
            if len(u):
                total += np.bincount((before(u, at, 2).astype(np.int32) << 10) | (before(u, at, 1).astype(np.int32) << 5) | u, minlength=1 << 15)
    if total.any():
        blobs = [zlib.compress(x.tobytes(), 1) for x in total.reshape(COUNT_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in table["blob"].to_pylist())
    return pa.table({"part": table["part"][:1], "blob": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def corpus_counts(docs: DataFrame) -> np.ndarray:
    """How often each unit comes after the two before; an array of 2^15 counts, whatever the corpus."""
    parts = docs.select("text").mapInArrow(_unit_counts, "part int, blob binary").withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
    some = parts.groupBy("part", "slice").applyInArrow(_added, "part int, blob binary")
    out = np.zeros((COUNT_PARTS, (1 << 15) // COUNT_PARTS), np.int64)
    for r in some.groupBy("part").applyInArrow(_added, "part int, blob binary").collect():
        out[r["part"]] = np.frombuffer(zlib.decompress(r["blob"]), np.int64)
    return out.ravel()


def node_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of counts by unit the 0s and 1s by node of the unit's bits, for each 32 in a row."""
    c = counts.reshape(-1, 32)
    zeros, ones = np.zeros_like(c), np.zeros_like(c)
    for j in range(PLACES - 1, -1, -1):
        zeros[:, 1 << j : 2 << j], ones[:, 1 << j : 2 << j] = c[:, ::2], c[:, 1::2]
        c = c[:, ::2] + c[:, 1::2]
    return zeros.ravel(), ones.ravel()


# The corpus: anchors, and what follows them in other documents.

def anchors_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place behind each anchor, its key, and the text that it is in."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, inv = power_sums(data)
    key = mix64((s[WINDOW:] - s[:-WINDOW]) * inv[: n - WINDOW + 1])
    at = np.flatnonzero(key & np.uint64(ANCHOR - 1) == 0)
    text = np.searchsorted(offs, at, side="right") - 1
    ok = at + WINDOW <= offs[text + 1]
    at = at[ok]
    return at + WINDOW, key[at], text[ok]


def _chunks(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j
        i = j


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, doc, and the bytes up to the document's next anchor; a key once for each document."""
    for b in batches:
        data, offs = text_buffers(b.column(1))
        doc = b.column(0).to_numpy()
        for i, j in _chunks(offs, 1 << 20):
            own, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            at, key, text = anchors_of(own, o)
            if not len(at):
                continue
            end = np.r_[at[1:], 0]
            last = np.r_[text[1:] != text[:-1], True]
            end[last] = o[text[last] + 1]
            order = np.lexsort((key, text))
            fresh = np.r_[True, (key[order[1:]] != key[order[:-1]]) | (text[order[1:]] != text[order[:-1]])]
            first = np.sort(order[fresh])
            first = first[end[first] > at[first]]
            n = end[first] - at[first]
            to = np.r_[0, np.cumsum(n)]
            idx = np.arange(int(to[-1])) + np.repeat(at[first] - to[:-1], n)
            rest = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(own[idx])])
            yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(doc[i:j][text[first]]), rest.cast(pa.binary())], names=["key", "doc", "rest"])


def followers(docs: DataFrame) -> DataFrame:
    """doc, found (key and what follows it in another document); docs: doc, text. A written table."""
    anchors = written(docs.mapInArrow(_anchor_rows, "key long, doc long, rest binary"), "anchors")
    # Two documents are enough for every one to have another.
    shared = anchors.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b")
    shared = written(shared, "shared")
    sources = written(shared.select("key", F.explode(F.array("a", "b")).alias("doc")), "sources")
    rests = matching(anchors, sources, ["key", "doc"]).groupBy("key").agg(F.min(F.struct("doc", "rest")).alias("x"), F.max(F.struct("doc", "rest")).alias("y"))
    asked = matching(anchors.select("key", "doc"), written(rests, "rests"), ["key"])
    found = asked.select("doc", F.struct("key", F.when(F.col("doc") != F.col("x.doc"), F.col("x.rest")).otherwise(F.col("y.rest")).alias("rest")).alias("found"))
    return written(found.groupBy("doc").agg(F.collect_set("found").alias("found")), "followers")


def guesses(data: np.ndarray, found: Mapping[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte that a match predicts at each place of one text, and the state of the match (0: none)."""
    guess, state = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    at, key, _ = anchors_of(data, np.array([0, len(data)]))
    for a, k in zip(at.tolist(), key.view(np.int64).tolist()):
        if (rest := found.get(k)) is not None:
            n = min(len(rest), len(data) - a)
            guess[a : a + n] = np.frombuffer(rest, np.uint8, n)
            state[a : a + n] = 1
    place = np.flatnonzero(state)
    if len(place):
        missed = np.maximum.accumulate(np.where(guess[place] != data[place], place, -(1 << 40)))
        run = place[1:] - 1 - missed[:-1]
        state[place[0]] += len(RUNS)
        state[place[1:]] += sum((run >= r).astype(np.uint8) for r in RUNS)
    return guess, state


# Coding.

class Texts:
    """Flat arrays by unit of some texts, with room for a stretch of blocks behind the last."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, found: list[Mapping[int, bytes] | None], counts: tuple[np.ndarray, np.ndarray]):
        u, at = units_at(data)
        self.offs = at[offs]
        room = MOST_BLOCKS * UNITS
        #: The units, behind three zeros.
        self.padded = np.zeros(len(u) + 3 + room, np.uint8)
        self.padded[3 : len(u) + 3] = u
        self.guess, self.state = np.zeros(len(u) + room, np.uint8), np.zeros(len(u) + room, np.uint8)
        for i, f in enumerate(found):
            if f:
                own = slice(offs[i], offs[i + 1])
                self._guess(data[own], at[own], *guesses(data[own], f))
        del at
        #: Scaled log-odds of each unit's bits by the corpus's counts, less the text's own.
        self.odds = self._without_own(u, *counts)

    def _guess(self, data: np.ndarray, at: np.ndarray, guess: np.ndarray, state: np.ndarray) -> None:
        """The guessed units of each byte of a text, as long as those before were right."""
        place = np.flatnonzero(state)
        data, at, guess, state = data[place], at[place], guess[place], state[place]
        self.guess[at], self.state[at] = _CODE[guess], state
        second = np.flatnonzero((_CODE[data] == RARE) & (_CODE[guess] == RARE))
        self.guess[at[second] + 1], self.state[at[second] + 1] = guess[second] >> 4, state[second]
        third = second[guess[second] >> 4 == data[second] >> 4]
        self.guess[at[third] + 2], self.state[at[third] + 2] = guess[third] & 15, state[third]

    def _without_own(self, u: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
        f = np.float32
        context = (before(u, self.offs, 2).astype(np.int32) << 5) | before(u, self.offs, 1)
        zeros, ones = zeros.astype(f) + f(0.4), ones.astype(f) + f(0.4)
        out = np.zeros((len(u) + MOST_BLOCKS * UNITS, PLACES), np.int8)
        for i in range(0, len(self.offs) - 1, 16):
            some = self.offs[i : i + 17]
            a, b = int(some[0]), int(some[-1])
            place = context[a:b] + np.repeat(np.arange(len(some) - 1, dtype=np.int32) << 10, np.diff(some))
            seen = np.zeros(16 << 10, bool)
            seen[place] = True
            own = np.flatnonzero(seen)  # the texts' contexts, in dense rows of 32 cells
            leaf = ((np.cumsum(seen) - 1) << 5).take(place)
            leaf += u[a:b]
            times = np.bincount(leaf, minlength=len(own) << 5).astype(np.int32)
            n0, n1 = node_counts(times)
            used = np.flatnonzero(n0 | n1)
            cell = ((own << 5) & 0x7FFF).take(used >> 5) | (used & 31)
            x = ones.take(cell) - n1.take(used).astype(f)
            x /= zeros.take(cell) - n0.take(used).astype(f)
            np.log(x, out=x)
            x *= f(1 / SCALE)
            odds = np.zeros(len(n0), np.int8)
            odds[used] = np.rint(x.clip(-127, 127))
            leaves = np.flatnonzero(times)
            number = np.zeros(len(times), np.int64)
            number[leaves] = np.arange(len(leaves))
            paths = odds.take((leaves & ~31)[:, None] + _PATH.take(leaves & 31, axis=0))
            paths.take(number.take(leaf), axis=0, out=out[a:b], mode="clip")
        return out.ravel()


def _lanes(blocks: list[int], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lane and first block there of each text, and each lane's blocks, which fall; blocks: of each text, falling."""
    lane, first = np.zeros(len(blocks), np.int64), np.zeros(len(blocks), np.int64)
    loads = [(0, k) for k in range(lanes)]
    for i, n in enumerate(blocks):
        first[i], lane[i] = loads[0]
        heapq.heapreplace(loads, (loads[0][0] + n, loads[0][1]))
    load = np.zeros(lanes, np.int64)
    for n, k in loads:
        load[k] = n
    order = np.argsort(-load, kind="stable")
    number = np.empty(lanes, np.int64)
    number[order] = np.arange(lanes)
    return number[lane], first, load[order]


def _missed(x: np.ndarray, sign: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Bits less their probabilities, of log-odds; sign: 1 or -1 by the bit, 0 where none is."""
    np.multiply(x, sign, out=out)
    np.exp(out, out=out)
    out += np.float32(1)
    return np.divide(sign, out, out=out)


@np.errstate(over="ignore")  # 1 / inf is 0
def code_lengths(t: Texts, own: np.ndarray) -> np.ndarray:
    """Bits of texts; own: their numbers, by falling length. A lane's texts are coded one behind the other, each from the state that all begin with."""
    f, windows = np.float32, np.lib.stride_tricks.sliding_window_view
    bits = np.zeros(len(own))
    if not len(own):
        return bits
    start, lens = t.offs[own], t.offs[own + 1] - t.offs[own]
    lanes = min(LANES, len(own))
    lane, first, load = _lanes((-(-lens // UNITS)).tolist(), lanes)
    begins = np.argsort(first, kind="stable")
    edges_of = first[begins]
    slots = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(lens, 1))).astype(np.int64))
    # A lane's two tables by context are neighbours; its first text is the longest.
    cells = np.zeros(lanes, np.int64)
    np.maximum.at(cells, lane, slots + 1024)
    table = np.zeros(int(cells.sum()), f)
    low = np.cumsum(cells) - cells
    mask = (slots - 1).astype(np.uint32)
    # Where no match is, the fourth predictor gives 0; the weights of the other states are kept apart.
    w, w_matched = np.empty((3, PLACES, lanes), f), np.empty((3, 4, PLACES, lanes), f)
    flat_w = w_matched.ravel()
    steps = np.arange(4)[:, None] * (PLACES * lanes)
    slope, shift = np.empty((PLACES, lanes), f), np.empty((PLACES, lanes), f)
    begin_w = np.array(FIRST_WEIGHTS, f)[:, None, None]
    rates, trust = np.array(TABLE_RATES, f)[:, None, None, None], np.array(TRUST, f)
    unit_windows, odds_windows, state_windows = windows(t.padded, UNITS + 3), windows(t.odds, UNITS * PLACES), windows(t.state, UNITS)
    now = np.zeros(lanes, np.int64)  # each lane's text
    at, longest = 0, int(load[0])
    while at < longest:
        # What isn't learned is made for several blocks of units at a time.
        a = int(np.searchsorted(-load, -at, side="left"))
        k = max(1, min(STRETCH // (a * PLACES * UNITS), MOST_BLOCKS, longest - at))
        blocks = (k, UNITS, PLACES, a)
        new = begins[np.searchsorted(edges_of, at) : np.searchsorted(edges_of, at + k)]
        text = np.repeat(now[None, :a], k, axis=0)
        starts: list[list[int]] = [[] for _ in range(k)]
        for i, b, c in zip(new.tolist(), (first[new] - at).tolist(), lane[new].tolist()):
            text[b:, c] = i
            starts[b].append(i)
        now[:a] = text[-1]
        done = (np.arange(at, at + k)[:, None] - first[text]) * UNITS
        place, left = start[text] + done, lens[text] - done
        ending = bool((left < UNITS).any())
        around = np.ascontiguousarray(unit_windows[place].transpose(0, 2, 1))
        np.copyto(around[:, :3], 0, where=np.arange(3)[:, None] < 3 - done[:, None])  # nothing is known from before a text
        u = around[:, 3:, None]
        back = [around[:, 3 - d : UNITS + 3 - d] for d in (1, 2, 3)]
        sign = ((u >> _NEXT) & np.uint8(1)).astype(f)
        sign *= f(2)
        sign -= f(1)
        if ending:
            over = np.arange(UNITS)[:, None] >= left[:, None]
            np.copyto(sign, 0, where=over[:, :, None])
        node = (u >> _DOWN) | _LEAD
        x = node.astype(np.uint32)
        x *= _NODE_MULT
        x += (((back[2].astype(np.uint32) << np.uint32(10)) | (back[1].astype(np.uint32) << np.uint32(5)) | back[0]) * np.uint32(0x9E3779B1))[:, :, None]
        x ^= x >> np.uint32(15)
        x *= _HASH_MULT
        x ^= x >> np.uint32(13)
        x &= mask[text][:, None, None]
        node = node.astype(np.int64)
        st = np.empty((k, 3, UNITS, PLACES, a), f)
        st.reshape(k, 3, -1, a)[:, 2] = np.ascontiguousarray(odds_windows[place * PLACES].transpose(0, 2, 1))
        st[:, 2] *= f(SCALE)
        context = low[:a] + (back[0].astype(np.int64) << 5)
        # The tables learn by themselves, a few lanes at a time.
        for c in range(0, a, NEAR):
            e = min(a, c + NEAR)
            cell = np.empty((k, 2, UNITS, PLACES, e - c), np.int64)
            np.add(node[..., c:e], context[:, :, None, c:e], out=cell[:, 0])
            cell[:, 1] = x[..., c:e]
            cell[:, 1] += low[c:e] + 1024
            signs = np.ascontiguousarray(sign[..., c:e])
            got = st[:, :2] if e - c == a else np.empty(cell.shape, f)
            miss = np.empty(cell.shape[1:], f)
            for b in range(k):
                for i in starts[b]:
                    if c <= lane[i] < e:
                        table[low[lane[i]] : low[lane[i]] + 1024 + slots[i]] = 0
                table.take(cell[b], out=got[b], mode="clip")
                _missed(got[b], signs[b], miss)
                miss *= rates
                np.add.at(table, cell[b].ravel(), miss.ravel())
            if e - c < a:
                st[:, :2, ..., c:e] = got
        # The bits of a match, each with the weights of its state.
        state = state_windows[place]
        if ending:
            state *= np.arange(UNITS) < left[..., None]
        some = np.flatnonzero(state)
        edges = None
        if len(some):
            kind, own_block = state.ravel().take(some), some // UNITS
            unit = some - own_block * UNITS
            source = place.ravel().take(own_block) + unit
            guess = t.guess.take(source)
            m, j = np.nonzero((((guess ^ t.padded.take(source + 3)) >> _DOWN) == 0).T)
            kind, guess, unit, own_block = (v.take(m) for v in (kind.astype(np.int64), guess, unit, own_block))
            edges = np.searchsorted(own_block, np.arange(k + 1) * a).tolist()
            col = own_block % a
            cells = (unit * PLACES + j) * a + col
            own_w = (kind - 1) * (4 * PLACES * lanes) + j * lanes + col + steps  # of each input and bit
            own_st = np.empty((4, len(m)), f)
            np.multiply(trust.take(kind), ((guess >> (PLACES - 1 - j).astype(np.uint8)) & np.uint8(1)) * f(2) - f(1), out=own_st[3])
        right = np.empty((k, UNITS, a), f)
        dot, err, z = (np.empty(blocks[1:], f) for _ in range(3))
        for b in range(k):
            if starts[b]:
                c = lane[starts[b]]
                w[..., c], w_matched[..., c], slope[:, c], shift[:, c] = begin_w[:3], begin_w, 1, 0
            s, inputs = sign[b], st[b]
            np.einsum("iuja,ija->uja", inputs, w[:, :, :a], out=dot)
            matched = edges and edges[b] < edges[b + 1]
            if matched:
                e = slice(edges[b], edges[b + 1])
                own_st[:3, e] = inputs.reshape(3, -1).take(cells[e], axis=1)
                dot.ravel()[cells[e]] = np.einsum("ix,ix->x", own_st[:, e], flat_w.take(own_w[:, e]))
            # The refined prediction: a logistic map of the mixed one. At first how far it misses the bit, 1 - LEAST at most.
            np.multiply(dot, slope[:, :a], out=z)
            z += shift[:, :a]
            _missed(z, s, z)
            z *= f(1 - 2 * LEAST)
            np.multiply(s, f(LEAST), out=err)
            z += err
            np.subtract(f(1), np.abs(z, out=err), out=err)
            np.multiply.reduce(err, axis=1, out=right[b])  # 1e-18 at least
            # Learning, from all bits of these units at once.
            shift[:, :a] += f(MAP_RATE) * z.sum(axis=0)
            z *= dot
            slope[:, :a] += f(MAP_RATE) * z.sum(axis=0)
            _missed(dot, s, err)
            if matched:
                own_err = err.ravel().take(cells[e])
                own_err *= f(RATE)
                err.ravel()[cells[e]] = 0
                np.add.at(flat_w, own_w[:, e].ravel(), (own_st[:, e] * own_err).ravel())
            w[:, :, :a] += f(RATE) * np.einsum("iuja,uja->ija", inputs, err)
        if ending:
            np.copyto(right, 1, where=over)
        np.add.at(bits, text.ravel(), -np.log(right, out=right).sum(axis=1, dtype=np.float64).ravel())
        at += k
    return bits / math.log(2)


def score_batch(data: np.ndarray, offs: np.ndarray, found: list[Mapping[int, bytes] | None], counts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Bits of each text."""
    t = Texts(data, offs, found, counts)
    n = np.diff(t.offs)
    out = np.zeros(len(n))
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    out[order] = code_lengths(t, order)
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, bits, bits_per_byte: one row for each document."""
    counts = docs.sparkSession.sparkContext.broadcast(node_counts(corpus_counts(docs)))
    schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.float64()), ("bits_per_byte", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            data, offs = text_buffers(t["text"])
            found = [{x["key"]: x["rest"] for x in f} if f else None for f in t["found"].to_pylist()]
            bits = score_batch(data, offs, found, counts.value)
            n = np.diff(offs)
            rate = pa.array(bits / np.maximum(n, 1), mask=n == 0)
            return pa.RecordBatch.from_arrays([t["doc_id"].combine_chunks(), pa.array(bits), rate], schema=schema)

        for b in batches:
            i, (_, offs) = 0, text_buffers(b.column("text"))
            while i < b.num_rows:  # no more than HELD bytes at a time, but for a single text
                j = min(b.num_rows, max(i + 1, int(np.searchsorted(offs, offs[i] + HELD - size, side="right")) - 1))
                held.append(b.slice(i, j - i))
                size += int(offs[j] - offs[i])
                i = j
                if i < b.num_rows or size >= HELD:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    rows = partly_joined(rows, followers(rows.select("doc", "text")), ["doc"])
    return rows.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, bits double, bits_per_byte double")
