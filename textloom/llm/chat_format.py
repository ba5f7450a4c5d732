"""Chat formatting by columnar byte assembly.

The turns of a conversation become one text: for each turn a header with its
role, its content and an end mark. All texts of a batch are assembled in one
preallocated buffer: the lengths of the segments (header, content, end mark)
give cumulative offsets, and from these numpy makes the indices by which
bytes are scattered to their place; the buffer then becomes an Arrow column.

Defined results: turns come in the order of turn, role and text, nulls first;
equal rows come as often as they are there. A null role is written as
"unknown", a null text as an empty one. Rows with a null conv_id are one
conversation with a null id. Contents are copied byte by byte, also where
they look like marks. Conversations of any length aren't cut. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_buffers

START, MID, END = "<|im_start|>", "\n", "<|im_end|>\n"
_OUT = pa.schema([("conv_id", pa.int64()), ("text", pa.string()), ("n_turns", pa.int64()), ("n_bytes", pa.int64())])
#: Bytes of content up to which batches are put together for one assembly.
GATHER = 32 << 20


def scatter_copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, offs: np.ndarray) -> None:
    """Copy the segments data[offs[i]:offs[i+1]] to out[at[i]:]."""
    n = np.diff(offs)
    total = int(n.sum())
    if total:
        idx = np.repeat(at - offs[:-1], n)
        idx += np.arange(int(offs[0]), int(offs[-1]), dtype=np.int64)
        out[idx] = data[int(offs[0]) : int(offs[-1])]


def assemble(heads: list[bytes], which: np.ndarray, data: np.ndarray, offs: np.ndarray, tail: bytes) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with header, content and tail of each row, and the rows' offsets in it."""
    h_len = np.array([len(h) for h in heads], dtype=np.int64)[which] if len(which) else np.zeros(0, np.int64)
    rows = np.zeros(len(which) + 1, dtype=np.int64)
    np.cumsum(h_len + np.diff(offs) + len(tail), out=rows[1:])
    out = np.empty(int(rows[-1]), dtype=np.uint8)
    for k, h in enumerate(heads):
        own = np.flatnonzero(which == k)
        out[(rows[own][:, None] + np.arange(len(h))).ravel()] = np.tile(np.frombuffer(h, np.uint8), len(own))
    scatter_copy(out, rows[:-1] + h_len, data, offs)
    out[((rows[1:] - len(tail))[:, None] + np.arange(len(tail))).ravel()] = np.tile(np.frombuffer(tail, np.uint8), len(which))
    return out, rows


def format_table(t: pa.Table) -> pa.RecordBatch:
    """Format whole conversations; t is sorted and has conv_id, role and text."""
    ids = t["conv_id"].combine_chunks()
    n = len(ids)
    filled = ids.fill_null(0).to_numpy(zero_copy_only=False)
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    new = np.flatnonzero(np.r_[True, (filled[1:] != filled[:-1]) | (valid[1:] != valid[:-1])])
    roles = t["role"].combine_chunks().fill_null("unknown").dictionary_encode()
    heads = [f"{START}{r}{MID}".encode() for r in roles.dictionary.to_pylist()]
    data, offs = text_buffers(t["text"])
    out, rows = assemble(heads, roles.indices.to_numpy(zero_copy_only=False), data, offs, END.encode())
    ends = np.r_[new[1:], n]
    bounds = np.r_[rows[new], rows[-1]]
    text = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(new)), text, pa.array(ends - new), pa.array(np.diff(bounds))], schema=_OUT)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations: the last one of a batch waits for the next batch."""
    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        held.append(t)
        if sum(x.nbytes for x in held) < GATHER:
            continue
        t = pa.concat_tables(held).combine_chunks()
        ids = t["conv_id"].chunk(0)
        filled, valid = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)
        other = np.flatnonzero((filled != filled[-1]) | (valid != valid[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = [t.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, text, n_turns, n_bytes: one row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches):
            yield format_table(t)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
        .mapInArrow(run, "conv_id long, text string, n_turns long, n_bytes long")
    )


CHAT_SQL = f"""
SELECT conv_id, string_agg(part, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text, count(*)::BIGINT AS n_turns,
       sum(octet_length(encode(part)))::BIGINT AS n_bytes
FROM (SELECT *, '{START}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS part FROM conversations)
GROUP BY conv_id"""
