"""Arrow batches in parts of a bounded size, so that what a Python worker holds doesn't grow with its task."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None

#: Bytes of texts, or elements of lists, in a part; a row that has more is a part by itself.
PART_BYTES, PART_ELEMENTS = 1 << 20, 1 << 18


def give_back(bytes_used: int = 1 << 62) -> None:
    """Free memory goes back to the system: Python workers are kept between tasks, and idle ones count beside the JVM.

    After little work (bytes_used under 1 MB) nothing is done.
    """
    if bytes_used >= 1 << 20:
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def parts(a: pa.Array) -> Iterator[slice]:
    """Where a is cut: texts by their bytes, lists by their elements."""
    nested = pa.types.is_list(a.type) or pa.types.is_large_list(a.type)
    size = np.asarray(pc.fill_null(pc.list_value_length(a) if nested else pc.binary_length(a), 0)).astype(np.int64)
    ends, most, at = np.cumsum(size), PART_ELEMENTS if nested else PART_BYTES, 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def in_parts(kind: str, fn: Callable[..., pa.Array]) -> Callable:
    """A function of one or more Columns, of which the first decides how batches are cut: fn gets parts of their arrays, and its rows leave the worker part by part."""

    @F.arrow_udf(kind)
    def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            for p in parts(a):
                yield fn(a[p])
            give_back(a.nbytes)

    @F.arrow_udf(kind)
    def several(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            for p in parts(arrays[0]):
                yield fn(*(a[p] for a in arrays))
            give_back(arrays[0].nbytes)

    return lambda *columns: (several if len(columns) > 1 else one)(*columns)


def lists(fn: Callable[[list], list], kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """A function of Python lists of rows as one of arrays."""
    return lambda a: pa.array(fn(a.to_pylist()), kind)
