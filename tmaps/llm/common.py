"""Helpers shared by the operators: table access, flat byte views of Arrow text, word spans."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmaps.session import scratch_path

#: White space of the text contracts: space, tab, LF, VT, FF, CR.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table written below the shared checkpoint folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own(*names: str) -> list[str]:
    """Column names that no input column can clash with."""
    tag = uuid.uuid4().hex[:8]
    return [f"__{n}_{tag}" for n in names]


def held_out(doc_id):
    """Rows that no model learns from: crc32(doc_id as text) mod 4 = 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), off.astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut between rows so that each holds about ``limit`` bytes of
    ``column`` (one longer text is a piece of its own): bounds the work space."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = flat(b.column(column))
        start = 0
        while start < b.num_rows:
            stop = int(np.searchsorted(off, off[start] + limit, side="right")) - 1
            stop = max(start + 1, min(stop, b.num_rows))
            yield b.slice(start, stop - start)
            start = stop


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # of the GNU library
MANY_ROWS = 256


def let_go() -> None:
    """Gives freed memory back to the system. A Python worker lives on from stage to stage, beside the
    executor's own memory, and else keeps what its largest task took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def brief(kernel: Callable) -> Callable:
    """The kernel of batches; at its end the worker lets go of what it freed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        let_go()
    return run


def brief_group(kernel: Callable) -> Callable:
    """The kernel of a group; after a group of many rows the worker lets go of what it freed."""
    def run(group: pa.Table) -> pa.Table:
        out = kernel(group)
        if group.num_rows >= MANY_ROWS:
            let_go()
        return out
    return run


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have:have + take] = out[:take] * step
        have += take
    return out[:n]


class Powers:
    """Growing tables of the base and its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = _powers(_BASE, 1 << 12)
        self.down = _powers(pow(_BASE, -1, 1 << 64), 1 << 12)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of non-white bytes as (start, end, row), never over a row's end."""
    lo, hi = int(off[0]), int(off[-1])
    if hi == lo:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~WHITE[data[lo:hi]]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = off[:-1] - lo
    cuts = cuts[cuts < hi - lo]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = off[1:] - lo
    ends = ends[ends > 0] - 1
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first) + lo, np.flatnonzero(last) + 1 + lo
    return start, end, np.searchsorted(off, start, side="right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers, lower: bool = True) -> np.ndarray:
    """64-bit hash of each span (a random-table polynomial, then a finaliser)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    lo, hi = int(start.min()), int(end.max())
    up, down = powers.to(hi - lo + 1)
    terms = (_BYTE_LOWER if lower else _BYTE)[data[lo:hi]] * up[:hi - lo]
    total = np.zeros(hi - lo + 1, dtype=np.uint64)
    np.cumsum(terms, out=total[1:])
    h = (total[end - lo] - total[start - lo]) * down[start - lo]
    return mix64(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
