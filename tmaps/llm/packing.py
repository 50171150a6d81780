"""Best-fit decreasing packing of token sequences, with a segment tree over capacities.

A piece's place depends on its length alone, and lengths are at most ``capacity``. So
the sequential part of best-fit decreasing runs on the histogram of lengths (at most
``capacity`` rows, whatever the corpus): lengths descend, and a segment tree over
remaining capacities finds the tightest open bins in logarithmic time. Bins of one
remaining capacity are kept as runs of bin numbers, and a step places a whole run of
equal pieces: "pieces ``lo`` to ``hi`` of this length go to the bins from ``bin`` on,
``per`` to a bin". That is the very placement that taking the pieces one by one gives.

The pieces themselves never leave Spark: tokenising numbers them by (task, length),
counts by (task, length) give each task's first rank, and every row finds its step by
binary search. Steps are at most about two for each length and open run.

Defined cases: null and empty texts are one end-of-document id; repeated rows are
packed as documents of their own (same doc_id); null doc_ids stay null; an empty table
packs into no sequence; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmaps.llm.bpe import PATTERN, Tokens
from tmaps.llm.common import pieces, stored

CAPACITY = 2048
END = b"\0\0\0\0"  # id 0 closes every document
LONG = 100_000  # tiktoken's pattern fails on about a million white characters on end
_LONG_WHITE = regex.compile(rf"(?<!\s)\s{{{LONG},}}")


class Ids:
    """Ids of a byte-level BPE file, as the tokenizers library gives them, through
    tiktoken's encoder on the file's own vocabulary: it needs a fifth of the time, and no
    table of words. The strings of special tokens are those tokens. Runs of ``LONG`` and
    more white characters do not go through tiktoken's pattern: it takes such a run whole,
    without the last character where something stands after it."""

    def __init__(self, path: str) -> None:
        v = Tokens(path)
        self.encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=v.id_of, special_tokens=v.special)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v.special, key=len, reverse=True))) + ")").split if v.special else lambda s: [s]

    def of(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if len(text) < LONG or _LONG_WHITE.search(text) is None:
            return self.short(text)
        out = []
        for k, part in enumerate(self.cut(text)):
            at = 0
            for m in () if k % 2 else _LONG_WHITE.finditer(part):
                end = m.end() if m.end() == len(part) else m.end() - 1
                out += [self.short(part[at:m.start()]), np.array(self.encoding._encode_single_piece(part[m.start():end]), "<u4").tobytes()]
                at = end
            out.append(self.short(part[at:]))
        return b"".join(out)

    def short(self, text: str) -> bytes:
        """Ids of a text without long runs of white characters."""
        return self.encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


_READY: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _READY:
        _READY[path] = Ids(path)
    return _READY[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, numbered within its task and length: part, rank."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, ids = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), ids_of(path)
        for b in pieces(batches, "text"):
            row, no, start, length, crc, rank = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                raw = ids.of(text or "") + END
                at, total, k = 0, len(raw) // 4, 0
                while at < total:
                    n = (total - at - 1) % capacity + 1 if at == 0 else capacity
                    row.append(i)
                    no.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(crc32(raw[4 * at:4 * (at + n)]))
                    rank.append(int(seen[n]))
                    seen[n] += 1
                    at, k = at + n, k + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(no, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in (start, length, crc, rank)),
                 pa.array([part] * len(row), pa.int32())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        kernel, "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int")


class Capacities:
    """Segment tree over remaining capacities: is a bin of this capacity open?"""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        k = capacity + self.size
        self.open[k] = is_open
        while k > 1:
            k >>= 1
            self.open[k] = self.open[2 * k] or self.open[2 * k + 1]

    def tightest(self, length: int) -> int:
        """The least open capacity of at least ``length``, or -1."""
        k = length + self.size
        if self.open[k]:
            return length
        while k > 1:
            if not k & 1 and self.open[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.open[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return -1


def best_fit_steps(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Steps (length, lo, hi, bin, per, base) of best-fit decreasing, and the bins used."""
    tree, runs, bins, steps = Capacities(capacity), [[] for _ in range(capacity + 1)], 0, []

    def leave(room: int, first: int, count: int) -> None:
        if count and room:
            runs[room].append((first, count))
            tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        left, lo = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                first, count = bins, -(-left // (room // length))
                bins += count
            else:
                first, count = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
            per = room // length  # a bin that still has room is the tightest: it is filled first
            put = min(left, count * per)
            steps.append((length, lo, lo + put, first, per, capacity - room))
            full, rest = divmod(put, per)
            leave(room - per * length, first, full)
            if rest:
                leave(room - rest * length, first + full, 1)
            used = full + (rest > 0)
            leave(room, first + used, count - used)
            left, lo = left - put, lo + put
    return np.array(steps, dtype=np.int64).reshape(-1, 6), bins


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = stored(cut_pieces(docs, path, capacity), "pieces")
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps, _ = best_fit_steps(histogram, capacity)
    order = np.lexsort((steps[:, 1], steps[:, 0])) if len(steps) else np.zeros(0, int)
    steps = steps[order]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {int(n): (a, b) for n, a, b in zip(*_slices(steps[:, 0]))}
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            step = np.empty(len(rank), np.int64)
            for n in np.unique(length):
                of, (lo, hi) = length == n, at[int(n)]
                step[of] = lo + np.searchsorted(steps[lo:hi, 1], rank[of], side="right") - 1
            s = steps[step]
            in_step = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(s[:, 3] + in_step // s[:, 4]), pa.array(s[:, 5] + in_step % s[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = rows.join(firsts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _slices(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value of a sorted array with the place where it begins and ends."""
    values, first = np.unique(sorted_values, return_index=True)
    return values, first, np.append(first[1:], len(sorted_values))
