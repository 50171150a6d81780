"""Quality: a linear-chain conditional random field over the lines of a document.

Every line (they end at line feeds) is good or bad. Its features are shares of characters
(each ASCII sign for itself), of pairs of character classes, of hashed words, the lengths,
repetition and shape of its words and how it begins and ends; the same features of the
line before and the line after count with weights of their own, and weights for the move
from one line's label to the next are learned with them. Forward-backward gives the
probability that a line is good; a document's score is the mean of these, weighted by the
lines' lengths.

A document is one chain, however long. Lines are described in blocks of ``BLOCK_BYTES`` and
``BLOCK_LINES``, of which only six numbers a line are kept, so work space does not follow the
length of a text.

Fit. At most ``TRAIN_ROWS`` labelled rows (those with the smallest hashes of their ids, equal
texts once; ids whose crc32 is divisible by ``FOLDS`` are held out), of each at most the first
``TRAIN_LINES`` lines, each labelled as its document; documents are spliced into chains so
that moves between labels are seen. The driver's work is bounded by these parameters. Scoring
reads every whole text.

Defined cases: null and empty texts are one empty line and get a score; null labels are not
learned from; of several labels for one document the highest counts; without both labels
every score is the share of label 1 (0 without labels); a null doc_id counts as not held
out; repeated rows give repeated results; an empty table gives no rows; further columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import Powers, flat, pieces, span_hash, word_spans
from tmaps.llm.language import Chains

FOLDS = 5
TRAIN_ROWS, TRAIN_LINES, EPOCHS, SPLICED = 6000, 12, 12, 6
THRESHOLD = 0.3
PIECE_BYTES = 1 << 19
BLOCK_BYTES, BLOCK_LINES = 1 << 18, 4096
WORD_BITS = 8

# classes of bytes: letters of either case, digits, white space, each sign, bytes of other scripts, controls
_CLASS = np.full(256, 38, np.int64)
_CLASS[0x20], _CLASS[0x09], _CLASS[0x0D] = 3, 3, 3
_signs = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
_CLASS[_signs] = np.arange(4, 4 + len(_signs))
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 36, 37
CLASSES = 39
_ROUGH = np.select([_CLASS < 4, np.isin(np.arange(256), [ord(x) for x in ".,;:?!"]), _CLASS < 36, _CLASS < 38], [_CLASS, 4, 5, 6], 7)
ROUGH = 8
SHAPE = 14
WIDTH = CLASSES + ROUGH * ROUGH + SHAPE + (1 << WORD_BITS) + 1


@dataclass
class Model:
    weights: np.ndarray | None = None  # of a line's own features and its neighbours'; None: only the share
    moves: np.ndarray | None = None  # log weights, from bad (0) and good (1)
    share: float = 0.0  # of good documents


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of lines of each row); an empty row is one empty line."""
    feeds = np.flatnonzero(data[off[0]:off[-1]] == 0x0A) + off[0]
    count = np.searchsorted(feeds, off[1:]) - np.searchsorted(feeds, off[:-1]) + 1
    start = np.sort(np.concatenate([off[:-1], feeds + 1]), kind="stable")
    last = np.cumsum(count) - 1
    end = np.empty(len(start), np.int64)
    end[:-1] = start[1:] - 1
    end[last] = off[1:]
    return start, end, count


def describe(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """Features of consecutive lines."""
    n, size = len(start), end - start
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size)
    text = data[at]
    share = lambda groups, of, k: np.sqrt(np.bincount(of * k + groups, minlength=n * k).reshape(n, k) / np.maximum(size, 1)[:, None])
    rough = _ROUGH[text]
    inside = owner[1:] == owner[:-1] if len(owner) else np.zeros(0, bool)
    out = [share(_CLASS[text], owner, CLASSES), share((rough[:-1] * ROUGH + rough[1:])[inside], owner[:-1][inside], ROUGH * ROUGH)]
    first, last, row = word_spans(data, np.append(start, max(int(end[-1]), int(start[-1]))))
    h, long = span_hash(data, first, last, powers), last - first
    words = np.bincount(row, minlength=n)
    mean = lambda x: np.bincount(row, x, minlength=n) / np.maximum(words, 1)
    order = np.lexsort((h, row))
    new = np.ones(len(h))
    new[order[1:]] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
    again = np.zeros(len(h))  # the word before it, or the one before that, once more
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    again[2:] = np.maximum(again[2:], (h[2:] == h[:-2]) & (row[2:] == row[:-2]))
    fresh = mean(new)
    edge = lambda where, test: np.where(size > 0, test(np.append(data, np.uint8(0))[where]), False)
    out.append(np.column_stack([
        np.log1p(size) / 8, size == 0, np.log1p(words) / 8, np.minimum(mean(long) / 10, 3), mean(long <= 3), mean(long >= 12),
        fresh, (words > 3) & (fresh < 0.5), (words > 3) & (fresh < 0.25), mean(again), np.sqrt(mean(again)),
        mean(_CLASS[data[np.maximum(last - 1, 0)]] > 3) if len(last) else np.zeros(n),
        edge(np.maximum(end - 1, 0), lambda c: np.isin(c, [ord(x) for x in ".?!"])), edge(start, lambda c: _CLASS[c] == 1)]))
    bag = np.bincount(row * (1 << WORD_BITS) + (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), minlength=n << WORD_BITS)
    out += [np.sqrt(bag.reshape(n, -1) / np.maximum(words, 1)[:, None]), np.ones((n, 1))]
    return np.hstack(out).astype(np.float32)


def blocks(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Consecutive lines of at most BLOCK_BYTES (a longer line is a block of its own)."""
    lo = 0
    while lo < len(start):
        hi = int(np.searchsorted(end, start[lo] + BLOCK_BYTES, side="right"))
        hi = min(max(hi, lo + 1), lo + BLOCK_LINES)
        yield lo, hi
        lo = hi


def with_neighbours(own: np.ndarray, before: np.ndarray, after: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of a line's own part, the part of the line before it and of the line after it."""
    out = own.copy()
    first = np.zeros(len(own), bool)
    first[(np.cumsum(count) - count)[count > 0]] = True
    joined = np.flatnonzero(~first)
    out[joined] += before[joined - 1]
    out[joined - 1] += after[joined]
    return out


def train(rows: list[np.ndarray], good: np.ndarray, seed: int = 11) -> Model:
    """Stochastic gradient ascent (a rate for each weight) on spliced chains; ``rows`` holds
    the line features of each document."""
    rng = np.random.default_rng(seed)
    weights, moves = np.zeros((3, WIDTH, 2)), np.zeros((2, 2))
    seen_w, seen_m = np.full(weights.shape, 1e-2), np.full(moves.shape, 1e-2)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 16 * SPLICED):
            some = order[lo:lo + 16 * SPLICED]
            x = np.concatenate([rows[k] for k in some]).astype(np.float64)
            count = np.array([len(rows[k]) for k in some])
            gold = np.repeat(good[some].astype(np.int64), count)
            score = with_neighbours(x @ weights[0], x @ weights[1], x @ weights[2], count)
            chain = np.add.reduceat(count, np.arange(0, len(count), SPLICED))
            layout = Chains(chain)
            marginal, alpha, beta = layout.run(score, moves)
            miss = -marginal
            miss[np.arange(len(gold)), gold] += 1
            # a line's features count for itself, for the line after it and for the one before
            zero = np.zeros_like(miss)
            parts = [miss, with_neighbours(zero, zero, miss, count), with_neighbours(zero, miss, zero, count)]
            grad = np.stack([x.T @ p for p in parts]) / len(gold) - 1e-4 * weights
            follow = np.ones(len(gold), bool)
            follow[np.cumsum(chain) - chain] = False
            b = np.flatnonzero(follow)
            pair = alpha[layout.slot[b - 1]][:, :, None] * np.exp(moves) * beta[layout.slot[b]][:, None, :]
            move = -(pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            np.add.at(move, (gold[b - 1], gold[b]), 1)
            move = move / len(gold) - 1e-3 * moves
            seen_w += grad * grad
            seen_m += move * move
            weights += 0.3 * grad / np.sqrt(seen_w)
            moves += 0.1 * move / np.sqrt(seen_m)
    return Model(weights.astype(np.float32), moves, float(good.mean()))


def predict(model: Model, texts: pa.Array, powers: Powers) -> np.ndarray:
    """Scores of the texts: length-weighted means of their lines' marginals."""
    if model.weights is None:
        return np.full(len(texts), model.share)
    data, off = flat(texts)
    start, end, count = lines(data, off)
    stacked = np.concatenate(model.weights, axis=1)
    parts = np.concatenate([describe(data, start[a:b], end[a:b], powers) @ stacked for a, b in blocks(start, end)]).astype(np.float64)
    marginal, _, _ = Chains(count).run(with_neighbours(parts[:, :2], parts[:, 2:4], parts[:, 4:], count), model.moves)
    weight, row = (end - start + 1).astype(float), np.repeat(np.arange(len(count)), count)
    return np.clip(np.bincount(row, weight * marginal[:, 1], minlength=len(count)) / np.bincount(row, weight, minlength=len(count)), 0, 1)


def held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    label = (labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("__id"))
             .agg(F.max("quality").cast("int").alias("good")).where(~held_out("__id")))
    pick = label.orderBy(F.xxhash64("__id"), "__id").limit(TRAIN_ROWS)  # at most TRAIN_ROWS pairs of numbers
    # of a sampled text only the lines to learn from travel on
    begun = F.substring_index(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", TRAIN_LINES)
    some = docs.select(F.col("doc_id").cast("long").alias("__id"), begun.alias("text")).join(F.broadcast(pick), "__id").select("text", "good").distinct()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in pieces(batches, "text", PIECE_BYTES):
            data, off = flat(b.column("text"))
            start, end, count = lines(data, off)
            x = np.concatenate([describe(data, start[lo:hi], end[lo:hi], powers) for lo, hi in blocks(start, end)])
            cuts = np.concatenate([[0], np.cumsum(count)])
            order = [x[cuts[k]:cuts[k + 1]].tobytes() for k in range(len(count))]
            yield pa.RecordBatch.from_arrays([b.column("good"), pa.array(order, pa.binary())], names=["good", "x"])

    got = some.mapInArrow(kernel, "good int, x binary").toArrow().to_pydict()
    good = np.array(got["good"], dtype=float)
    if not len(good) or good.min() == good.max():
        return Model(share=float(good.mean()) if len(good) else 0.0)
    order = sorted(range(len(good)), key=lambda k: (got["good"][k], got["x"][k]))  # one order, however Spark returned the rows
    return train([np.frombuffer(got["x"][k], np.float32).reshape(-1, WIDTH) for k in order], good[order])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(predict(model, b.column("text"), powers))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
