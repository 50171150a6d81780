"""Language ID: a linear-chain conditional random field over the words of a text.

Words are runs of ASCII letters and non-ASCII characters. A word's features, hashed into
2**16 buckets, are its n-grams of 2 to 4 bytes with marks at both ends (those that hold a
mark are its prefixes and suffixes) and the whole word (its lexicon entry). Transition
weights between the languages of neighbouring words are learned with them. Forward-
backward gives every word's marginals; a text's language is the one with the largest sum,
and the score is that sum's share.

A text is one chain, however long. Chains are laid out in windows of ``WINDOW`` words:
the windows' transfer matrices are multiplied up and down each text first, then all
windows run forward and backward at once from exact border vectors.

Fit. At most about ``TRAIN_ROWS`` labelled rows that are not held out, of at most
``TRAIN_BYTES`` bytes each, in equal numbers for each language (chosen by a hash of their
ids), spliced into code-switched chains of 5 to 30 words a turn so that transitions are
seen. Languages are those of all such rows; one with too few rows of that size is learned from
the beginnings of its longer ones too. The driver's work is bounded by these parameters.

Defined cases: ``und`` with score 0 for null texts and texts without a letter, and for
all texts if nothing could be learned; equal sums go to the first language by name; null
lang is not learned from; a null doc_id counts as not held out; repeated rows give
repeated results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import Powers, brief, flat, held_out, mix64, pieces, span_hash

BITS = 16
ORDERS = (2, 3, 4)
WINDOW = 64
TRAIN_ROWS, TRAIN_BYTES, EPOCHS = 1200, 20_000, 4
LEAST_SCORE = 0.35
PIECE_BYTES = 1 << 19
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[0x80:] = True
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_FACTORS = mix64(np.arange(11, 11 + max(ORDERS), dtype=np.uint64)) | np.uint64(1)


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # log weights


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and words as (start, end, row)."""
    lo, hi = int(off[0]), int(off[-1])
    text = _LOWER[data[lo:hi]]
    if not len(text):
        z = np.zeros(0, np.int64)
        return text, z, z, z
    # upper case of two-byte Latin letters
    second = np.zeros(len(text), bool)
    second[1:] = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)
    text = np.where(second, text + np.uint8(32), text)
    inside = _LETTER[text]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = off - lo
    at = cuts[:-1][cuts[:-1] < len(text)]
    first[at] = inside[at]
    at = cuts[1:][cuts[1:] > 0] - 1
    last[at] = inside[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return text, start, end, np.searchsorted(cuts, start, side="right") - 1


def features(text: np.ndarray, start: np.ndarray, end: np.ndarray, identity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each feature, place where each word's features begin)."""
    size = end - start + 2
    ends = np.cumsum(size)
    begin = ends - size
    marked = np.zeros(int(ends[-1]) + max(ORDERS), np.uint64)
    inner = np.arange(int(ends[-1])) - np.repeat(begin, size)
    edge = np.repeat(size, size)
    body = (inner > 0) & (inner < edge - 1)
    marked[:int(ends[-1])][body] = text[np.repeat(start, size)[body] + inner[body] - 1]
    marked[begin], marked[ends - 1] = 256, 257
    n = int(ends[-1])
    h, buckets, keep = None, [], []
    for k in range(max(ORDERS)):
        term = (marked[k:k + n] + np.uint64(1)) * _FACTORS[k]
        h = term if h is None else h + term
        if k + 1 in ORDERS:
            buckets.append((mix64(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int32))
            keep.append(inner + k < edge)
    # a word's features stand together: its n-grams of each order, then the whole word
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    flat_bucket = np.concatenate([b[k] for b, k in zip(buckets, keep)] + [(identity >> np.uint64(64 - BITS)).astype(np.int32)])
    flat_owner = np.concatenate([owner[k] for k in keep] + [np.arange(len(size), dtype=np.int32)])
    order = np.argsort(flat_owner, kind="stable")
    counts = np.bincount(flat_owner, minlength=len(size))
    return flat_bucket[order], np.cumsum(counts) - counts


def word_scores(weights: np.ndarray, buckets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[buckets], begin, axis=0)


class Chains:
    """Forward-backward over chains of ``count`` words each, laid out in windows."""

    def __init__(self, count: np.ndarray) -> None:
        self.windows = -(-count // WINDOW)
        self.total = int(self.windows.sum())
        self.first = np.cumsum(self.windows) - self.windows
        word_first = np.cumsum(count) - count
        inside = np.arange(int(count.sum())) - np.repeat(word_first, count)
        self.slot = np.repeat(self.first, count) * WINDOW + inside
        self.real = np.zeros(self.total * WINDOW, bool)
        self.real[self.slot] = True
        self.real = self.real.reshape(-1, WINDOW)
        self.is_last = np.zeros(self.total, bool)
        self.is_last[(self.first + self.windows - 1)[self.windows > 0]] = True

    def run(self, scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(marginals by word, forward and backward vectors by slot); ``scores`` in logs."""
        langs = scores.shape[1]
        e = np.ones((self.total * WINDOW, langs))
        e[self.slot] = np.exp(scores - scores.max(axis=1, keepdims=True))
        e = np.maximum(e, 1e-30).reshape(self.total, WINDOW, langs)
        a = np.exp(moves)
        norm = lambda x: x / x.sum(axis=-1, keepdims=True)
        # transfer matrices of the windows that others follow
        inner = np.flatnonzero(~self.is_last)
        step = np.broadcast_to(np.eye(langs), (len(inner), langs, langs))
        for t in range(WINDOW):
            step = (step * e[inner, t][:, None, :]) @ a
            step = step / step.sum(axis=(1, 2), keepdims=True)
        transfer = np.zeros((self.total, langs, langs))
        transfer[inner] = step
        back = np.ones((self.total, langs))  # at a window's first word
        last = np.flatnonzero(self.is_last)
        v = np.ones((len(last), langs))
        for t in range(WINDOW - 1, -1, -1):
            follows = self.real[last, t + 1] if t + 1 < WINDOW else np.zeros(len(last), bool)
            v = np.where(self.real[last, t][:, None], norm(e[last, t] * np.where(follows[:, None], v @ a.T, 1.0)), v)
        back[last] = v
        front = np.full((self.total, langs), 1.0 / langs)
        for k in range(1, int(self.windows.max(initial=0))):
            of = np.flatnonzero(self.windows > k)
            w = self.first[of] + k
            front[w] = norm((front[w - 1][:, None, :] @ transfer[w - 1])[:, 0])
            w = self.first[of] + self.windows[of] - 1 - k
            back[w] = norm((transfer[w] @ back[w + 1][:, :, None])[:, :, 0])
        # every window from its border vectors
        fwd, bwd = np.empty_like(e), np.empty_like(e)
        v = front
        for t in range(WINDOW):
            fwd[:, t] = v
            v = norm((v * e[:, t]) @ a)
        after = np.ones((self.total, langs))
        after[inner] = back[inner + 1]
        follows_window = ~self.is_last
        v = after
        for t in range(WINDOW - 1, -1, -1):
            follows = self.real[:, t + 1] if t + 1 < WINDOW else follows_window
            v = np.where(self.real[:, t][:, None], norm(e[:, t] * np.where(follows[:, None], v @ a.T, 1.0)), after)
            bwd[:, t] = v
        fwd, bwd = fwd.reshape(-1, langs), bwd.reshape(-1, langs)
        return norm(fwd[self.slot] * bwd[self.slot]), fwd * e.reshape(-1, langs), bwd


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Stochastic gradient ascent (a rate for each weight) on code-switched chains."""
    languages = sorted(set(langs))
    index = {x: i for i, x in enumerate(languages)}
    data, off = flat(pa.array(texts, pa.string()))
    text, start, end, row = words(data, off)
    model = Model(languages, np.zeros((1 << BITS, len(languages))), np.zeros((len(languages), len(languages))))
    if not len(start):
        return Model()
    identity, at, inverse = np.unique(span_hash(text, start, end, Powers(), lower=False), return_index=True, return_inverse=True)
    parts, begin, full = [], [], 0
    for lo in range(0, len(at), 10_000):  # the driver's work space stays small
        some = at[lo:lo + 10_000]
        f, first = features(text, start[some], end[some], identity[lo:lo + 10_000])
        parts.append(f)
        begin.append(first + full)
        full += len(f)
    buckets, begin = np.concatenate(parts), np.concatenate(begin)
    ends = np.append(begin[1:], len(buckets))
    truth = np.array([index[x] for x in langs])[row]
    rng = np.random.default_rng(seed)
    # turns of 5 to 30 words of one document, dealt into chains at random
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    turns = []
    for lo, hi in zip(first, np.append(first[1:], len(row))):
        while lo < hi:
            step = int(rng.integers(5, 31))
            turns.append((lo, min(lo + step, hi)))
            lo += step
    seen_w, seen_m = np.full(model.weights.shape, 1.0), np.full(model.moves.shape, 1.0)
    for epoch in range(EPOCHS):
        order = rng.permutation(len(turns))
        for lo in range(0, len(order), 400):
            mine = [np.arange(*turns[k]) for k in order[lo:lo + 400]]
            chains = [np.concatenate(mine[k:k + 8]) for k in range(0, len(mine), 8)]
            count = np.array([len(c) for c in chains])
            word = np.concatenate(chains)
            kinds, place = np.unique(inverse[word], return_inverse=True)
            size = ends[kinds] - begin[kinds]
            f_begin = np.cumsum(size) - size
            f = buckets[np.repeat(begin[kinds] - f_begin, size) + np.arange(int(size.sum()))]
            scores = word_scores(model.weights, f, f_begin)[place]
            layout = Chains(count)
            marginal, alpha, beta = layout.run(scores, model.moves)
            gold = truth[word]
            miss = -marginal
            miss[np.arange(len(gold)), gold] += 1
            by_kind = np.zeros((len(kinds), len(languages)))
            np.add.at(by_kind, place, miss)
            grad = np.zeros_like(model.weights)
            np.add.at(grad, f, np.repeat(by_kind, size, axis=0))
            follow = np.ones(len(word), bool)
            follow[np.cumsum(count) - count] = False
            b = np.flatnonzero(follow)
            pair = alpha[layout.slot[b - 1]][:, :, None] * np.exp(model.moves) * beta[layout.slot[b]][:, None, :]
            expected = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            move = -expected
            np.add.at(move, (gold[b - 1], gold[b]), 1)
            move /= len(word)
            grad = grad / len(word) * 50 - 1e-5 * model.weights
            seen_w += grad * grad
            seen_m += move * move
            model.weights += 0.5 * grad / np.sqrt(seen_w)
            model.moves += 1.0 * move / np.sqrt(seen_m)
    return model


def fit(docs: DataFrame) -> Model:
    rows = docs.where("lang is not null and text is not null").where(~held_out("doc_id"))
    short = F.octet_length("text") <= TRAIN_BYTES
    have = {r["lang"]: (r["short"], r["n"]) for r in rows.groupBy("lang").agg(
        F.count(F.when(short, 1)).alias("short"), F.count("*").alias("n")).collect()}  # a row a language
    if not have:
        return Model()
    # languages with too few short rows are learned from the beginnings of their long ones too
    each = TRAIN_ROWS / len(have)
    scarce = [lang for lang, (few, n) in sorted(have.items()) if few < min(each, n)]
    rows = rows.where(short | F.col("lang").isin(scarce)).withColumn("text", F.when(short, F.col("text")).otherwise(F.left("text", F.lit(TRAIN_BYTES // 4))))
    share = F.create_map(*[F.lit(x) for lang, (few, n) in sorted(have.items()) for x in (lang, min(1.0, each / (n if lang in scarce else few)))])
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 20)) / (1 << 20)
    some = rows.where(draw < share[F.col("lang")]).select("text", "lang").limit(4 * TRAIN_ROWS).toPandas()
    some = some.sort_values(["lang", "text"])
    return train(some["text"].tolist(), some["lang"].tolist()) if len(some) else Model()


def predict(model: Model, texts: pa.Array, powers: Powers) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    data, off = flat(texts)
    text, start, end, row = words(data, off)
    # runs without an ASCII letter may hold none at all
    ascii_letters = np.concatenate([[0], np.cumsum((text >= ord("a")) & (text <= ord("z")))])
    plain = ascii_letters[off[1:] - off[0]] > ascii_letters[off[:-1] - off[0]]
    has = plain | np.array([not p and any(c.isalpha() for c in (texts[i].as_py() or "")) for i, p in enumerate(plain)], bool)
    total = np.zeros((n, max(1, len(model.languages))))
    count = np.bincount(row, minlength=n)
    if len(start) and model.languages:
        identity, at, inverse = np.unique(span_hash(text, start, end, powers, lower=False), return_index=True, return_inverse=True)
        buckets, begin = features(text, start[at], end[at], identity)
        marginal, _, _ = Chains(count).run(word_scores(model.weights, buckets, begin)[inverse], model.moves)
        for k in range(len(model.languages)):
            total[:, k] = np.bincount(row, marginal[:, k], minlength=n)
    best = total.argmax(axis=1)
    known = has & (count > 0) & bool(model.languages)
    score = np.where(known, total[np.arange(n), best] / np.maximum(count, 1), 0.0)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)], np.clip(score, 0, 1)


def label(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in pieces(batches, "text", PIECE_BYTES):
            lang, score = predict(model, b.column("text"), powers)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)],
                                             names=["doc_id", "lang_pred", "score"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, lang_pred string, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return label(docs, fit(docs))


def keep_known(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs`` with a known language of at least this score, with their columns."""
    model = fit(docs)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for b in pieces(batches, "text", PIECE_BYTES):
            lang, score = predict(model, b.column("text"), powers)
            yield b.filter(pa.array((np.array(lang) != UNKNOWN) & (score >= least)))
    return docs.mapInArrow(brief(kernel), docs.schema)
