"""Toxicity: a character n-gram linear classifier with naive Bayes scaled features.

A text's features are the distinct n-grams of 4, 5 and 6 characters of its lower-cased
form (runs of white space as one space, with marks before and after the text), hashed
into 2**21 buckets. A feature's value is its naive Bayes log-count ratio, the log of
(share of toxic texts that hold it / share of the others), and a logistic regression
over these values gives the score.

Fit. Labelled rows that are not held out, at most ``TOXIC_ROWS`` of label 1 and
``CLEAN_ROWS`` of label 0 (those with the smallest hashes of their ids; class weights
restore the true shares), equal texts once. Spark counts buckets over the sample, keeps
the ``FEATURES`` buckets of the highest chi-square, and the driver fits their weights on
the sample's sparse rows: its work is bounded by these parameters. Scoring reads every
whole text, in pieces of about 0.5 MB.

Defined cases: null and empty texts have only the marks' n-grams and get a score; null
labels are not learned from; of several labels for one document the highest counts;
without both labels every score is the share of label 1 (0 without labels); a null
doc_id counts as not held out; repeated rows give repeated results; an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import brief, held_out, mix64, pieces

ORDERS = (4, 5, 6)
BITS = 21
TOXIC_ROWS, CLEAN_ROWS, FEATURES = 4000, 8000, 2000
THRESHOLD = 0.3
PIECE_BYTES = 1 << 19
LEAST_COUNT = 5
_FACTORS = mix64(np.arange(1, 1 + max(ORDERS), dtype=np.uint64)) | np.uint64(1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_PAD = "\0" * max(ORDERS)


@dataclass
class Model:
    buckets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # ratio times learned weight
    bias: float = -30.0


def grams(texts: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) of the texts' n-grams, by row and bucket; of ``wanted``
    (a flag for each bucket) only, if given."""
    parts = [" ".join(t.replace("\0", " ").lower().split()) for t in texts]
    units = np.frombuffer((_PAD + _PAD.join(parts) + _PAD).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.array([len(p) for p in parts]) + len(_PAD)
    begin = np.cumsum(size) - size  # a text owns the marks before it
    wide = units.astype(np.uint64)
    h, found = None, []
    n_all = int(size.sum())
    for k in range(max(ORDERS)):
        term = wide[k:k + n_all] * _FACTORS[k]
        h = term if h is None else h + term
        if k + 1 in ORDERS:
            bucket = ((h ^ (h >> np.uint64(29))) * _SPREAD >> np.uint64(64 - BITS)).astype(np.int64)
            at = np.arange(n_all) if wanted is None else np.flatnonzero(wanted[bucket])
            found.append(np.searchsorted(begin, at, side="right") - 1 << BITS | bucket[at])
    key = np.unique(np.concatenate(found))
    return key >> BITS, key & (1 << BITS) - 1


def fit_weights(rows: np.ndarray, cols: np.ndarray, ratio: np.ndarray, y: np.ndarray, share: np.ndarray,
                penalty: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weighted logistic regression on sparse binary rows whose columns are scaled by
    ``ratio``: accelerated gradient steps. Returns weights (scaled back) and bias."""
    n, m = len(y), len(ratio)
    values = ratio[cols]
    norm = np.bincount(rows, values * values, minlength=n)
    # a step for each column by its own curvature keeps rare and frequent columns level
    curve = 0.25 * np.bincount(cols, share[rows] * np.abs(values) * np.sqrt(norm[rows] + 1), minlength=m)
    scale = 1.0 / (curve + penalty)
    w, bias, vw, vb = np.zeros(m), float(np.log((share * y).sum() / (share * (1 - y)).sum())), np.zeros(m), 0.0
    uw, ub = w.copy(), bias
    for t in range(1, steps + 1):
        z = np.bincount(rows, values * uw[cols], minlength=n) + ub
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        gw = np.bincount(cols, values * g[rows], minlength=m) + penalty * uw
        new_w, new_b = uw - scale * gw, ub - 0.5 * g.sum() / (0.25 * share.sum())
        move = (t - 1) / (t + 2)
        uw, ub = new_w + move * (new_w - w), new_b + move * (new_b - bias)
        w, bias = new_w, new_b
    return w * ratio, bias


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Labelled training texts, (text, toxic), within the bounds, and all rows by label."""
    label = (labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("__id"))
             .agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out("__id")))
    have = {r["toxic"]: r["n"] for r in label.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    pick = None
    for toxic, most in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        some = label.where(F.col("toxic") == toxic).orderBy(F.xxhash64("__id"), "__id").limit(most)
        pick = some if pick is None else pick.unionByName(some)
    # at most TOXIC_ROWS + CLEAN_ROWS pairs of numbers
    text = docs.select(F.col("doc_id").cast("long").alias("__id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(pick), "__id").select("text", "toxic").distinct(), have


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows, have = sample(docs, labels)
    total = sum(have.values())
    if not have.get(1) or not have.get(0):
        return Model(bias=30.0 if have.get(1) else -30.0)
    rows = rows.cache()
    try:
        got = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if not got.get(1) or not got.get(0):
            return Model(bias=30.0 if got.get(1) else -30.0)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((2, 1 << BITS), np.int32)
            for b in pieces(batches, "text", PIECE_BYTES):
                row, bucket = grams(b.column("text").to_pylist())
                toxic = np.asarray(b.column("toxic"))[row]
                for c in (0, 1):
                    at, n = np.unique(bucket[toxic == c], return_counts=True)
                    seen[c, at] += n.astype(np.int32)
            at = np.flatnonzero(seen.any(axis=0))
            for k in range(0, len(at), 100_000):
                some = at[k:k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some], pa.int64()), pa.array(seen[1, some], pa.int64())],
                                                 names=["bucket", "clean", "toxic"])

        p, q = got[1], got[0]
        held = rows.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(
            F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
        both, n = F.col("toxic") + F.col("clean"), p + q
        chi = F.pow(F.col("toxic") * q - F.col("clean") * p, 2) * n / (both * (n - both) * p * q)
        best = held.where((both >= LEAST_COUNT) & (both < n)).orderBy(chi.desc(), "bucket").limit(FEATURES).toPandas().sort_values("bucket")
        buckets = best["bucket"].to_numpy()
        if not len(buckets):
            return Model(bias=float(np.log(have[1] / have[0])))
        # log-count ratios with one added to each count
        ratio = np.log((best["toxic"].to_numpy() + 1) / (p + 2)) - np.log((best["clean"].to_numpy() + 1) / (q + 2))

        def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = np.zeros(1 << BITS, bool)
            wanted[buckets] = True
            for b in pieces(batches, "text", PIECE_BYTES):
                row, bucket = grams(b.column("text").to_pylist(), wanted)
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                cols = np.searchsorted(buckets, bucket).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(cols))],
                                                 names=["toxic", "cols"])

        sparse = rows.mapInArrow(select, "toxic int, cols array<int>").toArrow()
    finally:
        rows.unpersist()
    y = np.asarray(sparse["toxic"].combine_chunks()).astype(float)
    lists = sparse["cols"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    row = np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets)))
    share = np.where(y == 1, have[1] / total * n / p, have[0] / total * n / q)
    weights, bias = fit_weights(row, np.asarray(lists.flatten()).astype(np.int64), ratio, y, share)
    return Model(buckets, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _scored(rows: DataFrame, model: Model) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS)
        weight[model.buckets] = model.weights
        wanted = weight != 0
        for b in pieces(batches, "text", PIECE_BYTES):
            row, bucket = grams([t or "" for t in b.column("text").to_pylist()], wanted)
            z = np.bincount(row, weight[bucket], minlength=b.num_rows) + model.bias
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))))], names=["doc_id", "score"])
    return rows.mapInArrow(kernel, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` scored below the threshold, with their columns."""
    model = fit(docs, labels)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << BITS)
        weight[model.buckets] = model.weights
        wanted, limit = weight != 0, np.log(THRESHOLD / (1 - THRESHOLD))
        for b in pieces(batches, "text", PIECE_BYTES):
            row, bucket = grams([t or "" for t in b.column("text").to_pylist()], wanted)
            z = np.bincount(row, weight[bucket], minlength=b.num_rows) + model.bias
            yield b.filter(pa.array(z < limit))
    return docs.mapInArrow(brief(kernel), docs.schema)
