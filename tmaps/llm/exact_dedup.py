"""Exact dedup: composable polynomial fingerprints, then chunkwise comparison.

A text is one polynomial over its (white-space normalised) bytes, taken modulo two
primes. A chunk's hash moves to its place by one factor: hash(a + b) =
hash(a) * BASE**len(b) + hash(b). Ordinary texts combine their chunks inside one
task; the chunks of a huge text are rows of their own, hashed anywhere, and Spark's
sum over (chunk hash * BASE**bytes after it) is the same polynomial.

Equal (hash, hash, length) only makes candidates: each candidate's chunks are joined
to the chunks of its group's smallest doc_id and compared byte by byte; texts that
differ go to another round with a representative of their own.

Defined cases: null text is the empty text, and all empty texts are equal; rows that
repeat a doc_id with the same text share one decision (the filter keeps one of them); a
null doc_id ranks after every other id, so it stays only where its group has no other;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import WHITE, flat, own, stored

WHITE_RUN = r"[\x20\x09-\x0D]+"
PRIMES = (2147483647, 2147483629)
BASE = 1_000_003
CHUNK_BYTES = 1 << 16
HUGE_BYTES = 1 << 22
PART_ROWS = 500
LAST_ID = (1 << 63) - 1  # stands for a null doc_id while rows are compared
KEY = ["f1", "f2", "n_bytes"]


def normalised(text: np.ndarray) -> np.ndarray:
    """Each run of white space as one space."""
    white = WHITE[text]
    if not white.any():
        return text
    again = white.copy()
    again[0] = False
    again[1:] &= white[:-1]
    return np.where(white, np.uint8(0x20), text)[~again]


class Polynomial:
    """Chunk hashes and their length-shifted sum modulo ``primes``."""

    def __init__(self, chunk: int = CHUNK_BYTES, primes=PRIMES) -> None:
        self.chunk, self.primes = chunk, primes
        self.powers = []
        for p in primes:
            t = np.ones(chunk, dtype=np.uint64)
            have = 1
            while have < chunk:
                take = min(have, chunk - have)
                t[have:have + take] = t[:take] * np.uint64(pow(BASE, have, p)) % np.uint64(p)
                have += take
            self.powers.append(t[::-1].copy())

    def of_chunk(self, b: np.ndarray) -> list[int]:
        """Terms stay below 2**40, so a chunk's sum fits 64 bits."""
        wide = b.astype(np.uint64) + np.uint64(1)
        return [int((wide * t[self.chunk - len(b):]).sum() % np.uint64(p)) for t, p in zip(self.powers, self.primes)]

    def of(self, b: np.ndarray) -> list[int]:
        out = [0] * len(self.primes)
        for at in range(0, len(b), self.chunk):
            part = b[at:at + self.chunk]
            out = [(h * pow(BASE, len(part), p) + c) % p for h, c, p in zip(out, self.of_chunk(part), self.primes)]
        return out


def _whole(chunk: int, primes):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(chunk, primes)
        for b in batches:
            data, off = flat(b.column("text"))
            out = ([], [], [], [])
            for i in range(b.num_rows):
                t = normalised(data[off[i]:off[i + 1]])
                h = poly.of(t)
                for column, v in zip(out, (len(t), h[0], h[1], hashlib.sha256(t).digest())):
                    column.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary())],
                names=["doc_id", "n_bytes", "f1", "f2", "sha"])
    return kernel


def _terms(chunk: int, primes):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poly = Polynomial(chunk, primes)
        for b in batches:
            data, off = flat(b.column("chunk"))
            after = b.column("after").to_pylist()
            terms = ([], [])
            for i in range(b.num_rows):
                for column, c, p in zip(terms, poly.of_chunk(data[off[i]:off[i + 1]]), primes):
                    column.append(c * pow(BASE, after[i], p) % p)
            yield pa.RecordBatch.from_arrays(
                [b.column(x) for x in ("row", "doc_id", "n_bytes", "sha")] + [pa.array(x, pa.int64()) for x in terms],
                names=["row", "doc_id", "n_bytes", "sha", "t1", "t2"])
    return kernel


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _norm(text) -> F.Column:
    return F.regexp_replace(text, WHITE_RUN, " ").cast("binary")


def _cut(rows: DataFrame, chunk: int) -> DataFrame:
    """One row per chunk of the binary column ``norm``; an empty text has one."""
    last = F.greatest(F.ceil(F.octet_length("norm") / chunk).cast("int") - 1, F.lit(0))
    return (rows.withColumn("no", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("chunk", F.substring("norm", F.col("no") * chunk + 1, F.lit(chunk))).drop("norm"))


def fingerprints(docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES, primes=PRIMES) -> DataFrame:
    """(doc_id, n_bytes, f1, f2, sha) of every text. The chunks of texts of ``huge``
    bytes and more are hashed as rows of their own; both ways give the same numbers."""
    rows, schema = _rows(docs), "doc_id long, n_bytes long, f1 long, f2 long, sha binary"
    small = rows.where(F.octet_length("text") < huge).mapInArrow(_whole(chunk, primes), schema)
    large = (rows.where(F.octet_length("text") >= huge)
             .select(F.monotonically_increasing_id().alias("row"), "doc_id", _norm("text").alias("norm"))
             .withColumn("n_bytes", F.octet_length("norm").cast("long")).withColumn("sha", F.unhex(F.sha2("norm", 256))))
    terms = (_cut(large, chunk)
             .withColumn("after", F.greatest(F.col("n_bytes") - (F.col("no") + 1) * chunk, F.lit(0)))
             .repartition("row", "no")
             .mapInArrow(_terms(chunk, primes), "row long, doc_id long, n_bytes long, sha binary, t1 long, t2 long"))
    summed = terms.groupBy("row", "doc_id", "n_bytes", "sha").agg(
        (F.sum("t1") % primes[0]).alias("f1"), (F.sum("t2") % primes[1]).alias("f2"))
    return small.unionByName(summed.drop("row"))


def compared(docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES, primes=PRIMES) -> DataFrame:
    """The fingerprint of every document, with the smallest id (rep; null: alone) of its text's group and keep_id."""
    key = KEY
    fp = stored(fingerprints(docs, chunk, huge, primes), "fingerprints")
    many = fp.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    # a group of many rows is compared in parts, each beside a copy of the group's first text
    many = many.withColumn("parts", F.ceil(F.col("n") / PART_ROWS).cast("int")).drop("n")
    # in this order Spark can split a hot group; written, as five places of a round's plan read it
    rest = stored(fp.distinct().join(many, key), "candidates")
    # the candidates' texts, found again by id and paired with their own digest
    text = _rows(docs).join(rest.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("norm", _norm("text"))
    text = text.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
    done = None
    while True:
        # one row per (group, text of a document): its chunks beside those of the group's smallest id
        reps = rest.groupBy(*key, "parts").agg(F.min(F.struct("doc_id", "sha")).alias("r")).select(*key, "parts", "r.*")
        mine = _cut(text.join(rest, ["doc_id", "sha"]), chunk).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        first = _cut(text.join(reps, ["doc_id", "sha"]), chunk).groupBy(*key, "parts", "no").agg(
            F.min("doc_id").alias("rep"), F.first("chunk").alias("rep_chunk"))
        first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        same = stored(mine.join(first, [*key, "no", "part"]).groupBy(*key, "parts", "sha", "doc_id", "rep")
                      .agg(F.min(F.col("chunk") == F.col("rep_chunk")).alias("same")), "compared")
        found = same.where("same").drop("same", "parts")
        done = found if done is None else done.unionByName(found)
        rest = same.where("not same").drop("same", "rep")
        if rest.isEmpty():
            break
    return fp.join(done, [*key, "sha", "doc_id"], "left").withColumn("keep_id", F.coalesce("rep", "doc_id"))


def exact_groups(docs: DataFrame, chunk: int = CHUNK_BYTES, huge: int = HUGE_BYTES, primes=PRIMES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    key, out = KEY, compared(docs, chunk, huge, primes)
    sizes = (out.where("rep is not null").groupBy(*key, F.col("keep_id").alias("of")).agg(F.count("*").alias("size")))
    sizes = sizes.select(*(F.col(c).alias(f"of_{c}") for c in key), "of", "size")
    out = out.join(sizes, [F.col(c) == F.col(f"of_{c}") for c in key] + [F.col("rep") == F.col("of")], "left")
    real = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return out.select(real("doc_id").alias("doc_id"), real("keep_id").alias("keep_id"),
                      F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                      (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each text, with their columns."""
    number, digest = own("id", "sha")
    # LAST_ID stands for a null id, which stays only where its text is alone or all its group's ids are null
    keep = compared(docs).where("doc_id = keep_id").select(F.col("doc_id").alias(number), F.lower(F.hex("sha")).alias(digest))
    mine = docs.withColumns({number: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)),
                             digest: F.sha2(_norm(F.coalesce("text", F.lit(""))), 256)})
    return mine.join(keep, [number, digest], "left_semi").dropDuplicates([number, digest]).drop(number, digest)
