"""Exact neighbour search (no cross join).

``knn_join`` returns the long table ``knn(i, j, d2, r)`` — the k nearest
neighbours of every row, nearest first, ties broken by ``j``.

Few blocks of rows meet all blocks. From ``DIRECT_BLOCKS`` blocks on, rows are placed first:
every row goes to its nearest pivot (a bounded sample), a pivot's rows are a *cell* with a
covering radius, and cells of many rows are split into blocks. A block's rows find their k-th
distance among themselves; a cell whose pivot is farther than that bound and its
radius together holds no nearer row, so the block leaves it out. What is left is
searched in groups of (super-block of rows, super-block of candidates) of at most
``SUPER_ROWS`` rows each: a vector is copied once for each group, n / SUPER_ROWS times at
the most, and only the pairs of blocks that can meet are multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmaps.operators import blocks
from tmaps.session import stored

PIVOTS = 4096
SUPER_ROWS = 131_072
DIRECT_BLOCKS = 8
SLACK = 1e-9  # relative rounding allowed in bounds


def row_norms(vectors: DataFrame) -> DataFrame:
    """``(id, norm)`` — L2 norm of each row, JVM-side higher-order function."""
    return vectors.select(
        "id", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))


def _blocked(vectors: DataFrame, n: int | None, block_rows: int):
    spark = vectors.sparkSession
    if n is None:
        n = vectors.count()
    nb = blocks.choose_blocks(n, block_rows, blocks.default_min_groups(spark))
    rep = blocks.replicate_pairs(blocks.with_block(vectors.select("id", "v"), nb), nb)
    return rep.groupBy("_lo", "_hi"), nb


def pair_distances(vectors: DataFrame, n: int | None = None, block_rows: int = 2048) -> DataFrame:
    """All-pairs squared distances, reduced per row: ``(i, n_pairs, d2_min, d2_max, d2_sum)``.

    Every ordered pair (i, j ≠ i) is evaluated once inside a block-pair group;
    only per-row partials leave the kernel, combined by a keyed aggregate.
    """
    grouped, _ = _blocked(vectors, n, block_rows)
    part = grouped.applyInArrow(blocks.dist_summary_kernel, blocks.DIST_SUMMARY_SCHEMA)
    return part.groupBy("i").agg(
        F.sum("n_pairs").cast("bigint").alias("n_pairs"),
        F.min("d2_min").alias("d2_min"),
        F.max("d2_max").alias("d2_max"),
        F.sum("d2_sum").alias("d2_sum"))


@dataclass
class Placed:
    """Rows (id, v, cell, blk) by their nearest pivots; a cell's blocks are numbered in a row."""
    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray  # of each cell
    first: np.ndarray  # block of each cell
    parts: np.ndarray  # blocks of each cell

    def of_cell(self, values: np.ndarray, cell: str = "cell") -> str:
        return f"element_at(array({', '.join(map(str, values.tolist()))}), {cell} + 1)"


def place(vectors: DataFrame, n: int, block_rows: int) -> Placed:
    """Rows by nearest pivot, in blocks of about ``block_rows``."""
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    sample = (vectors.where(finite).orderBy(F.xxhash64("id"), "id").limit(max(1, min(PIVOTS, math.ceil(n / block_rows)))).select("v").toArrow())
    pivots = np.unique(blocks._matrix(sample["v"]), axis=0) if sample.num_rows else np.zeros((1, 0))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, block_rows):
                some = b.slice(lo, block_rows)
                x = blocks._matrix(some.column("v"))
                if pivots.shape[1]:
                    d = blocks.sq_dist(x, pivots)
                    d = np.where(np.isnan(d), np.inf, d)
                    cell = d.argmin(axis=1)
                    away = np.sqrt(d[np.arange(len(x)), cell])
                else:
                    cell, away = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("v"), pa.array(cell.astype(np.int32)), pa.array(away)], names=["id", "v", "cell", "away"])

    rows = stored(vectors.select("id", "v").mapInArrow(kernel, "id bigint, v array<double>, cell int, away double"), "placed")
    radius, count = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max(F.when(F.col("away") < float("inf"), F.col("away"))).alias("r")).collect():  # <= PIVOTS rows
        radius[r["cell"]], count[r["cell"]] = r["r"] or 0.0, r["n"]
    parts = np.maximum(1, -(-count // block_rows))
    placed = Placed(rows, pivots, radius, np.cumsum(parts) - parts, parts)
    placed.rows = rows.withColumn("blk", F.expr(f"cast({placed.of_cell(placed.first)} + pmod(xxhash64(id), {placed.of_cell(parts)}) as int)")).drop("away")
    return placed


def reachable(placed: Placed, k: int) -> DataFrame:
    """``(blk, cell)``: the cells that can hold one of the k nearest of a row of the block."""
    pivots, radius = placed.pivots, placed.radius

    def kernel(key, group):
        x, ids = blocks._matrix(group.column("v")), blocks._np(group, "id", np.int64)
        bound = np.full(len(x), np.inf)
        if len(x) > k:
            for lo in range(0, len(x), 1024):
                d = blocks.sq_dist(x[lo:lo + 1024], x)
                d[ids[lo:lo + 1024][:, None] == ids[None, :]] = np.inf
                bound[lo:lo + 1024] = np.sqrt(np.partition(d, k - 1, axis=1)[:, k - 1])
        hit = np.zeros(len(pivots), bool)
        for lo in range(0, len(x), 512):
            away = np.sqrt(blocks.sq_dist(x[lo:lo + 512], pivots)) if pivots.shape[1] else np.zeros((len(x[lo:lo + 512]), len(pivots)))
            # equal similarities of slightly larger distances count too
            limit = np.sqrt(bound[lo:lo + 512] ** 2 * (1 + SLACK) + SLACK)[:, None]
            hit |= (away * (1 - SLACK) - radius[None, :] * (1 + SLACK) <= limit).any(axis=0)
        cells = np.flatnonzero(hit)
        return pa.table({"blk": pa.array(np.full(len(cells), key[0].as_py(), np.int32)), "cell": pa.array(cells.astype(np.int32))})

    return placed.rows.groupBy("blk").applyInArrow(kernel, "blk int, cell int")


def _pruned(vectors: DataFrame, k: int, n: int, block_rows: int, kernel, schema: str) -> DataFrame:
    """Candidates of every row from the cells that its block reaches."""
    placed = place(vectors, n, block_rows)
    total = int(placed.parts.sum())
    # a row has k candidates for every super-block of candidates, so these are as large as SUPER_ROWS allows;
    # those of rows are as small as cores with several groups each ask for
    groups = 2 * blocks.default_min_groups(vectors.sparkSession)
    cols = max(math.ceil(total * block_rows / SUPER_ROWS), min(2, total))
    wide_b = math.ceil(total / cols)
    wide_a = max(1, min(SUPER_ROWS // block_rows, math.ceil(total / math.ceil(groups / cols))))
    groups = math.ceil(total / wide_a) * math.ceil(total / wide_b)
    visits = reachable(placed, k).selectExpr("blk", f"cast(blk div {wide_a} as int) as sa", "cell", f"explode(sequence(cast({placed.of_cell(placed.first)} div {wide_b} as int), "
                                             f"cast(({placed.of_cell(placed.first)} + {placed.of_cell(placed.parts)} - 1) div {wide_b} as int))) as sb")
    visits = stored(visits, "visits")
    as_row = placed.rows.join(visits.select("blk", "sa", "sb").distinct(), "blk").select("sa", "sb", F.lit(True).alias("_row"), "id", "v", "blk", "cell")
    as_candidate = (placed.rows.withColumn("sb", F.expr(f"cast(blk div {wide_b} as int)")).join(visits.select("sa", "cell", "sb").distinct(), ["cell", "sb"])
                    .select("sa", "sb", F.lit(False).alias("_row"), "id", "v", "blk", "cell"))
    parts = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups, 8 * blocks.default_min_groups(vectors.sparkSession)))
    pairs = visits.select(F.col("sa").alias("of_a"), F.col("sb").alias("of_b"), "blk", "cell").repartition(parts, "of_a", "of_b")
    return (as_row.union(as_candidate).repartition(parts, "sa", "sb").groupBy("sa", "sb")
            .cogroup(pairs.groupBy("of_a", "of_b")).applyInArrow(kernel, schema))


def knn_join(vectors: DataFrame, k: int, n: int | None = None, block_rows: int = 2048) -> DataFrame:
    """Exact k nearest neighbours ``knn(i, j, d2, r)``, r = 1 for the nearest: each group
    keeps k candidates a row, and only those partial lists are merged by row."""
    if k <= 0:
        return vectors.sparkSession.createDataFrame([], "i bigint, j bigint, d2 double, r int")
    spark = vectors.sparkSession
    if n is None:
        n = vectors.count()
    if n > DIRECT_BLOCKS * block_rows:
        cand = _pruned(vectors, k, n, block_rows, blocks.visiting_kernel(k), blocks.KNN_SCHEMA)
    else:
        # enough row blocks for every core, but never blocks below MIN_BLOCK_ROWS rows
        nb = max(math.ceil(n / block_rows),
                 min(spark.sparkContext.defaultParallelism, math.ceil(n / blocks.MIN_BLOCK_ROWS)), 1)
        rep = blocks.replicate_directed(blocks.with_block(vectors.select("id", "v"), nb), nb, 1)
        cand = rep.groupBy("_br", "_sc").applyInArrow(blocks.directed_knn_kernel(k), blocks.KNN_SCHEMA)
    w = Window.partitionBy("i").orderBy("d2", "j")
    return (cand.withColumn("r", F.row_number().over(w))
            .where(F.col("r") <= k)
            .select("i", "j", "d2", F.col("r").cast("int").alias("r")))


def nearest_in_map(state: DataFrame, k: int, dims: int, n: int, block_rows: int = 1024) -> DataFrame:
    """Candidates ``(i, j, qz)`` for the k largest kernels 1 / (1 + d²) of every row of one map."""
    vectors = state.select(F.col("id").cast("bigint").alias("id"), F.array(*[f"y{m}" for m in range(1, dims + 1)]).alias("v"))
    return _pruned(vectors, k, n, block_rows, blocks.visiting_kernel(k, by_kernel=True), blocks.TOPQ_SCHEMA)


def neighbours_for_perplexity(perplexity: float) -> int:
    """k = int(3 * perplexity)."""
    return int(3 * perplexity)
