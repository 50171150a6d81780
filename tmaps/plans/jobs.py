"""Embedding jobs: exact t-SNE, Barnes-Hut t-SNE and multiple-maps t-SNE.

Each iteration is one lazily built DataFrame plan over the keyed state
(``state(id, map, y*, …)``); the loop itself runs on the driver but only
scalars (Z, sumQ, losses, means, preservation) come back.  Every ``checkpoint_every``
iterations (persisted in between) the state is written as a table of its own and read
again, so a lost executor costs at most that many iterations of recompute, and the
next plan starts from a table of known size.

The tables stand below the session's shared checkpoint folder, or below ``state_path``, as
``<state_path>/<run_id>/iteration-<k>``; the file that Spark writes last marks one as
committed. A job that finds committed iterations of its ``run_id`` under ``state_path`` goes on after the
last of them: it gives the same map as one that never stopped. Frames and metrics
of an iteration are written before its state, and again replace their own partition.
"""

from __future__ import annotations

import math
import re
import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tmaps.functions.columns import gaussian_col
from tmaps.operators import affinity, blocks, cells, kernel, metrics, multimap, neighbors, update
from tmaps.params import TSNEParams
from tmaps.session import checkpoint as reliable_checkpoint, checkpoint_by, committed, drop_table, scratch_path, stored
from tmaps.streaming import frames


HALO_ROWS = 16_384  # points of a block of P edges


@dataclass
class RunResult:
    run_id: str
    state: DataFrame
    metrics: list[tuple[int, str, float]] = field(default_factory=list)

    def metrics_df(self, spark):
        return frames.metrics_frame(spark, self.run_id, self.metrics)


def _d(prefix, dims):
    return [f"{prefix}{k}" for k in range(1, dims + 1)]


def init_map(ids: DataFrame, dims: int = 2, maps: int = 1, seed: int = 0, scale: float = 1.0) -> DataFrame:
    """Random start ``(id, map, y*)`` ~ N(0, scale²), a pure function of (seed, id, map, dim):
    identical under any partitioning or recompute."""
    base = ids.select(F.col("id").cast("bigint").alias("id"))
    base = base.select("id", F.explode(F.sequence(F.lit(0), F.lit(maps - 1))).alias("map"))
    return base.select("id", F.col("map").cast("int").alias("map"),
                       *[(F.lit(float(scale)) * gaussian_col(seed, F.col("id"), F.col("map"), F.lit(k))).alias(f"y{k}")
                         for k in range(1, dims + 1)])


def affinities(vectors: DataFrame, perplexity: float = 30.0, n: int | None = None, tol: float = 1e-5,
               floor: float | None = 1e-12):
    """k-NN → calibrated conditional p → joint P (checkpointed once); returns ``(joint, betas, n)``."""
    if n is None:
        n = vectors.count()
    knn = neighbors.knn_join(vectors, neighbors.neighbours_for_perplexity(perplexity), n=n)
    cond, betas = affinity.cond_affinity(knn, perplexity, tol, with_betas=True)
    betas = reliable_checkpoint(betas)
    joint = reliable_checkpoint(affinity.joint_affinity(cond, n, floor))
    return joint, betas, n


def _keyed_edges(spark, joint: DataFrame, n: int, n_maps: int, block_rows: int | None = None):
    """Block count for the fused per-iteration pass and the P edges keyed by block pair
    (static for the whole run, so written once)."""
    nb = blocks.map_blocks(n, n_maps, blocks.default_min_groups(spark), block_rows)
    # the checkpoint keeps the co-group's partitioning and order, so an iteration shuffles only
    # the replicated positions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kedges = checkpoint_by(blocks.key_edges(joint, nb), parts, "_lo", "_hi", ordered=("_lo", "_hi"))
    return nb, kedges


class _Stepper:
    """Commits the evolving state: as a table every few iterations, persisted in between."""

    def __init__(self, spark, run_id: str, checkpoint_every: int, state_path: str | None):
        self.spark, self.every = spark, max(1, int(checkpoint_every))
        self.folder = f"{state_path.rstrip('/')}/{run_id}" if state_path else scratch_path(spark, f"run-{run_id}")
        self.prev: DataFrame | None = None

    def last(self) -> tuple[int, DataFrame] | None:
        """The last committed iteration of this run and its state."""
        done = committed(self.spark, self.folder, "iteration-")
        return (done[-1], self.spark.read.parquet(f"{self.folder}/iteration-{done[-1]}")) if done else None

    def commit(self, df: DataFrame, iteration: int) -> DataFrame:
        """The state, written (or persisted); positions that are no numbers, which the write
        itself counts, stop the run."""
        seen = Observation()
        position = [F.col(c) for c in df.columns if re.fullmatch(r"y\d+", c)]
        finite = reduce(lambda x, y: x & y, [~F.isnan(c) & (F.abs(c) < float("inf")) for c in position])
        watched = df.observe(seen, F.count_if(~F.coalesce(finite, F.lit(False))).alias("bad"))
        path = f"{self.folder}/iteration-{iteration}" if iteration % self.every == 0 else None
        if path:
            watched.write.mode("overwrite").parquet(path)
            out = self.spark.read.schema(df.schema).parquet(path)
        else:
            out = watched.persist(StorageLevel.MEMORY_AND_DISK)
            out.count()
        if seen.get["bad"]:
            if path:
                drop_table(self.spark, path)
            raise ValueError(f"iteration {iteration}: {seen.get['bad']} positions are not finite")
        if path:
            for old in committed(self.spark, self.folder, "iteration-")[:-2]:  # this one and the one before stay
                drop_table(self.spark, f"{self.folder}/iteration-{old}")
        if self.prev is not None:
            self.prev.unpersist()
        self.prev = out
        return out

    def begin(self, state: DataFrame) -> tuple[int, DataFrame]:
        """Where to go on: after the last committed iteration, or from ``state``."""
        return self.last() or (0, self.commit(state, 0))

    def commit_centered(self, moved: DataFrame, iteration: int, dims: int) -> DataFrame:
        """Commit a moved single map, centred; the step is evaluated once."""
        moved = moved.persist(StorageLevel.MEMORY_AND_DISK)
        out = self.commit(update.center_map(moved, dims), iteration)
        moved.unpersist()
        return out


def _start(given: DataFrame | None, vectors: DataFrame, make) -> DataFrame:
    """The start given by the caller, which must place every vector, or a random one."""
    if given is None:
        return make()
    gone = vectors.select("id").join(given.select("id"), "id", "left_anti").limit(5).collect()
    if gone:
        raise ValueError(f"the start has no position for {[r['id'] for r in gone]}")
    return given


def _report(result: RunResult, callback, iteration, state, loss, trajectory_path, trajectory_every, dims):
    if trajectory_path and trajectory_every and iteration % trajectory_every == 0:
        frames.append_trajectory(frames.trajectory_frame(state, result.run_id, iteration, dims), trajectory_path)
    if callback is not None:
        callback(iteration, state, loss)


def _put_metrics(spark, result: RunResult, iteration: int, metrics_path: str | None) -> None:
    """The iteration's metrics, in place of those that an earlier try left."""
    rows = [m for m in result.metrics if m[0] == iteration]
    if metrics_path and rows:
        frames.append_metrics(frames.metrics_frame(spark, result.run_id, rows), metrics_path)


def _resumed(result: RunResult, first: int, state: DataFrame, trajectory_path, trajectory_every, dims) -> None:
    """The frame of a committed iteration, which the run before may not have written."""
    if first:
        _report(result, None, first, state, None, trajectory_path, trajectory_every, dims)


def _finish(spark, result: RunResult, state: DataFrame, first: int, max_iterations: int, t0: float, metrics_path: str | None) -> RunResult:
    result.state = state
    if first < max_iterations:
        result.metrics.append((max_iterations, "elapsed_sec", time.time() - t0))
        _put_metrics(spark, result, max_iterations, metrics_path)
    return result


def tsne_exact(vectors: DataFrame, dims: int = 2, max_iterations: int = 1000, perplexity: float = 30.0,
               seed: int = 0, params: TSNEParams = TSNEParams(), callback=None, loss_every: int = 1,
               report_every: int = 100, checkpoint_every: int = 1, trajectory_path: str | None = None,
               trajectory_every: int = 0, metrics_path: str | None = None, run_id: str | None = None,
               start: DataFrame | None = None, joint: DataFrame | None = None, n: int | None = None,
               state_path: str | None = None) -> RunResult:
    """Exact t-SNE: gradient 4(A − R/Z) from the block-pair kernel + P-edge joins,
    gains/momentum update, re-centring.  ``callback(iteration, state_df, loss)``."""
    t0 = time.time()
    spark = vectors.sparkSession
    result = RunResult(run_id or uuid.uuid4().hex[:12], None)
    if joint is None:
        joint, _, n = affinities(vectors, perplexity, n)
    else:
        joint = reliable_checkpoint(joint)
    n = n or vectors.count()
    y0 = _start(start, vectors, lambda: init_map(vectors, dims, 1, seed, 1.0))
    state = y0.select("id", F.lit(0).alias("map"), *_d("y", dims),
                      *[F.lit(0.0).alias(f"iy{k}") for k in range(1, dims + 1)],
                      *[F.lit(1.0).alias(f"g{k}") for k in range(1, dims + 1)])
    step = _Stepper(spark, result.run_id, checkpoint_every, state_path)
    first, state = step.begin(state)
    _resumed(result, first, state, trajectory_path, trajectory_every, dims)
    nb, kedges = _keyed_edges(spark, joint, n, 1)
    for it in range(first + 1, max_iterations + 1):
        scale = params.exaggeration_factor if it <= params.early_exaggeration else 1.0
        ys = state.select("id", "map", *_d("y", dims))
        # a table: joined to the state that it is made of, a persisted pass is not known again and runs twice
        path = scratch_path(spark, "sums")
        sums = stored(blocks.fused_pass(ys.withColumn("pi", F.lit(1.0)), kedges, nb, dims, True, scale), "sums", path)
        z, fused_loss = blocks.fused_scalars(sums, n, True)
        z = z or 1.0  # one point: no pairs, no force
        loss = None
        if loss_every and (it % loss_every == 0 or it == max_iterations):
            loss = fused_loss if fused_loss is not None else \
                float(kernel.kl_loss(joint, ys, z, dims, scale).first()["loss"] or 0.0)
            result.metrics.append((it, "kl", loss))
        if report_every and it % report_every == 0:
            tq = metrics.topk_by_q(ys, params.K, dims, n)
            pres = metrics.neighborhood_preservation_avg(
                metrics.neighborhood_preservation(joint, tq, params.K), n).first()["preservation"]
            result.metrics.append((it, "preservation", float(pres) if pres is not None else None))
        grad = sums.select("id", *[(F.lit(4.0) * (F.col(f"e{k}") - F.col(f"r{k}") / F.lit(z))).alias(f"dy{k}")
                                   for k in range(1, dims + 1)])
        _put_metrics(spark, result, it, metrics_path)
        state = step.commit_centered(update.gain_update(state, grad, it, params, dims, center=False), it, dims)
        drop_table(spark, path)
        _report(result, callback, it, state, loss, trajectory_path, trajectory_every, dims)
    return _finish(spark, result, state, first, max_iterations, t0, metrics_path)


def tsne_bh(vectors: DataFrame, dims: int = 2, max_iterations: int = 1000, perplexity: float = 30.0,
            theta: float = 0.5, seed: int = 0, params: TSNEParams = TSNEParams(), callback=None,
            report_loss=lambda it: it % 10 == 0, report_every: int = 0, checkpoint_every: int = 1, trajectory_path: str | None = None,
            trajectory_every: int = 0, metrics_path: str | None = None, run_id: str | None = None,
            joint: DataFrame | None = None, n: int | None = None,
            start: DataFrame | None = None, state_path: str | None = None) -> RunResult:
    """Barnes-Hut t-SNE: dY = posF − negF/sumQ (no factor 4, as the reference),
    P × exaggeration while iteration ≤ early_exaggeration, start N(0,1)·1e-4.
    ``theta`` is compared with radius²/d² (i.e. it is a squared threshold). The P edges stand
    by blocks of neighbouring vectors (``kernel.halo``): an iteration shuffles positions only.
    Every ``report_every`` iterations the neighbourhood preservation is measured."""
    t0 = time.time()
    spark = vectors.sparkSession
    result = RunResult(run_id or uuid.uuid4().hex[:12], None)
    if joint is None:
        joint, _, n = affinities(vectors, perplexity, n)
    else:
        joint = reliable_checkpoint(joint)
    n = n or vectors.count()
    y0 = _start(start, vectors, lambda: init_map(vectors, dims, 1, seed, 1e-4))
    state = y0.select("id", F.lit(0).alias("map"), *_d("y", dims),
                      *[F.lit(0.0).alias(f"iy{k}") for k in range(1, dims + 1)],
                      *[F.lit(1.0).alias(f"g{k}") for k in range(1, dims + 1)])
    step = _Stepper(spark, result.run_id, checkpoint_every, state_path)
    first, state = step.begin(state)
    _resumed(result, first, state, trajectory_path, trajectory_every, dims)
    rows = max(blocks.MIN_BLOCK_ROWS, min(HALO_ROWS, math.ceil(n / blocks.default_min_groups(spark))))
    edges, needed = kernel.halo(joint, neighbors.place(vectors, n, rows).rows)
    for it in range(first + 1, max_iterations + 1):
        scale = params.exaggeration_factor if it <= params.early_exaggeration else 1.0
        ys = state.select("id", "map", *_d("y", dims))
        rep = cells.bh_repulsion(ys, theta, dims, n)
        sum_q = float(rep.agg(F.sum("sum_q").alias("s")).first()["s"] or 0.0) or 1.0
        pos = kernel.halo_pass(edges, needed, ys, dims, scale)
        loss = None
        if report_loss is not None and report_loss(it):
            pos = pos.persist(StorageLevel.MEMORY_AND_DISK)
            loss = kernel.halo_loss(pos, sum_q)
            if loss is None:  # an edge hits the floor
                loss = float(kernel.bh_kl_loss(affinity.exaggerate(joint, it, params.early_exaggeration,
                                                                   params.exaggeration_factor), ys, sum_q, dims)
                             .first()["loss"] or 0.0)
            result.metrics.append((it, "kl", loss))
        if report_every and it % report_every == 0:
            tq = metrics.topk_by_q(ys, params.K, dims, n)
            pres = metrics.neighborhood_preservation_avg(
                metrics.neighborhood_preservation(joint, tq, params.K), n).first()["preservation"]
            result.metrics.append((it, "preservation", float(pres) if pres is not None else None))
        grad = rep.join(pos, "id", "left").select(
            "id", *[(F.coalesce(F.col(f"e{k}"), F.lit(0.0)) - F.col(f"n{k}") / F.lit(sum_q)).alias(f"dy{k}")
                    for k in range(1, dims + 1)])
        _put_metrics(spark, result, it, metrics_path)
        state = step.commit_centered(update.gain_update(state, grad, it, params, dims, center=False), it, dims)
        pos.unpersist()
        _report(result, callback, it, state, loss, trajectory_path, trajectory_every, dims)
    return _finish(spark, result, state, first, max_iterations, t0, metrics_path)


def mm_tsne(vectors: DataFrame, dims: int = 2, no_maps: int = 15, max_iterations: int = 2000,
            perplexity: float = 30.0, seed: int = 0, params: TSNEParams = TSNEParams(), callback=None,
            loss_every: int = 0, report_every: int = 100, checkpoint_every: int = 1, lookahead: str = "stored",
            position_scale: float = 2.0, trajectory_path: str | None = None, trajectory_every: int = 0,
            metrics_path: str | None = None, run_id: str | None = None, start: DataFrame | None = None,
            joint: DataFrame | None = None, n: int | None = None, state_path: str | None = None,
            theta: float | None = None) -> RunResult:
    """Multiple-maps t-SNE.  Returns all maps and their weights
    (``state(id, map, y*, iy*, w)``); π = softmax(−w) per point.  With ``theta`` the sums over all
    pairs come from weighted cells (``multimap.mm_cell_pairs``) instead of the block pairs."""
    t0 = time.time()
    spark = vectors.sparkSession
    result = RunResult(run_id or uuid.uuid4().hex[:12], None)
    if joint is None:
        joint, _, n = affinities(vectors, perplexity, n)
    else:
        joint = reliable_checkpoint(joint)
    n = n or vectors.count()
    start = _start(start, vectors, lambda: init_map(vectors, dims, no_maps, seed, 1.0).withColumn("w", F.lit(1.0 / no_maps)))
    state = start.select("id", F.col("map").cast("int").alias("map"), *_d("y", dims),
                         *[F.lit(0.0).alias(f"iy{k}") for k in range(1, dims + 1)], F.col("w").cast("double"))
    step = _Stepper(spark, result.run_id, checkpoint_every, state_path)
    first, state = step.begin(state)
    _resumed(result, first, state, trajectory_path, trajectory_every, dims)
    nb, kedges = _keyed_edges(spark, joint, n, no_maps) if theta is None else (None, None)
    lam = params.laplace
    degree = reliable_checkpoint(affinity.affinity_degree(joint)) if lam != 0.0 else None
    for it in range(first + 1, max_iterations + 1):
        scale = params.zoom_value if it <= params.early_exaggeration else 1.0
        sp = multimap.with_proportions(state.select("id", "map", *_d("y", dims), *_d("iy", dims), "w")).persist(StorageLevel.MEMORY_AND_DISK)
        by_cells = theta is not None
        sums = multimap.mm_cell_pass(sp, joint, dims, n, theta, scale, params.realmin) if by_cells else \
            blocks.fused_pass(sp, kedges, nb, dims, False, scale, params.realmin)
        path = scratch_path(spark, "sums")
        sums = stored(sums, "sums", path)
        loss = None
        if loss_every and (it % loss_every == 0 or it == max_iterations) and not by_cells:
            z, loss = multimap.fused_mm_loss(sums, sp, joint, n, dims, scale, params.realmin, degree, lam)
        else:
            z = float(multimap.mm_total(sums, n, params.realmin).first()["z"])
            if loss_every and (it % loss_every == 0 or it == max_iterations):
                loss = float(multimap.mm_loss(multimap.mm_edge_frame(joint, sp, dims, params.realmin), z, scale, params.realmin).first()["loss"] or 0.0)
                if lam != 0.0:
                    loss += float(multimap.laplacian_penalty(sums, sp, degree, lam, scale).first()["penalty"] or 0.0)
        if loss is not None:
            result.metrics.append((it, "loss", loss))
        if report_every and it % report_every == 0:
            tq = metrics.topk_by_q(sp, params.K, dims, n, n_maps=no_maps)
            pres = metrics.neighborhood_preservation_avg(
                metrics.neighborhood_preservation(joint, tq, params.K), n).first()["preservation"]
            result.metrics.append((it, "preservation", float(pres) if pres is not None else None))
        moved = update.mm_move(multimap.mm_gradients(sums, sp, z, dims, lam, position_scale, degree, scale), it, params, dims
                               ).persist(StorageLevel.MEMORY_AND_DISK)
        _put_metrics(spark, result, it, metrics_path)
        state = step.commit(update.mm_center(moved, it, params, dims, lookahead), it)
        moved.unpersist()
        sp.unpersist()
        drop_table(spark, path)
        _report(result, callback, it, state, loss, trajectory_path, trajectory_every, dims)
    return _finish(spark, result, state, first, max_iterations, t0, metrics_path)
