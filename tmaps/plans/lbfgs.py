"""L-BFGS t-SNE with distributed vectors (vector-free two-loop recursion).

The iterate, its gradient and the last m correction pairs (s, r) are columns
of the keyed state ``(id, y*, g*, s{h}_*, r{h}_*)``.  All inner products the
two-loop recursion needs are entries of the Gram matrix of
``[s_0..s_{m-1}, r_0..r_{m-1}, g]``, computed by ONE aggregate per iteration;
the recursion then runs on those (2m+1)² scalars on the driver and yields the
search direction as coefficients of a linear combination of state columns
(Chen, Wang, Zhou — "Large-scale L-BFGS using MapReduce", NIPS 2014).
The line search wants the strong Wolfe conditions on the exact KL cost. ``TRIALS`` step lengths
are evaluated at once, as so many maps of one block pass: it gives the loss and the slope of each.
A step that does not lower the cost is never taken (steepest descent is tried, then the phase
ends); phase 1 uses P × 4, phase 2 the plain P, starting from the phase-1 result (as the reference).
"""

from __future__ import annotations

import time
import uuid

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.operators import blocks, kernel
from tmaps.plans.jobs import RunResult, _keyed_edges, _start, affinities, init_map
from tmaps.session import checkpoint, drop_table, scratch_path

CURVATURE = 1e-10
TRIALS, ROUNDS = 4, 10
ARMIJO, WOLFE = 1e-4, 0.9

def _d(prefix, dims):
    return [f"{prefix}{k}" for k in range(1, dims + 1)]


def _value_and_grad(ys: DataFrame, joint: DataFrame, n: int, dims: int, p_scale: float, edges):
    """(loss, grad DataFrame (id, g*)) of KL(P'‖Q) at positions ``ys(id, map, y*)``:
    one co-grouped block pass gives Z, the loss parts and the gradient sums."""
    nb, kedges = edges
    sums = blocks.fused_pass(ys.withColumn("pi", F.lit(1.0)), kedges, nb, dims, True, p_scale
                             ).persist(StorageLevel.MEMORY_AND_DISK)
    z, loss = blocks.fused_scalars(sums, n, True)
    if loss is None:  # an edge hits the 1e-12 floor: evaluate the floored loss exactly
        loss = float(kernel.kl_loss(joint, ys, z or 1.0, dims, p_scale).first()["loss"] or 0.0)
    z = z or 1.0  # one point: no pairs, no force
    g = sums.select("id", *[(F.lit(4.0) * (F.col(f"e{k}") - F.col(f"r{k}") / F.lit(z))).alias(f"g{k}")
                            for k in range(1, dims + 1)])
    return loss, g, sums


def _gram(state: DataFrame, names: list[str], dims: int) -> np.ndarray:
    k = len(names)
    exprs, idx = [], []
    for a in range(k):
        for b in range(a, k):
            e = None
            for c in range(1, dims + 1):
                t = F.col(f"{names[a]}{c}") * F.col(f"{names[b]}{c}")
                e = t if e is None else e + t
            exprs.append(F.sum(e).alias(f"_g{a}_{b}"))
            idx.append((a, b))
    row = state.agg(*exprs).first()
    G = np.zeros((k, k))
    for (a, b), v in zip(idx, row):
        G[a, b] = G[b, a] = float(v)
    return G


def _direction(G: np.ndarray, m: int) -> np.ndarray:
    """Two-loop recursion on coefficients over [s_0..s_{m-1}, r_0..r_{m-1}, g];
    returns coefficients of the descent direction −H·g."""
    k = 2 * m + 1
    q = np.zeros(k)
    q[-1] = 1.0  # q = g
    alpha = np.zeros(m)
    rho = np.array([1.0 / G[i, m + i] for i in range(m)])  # positive: see _usable
    for i in range(m - 1, -1, -1):
        alpha[i] = rho[i] * (G[i] @ q)           # s_i · q
        q[m + i] -= alpha[i]                      # q -= alpha_i r_i
    if m > 0:
        gamma = G[m - 1, 2 * m - 1] / G[2 * m - 1, 2 * m - 1]   # s·r / r·r of the newest pair
    else:
        gamma = 1.0 / np.sqrt(max(G[-1, -1], 1e-300))
    r = gamma * q
    for i in range(m):
        beta = rho[i] * (G[m + i] @ r)           # r_i · r
        r[i] += alpha[i] - beta                   # r += s_i (alpha_i − beta)
    return -r


def _usable(G: np.ndarray, m: int) -> list[int]:
    """Pairs of positive curvature: s·r must stand clear of rounding, or dividing by it
    gives no direction at all."""
    return [i for i in range(m) if np.isfinite(G[i, m + i])
            and G[i, m + i] > CURVATURE * np.sqrt(G[i, i] * G[m + i, m + i]) and G[m + i, m + i] > 0]


def wolfe_search(evaluate, f: float, slope: float, c1: float = ARMIJO, c2: float = WOLFE, rounds: int = ROUNDS) -> float | None:
    """A step length along a descent direction that meets the strong Wolfe conditions, of several
    the one of least loss; if the rounds find none, the best that lowers the loss enough, or
    None.  ``evaluate(steps)`` gives ``(loss, slope)`` of each.

    A round looks at TRIALS steps.  The first place where the loss stops falling (too little
    below ``f``, above the step before it, or rising there) ends an interval that holds
    such a step, and the next round parts it; while there is none, steps are doubled."""
    known, best = {0.0: (f, slope)}, None
    steps = [2.0 ** k for k in range(2 - TRIALS, 2)]
    for _ in range(rounds):
        known.update(zip(steps, evaluate(steps)))
        enough = {t: v for t, v in known.items() if t > 0 and np.isfinite(v[0]) and v[0] <= f + c1 * t * slope}
        if enough:
            best = min(enough, key=lambda t: enough[t][0])
        good = {t: v for t, v in enough.items() if abs(v[1]) <= -c2 * slope}
        if good:
            return min(good, key=lambda t: good[t][0])
        at = sorted(known)
        low = high = None
        for a, b in zip(at, at[1:]):
            if b not in enough or known[b][0] >= known[a][0] or known[b][1] >= 0:
                low, high = a, b
                break
        if low is None:
            steps = [at[-1] * 2.0 ** k for k in range(1, TRIALS + 1)]
        else:
            steps = [low + (high - low) * k / (TRIALS + 1) for k in range(1, TRIALS + 1)]
    return best


def _trials(base: DataFrame, steps: list[float], joint: DataFrame, n: int, dims: int, p_scale: float, edges) -> tuple[DataFrame, list[tuple[float, float, float]]]:
    """The sums of one block pass over the positions of every step (a step is a map), and
    ``(loss, slope, Z)`` of each."""
    nb, kedges = edges
    tries = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(float(t)).alias("t")) for m, t in enumerate(steps)])).alias("try")
    at = base.select("id", *_d("y", dims), *_d("_dir", dims), tries)
    at = at.select("id", F.col("try.m").alias("map"), *[(F.col(f"y{k}") + F.col("try.t") * F.col(f"_dir{k}")).alias(f"y{k}") for k in range(1, dims + 1)], F.lit(1.0).alias("pi"))
    sums = blocks.fused_pass(at, kedges, nb, dims, True, p_scale).persist(StorageLevel.MEMORY_AND_DISK)
    dot = lambda x: sum((F.col(f"{x}{k}") * F.col(f"_dir{k}") for k in range(1, dims + 1)), F.lit(0.0))
    rows = sums.join(base.select("id", *_d("_dir", dims)), "id").groupBy("map").agg(
        F.sum("a").alias("z"), F.sum("lp").alias("lp"), F.sum("ps").alias("ps"), F.min("qmin").alias("qmin"), F.sum(dot("e")).alias("e"), F.sum(dot("r")).alias("r")).collect()
    out = [None] * len(steps)
    for r in rows:  # one row a step
        z = r["z"] or 1.0
        loss = r["lp"] + r["ps"] * np.log(z) if z > 0 and np.isfinite(z) else np.nan
        if not r["qmin"] / z >= kernel.Q_FLOOR and np.isfinite(z):  # an edge hits the floor
            loss = float(kernel.kl_loss(joint, at.where(F.col("map") == r["map"]), z, dims, p_scale).first()["loss"] or 0.0)
        out[r["map"]] = (float(loss), float(4.0 * (r["e"] - r["r"] / z)), float(z))
    return sums, out


def _phase(state: DataFrame, joint: DataFrame, n: int, dims: int, p_scale: float, max_iterations: int,
           m_max: int, tol: float, result: RunResult, it0: int, edges):
    ys = state.select("id", "map", *_d("y", dims))
    f, g, sums = _value_and_grad(ys, joint, n, dims, p_scale, edges)
    state = checkpoint(ys.join(g, "id"))
    sums.unpersist()
    held = None
    hist: list[int] = []  # slot numbers of stored pairs, oldest first
    next_slot = 0
    it = it0
    for _ in range(max_iterations):
        it += 1
        names = [f"s{h}_" for h in hist] + [f"r{h}_" for h in hist] + ["g"]
        G = _gram(state, names, dims)
        if G[-1, -1] == 0.0:
            break  # the gradient is zero
        good = _usable(G, len(hist))
        rows = good + [len(hist) + i for i in good] + [2 * len(hist)]
        hist, names, G = [hist[i] for i in good], [names[i] for i in rows], G[np.ix_(rows, rows)]
        coef = _direction(G, len(hist))
        slope = float(coef @ G[-1])  # g · d
        steepest = np.zeros(len(names))
        steepest[-1] = -1.0 / np.sqrt(G[-1, -1])
        tries = [(coef, slope)] if hist and np.isfinite(slope) and slope < 0 else []
        tries.append((steepest, float(steepest[-1] * G[-1, -1])))
        t = None
        for coef, slope in tries:  # where the history leads nowhere, steepest descent
            dcol = [sum((F.lit(float(c)) * F.col(f"{nm}{k}") for c, nm in zip(coef, names) if c), F.lit(0.0))
                    for k in range(1, dims + 1)]
            base = checkpoint(state.select("id", "map", *_d("y", dims), *_d("g", dims),
                                           *[f"{x}{h}_{k}" for h in hist for x in "sr" for k in range(1, dims + 1)],
                                           *[d.alias(f"_dir{k}") for k, d in enumerate(dcol, 1)]))

            tried, passes = {}, []

            def evaluate(steps):
                sums, values = _trials(base, steps, joint, n, dims, p_scale, edges)
                passes.append(sums)
                tried.update({t: (sums, m, *v) for m, (t, v) in enumerate(zip(steps, values))})
                return [v[:2] for v in values]

            t = wolfe_search(evaluate, f, slope)
            if t is not None:
                break
            for sums in passes:
                sums.unpersist()
            hist = []
        if t is None:
            break  # no step lowers the loss: the point stays
        sums, place, f_new, slope_new, z = tried[t]
        cand = base.select("id", "map", *[(F.col(f"y{k}") + F.lit(t) * F.col(f"_dir{k}")).alias(f"y{k}") for k in range(1, dims + 1)])
        g_new = sums.where(F.col("map") == place).select(
            "id", *[(F.lit(4.0) * (F.col(f"e{k}") - F.col(f"r{k}") / F.lit(z))).alias(f"g{k}") for k in range(1, dims + 1)])
        result.metrics.append((it, "passes", float(len(passes))))
        result.metrics.append((it, "wolfe", float(f_new <= f + ARMIJO * t * slope and abs(slope_new) <= -WOLFE * slope)))
        slot, next_slot = next_slot, next_slot + 1
        keep = hist[-(m_max - 1):] if m_max > 1 else []
        cols = [F.col("id"), F.col("map")]
        cols += [F.col(f"c.y{k}").alias(f"y{k}") for k in range(1, dims + 1)]
        cols += [F.col(f"n.g{k}").alias(f"g{k}") for k in range(1, dims + 1)]
        cols += [F.col(f"b.{x}{h}_{k}").alias(f"{x}{h}_{k}") for h in keep for x in "sr" for k in range(1, dims + 1)]
        cols += [(F.lit(t) * F.col(f"b._dir{k}")).alias(f"s{slot}_{k}") for k in range(1, dims + 1)]
        cols += [(F.col(f"n.g{k}") - F.col(f"b.g{k}")).alias(f"r{slot}_{k}") for k in range(1, dims + 1)]
        joined = (base.alias("b").join(cand.alias("c"), ["id", "map"]).join(g_new.alias("n"), "id"))
        # a table of its own: the next plan starts from a known size, and the one before goes
        path = scratch_path(base.sparkSession, "lbfgs")
        joined.select(*cols).write.parquet(path)
        state = base.sparkSession.read.parquet(path)
        for sums in passes:
            sums.unpersist()
        if held:
            drop_table(base.sparkSession, held)
        held = path
        hist = keep + [slot]
        result.metrics.append((it, "kl", f_new))
        result.metrics.append((it, "grad_norm", float(np.sqrt(G[-1, -1]))))
        converged = abs(f - f_new) <= tol * max(abs(f), 1.0)
        f = f_new
        if converged:
            break
    return state, it


def tsne_lbfgs(vectors: DataFrame, dims: int = 2, max_iterations: int = 1000, num_corrections: int = 10,
               convergence_tol: float = 1e-4, perplexity: float = 30.0, seed: int = 0,
               exaggeration: float = 4.0, joint: DataFrame | None = None, n: int | None = None,
               start: DataFrame | None = None, run_id: str | None = None) -> RunResult:
    """Two L-BFGS phases (exaggerated P, then plain P), each up to ``max_iterations``.
    P is the joint affinity without the 1e-12 floor, as in the reference's variant."""
    t0 = time.time()
    result = RunResult(run_id or uuid.uuid4().hex[:12], None)
    if joint is None:
        joint, _, n = affinities(vectors, perplexity, n, floor=None)
    else:
        joint = checkpoint(joint)
    n = n or vectors.count()
    y0 = _start(start, vectors, lambda: init_map(vectors, dims, 1, seed, 1.0))
    state = checkpoint(y0.select("id", F.lit(0).alias("map"), *_d("y", dims)))
    edges = _keyed_edges(vectors.sparkSession, joint, n, 1)
    state, it = _phase(state, joint, n, dims, exaggeration, max_iterations, num_corrections,
                       convergence_tol, result, 0, edges)
    state, it = _phase(state, joint, n, dims, 1.0, max_iterations, num_corrections,
                       convergence_tol, result, it, edges)
    result.metrics.append((it, "elapsed_sec", time.time() - t0))
    result.state = state.select("id", "map", *_d("y", dims))
    return result
