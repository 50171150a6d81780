"""Position updates: gains + momentum (single map), momentum + look-ahead
(multiple maps), RMS-scaled steps, and map centring.

All updates are column expressions on the keyed state; the per-map column
means come from a one-row-per-map aggregate joined back by ``map`` (its size
is the number of maps, so the broadcast is bounded).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.params import TSNEParams


def _d(prefix, dims):
    return [f"{prefix}{k}" for k in range(1, dims + 1)]


def map_means(state: DataFrame, dims: int = 2) -> DataFrame:
    """``(map, mean_y1..mean_yd)`` — one row per map."""
    st = state if "map" in state.columns else state.withColumn("map", F.lit(0))
    return st.groupBy("map").agg(*[F.avg(c).alias("mean_" + c) for c in _d("y", dims)])


def center_map(state: DataFrame, dims: int = 2) -> DataFrame:
    """Subtract the per-map column mean of ``y``."""
    if "map" not in state.columns:
        # one map: the means are scalar subqueries (no join at all)
        out = state
        for c in _d("y", dims):
            out = out.withColumn(c, F.col(c) - state.agg(F.avg(c)).scalar())
        return out
    means = map_means(state, dims)  # one row per map
    out = state.join(F.broadcast(means), "map")
    for c in _d("y", dims):
        out = out.withColumn(c, F.col(c) - F.col("mean_" + c))
    return out.select(*state.columns)


def gain_update(state: DataFrame, grad: DataFrame, iteration: int, params: TSNEParams = TSNEParams(),
                dims: int = 2, center: bool = True) -> DataFrame:
    """One gradient step with adaptive gains.

    ``state(id, map, y*, iy*, g*)``, ``grad(id, dy*)``.  gain += 0.2 when the
    signs of gradient and velocity differ, else ×0.8, floored at min_gain;
    iy = momentum·iy − eta·gain·dY; y += iy; then the map is re-centred.
    """
    mom = params.momentum(iteration)
    j = state.join(grad, "id")
    moving = set(_d("y", dims) + _d("iy", dims) + _d("g", dims))
    cols = [F.col(c) for c in state.columns if c not in moving]
    new = []
    for k in range(1, dims + 1):
        dy, iy, g, y = F.col(f"dy{k}"), F.col(f"iy{k}"), F.col(f"g{k}"), F.col(f"y{k}")
        ng = F.greatest(F.lit(params.min_gain),
                        F.when((dy > 0.0) != (iy > 0.0), g + F.lit(0.2)).otherwise(g * F.lit(0.8)))
        niy = F.lit(mom) * iy - F.lit(params.eta) * ng * dy
        new += [(y + niy).alias(f"y{k}"), niy.alias(f"iy{k}"), ng.alias(f"g{k}")]
    out = j.select(*cols, *new).select(*state.columns)
    return center_map(out, dims) if center else out


def mm_update(state: DataFrame, dy: DataFrame, dw: DataFrame, iteration: int,
              params: TSNEParams = TSNEParams(), dims: int = 2, lookahead: str = "stored") -> DataFrame:
    """Multi-map step on ``state(id, map, y*, iy*, w)`` with ``dy(id, map, dy*)``, ``dw(id, map, dw)``:
    :func:`mm_move`, then :func:`mm_center`."""
    j = state.join(dy, ["id", "map"]).join(dw, ["id", "map"])
    return mm_center(mm_move(j, iteration, params, dims), iteration, params, dims, lookahead).select(*state.columns)


def mm_move(j: DataFrame, iteration: int, params: TSNEParams = TSNEParams(), dims: int = 2) -> DataFrame:
    """iy' = momentum·iy − eta·dY; y += iy'; w −= etw·dW (no gains) on rows that carry
    ``dy*`` and ``dw``; the old velocity stays as ``_old*`` for the look-ahead."""
    mom = F.lit(params.momentum(iteration))
    iy = {k: mom * F.col(f"iy{k}") - F.lit(params.eta) * F.col(f"dy{k}") for k in range(1, dims + 1)}
    return j.select("id", "map", *[(F.col(f"y{k}") + v).alias(f"y{k}") for k, v in iy.items()],
                    *[v.alias(f"iy{k}") for k, v in iy.items()], *[F.col(f"iy{k}").alias(f"_old{k}") for k in iy],
                    (F.col("w") - F.lit(params.etw) * F.col("dw")).alias("w"))


def mm_center(moved: DataFrame, iteration: int, params: TSNEParams = TSNEParams(), dims: int = 2,
              lookahead: str = "stored") -> DataFrame:
    """Centre per map; then (look-ahead ``'stored'``) y += momentum·iy_old, not re-centred.
    ``moved`` is read twice (its means, then its rows): persist it in a loop."""
    out = moved.join(F.broadcast(map_means(moved, dims)), "map")  # one row per map
    for k in range(1, dims + 1):
        y = F.col(f"y{k}") - F.col(f"mean_y{k}")
        if lookahead == "stored":
            y = y + F.lit(params.momentum(iteration)) * F.col(f"_old{k}")
        out = out.withColumn(f"y{k}", y)
    return out.select("id", "map", *_d("y", dims), *_d("iy", dims), "w")


def rms_step(grad: DataFrame, state_e: DataFrame, lr: float, realmin: float = 1e-12,
             decay: float = 0.1, key=("id", "map"), col: str = "g") -> DataFrame:
    """RMS-scaled step: E ← decay·E + (1−decay)·g²; step = lr·g / sqrt(E + realmin).

    ``grad(key…, g)``, ``state_e(key…, e)`` → ``(key…, e, step)``.
    """
    j = grad.join(state_e, list(key))
    e = F.lit(decay) * F.col("e") + F.lit(1.0 - decay) * (F.col(col) * F.col(col))
    return j.select(*key, e.alias("e"),
                    (F.lit(lr) * F.col(col) / F.sqrt(e + F.lit(realmin))).alias("step"))
