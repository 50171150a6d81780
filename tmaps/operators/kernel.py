"""Student-t kernel, exact gradient and losses of a single map.

Map state: ``state(id, map, y1..yd[, pi])``.  The exact gradient uses the fused
single-pass form

    z_i = Σ_j num_ij,  R_i = Σ_j num_ij² (y_i − y_j)     (all pairs, block kernel)
    A_i = Σ_{j∈P} p_ij num_ij (y_i − y_j)                 (P edges, equi-joins)
    Z = Σ_i z_i,       dY_i = 4 (A_i − R_i / Z)

so no n×n table is ever materialised and Z needs no second all-pairs pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tmaps.operators import blocks
from tmaps.session import checkpoint, checkpoint_by, stored

Q_FLOOR = 1e-12


def dim_cols(prefix: str, dims: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(1, dims + 1)]


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def map_pass(state: DataFrame, dims: int = 2, n: int | None = None, block_rows: int | None = None,
             n_maps: int = 1) -> DataFrame:
    """All-pairs sums per (id, map): ``a = Σ_j π_i π_j num``, ``s = Σ_j π_j num``,
    ``r_k = Σ_j π_i π_j num² (y_ik − y_jk)``.  Missing ``map``/``pi`` columns
    default to a single map with π = 1."""
    st = state
    if "map" not in st.columns:
        st = st.withColumn("map", F.lit(0))
    if "pi" not in st.columns:
        st = st.withColumn("pi", F.lit(1.0))
    st = st.select("id", F.col("map").cast("int").alias("map"), *dim_cols("y", dims),
                   F.col("pi").cast("double").alias("pi"))
    if n is None:
        n = st.select("id").distinct().count()
    spark = st.sparkSession
    # a group holds two blocks of all maps: keep it bounded by block_rows rows in total
    nb = blocks.map_blocks(n, n_maps, blocks.default_min_groups(spark), block_rows)
    # numbered partitions are not merged where rows are few: the pairs cost more than their rows weigh
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(nb * (nb + 1) // 2, 4 * blocks.default_min_groups(spark)))
    rep = blocks.replicate_pairs(blocks.with_block(st, nb), nb).repartition(parts, "_lo", "_hi")
    part = rep.groupBy("_lo", "_hi").applyInArrow(blocks.map_sums_kernel(dims), blocks.map_sums_schema(dims))
    return part.groupBy("id", "map").agg(
        F.sum("a").alias("a"), F.sum("s").alias("s"), *[F.sum(c).alias(c) for c in dim_cols("r", dims)])


def student_t_kernel(state: DataFrame, dims: int = 2, n: int | None = None) -> DataFrame:
    """Row sums of the Student-t kernel ``num_ij = 1/(1+|y_i−y_j|²)``, diagonal 0:
    ``(id, num_sum)``."""
    return map_pass(state, dims, n).select("id", F.col("a").alias("num_sum"))


def kernel_total(row_sums: DataFrame, col: str = "a") -> DataFrame:
    """One row ``Z = Σ_i Σ_{j≠i} num_ij``."""
    return row_sums.agg(F.sum(col).alias("z"))


def edge_frame(joint_p: DataFrame, state: DataFrame, dims: int = 2) -> DataFrame:
    """P edges with both endpoints: ``(i, j, p, y?_i, y?_j, d2, num)`` — two equi-joins.

    Catalyst broadcasts positions whose measured size is small; otherwise both joins
    shuffle and a hot j (hub) is split by AQE's skew join."""
    yi = state.select(F.col("id").alias("i"), *[F.col(c).alias(c + "_i") for c in dim_cols("y", dims)])
    yj = state.select(F.col("id").alias("j"), *[F.col(c).alias(c + "_j") for c in dim_cols("y", dims)])
    e = joint_p.select("i", "j", "p").join(yi, "i").join(yj, "j")
    d2 = None
    for c in dim_cols("y", dims):
        term = (F.col(c + "_i") - F.col(c + "_j")) * (F.col(c + "_i") - F.col(c + "_j"))
        d2 = term if d2 is None else d2 + term
    return e.withColumn("d2", d2).withColumn("num", F.lit(1.0) / (F.lit(1.0) + F.col("d2")))


def pq_residual(joint_p: DataFrame, state: DataFrame, z, dims: int = 2) -> DataFrame:
    """Residual ``q − p`` at the P edges, q = num / Z (elsewhere the residual is q itself)."""
    e = edge_frame(joint_p, state, dims)
    return e.select("i", "j", (F.col("num") / _lit(z) - F.col("p")).alias("pq"))


def attractive_forces(joint_p: DataFrame, state: DataFrame, dims: int = 2) -> DataFrame:
    """``posF_i = Σ_j p_ij (y_i − y_j) / (1 + d²)`` → ``(id, f1..fd)``."""
    e = edge_frame(joint_p, state, dims)
    aggs = [F.sum(F.col("p") * F.col("num") * (F.col(c + "_i") - F.col(c + "_j"))).alias(f"f{k}")
            for k, c in enumerate(dim_cols("y", dims), 1)]
    return e.groupBy(F.col("i").alias("id")).agg(*aggs)


def edge_pass(joint_p: DataFrame, state: DataFrame, dims: int = 2, p_scale=1.0) -> DataFrame:
    """``A_i = Σ_{j∈P} (p·scale)·num·(y_i − y_j)`` → ``(id, e1..ed)``."""
    e = edge_frame(joint_p, state, dims)
    w = F.col("p") * _lit(p_scale) * F.col("num")
    aggs = [F.sum(w * (F.col(c + "_i") - F.col(c + "_j"))).alias(f"e{k}")
            for k, c in enumerate(dim_cols("y", dims), 1)]
    return e.groupBy(F.col("i").alias("id")).agg(*aggs)


def halo(joint_p: DataFrame, blocks_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P edges by the block of ``i``, and the halo: which positions each block needs.

    ``blocks_of`` is ``(id, blk)``, best with neighbours in one block. Both tables are static and
    written once with their partitioning, so an iteration shuffles positions only:
    the state to the halo's ids, and the halo's positions to the blocks."""
    parts = int(joint_p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = blocks_of.select(F.col("id").alias("i"), "blk")
    edges = checkpoint_by(checkpoint(joint_p.select("i", "j", "p").join(of, "i")), parts, "blk", ordered=("blk",))
    needed = checkpoint(edges.select("blk", F.col("j").alias("id")).union(edges.select("blk", "i")).distinct())
    return edges, checkpoint_by(needed, parts, "id", ordered=("id",))


def halo_pass(edges: DataFrame, needed: DataFrame, state: DataFrame, dims: int = 2, p_scale: float = 1.0) -> DataFrame:
    """``(id, e1..ed, lp, ps, qmin)`` of every point with edges: attraction
    ``Σ p'·num·(y_i − y_j)`` with p' = p·p_scale, and the parts of the loss,
    ``Σ p'·ln(max(p', floor) / num)``, ``Σ p'`` and the least num."""
    y = dim_cols("y", dims)
    near = needed.join(state.select("id", *y), "id").select(F.col("blk").alias("of"), "id", *y)
    schema = "id bigint, " + ", ".join(f"{c} double" for c in dim_cols("e", dims) + ["lp", "ps", "qmin"])
    return edges.groupBy("blk").cogroup(near.groupBy("of")).applyInArrow(blocks.halo_kernel(dims, p_scale, Q_FLOOR), schema)


def halo_loss(sums: DataFrame, sum_q: float) -> float | None:
    """The KL loss from the parts of ``halo_pass``; None where an edge is below the floor."""
    r = sums.agg(F.sum("lp").alias("lp"), F.sum("ps").alias("ps"), F.min("qmin").alias("qmin")).first()
    if r["qmin"] is None or r["qmin"] / sum_q < Q_FLOOR:
        return None if r["qmin"] is not None else 0.0
    return float(r["lp"]) + float(r["ps"]) * math.log(sum_q)


def gradient_from_parts(sums: DataFrame, edges: DataFrame, z, dims: int = 2, factor: float = 4.0) -> DataFrame:
    """``dY_i = factor · (A_i − R_i / Z)`` → ``(id, dy1..dyd)``; rows without P edges have A = 0."""
    j = sums.select("id", *dim_cols("r", dims)).join(edges, "id", "left")
    return j.select("id", *[(F.lit(factor) * (F.coalesce(F.col(f"e{k}"), F.lit(0.0)) - F.col(f"r{k}") / _lit(z)))
                            .alias(f"dy{k}") for k in range(1, dims + 1)])


def tsne_gradient(joint_p: DataFrame, state: DataFrame, iteration: int = 1, dims: int = 2,
                  n: int | None = None, early_exaggeration: int = 50, factor: float = 4.0,
                  z=None) -> tuple[DataFrame, Column | float]:
    """Exact t-SNE gradient of KL(P‖Q) (true gradient, factor 4).  Returns ``(grad, Z)``
    where Z is a scalar-subquery column unless given."""
    sums = map_pass(state, dims, n)
    if z is None:
        sums = stored(sums, "kernel")  # Z and the gradient read it
        z = kernel_total(sums).scalar()
    scale = factor if iteration <= early_exaggeration else 1.0
    edges = edge_pass(joint_p, state, dims, scale)
    return gradient_from_parts(sums, edges, z, dims), z


def kl_loss(joint_p: DataFrame, state: DataFrame, z, dims: int = 2, p_scale=1.0) -> DataFrame:
    """One row ``loss = Σ_P p' ln(p' / max(num/Z, 1e-12))`` with p' = p·scale (NaN terms → 0)."""
    e = edge_frame(joint_p, state, dims)
    p = F.col("p") * _lit(p_scale)
    q = F.greatest(F.col("num") / _lit(z), F.lit(Q_FLOOR))
    term = p * F.log(p / q)
    return e.agg(F.sum(F.nanvl(term, F.lit(0.0))).alias("loss"))


def bh_kl_loss(joint_p: DataFrame, state: DataFrame, sum_q, dims: int = 2) -> DataFrame:
    """One row ``loss = Σ_P p ln(max(p,1e-12) / max(num/sumQ, 1e-12))`` over all edges."""
    e = edge_frame(joint_p, state, dims)
    q = F.greatest(F.col("num") / _lit(sum_q), F.lit(Q_FLOOR))
    term = F.col("p") * F.log(F.greatest(F.col("p"), F.lit(Q_FLOOR)) / q)
    return e.agg(F.sum(term).alias("loss"))
