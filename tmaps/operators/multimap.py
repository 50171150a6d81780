"""Multiple maps: every point has a position in each of M maps and a
proportion π_im = softmax(−w_i)_m.

Fused single-pass form (see SURVEY §7.3): with QQ_m = π_im π_jm num_m and
QZ = realmin + Σ_m QQ_m,

    all pairs, per (i, m):  a = Σ_j QQ_m,  R = Σ_j QQ_m num_m (y_i − y_j),  S = Σ_j π_jm num_m
    P edges,   per (i, m):  A = Σ_{j∈P} QQ_m num_m p / QZ (y_i − y_j),  T = Σ_{j∈P} π_jm num_m p / QZ
    Z = Σ a + n² realmin
    dCdY = scale (1−λ) (A − R/Z)            (scale 2 = the reference's half gradient)
    dCdP = 2 (S/Z − T) + λ (Lπ)
    dCdW = π (Σ_m dCdP π − dCdP)

The all-pairs sums come from the block-pair kernel (grouped by block pair,
all maps together); the edge sums from equi-joins of ``joint_p`` with the
state, QZ per edge being a window sum over the maps of that edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmaps.operators import blocks, cells
from tmaps.operators import kernel as K

REALMIN = 1e-12


def _d(prefix, dims):
    return [f"{prefix}{k}" for k in range(1, dims + 1)]


def _lit(x):
    return x if not isinstance(x, (int, float)) else F.lit(float(x))


def map_proportions(weights: DataFrame) -> DataFrame:
    """``weights(id, map, w)`` → ``(id, map, pi)``, π = exp(−w) / Σ_m exp(−w)
    (window over the maps of one id: bounded by the number of maps)."""
    return with_proportions(weights.select("id", "map", "w")).select("id", "map", "pi")


def with_proportions(state: DataFrame) -> DataFrame:
    """Adds ``pi`` to ``state(id, map, …, w)``; the exponents are shifted by the row's
    smallest weight, so large weights neither overflow nor vanish together."""
    mine = Window.partitionBy("id")
    return (state.withColumn("_e", F.exp(F.min("w").over(mine) - F.col("w")))
            .withColumn("pi", F.col("_e") / F.sum("_e").over(mine)).drop("_e"))


def mm_all_pairs(state_pi: DataFrame, dims: int, n: int, n_maps: int) -> DataFrame:
    """``(id, map, a, s, r*)`` from the block-pair kernel."""
    return K.map_pass(state_pi, dims, n, n_maps=n_maps)


def mm_cell_pairs(state_pi: DataFrame, dims: int, n: int, theta: float = 0.5) -> DataFrame:
    """``(id, map, a, s, r*)`` by cells: a point's mass is its π and a cell's is their sum, so
    one walk of every map gives s = Σ_j π_j num and Σ_j π_j num² (y_i − y_j); a and r are π_i
    times those. With ``theta`` → 0 these are the sums of ``mm_all_pairs``."""
    rep = cells.bh_repulsion(state_pi.select("id", "map", "pi", *_d("y", dims)), theta, dims, n)
    j = rep.join(state_pi.select("id", "map", "pi"), ["id", "map"])
    return j.select("id", "map", (F.col("pi") * F.col("sum_q")).alias("a"), F.col("sum_q").alias("s"),
                    *[(F.col("pi") * F.col(f"n{k}")).alias(f"r{k}") for k in range(1, dims + 1)])


def mm_edge_parts(edges: DataFrame, dims: int = 2, p_scale=1.0) -> DataFrame:
    """``(id, map, t, e*, pn)``: what ``mm_edge_sums`` gives, and Σ_{j∈P} p π_jm."""
    w = F.col("p") * _lit(p_scale) / F.col("qz")
    return edges.groupBy(F.col("i").alias("id"), "map").agg(
        F.sum(F.col("pi_j") * F.col("num") * w).alias("t"), F.sum(F.col("p") * _lit(p_scale) * F.col("pi_j")).alias("pn"),
        *[F.sum(F.col("qq") * F.col("num") * w * (F.col(c + "_i") - F.col(c + "_j"))).alias(f"e{k}")
          for k, c in enumerate(_d("y", dims), 1)])


def mm_cell_pass(state_pi: DataFrame, joint_p: DataFrame, dims: int, n: int, theta: float, p_scale=1.0, realmin: float = REALMIN) -> DataFrame:
    """What the block-pair pass gives for an iteration, with the all-pairs sums by cells."""
    parts = mm_edge_parts(mm_edge_frame(joint_p, state_pi, dims, realmin), dims, p_scale)
    j = mm_cell_pairs(state_pi, dims, n, theta).join(parts, ["id", "map"], "left")
    return j.na.fill(0.0, ["t", "pn", *_d("e", dims)])


def mm_total(sums: DataFrame, n: int, realmin: float = REALMIN) -> DataFrame:
    """One row ``z = Σ a + n² realmin`` (QZ carries realmin on every entry)."""
    return sums.agg((F.sum("a") + F.lit(float(n) * float(n) * realmin)).alias("z"))


def mm_edge_frame(joint_p: DataFrame, state_pi: DataFrame, dims: int = 2, realmin: float = REALMIN) -> DataFrame:
    """P edges × maps: ``(i, j, map, p, num, qq, qz, pi_i, pi_j, y?_i, y?_j)``.

    A point is one row with an array over its maps, so an edge meets its ends in
    two joins, and QZ is a sum inside the row: nothing is shuffled by (edge, map)."""
    names = ["map", "pi", *_d("y", dims)]
    point = state_pi.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("at"))
    e = (joint_p.select("i", "j", "p").join(point.select(F.col("id").alias("i"), F.col("at").alias("at_i")), "i")
         .join(point.select(F.col("id").alias("j"), F.col("at").alias("at_j")), "j"))

    def both(a, b):
        d2 = None
        for c in _d("y", dims):
            t = (a[c] - b[c]) * (a[c] - b[c])
            d2 = t if d2 is None else d2 + t
        num = F.lit(1.0) / (F.lit(1.0) + d2)
        return F.struct(a["map"].alias("map"), num.alias("num"), (a["pi"] * b["pi"] * num).alias("qq"), a["pi"].alias("pi_i"), b["pi"].alias("pi_j"),
                        *[x[c].alias(c + s) for x, s in ((a, "_i"), (b, "_j")) for c in _d("y", dims)])

    e = e.select("i", "j", "p", F.zip_with("at_i", "at_j", both).alias("m"))
    qz = F.lit(realmin) + F.aggregate("m", F.lit(0.0), lambda s, x: s + x["qq"])
    return e.select("i", "j", "p", qz.alias("qz"), F.inline("m"))


def mm_edge_sums(edges: DataFrame, dims: int = 2, p_scale=1.0) -> DataFrame:
    """``(id, map, t, e*)`` — the P-edge parts A (as e*) and T."""
    w = F.col("p") * _lit(p_scale) / F.col("qz")
    return edges.groupBy(F.col("i").alias("id"), "map").agg(
        F.sum(F.col("pi_j") * F.col("num") * w).alias("t"),
        *[F.sum(F.col("qq") * F.col("num") * w * (F.col(c + "_i") - F.col(c + "_j"))).alias(f"e{k}")
          for k, c in enumerate(_d("y", dims), 1)])


def mm_edge_pass(joint_p: DataFrame, state_pi: DataFrame, dims: int, n: int, n_maps: int, p_scale: float = 1.0,
                 realmin: float = REALMIN) -> DataFrame:
    """What ``mm_edge_sums`` gives for the frame of all edges, without the frame: no edge carries its ends' maps through a shuffle."""
    nb = blocks.map_blocks(n, n_maps, blocks.default_min_groups(joint_p.sparkSession))
    return blocks.edge_pass(state_pi, joint_p, nb, dims, p_scale, realmin)


def _edge_once(edges: DataFrame) -> DataFrame:
    """One row of every edge, whatever its maps are numbered from."""
    return edges.groupBy("i", "j").agg(F.first("p").alias("p"), F.first("qz").alias("qz"))


def mm_residual(edges: DataFrame, z, p_scale=1.0) -> DataFrame:
    """``(i, j, pq)`` with PQ = QZ/Z − P at the P edges (elsewhere PQ = Q)."""
    one = _edge_once(edges)
    return one.select("i", "j", (F.col("qz") / _lit(z) - F.col("p") * _lit(p_scale)).alias("pq"))


def laplacian_smooth(joint_p: DataFrame, pi: DataFrame, p_scale=1.0) -> DataFrame:
    """``(id, map, lpi)`` = (Lπ)_im = degree_i π_im − Σ_{j∈P} p_ij π_jm (sparse L, no background)."""
    p = joint_p.select("i", "j", (F.col("p") * _lit(p_scale)).alias("p"))
    deg = p.groupBy(F.col("i").alias("id")).agg(F.sum("p").alias("deg"))
    nb = (p.join(pi.select(F.col("id").alias("j"), "map", F.col("pi").alias("pi_j")), "j")
          .groupBy(F.col("i").alias("id"), "map").agg(F.sum(F.col("p") * F.col("pi_j")).alias("pn")))
    return (pi.select("id", "map", "pi").join(deg, "id", "left").join(nb, ["id", "map"], "left")
            .select("id", "map", (F.coalesce(F.col("deg"), F.lit(0.0)) * F.col("pi")
                                  - F.coalesce(F.col("pn"), F.lit(0.0))).alias("lpi")))


def mm_position_gradient(sums: DataFrame, esums: DataFrame, z, dims: int = 2, laplace: float = 0.0,
                         scale: float = 2.0) -> DataFrame:
    """``(id, map, dy*)`` = scale (1−λ) (A − R/Z)."""
    j = sums.join(esums, ["id", "map"], "left")
    f = F.lit(scale * (1.0 - laplace))
    return j.select("id", "map", *[(f * (F.coalesce(F.col(f"e{k}"), F.lit(0.0)) - F.col(f"r{k}") / _lit(z)))
                                   .alias(f"dy{k}") for k in range(1, dims + 1)])


def mm_weight_gradient(sums: DataFrame, esums: DataFrame, state_pi: DataFrame, z,
                       lpi: DataFrame | None = None, laplace: float = 0.0) -> DataFrame:
    """``(id, map, dp, dw)``: dCdP = 2(S/Z − T) + λ(Lπ);  dCdW = π (Σ_m dCdP·π − dCdP)."""
    j = (sums.select("id", "map", "s").join(esums.select("id", "map", "t"), ["id", "map"], "left")
         .join(state_pi.select("id", "map", "pi"), ["id", "map"]))
    dp = F.lit(2.0) * (F.col("s") / _lit(z) - F.coalesce(F.col("t"), F.lit(0.0)))
    if lpi is not None and laplace != 0.0:
        j = j.join(lpi, ["id", "map"], "left")
        dp = dp + F.lit(laplace) * F.coalesce(F.col("lpi"), F.lit(0.0))
    j = j.withColumn("dp", dp)
    tot = F.sum(F.col("dp") * F.col("pi")).over(Window.partitionBy("id"))
    return j.select("id", "map", "dp", (F.col("pi") * (tot - F.col("dp"))).alias("dw"))


def mm_gradients(sums: DataFrame, state_pi: DataFrame, z, dims: int = 2, laplace: float = 0.0, scale: float = 2.0,
                 degree: DataFrame | None = None, p_scale=1.0) -> DataFrame:
    """``state_pi`` with ``dy*`` and ``dw``: every sum of the fused pass stands on one row,
    so one join with the state and one window over a point's maps give both gradients.
    With λ, (Lπ)_im = degree_i π_im − Σ_{j∈P} p_ij π_jm; the pass has that sum as ``pn``."""
    j = state_pi.join(sums, ["id", "map"])
    if laplace != 0.0:
        j = j.join(degree.select(F.col("i").alias("id"), "degree"), "id", "left")
    dp = F.lit(2.0) * (F.col("s") / _lit(z) - F.col("t"))
    if laplace != 0.0:
        dp = dp + F.lit(laplace) * (F.coalesce("degree", F.lit(0.0)) * _lit(p_scale) * F.col("pi") - F.col("pn"))
    j = j.withColumn("_dp", dp)
    total = F.sum(F.col("_dp") * F.col("pi")).over(Window.partitionBy("id"))
    f = F.lit(scale * (1.0 - laplace))
    return j.select(*state_pi.columns, *[(f * (F.col(f"e{k}") - F.col(f"r{k}") / _lit(z))).alias(f"dy{k}") for k in range(1, dims + 1)],
                    (F.col("pi") * (total - F.col("_dp"))).alias("dw"))


def laplacian_penalty(sums: DataFrame, state_pi: DataFrame, degree: DataFrame, laplace: float, p_scale=1.0) -> DataFrame:
    """One row ``penalty`` = λ Σ_i Σ_m π_im (Lπ)_im from the fused pass's ``pn``."""
    j = (state_pi.select("id", "map", "pi").join(sums.select("id", "map", "pn"), ["id", "map"])
         .join(degree.select(F.col("i").alias("id"), "degree"), "id", "left"))
    lpi = F.coalesce("degree", F.lit(0.0)) * _lit(p_scale) * F.col("pi") - F.col("pn")
    return j.agg((F.lit(laplace) * F.sum(F.col("pi") * lpi)).alias("penalty"))


def fused_mm_loss(sums: DataFrame, state_pi: DataFrame, joint_p: DataFrame, n: int, dims: int = 2, p_scale: float = 1.0,
                  realmin: float = REALMIN, degree: DataFrame | None = None, laplace: float = 0.0) -> tuple[float, float]:
    """(Z, loss) of an iteration's block-pair pass: no join of the edges, but where one is below the floor."""
    z, loss = blocks.fused_scalars(sums, n, False, realmin, realmin)
    if loss is None:
        edges = mm_edge_frame(joint_p, state_pi, dims, realmin)
        loss = float(mm_loss(edges, z, p_scale, realmin).first()["loss"] or 0.0)
    if laplace != 0.0:
        loss += float(laplacian_penalty(sums, state_pi, degree, laplace, p_scale).first()["penalty"] or 0.0)
    return z, loss


def mm_loss(edges: DataFrame, z, p_scale=1.0, realmin: float = REALMIN,
            lpi: DataFrame | None = None, pi: DataFrame | None = None, laplace: float = 0.0) -> DataFrame:
    """One row: Σ_P p ln(max(p, realmin) / max(QZ/Z, realmin)) (NaN terms → 0)
    + λ Σ_i Σ_m π_im (Lπ)_im."""
    one = _edge_once(edges)
    p = F.col("p") * _lit(p_scale)
    term = p * F.log(F.greatest(p, F.lit(realmin)) / F.greatest(F.col("qz") / _lit(z), F.lit(realmin)))
    kl = one.agg(F.sum(F.nanvl(term, F.lit(0.0))).alias("kl"))
    if lpi is None or pi is None or laplace == 0.0:
        return kl.select(F.col("kl").alias("loss"))
    reg = lpi.join(pi, ["id", "map"]).agg((F.lit(laplace) * F.sum(F.col("pi") * F.col("lpi"))).alias("reg"))
    return kl.select((F.col("kl") + reg.scalar()).alias("loss"))
