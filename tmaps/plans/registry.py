"""Registered queries: one per operator of the inventory, each with its
independent SQL oracle where SQL can express it.

Every query reads the ``embeddings`` table (or data Spark derives from it) at
full size; numbers are rounded identically on both sides for comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tmaps.operators import affinity, kernel, metrics, multimap, neighbors, update
from tmaps.params import TSNEParams
from tmaps.plans import oracle as O
from tmaps.plans.common import Inputs, rnd, K_NEIGHBOURS, PERPLEXITY, ORACLE_MAPS
from tmaps.session import checkpoint
from tmaps.sources import vectors as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


# ------------------------------------------------------------------ sources

@register("src_vectors", O.with_() +
          f"SELECT id, label, CAST(len(v) AS INTEGER) AS n_dims, {O.rnd(O._sum('v'), 6)} AS v_sum, "
          f"{O.rnd('v[1]', 9)} AS v_first FROM vec")
def q_src_vectors(spark, sf):
    v = Inputs(spark, sf).vectors()
    return v.select("id", "label", F.size("v").cast("int").alias("n_dims"),
                    rnd(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("v_sum"),
                    rnd(F.get("v", 0), 9).alias("v_first"))


@register("src_csv_vectors", O.with_() +
          f"SELECT id, CAST(len(v) AS INTEGER) AS n_dims, {O.rnd(O._sum('v'), 6)} AS v_sum FROM vec")
def q_src_csv_vectors(spark, sf):
    from tmaps.session import scratch_path
    v = Inputs(spark, sf).vectors()
    path = scratch_path(spark, "csv-vectors")
    src.write_csv_vectors(v.select("id", "v"), path)
    good, _rejects = src.read_csv_vectors(spark, path)
    return good.select("id", F.size("v").cast("int").alias("n_dims"),
                       rnd(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("v_sum"))


@register("row_index", O.with_() +
          f"SELECT id, label, {O.rnd('v[1]', 9)} AS v_first, CAST(row_number() OVER (ORDER BY label, id) - 1 AS BIGINT) AS row_idx FROM vec")
def q_row_index(spark, sf):
    v = Inputs(spark, sf).vectors().select("id", "label", "v")  # the vector is payload
    return src.row_index(v, ["label", "id"]).select("id", "label", rnd(F.get("v", 0), 9).alias("v_first"), "row_idx")


@register("packed_column_summary",
          "SELECT CAST(pos AS INTEGER) AS pos, " + O.rnd("avg(x)", 6) + " AS mean, " + O.rnd("var_samp(x)", 4)
          + " AS variance, CAST(count(*) FILTER (WHERE x <> 0) AS BIGINT) AS nnz FROM ("
          "SELECT unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS x, unnest([0, 1]) AS pos FROM part) GROUP BY pos")
def q_packed_column_summary(spark, sf):
    part = src.table(spark, sf, "part")
    packed = src.pack_vectors(part, "p_partkey", ["p_size", "p_retailprice"])
    cs = metrics.column_summary(packed)
    return cs.select(F.col("pos").cast("int").alias("pos"), rnd("mean", 6).alias("mean"),
                     rnd("variance", 4).alias("variance"), F.col("nnz").cast("bigint").alias("nnz"))


# ------------------------------------------------------------------ projections / pairs

@register("row_norms", O.with_() + f"SELECT id, {O.rnd('sqrt(' + O._sum('list_transform(v, lambda x: x * x)') + ')', 9)} AS norm FROM vec")
def q_row_norms(spark, sf):
    return neighbors.row_norms(Inputs(spark, sf).vectors()).select("id", rnd("norm", 9).alias("norm"))


@register("pair_distances", O.with_("pairs") +
          "SELECT i, CAST(count(*) AS BIGINT) AS n_pairs, " + O.rnd("min(d2)", 6) + " AS d2_min, "
          + O.rnd("max(d2)", 6) + " AS d2_max, " + O.rnd("sum(d2)", 4) + " AS d2_sum FROM pairs GROUP BY i")
def q_pair_distances(spark, sf):
    inp = Inputs(spark, sf)
    pdist = neighbors.pair_distances(inp.vectors(), n=inp.n)
    return pdist.select("i", "n_pairs", rnd("d2_min", 6).alias("d2_min"), rnd("d2_max", 6).alias("d2_max"),
                        rnd("d2_sum", 4).alias("d2_sum"))


@register("knn_join", O.with_("knn") + f"SELECT i, j, {O.rnd('d2', 6)} AS d2, r FROM knn")
def q_knn_join(spark, sf):
    return Inputs(spark, sf).knn().select("i", "j", rnd("d2", 6).alias("d2"), "r")


@register("column_summary",
          O.with_() + "SELECT CAST(pos - 1 AS INTEGER) AS pos, " + O.rnd("avg(x)", 8) + " AS mean, "
          + O.rnd("var_samp(x)", 8) + " AS variance, CAST(count(*) FILTER (WHERE x <> 0) AS BIGINT) AS nnz "
          "FROM (SELECT unnest(v) AS x, unnest(range(1, len(v) + 1)) AS pos FROM vec) GROUP BY pos")
def q_column_summary(spark, sf):
    cs = metrics.column_summary(Inputs(spark, sf).vectors())
    return cs.select(F.col("pos").cast("int").alias("pos"), rnd("mean", 8).alias("mean"),
                     rnd("variance", 8).alias("variance"), F.col("nnz").cast("bigint").alias("nnz"))


@register("row_slice", O.with_() + f"SELECT id, label, {O.rnd('v[1]', 9)} AS v_first FROM vec WHERE id IN "
          "(SELECT doc_id FROM documents WHERE lang = 'de') OR id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def q_row_slice(spark, sf):
    """The vectors whose ids a list names: German and toxic documents, some in both lists."""
    v = Inputs(spark, sf).vectors()
    ids = src.table(spark, sf, "documents").where("lang = 'de'").select("doc_id").union(src.table(spark, sf, "labels").where("toxic = 1").select("doc_id"))
    return metrics.slice_rows(v, ids, "doc_id").select("id", "label", rnd(F.get("v", 0), 9).alias("v_first"))


@register("bounding_box", O.with_("st1") +
          "SELECT map, " + ", ".join(f"{O.rnd(f'{f}({c})', 9)} AS {f}_{c}" for c in ("y1", "y2") for f in ("min", "max"))
          + " FROM st1 GROUP BY map")
def q_bounding_box(spark, sf):
    bb = metrics.bounding_box(Inputs(spark, sf).state1())
    return bb.select("map", *[rnd(c, 9).alias(c) for c in bb.columns if c != "map"])


@register("center_map", O.with_("st1") +
          f"SELECT id, map, {O.rnd('y1 - avg(y1) OVER ()', 9)} AS y1, {O.rnd('y2 - avg(y2) OVER ()', 9)} AS y2 FROM st1")
def q_center_map(spark, sf):
    c = update.center_map(Inputs(spark, sf).state1())
    return c.select("id", "map", rnd("y1", 9).alias("y1"), rnd("y2", 9).alias("y2"))


@register("nan_rows", O.with_("st1") +
          "SELECT map, CAST(count(*) AS BIGINT) AS n_rows, "
          "CAST(count(*) FILTER (WHERE isnan(y1) OR isnan(y2)) AS BIGINT) AS n_nan FROM st1 GROUP BY map")
def q_nan_rows(spark, sf):
    st = Inputs(spark, sf).state1()
    bad = metrics.nan_rows(st, ["y1", "y2"]).groupBy("map").agg(F.count("*").alias("n_nan"))
    return (st.groupBy("map").agg(F.count("*").alias("n_rows")).join(bad, "map", "left")
            .select("map", F.col("n_rows").cast("bigint"), F.coalesce("n_nan", F.lit(0)).cast("bigint").alias("n_nan")))


# ------------------------------------------------------------------ affinities

@register("entropy_at_beta", O.with_("nb") + f"SELECT i, {O.rnd(O.H('ds', 'CAST(1.0 AS DOUBLE)'), 9)} AS h FROM nb")
def q_entropy_at_beta(spark, sf):
    return affinity.entropy_at_beta(Inputs(spark, sf).knn(), 1.0).select("i", rnd("h", 9).alias("h"))


@register("calibrate_beta", O.with_("betas") + f"SELECT i, {O.rnd('beta', 9)} AS beta, tries, converged FROM betas")
def q_calibrate_beta(spark, sf):
    _, b = Inputs(spark, sf).cond_and_betas()
    return b.select("i", rnd("beta", 9).alias("beta"), F.col("tries").cast("int").alias("tries"), "converged")


@register("cond_affinity", O.with_("cond") + f"SELECT i, j, {O.rnd('p', 9)} AS p FROM cond")
def q_cond_affinity(spark, sf):
    cond, _ = Inputs(spark, sf).cond_and_betas()
    return cond.select("i", "j", rnd("p", 9).alias("p"))


@register("joint_affinity", O.with_("joint") + f"SELECT i, j, {O.rnd('p', 4, 1e6)} AS p FROM joint")
def q_joint_affinity(spark, sf):
    return Inputs(spark, sf).joint().select("i", "j", rnd("p", 4, 1e6).alias("p"))


@register("mean_sigma", O.with_("betas") + f"SELECT {O.rnd('avg(sqrt(1.0 / beta))', 9)} AS mean_sigma FROM betas")
def q_mean_sigma(spark, sf):
    _, b = Inputs(spark, sf).cond_and_betas()
    return affinity.mean_sigma(b).select(rnd("mean_sigma", 9).alias("mean_sigma"))


@register("exaggerate", O.with_("joint") + f"SELECT i, j, {O.rnd('p * 4.0', 4, 1e6)} AS p FROM joint")
def q_exaggerate(spark, sf):
    ex = affinity.exaggerate(Inputs(spark, sf).joint(), iteration=1)
    return ex.select("i", "j", rnd("p", 4, 1e6).alias("p"))


@register("affinity_degree", O.with_("joint") + f"SELECT i, {O.rnd('sum(p)', 4, 1e6)} AS degree FROM joint GROUP BY i")
def q_affinity_degree(spark, sf):
    return affinity.affinity_degree(Inputs(spark, sf).joint()).select("i", rnd("degree", 4, 1e6).alias("degree"))


@register("graph_laplacian", O.with_("joint") +
          f"SELECT i, j, {O.rnd('l', 4, 1e6)} AS l FROM (SELECT i, i AS j, sum(p) AS l FROM joint GROUP BY i "
          "UNION ALL SELECT i, j, -p AS l FROM joint)")
def q_graph_laplacian(spark, sf):
    return affinity.graph_laplacian(Inputs(spark, sf).joint()).select("i", "j", rnd("l", 4, 1e6).alias("l"))


# ------------------------------------------------------------------ single-map kernel

@register("student_t_kernel", O.with_("mp1") + f"SELECT i AS id, {O.rnd('sum(num)', 6)} AS num_sum FROM mp1 GROUP BY i")
def q_student_t_kernel(spark, sf):
    inp = Inputs(spark, sf)
    return kernel.student_t_kernel(inp.state1(), n=inp.n).select("id", rnd("num_sum", 6).alias("num_sum"))


@register("kernel_total", O.with_("z1") + f"SELECT {O.rnd('z', 4)} AS z FROM z1")
def q_kernel_total(spark, sf):
    inp = Inputs(spark, sf)
    sums = kernel.map_pass(inp.state1(), n=inp.n)
    return kernel.kernel_total(sums).select(rnd("z", 4).alias("z"))


_EDGE1 = ("e1 AS (SELECT p.i, p.j, p.p, a.y1 AS y1_i, a.y2 AS y2_i, b.y1 AS y1_j, b.y2 AS y2_j, "
          "1.0 / (1.0 + ((a.y1 - b.y1) * (a.y1 - b.y1) + (a.y2 - b.y2) * (a.y2 - b.y2))) AS num "
          "FROM joint p JOIN st1 a ON a.id = p.i JOIN st1 b ON b.id = p.j)")


@register("pq_residual", O.with_("joint", "st1", "z1", extra=[_EDGE1]) +
          f"SELECT i, j, {O.rnd('num / (SELECT z FROM z1) - p', 4, 1e6)} AS pq FROM e1")
def q_pq_residual(spark, sf):
    inp = Inputs(spark, sf)
    st = inp.state1()
    z = kernel.kernel_total(kernel.map_pass(st, n=inp.n)).scalar()
    return kernel.pq_residual(inp.joint(), st, z).select("i", "j", rnd("pq", 4, 1e6).alias("pq"))


@register("attractive_forces", O.with_("joint", "st1", extra=[_EDGE1]) +
          f"SELECT i AS id, {O.rnd('sum(p * num * (y1_i - y1_j))', 4, 1e6)} AS f1, "
          f"{O.rnd('sum(p * num * (y2_i - y2_j))', 4, 1e6)} AS f2 FROM e1 GROUP BY i")
def q_attractive_forces(spark, sf):
    inp = Inputs(spark, sf)
    f = kernel.attractive_forces(inp.joint(), inp.state1())
    return f.select("id", rnd("f1", 4, 1e6).alias("f1"), rnd("f2", 4, 1e6).alias("f2"))


_GRAD1_SQL = (
    "g1 AS (SELECT s.id, 4.0 * (coalesce(e.a1, 0) - s.r1 / (SELECT z FROM z1)) AS dy1, "
    "4.0 * (coalesce(e.a2, 0) - s.r2 / (SELECT z FROM z1)) AS dy2 FROM "
    "(SELECT i AS id, sum(num * num * (y1_i - y1_j)) AS r1, sum(num * num * (y2_i - y2_j)) AS r2 FROM mp1 GROUP BY i) s "
    "LEFT JOIN (SELECT i AS id, sum(p * 4.0 * num * (y1_i - y1_j)) AS a1, sum(p * 4.0 * num * (y2_i - y2_j)) AS a2 "
    "FROM e1 GROUP BY i) e ON s.id = e.id)")


@register("tsne_gradient", O.with_("joint", "st1", "z1", extra=[_EDGE1, _GRAD1_SQL]) +
          f"SELECT id, {O.rnd('dy1', 4, 1e6)} AS dy1, {O.rnd('dy2', 4, 1e6)} AS dy2 FROM g1")
def q_tsne_gradient(spark, sf):
    inp = Inputs(spark, sf)
    g, _ = kernel.tsne_gradient(inp.joint(), inp.state1(), iteration=1, n=inp.n)
    return g.select("id", rnd("dy1", 4, 1e6).alias("dy1"), rnd("dy2", 4, 1e6).alias("dy2"))


@register("kl_loss", O.with_("joint", "st1", "z1", extra=[_EDGE1]) +
          f"SELECT {O.rnd('sum(CASE WHEN isnan(t) THEN 0.0 ELSE t END)', 9)} AS loss FROM "
          "(SELECT p * ln(p / greatest(num / (SELECT z FROM z1), 1e-12)) AS t FROM e1)")
def q_kl_loss(spark, sf):
    inp = Inputs(spark, sf)
    st = inp.state1()
    z = kernel.kernel_total(kernel.map_pass(st, n=inp.n)).scalar()
    return kernel.kl_loss(inp.joint(), st, z).select(rnd("loss", 9).alias("loss"))


@register("bh_kl_loss", O.with_("joint", "st1", "z1", extra=[_EDGE1]) +
          f"SELECT {O.rnd('sum(p * ln(greatest(p, 1e-12) / greatest(num / (SELECT z FROM z1), 1e-12)))', 9)} AS loss FROM e1")
def q_bh_kl_loss(spark, sf):
    inp = Inputs(spark, sf)
    st = inp.state1()
    z = kernel.kernel_total(kernel.map_pass(st, n=inp.n)).scalar()
    return kernel.bh_kl_loss(inp.joint(), st, z).select(rnd("loss", 9).alias("loss"))


# ------------------------------------------------------------------ metrics

@register("topk_by_p", O.with_("joint") +
          "SELECT i, j, CAST(r AS INTEGER) AS r FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY p DESC, j) AS r "
          "FROM joint) WHERE r <= 5")
def q_topk_by_p(spark, sf):
    return metrics.topk_by_p(Inputs(spark, sf).joint(), 5)


@register("topk_by_q", O.with_("mp1") +
          "SELECT i, j, CAST(r AS INTEGER) AS r FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY num DESC, j) AS r "
          "FROM mp1) WHERE r <= 5")
def q_topk_by_q(spark, sf):
    inp = Inputs(spark, sf)
    return metrics.topk_by_q(inp.state1(), 5, n=inp.n)


_NP1 = ("np1 AS (SELECT s.i, CASE WHEN s.m >= 1 THEN coalesce(h.hits, 0) / 1.0 END AS preservation FROM "
        "(SELECT i, count(*) AS m FROM joint GROUP BY i) s LEFT JOIN "
        "(SELECT tp.i, count(*) AS hits FROM "
        "(SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY p DESC, j) AS r FROM joint) WHERE r <= 1) tp "
        "JOIN (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY num DESC, j) AS r FROM mp1) WHERE r <= 1) tq "
        "ON tp.i = tq.i AND tp.j = tq.j GROUP BY tp.i) h ON s.i = h.i)")


@register("neighborhood_preservation", O.with_("joint", "mp1", extra=[_NP1]) +
          f"SELECT i, {O.rnd('preservation', 9)} AS preservation FROM np1")
def q_neighborhood_preservation(spark, sf):
    inp = Inputs(spark, sf)
    tq = metrics.topk_by_q(inp.state1(), 1, n=inp.n)
    npr = metrics.neighborhood_preservation(inp.joint(), tq, 1)
    return npr.select("i", rnd("preservation", 9).alias("preservation"))


@register("neighborhood_preservation_avg", O.with_("joint", "mp1", "nrows", extra=[_NP1]) +
          f"SELECT {O.rnd('sum(preservation) / (SELECT n FROM nrows)', 9)} AS preservation FROM np1")
def q_neighborhood_preservation_avg(spark, sf):
    inp = Inputs(spark, sf)
    tq = metrics.topk_by_q(inp.state1(), 1, n=inp.n)
    npr = metrics.neighborhood_preservation(inp.joint(), tq, 1)
    return metrics.neighborhood_preservation_avg(npr, inp.n).select(rnd("preservation", 9).alias("preservation"))


# ------------------------------------------------------------------ single-map steps and frames

def _step_sql(k: int, scale: float = 4.0, momentum: float = 0.5) -> list[str]:
    """CTEs computing state s{k} from s{k-1} (exact t-SNE step at iteration k, P × ``scale``,
    eta 250, gains)."""
    a, b = f"s{k - 1}", f"s{k}"
    pr = f"pr{k}"
    return [
        f"{pr} AS MATERIALIZED (SELECT x.id AS i, y.id AS j, x.y1 - y.y1 AS d1, x.y2 - y.y2 AS d2_, "
        f"1.0 / (1.0 + ((x.y1 - y.y1) * (x.y1 - y.y1) + (x.y2 - y.y2) * (x.y2 - y.y2))) AS num "
        f"FROM {a} x JOIN {a} y ON x.id <> y.id)",
        f"z{k} AS MATERIALIZED (SELECT sum(num) AS z FROM {pr})",
        f"rr{k} AS MATERIALIZED (SELECT i AS id, sum(num * num * d1) AS r1, sum(num * num * d2_) AS r2 FROM {pr} GROUP BY i)",
        f"ea{k} AS MATERIALIZED (SELECT p.i AS id, sum(p.p * {scale} * q.num * q.d1) AS a1, sum(p.p * {scale} * q.num * q.d2_) AS a2 "
        f"FROM joint p JOIN {pr} q ON p.i = q.i AND p.j = q.j GROUP BY p.i)",
        f"gr{k} AS MATERIALIZED (SELECT r.id, 4.0 * (coalesce(e.a1, 0) - r.r1 / (SELECT z FROM z{k})) AS dy1, "
        f"4.0 * (coalesce(e.a2, 0) - r.r2 / (SELECT z FROM z{k})) AS dy2 FROM rr{k} r LEFT JOIN ea{k} e ON r.id = e.id)",
        f"ng{k} AS MATERIALIZED (SELECT s.id, s.y1, s.y2, s.iy1, s.iy2, g.dy1, g.dy2, "
        f"greatest(0.01, CASE WHEN (g.dy1 > 0) <> (s.iy1 > 0) THEN s.g1 + 0.2 ELSE s.g1 * 0.8 END) AS g1, "
        f"greatest(0.01, CASE WHEN (g.dy2 > 0) <> (s.iy2 > 0) THEN s.g2 + 0.2 ELSE s.g2 * 0.8 END) AS g2 "
        f"FROM {a} s JOIN gr{k} g ON s.id = g.id)",
        f"mv{k} AS MATERIALIZED (SELECT id, g1, g2, {momentum} * iy1 - 250.0 * g1 * dy1 AS iy1, {momentum} * iy2 - 250.0 * g2 * dy2 AS iy2, "
        f"y1 + ({momentum} * iy1 - 250.0 * g1 * dy1) AS y1, y2 + ({momentum} * iy2 - 250.0 * g2 * dy2) AS y2 FROM ng{k})",
        f"{b} AS MATERIALIZED (SELECT id, y1 - avg(y1) OVER () AS y1, y2 - avg(y2) OVER () AS y2, iy1, iy2, g1, g2 FROM mv{k})",
    ]


_S0 = "s0 AS (SELECT id, y1, y2, 0.0 AS iy1, 0.0 AS iy2, 1.0 AS g1, 1.0 AS g2 FROM st1)"
_STEPS2 = [_S0] + _step_sql(1) + _step_sql(2)


def _steps2_state(spark, sf, iterations=2, trajectory_path=None):
    from tmaps.plans import jobs
    inp = Inputs(spark, sf)
    res = jobs.tsne_exact(inp.vectors(), max_iterations=iterations, loss_every=0, report_every=0,
                          start=inp.state1(), joint=inp.joint(), n=inp.n,
                          trajectory_path=trajectory_path, trajectory_every=1 if trajectory_path else 0,
                          run_id="steps")
    return res


@register("tsne_steps2", O.with_("joint", "st1", extra=_STEPS2) +
          f"SELECT id, {O.rnd('y1', 6)} AS y1, {O.rnd('y2', 6)} AS y2, {O.rnd('g1', 6)} AS g1, {O.rnd('g2', 6)} AS g2 FROM s2")
def q_tsne_steps2(spark, sf):
    st = _steps2_state(spark, sf).state
    return st.select("id", rnd("y1", 6).alias("y1"), rnd("y2", 6).alias("y2"),
                     rnd("g1", 6).alias("g1"), rnd("g2", 6).alias("g2"))


@register("gain_update", O.with_("joint", "st1", extra=_STEPS2[:1] + _step_sql(1)) +
          f"SELECT id, {O.rnd('y1', 6)} AS y1, {O.rnd('y2', 6)} AS y2, {O.rnd('iy1', 6)} AS iy1, "
          f"{O.rnd('iy2', 6)} AS iy2, {O.rnd('g1', 6)} AS g1, {O.rnd('g2', 6)} AS g2 FROM s1")
def q_gain_update(spark, sf):
    inp = Inputs(spark, sf)
    st = inp.state1()
    state = st.select("id", "map", "y1", "y2", F.lit(0.0).alias("iy1"), F.lit(0.0).alias("iy2"),
                      F.lit(1.0).alias("g1"), F.lit(1.0).alias("g2"))
    grad, _ = kernel.tsne_gradient(inp.joint(), st, iteration=1, n=inp.n)
    new = update.gain_update(state, grad, 1)
    return new.select("id", *[rnd(c, 6).alias(c) for c in ("y1", "y2", "iy1", "iy2", "g1", "g2")])


_VIEW_SQL = (O.with_("joint", "st1", extra=_STEPS2) +
             "SELECT iteration, key, label, x, y FROM ("
             "SELECT 0 AS iteration, id AS key, y1 AS x, y2 AS y FROM s0 UNION ALL "
             "SELECT 1, id, y1, y2 FROM s1 UNION ALL SELECT 2, id, y1, y2 FROM s2) t "
             "JOIN (SELECT id, label FROM vec) l ON l.id = t.key")


def _viewer_records(spark, sf):
    from tmaps.session import scratch_path
    from tmaps.streaming import frames
    inp = Inputs(spark, sf)
    path = scratch_path(spark, "trajectory")
    frames.append_trajectory(frames.trajectory_frame(inp.state1(), "steps", 0), path)
    _steps2_state(spark, sf, trajectory_path=path)
    traj = spark.read.parquet(path).where(F.col("run_id") == "steps")
    return frames.viewer_export(traj, inp.vectors().select("id", "label"))


@register("viewer_export", f"SELECT CAST(iteration AS INTEGER) AS iteration, key, label, {O.rnd('x', 6)} AS x, "
          f"{O.rnd('y', 6)} AS y FROM ({_VIEW_SQL})")
def q_viewer_export(spark, sf):
    from tmaps.session import scratch_path
    from tmaps.streaming import frames
    path = scratch_path(spark, "viewer")
    frames.write_viewer_json(_viewer_records(spark, sf), path)  # the viewer's JSON sink
    r = spark.read.schema("key bigint, label int, x double, y double, iteration int").json(path)
    return r.select(F.col("iteration").cast("int"), "key", "label", rnd("x", 6).alias("x"), rnd("y", 6).alias("y"))


@register("frame_limits", f"SELECT CAST(iteration AS INTEGER) AS iteration, {O.rnd('max(abs(x))', 6)} AS x_lim, "
          f"{O.rnd('max(abs(y))', 6)} AS y_lim FROM ({_VIEW_SQL}) GROUP BY iteration")
def q_frame_limits(spark, sf):
    from tmaps.streaming import frames
    lim = frames.frame_limits(_viewer_records(spark, sf))
    return lim.select(F.col("iteration").cast("int"), rnd("x_lim", 6).alias("x_lim"), rnd("y_lim", 6).alias("y_lim"))


# a schedule that ends exaggeration and changes momentum within the run
_SHORT = TSNEParams(early_exaggeration=2, t_momentum=3)
_SHORT_STEPS = 4
_START = (f"s0 AS MATERIALIZED (SELECT id, {O.gaussian(7, '0', 1)} AS y1, {O.gaussian(7, '0', 2)} AS y2, 0.0 AS iy1, 0.0 AS iy2, "
          "1.0 AS g1, 1.0 AS g2 FROM vec)")
_SHORT_SQL = [_START] + [c for k in range(1, _SHORT_STEPS + 1)
                         for c in _step_sql(k, 4.0 if k <= 2 else 1.0, 0.5 if k <= 3 else 0.8)]


@register("init_map", O.with_() + f"SELECT id, CAST(0 AS INTEGER) AS map, {O.rnd(O.gaussian(7, '0', 1), 9)} AS y1, "
          f"{O.rnd(O.gaussian(7, '0', 2), 9)} AS y2 FROM vec")
def q_init_map(spark, sf):
    from tmaps.plans import jobs
    y = jobs.init_map(Inputs(spark, sf).vectors(), dims=2, maps=1, seed=7)
    return y.select("id", "map", rnd("y1", 9).alias("y1"), rnd("y2", 9).alias("y2"))


def _short_run(spark, sf, **kw):
    from tmaps.plans import jobs
    inp = Inputs(spark, sf)
    return jobs.tsne_exact(inp.vectors(), max_iterations=_SHORT_STEPS, seed=7, params=_SHORT, joint=inp.joint(), n=inp.n,
                           **{"loss_every": 0, "report_every": 0, **kw})


@register("tsne_exact", O.with_("joint", extra=_SHORT_SQL) + f"SELECT id, CAST(0 AS INTEGER) AS map, {O.rnd('y1', 5)} AS y1, {O.rnd('y2', 5)} AS y2 "
          f"FROM s{_SHORT_STEPS}")
def q_tsne_exact(spark, sf):
    st = _short_run(spark, sf).state
    return st.select("id", F.col("map").cast("int").alias("map"), rnd("y1", 5).alias("y1"), rnd("y2", 5).alias("y2"))


@register("trajectory", O.with_("joint", extra=_SHORT_SQL) + " UNION ALL ".join(
    f"SELECT 'traj' AS run_id, CAST({k} AS INTEGER) AS iteration, CAST(0 AS INTEGER) AS map, id, {O.rnd('y1', 5)} AS y1, {O.rnd('y2', 5)} AS y2 FROM s{k}"
    for k in range(1, _SHORT_STEPS + 1)))
def q_trajectory(spark, sf):
    from tmaps.session import scratch_path
    path = scratch_path(spark, "trajectory")
    _short_run(spark, sf, trajectory_path=path, trajectory_every=1, run_id="traj")
    return spark.read.parquet(path).select("run_id", F.col("iteration").cast("int").alias("iteration"), F.col("map").cast("int").alias("map"),
                                           F.col("id").cast("bigint").alias("id"), rnd(F.get("y", 0), 5).alias("y1"), rnd(F.get("y", 1), 5).alias("y2"))


def _report_sql() -> str:
    """KL at every iteration (of the positions that the step starts from), preservation of
    the nearest neighbour at every second one, and the presence of the elapsed time."""
    rows = []
    for k in range(1, _SHORT_STEPS + 1):
        scale = 4.0 if k <= 2 else 1.0
        rows.append(f"SELECT {k} AS iteration, 'kl' AS name, (SELECT sum(p.p * {scale} * ln(p.p * {scale} / greatest(q.num / (SELECT z FROM z{k}), 1e-12))) "
                    f"FROM joint p JOIN pr{k} q ON p.i = q.i AND p.j = q.j) AS value")
        if k % 2 == 0:
            rows.append(f"SELECT {k}, 'preservation', (SELECT count(*) FROM "
                        f"(SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY p DESC, j) AS r FROM joint) a JOIN "
                        f"(SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY num DESC, j) AS r FROM pr{k}) b "
                        f"ON a.i = b.i AND a.j = b.j AND a.r = 1 AND b.r = 1) * 1.0 / (SELECT n FROM nrows)")
    rows.append(f"SELECT {_SHORT_STEPS}, 'elapsed_sec', 1.0")
    return "SELECT CAST(iteration AS INTEGER) AS iteration, name, " + O.rnd("value", 6) + " AS value FROM (" + " UNION ALL ".join(rows) + ")"


@register("metrics_report", O.with_("joint", "nrows", extra=_SHORT_SQL) + _report_sql())
def q_metrics_report(spark, sf):
    from tmaps.session import scratch_path
    path = scratch_path(spark, "metrics")
    _short_run(spark, sf, loss_every=1, report_every=2, metrics_path=path, run_id="metrics")
    value = F.when(F.col("name") == "elapsed_sec", (F.col("value") > 0).cast("double")).otherwise(F.col("value"))
    return spark.read.parquet(path).select(F.col("iteration").cast("int").alias("iteration"), "name", rnd(value, 6).alias("value"))


@register("csv_to_viewer", O.with_("joint", extra=["s0 AS MATERIALIZED (SELECT id, 10.0 * v[1] AS y1, 10.0 * v[2] AS y2, 0.0 AS iy1, 0.0 AS iy2, "
          "1.0 AS g1, 1.0 AS g2 FROM vec)"] + _SHORT_SQL[1:]) + "SELECT CAST(iteration AS INTEGER) AS iteration, key, label, "
          f"{O.rnd('x', 5)} AS x, {O.rnd('y', 5)} AS y FROM (" + " UNION ALL ".join(
              f"SELECT {k} AS iteration, id AS key, y1 AS x, y2 AS y FROM s{k}" for k in range(1, _SHORT_STEPS + 1)) +
          ") t JOIN (SELECT id, label FROM vec) l ON l.id = t.key")
def q_csv_to_viewer(spark, sf):
    """End to end: vectors written as CSV, read by position, embedded, exported for the viewer."""
    from tmaps.plans import jobs
    from tmaps.session import scratch_path
    from tmaps.streaming import frames
    inp = Inputs(spark, sf)
    csv, path = scratch_path(spark, "csv-vectors"), scratch_path(spark, "trajectory")
    src.write_csv_vectors(inp.vectors().select("id", "v"), csv)
    good, _ = src.read_csv_vectors(spark, csv)
    order = src.row_index(inp.vectors().select(F.col("id").alias("key"), "label"), "key").withColumnRenamed("row_idx", "id")
    vectors = checkpoint(good.join(order, "id").select(F.col("key").alias("id"), "v", "label"))
    start = vectors.select("id", (F.lit(10.0) * F.get("v", 0)).alias("y1"), (F.lit(10.0) * F.get("v", 1)).alias("y2"))
    jobs.tsne_exact(vectors, max_iterations=_SHORT_STEPS, perplexity=PERPLEXITY, params=_SHORT, start=start, loss_every=0, report_every=0,
                    trajectory_path=path, trajectory_every=1, run_id="csv")
    out = frames.viewer_export(spark.read.parquet(path), vectors.select("id", "label"))
    return out.select(F.col("iteration").cast("int"), "key", "label", rnd("x", 5).alias("x"), rnd("y", 5).alias("y"))


# ------------------------------------------------------------------ multiple maps

_EM = ("em AS (SELECT p.i, p.j, p.p, q.map, q.qq, q.qz, q.num, q.pi_i, q.pi_j, q.y1_i, q.y2_i, q.y1_j, q.y2_j "
       "FROM joint p JOIN mpq q ON p.i = q.i AND p.j = q.j)")
_MMG = ("mmg AS (SELECT r.id, r.map, 2.0 * (coalesce(e.a1, 0) - r.r1 / (SELECT z FROM zm)) AS dy1, "
        "2.0 * (coalesce(e.a2, 0) - r.r2 / (SELECT z FROM zm)) AS dy2, "
        "2.0 * (r.s / (SELECT z FROM zm) - coalesce(e.t, 0)) AS dp, r.pi FROM "
        "(SELECT i AS id, map, any_value(pi_i) AS pi, sum(qq * num * (y1_i - y1_j)) AS r1, "
        "sum(qq * num * (y2_i - y2_j)) AS r2, sum(pi_j * num) AS s FROM mpq GROUP BY i, map) r LEFT JOIN "
        "(SELECT i AS id, map, sum(qq * num * (p * 1.0 / qz) * (y1_i - y1_j)) AS a1, "
        "sum(qq * num * (p * 1.0 / qz) * (y2_i - y2_j)) AS a2, sum(pi_j * num * (p * 1.0 / qz)) AS t "
        "FROM em GROUP BY i, map) e ON r.id = e.id AND r.map = e.map)")
_MMW = "mmw AS (SELECT id, map, dy1, dy2, dp, pi * (sum(dp * pi) OVER (PARTITION BY id) - dp) AS dw FROM mmg)"
_LPI = ("lpi AS (SELECT s.id, s.map, coalesce(d.deg, 0) * s.pi - coalesce(nb.pn, 0) AS lpi FROM pim s "
        "LEFT JOIN (SELECT i, sum(p) AS deg FROM joint GROUP BY i) d ON d.i = s.id "
        "LEFT JOIN (SELECT p.i, t.map, sum(p.p * t.pi) AS pn FROM joint p JOIN pim t ON t.id = p.j GROUP BY p.i, t.map) nb "
        "ON nb.i = s.id AND nb.map = s.map)")


class _MM:
    """Spark side of the deterministic 3-map inputs; each part is made when it is first asked for."""

    def __init__(self, spark, sf, maps=ORACLE_MAPS):
        self.inp = Inputs(spark, sf)
        self.maps = maps
        self.state = self.inp.state_mm(maps)

    @cached_property
    def n(self):
        return self.inp.n

    @cached_property
    def sp(self):
        return checkpoint(multimap.with_proportions(self.state))

    @cached_property
    def sums(self):
        return checkpoint(multimap.mm_all_pairs(self.sp, 2, self.n, self.maps))

    @cached_property
    def z(self):
        return multimap.mm_total(self.sums, self.n).scalar()

    @cached_property
    def joint(self):
        return self.inp.joint()

    @cached_property
    def edges(self):
        return multimap.mm_edge_frame(self.joint, self.sp)

    @cached_property
    def esums(self):
        return multimap.mm_edge_pass(self.joint, self.sp, 2, self.n, self.maps)


def _mm_tables():
    return ["joint", "pim", "mpq", "zm"]


@register("map_proportions", O.with_("pim") + f"SELECT id, map, {O.rnd('pi', 9)} AS pi FROM pim")
def q_map_proportions(spark, sf):
    st = Inputs(spark, sf).state_mm()
    return multimap.map_proportions(st.select("id", "map", "w")).select("id", "map", rnd("pi", 9).alias("pi"))


@register("mm_kernel", O.with_("mpq") +
          f"SELECT i AS id, map, {O.rnd('sum(qq)', 6)} AS qq_sum, {O.rnd('sum(pi_j * num)', 6)} AS s FROM mpq GROUP BY i, map")
def q_mm_kernel(spark, sf):
    m = _MM(spark, sf)
    return m.sums.select("id", "map", rnd("a", 6).alias("qq_sum"), rnd("s", 6).alias("s"))


@register("mm_cell_kernel", O.with_("mpq") +
          f"SELECT i AS id, map, {O.rnd('sum(qq)', 6)} AS qq_sum, {O.rnd('sum(pi_j * num)', 6)} AS s, {O.rnd('sum(qq * num * (y1_i - y1_j))', 6)} AS r1, "
          f"{O.rnd('sum(qq * num * (y2_i - y2_j))', 6)} AS r2 FROM mpq GROUP BY i, map")
def q_mm_cell_kernel(spark, sf):
    """The all-pairs sums of every map from weighted cells that are opened to the last."""
    m = _MM(spark, sf)
    sums = multimap.mm_cell_pairs(m.sp, 2, m.n, 1e-12)
    return sums.select("id", "map", rnd("a", 6).alias("qq_sum"), *[rnd(c, 6).alias(c) for c in ("s", "r1", "r2")])


@register("mm_kernel_total", O.with_("zm") + f"SELECT {O.rnd('z', 4)} AS z FROM zm")
def q_mm_kernel_total(spark, sf):
    m = _MM(spark, sf)
    return multimap.mm_total(m.sums, m.n).select(rnd("z", 4).alias("z"))


@register("mm_residual", O.with_(*_mm_tables(), extra=[_EM]) +
          f"SELECT i, j, {O.rnd('qz / (SELECT z FROM zm) - p', 4, 1e6)} AS pq FROM em WHERE map = 0")
def q_mm_residual(spark, sf):
    m = _MM(spark, sf)
    return multimap.mm_residual(m.edges, m.z).select("i", "j", rnd("pq", 4, 1e6).alias("pq"))


@register("mm_position_gradient", O.with_(*_mm_tables(), extra=[_EM, _MMG]) +
          f"SELECT id, map, {O.rnd('dy1', 4, 1e6)} AS dy1, {O.rnd('dy2', 4, 1e6)} AS dy2 FROM mmg")
def q_mm_position_gradient(spark, sf):
    m = _MM(spark, sf)
    g = multimap.mm_position_gradient(m.sums, m.esums, m.z)
    return g.select("id", "map", rnd("dy1", 4, 1e6).alias("dy1"), rnd("dy2", 4, 1e6).alias("dy2"))


@register("mm_weight_gradient", O.with_(*_mm_tables(), extra=[_EM, _MMG, _MMW]) +
          f"SELECT id, map, {O.rnd('dp', 4, 1e6)} AS dp, {O.rnd('dw', 4, 1e6)} AS dw FROM mmw")
def q_mm_weight_gradient(spark, sf):
    m = _MM(spark, sf)
    g = multimap.mm_weight_gradient(m.sums, m.esums, m.sp, m.z)
    return g.select("id", "map", rnd("dp", 4, 1e6).alias("dp"), rnd("dw", 4, 1e6).alias("dw"))


@register("mm_block_gradient", O.with_(*_mm_tables(), extra=[_EM, _MMG, _MMW]) +
          f"SELECT id, map, {O.rnd('dy1', 4, 1e6)} AS dy1, {O.rnd('dy2', 4, 1e6)} AS dy2, {O.rnd('dw', 4, 1e6)} AS dw FROM mmw")
def q_mm_block_gradient(spark, sf):
    """The row-block execution used by the multi-map job: ONE co-grouped block pass
    (replicated positions + block-keyed P edges) gives every sum of the gradient."""
    from tmaps.operators import blocks
    from tmaps.plans.jobs import _keyed_edges
    inp = Inputs(spark, sf)
    n = inp.n
    sp = checkpoint(multimap.with_proportions(inp.state_mm()))
    nb, kedges = _keyed_edges(spark, inp.joint(), n, ORACLE_MAPS)
    sums = checkpoint(blocks.fused_pass(sp, kedges, nb, 2, False, 1.0))
    z, _ = blocks.fused_scalars(sums, n, False)
    g = multimap.mm_gradients(sums, sp, z)
    return g.select("id", "map", rnd("dy1", 4, 1e6).alias("dy1"), rnd("dy2", 4, 1e6).alias("dy2"), rnd("dw", 4, 1e6).alias("dw"))


@register("laplacian_smooth", O.with_("joint", "pim", extra=[_LPI]) + f"SELECT id, map, {O.rnd('lpi', 4, 1e6)} AS lpi FROM lpi")
def q_laplacian_smooth(spark, sf):
    inp = Inputs(spark, sf)
    sp = multimap.with_proportions(inp.state_mm())
    return multimap.laplacian_smooth(inp.joint(), sp).select("id", "map", rnd("lpi", 4, 1e6).alias("lpi"))


@register("mm_loss", O.with_(*_mm_tables(), extra=[_EM, _LPI]) +
          "SELECT " + O.rnd("(SELECT sum(CASE WHEN isnan(t) THEN 0.0 ELSE t END) FROM (SELECT p * ln(greatest(p, 1e-12) / "
                            "greatest(qz / (SELECT z FROM zm), 1e-12)) AS t FROM em WHERE map = 0)) + "
                            "0.1 * (SELECT sum(s.pi * l.lpi) FROM pim s JOIN lpi l ON s.id = l.id AND s.map = l.map)", 9)
          + " AS loss")
def q_mm_loss(spark, sf):
    from tmaps.operators import blocks
    from tmaps.plans import jobs
    m = _MM(spark, sf)  # as in the job: the loss parts of the fused pass
    nb, edges = jobs._keyed_edges(spark, m.joint, m.n, m.maps)
    sums = checkpoint(blocks.fused_pass(m.sp, edges, nb, 2, False, 1.0))
    _, loss = multimap.fused_mm_loss(sums, m.sp, m.joint, m.n)
    penalty = multimap.laplacian_penalty(sums, m.sp, affinity.affinity_degree(m.joint), 0.1)
    return penalty.select(rnd(F.col("penalty") + F.lit(loss), 9).alias("loss"))


@register("mm_update", O.with_(*_mm_tables(), extra=[_EM, _MMG, _MMW,
          "mmv AS (SELECT s.id, s.map, s.y1 + (0.5 * 0.0 - 250.0 * g.dy1) AS y1, s.y2 + (0.5 * 0.0 - 250.0 * g.dy2) AS y2, "
          "s.w - 100.0 * g.dw AS w FROM stm s JOIN mmw g ON s.id = g.id AND s.map = g.map)"]) +
          f"SELECT id, map, {O.rnd('y1 - avg(y1) OVER (PARTITION BY map)', 6)} AS y1, "
          f"{O.rnd('y2 - avg(y2) OVER (PARTITION BY map)', 6)} AS y2, {O.rnd('w', 9)} AS w FROM mmv")
def q_mm_update(spark, sf):
    m = _MM(spark, sf)
    dy = multimap.mm_position_gradient(m.sums, m.esums, m.z)
    dw = multimap.mm_weight_gradient(m.sums, m.esums, m.sp, m.z).select("id", "map", "dw")
    state = m.state.select("id", "map", "y1", "y2", F.lit(0.0).alias("iy1"), F.lit(0.0).alias("iy2"), "w")
    new = update.mm_update(state, dy, dw, 1)
    return new.select("id", "map", rnd("y1", 6).alias("y1"), rnd("y2", 6).alias("y2"), rnd("w", 9).alias("w"))


@register("rms_step", O.with_(*_mm_tables(), extra=[_EM, _MMG]) +
          f"SELECT id, map, {O.rnd('0.1 * 0.0 + 0.9 * (dy1 * dy1)', 4, 1e12)} AS e, "
          f"{O.rnd('0.1 * dy1 / sqrt(0.1 * 0.0 + 0.9 * (dy1 * dy1) + 1e-12)', 9)} AS step FROM mmg")
def q_rms_step(spark, sf):
    m = _MM(spark, sf)
    g = multimap.mm_position_gradient(m.sums, m.esums, m.z).select("id", "map", F.col("dy1").alias("g"))
    e0 = g.select("id", "map", F.lit(0.0).alias("e"))
    r = update.rms_step(g, e0, lr=0.1)
    return r.select("id", "map", rnd("e", 4, 1e12).alias("e"), rnd("step", 9).alias("step"))


_MNP = ("mnp AS (SELECT s.i, CASE WHEN s.m >= 1 THEN coalesce(h.hits, 0) / 1.0 END AS preservation FROM "
        "(SELECT i, count(*) AS m FROM joint GROUP BY i) s LEFT JOIN "
        "(SELECT tp.i, count(*) AS hits FROM "
        "(SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY p DESC, j) AS r FROM joint) WHERE r <= 1) tp "
        "JOIN (SELECT i, j FROM (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY qz DESC, j) AS r FROM "
        "(SELECT DISTINCT i, j, qz FROM mpq)) WHERE r <= 1) tq "
        "ON tp.i = tq.i AND tp.j = tq.j GROUP BY tp.i) h ON s.i = h.i)")


@register("mm_neighborhood_preservation", O.with_("joint", "mpq", extra=[_MNP]) +
          f"SELECT i, {O.rnd('preservation', 9)} AS preservation FROM mnp")
def q_mm_neighborhood_preservation(spark, sf):
    m = _MM(spark, sf)
    tq = metrics.topk_by_q(m.sp, 1, 2, m.n, n_maps=m.maps)
    return metrics.neighborhood_preservation(m.joint, tq, 1).select("i", rnd("preservation", 9).alias("preservation"))


def _mm_step_sql(k: int, scale: float = 4.0, momentum: float = 0.5) -> list[str]:
    """CTEs computing multi-map state m{k} from m{k-1}: iteration k (P × ``scale``,
    eta 250, etw 100, λ = 0, stored look-ahead)."""
    a, b = f"m{k - 1}", f"m{k}"
    return [
        f"pp{k} AS MATERIALIZED (SELECT id, map, y1, y2, iy1, iy2, w, exp(-1.0 * w) / sum(exp(-1.0 * w)) OVER (PARTITION BY id) AS pi FROM {a})",
        f"qa{k} AS MATERIALIZED (SELECT x.id AS i, y.id AS j, x.map, x.y1 - y.y1 AS d1, x.y2 - y.y2 AS d2_, x.pi AS pi_i, y.pi AS pi_j, "
        f"1.0 / (1.0 + ((x.y1 - y.y1) * (x.y1 - y.y1) + (x.y2 - y.y2) * (x.y2 - y.y2))) AS num "
        f"FROM pp{k} x JOIN pp{k} y ON x.id <> y.id AND x.map = y.map)",
        f"qb{k} AS MATERIALIZED (SELECT *, pi_i * pi_j * num AS qq, {O.REALMIN} + sum(pi_i * pi_j * num) OVER (PARTITION BY i, j) AS qz FROM qa{k})",
        f"zz{k} AS MATERIALIZED (SELECT sum(qq) + (SELECT n FROM nrows) * (SELECT n FROM nrows) * {O.REALMIN} AS z FROM qb{k})",
        f"rs{k} AS MATERIALIZED (SELECT i AS id, map, sum(qq * num * d1) AS r1, sum(qq * num * d2_) AS r2, sum(pi_j * num) AS s FROM qb{k} GROUP BY i, map)",
        f"es{k} AS MATERIALIZED (SELECT q.i AS id, q.map, sum(q.qq * q.num * (p.p * {scale} / q.qz) * q.d1) AS a1, "
        f"sum(q.qq * q.num * (p.p * {scale} / q.qz) * q.d2_) AS a2, sum(q.pi_j * q.num * (p.p * {scale} / q.qz)) AS t "
        f"FROM joint p JOIN qb{k} q ON p.i = q.i AND p.j = q.j GROUP BY q.i, q.map)",
        f"gd{k} AS MATERIALIZED (SELECT r.id, r.map, 2.0 * (coalesce(e.a1, 0) - r.r1 / (SELECT z FROM zz{k})) AS dy1, "
        f"2.0 * (coalesce(e.a2, 0) - r.r2 / (SELECT z FROM zz{k})) AS dy2, "
        f"2.0 * (r.s / (SELECT z FROM zz{k}) - coalesce(e.t, 0)) AS dp FROM rs{k} r LEFT JOIN es{k} e ON r.id = e.id AND r.map = e.map)",
        f"gw{k} AS MATERIALIZED (SELECT g.id, g.map, g.dy1, g.dy2, s.pi * (sum(g.dp * s.pi) OVER (PARTITION BY g.id) - g.dp) AS dw "
        f"FROM gd{k} g JOIN pp{k} s ON s.id = g.id AND s.map = g.map)",
        f"mo{k} AS MATERIALIZED (SELECT s.id, s.map, s.y1 + ({momentum} * s.iy1 - 250.0 * g.dy1) AS y1, s.y2 + ({momentum} * s.iy2 - 250.0 * g.dy2) AS y2, "
        f"{momentum} * s.iy1 - 250.0 * g.dy1 AS iy1, {momentum} * s.iy2 - 250.0 * g.dy2 AS iy2, s.iy1 AS o1, s.iy2 AS o2, "
        f"s.w - 100.0 * g.dw AS w FROM {a} s JOIN gw{k} g ON s.id = g.id AND s.map = g.map)",
        f"{b} AS MATERIALIZED (SELECT id, map, y1 - avg(y1) OVER (PARTITION BY map) + {momentum} * o1 AS y1, "
        f"y2 - avg(y2) OVER (PARTITION BY map) + {momentum} * o2 AS y2, iy1, iy2, w FROM mo{k})",
    ]


_M0 = "m0 AS (SELECT id, map, y1, y2, 0.0 AS iy1, 0.0 AS iy2, w FROM stm)"


@register("mm_steps2", O.with_("joint", "stm", "nrows", extra=[_M0] + _mm_step_sql(1) + _mm_step_sql(2)) +
          f"SELECT id, map, {O.rnd('y1', 6)} AS y1, {O.rnd('y2', 6)} AS y2, {O.rnd('w', 9)} AS w FROM m2")
def q_mm_steps2(spark, sf):
    from tmaps.plans import jobs
    inp = Inputs(spark, sf)
    res = jobs.mm_tsne(inp.vectors(), no_maps=ORACLE_MAPS, max_iterations=2, loss_every=0, report_every=0,
                       start=inp.state_mm(), joint=inp.joint(), n=inp.n)
    return res.state.select("id", "map", rnd("y1", 6).alias("y1"), rnd("y2", 6).alias("y2"), rnd("w", 9).alias("w"))


_MM_START = (f"m0 AS MATERIALIZED (SELECT id, CAST(m AS INTEGER) AS map, {O.gaussian(7, 'm', 1)} AS y1, {O.gaussian(7, 'm', 2)} AS y2, "
             f"0.0 AS iy1, 0.0 AS iy2, {1.0 / ORACLE_MAPS!r} AS w FROM vec, range({ORACLE_MAPS}) t(m))")
_MM_SHORT = TSNEParams(early_exaggeration=1, t_momentum=2)


@register("mm_tsne", O.with_("joint", "nrows", extra=[_MM_START] + _mm_step_sql(1) + _mm_step_sql(2, 1.0) + _mm_step_sql(3, 1.0, 0.8)) +
          f"SELECT id, map, {O.rnd('y1', 5)} AS y1, {O.rnd('y2', 5)} AS y2, {O.rnd('w', 7)} AS w FROM m3")
def q_mm_tsne(spark, sf):
    from tmaps.plans import jobs
    inp = Inputs(spark, sf)
    res = jobs.mm_tsne(inp.vectors(), no_maps=ORACLE_MAPS, max_iterations=3, seed=7, params=_MM_SHORT, loss_every=0,
                       report_every=0, joint=inp.joint(), n=inp.n)
    return res.state.select("id", "map", rnd("y1", 5).alias("y1"), rnd("y2", 5).alias("y2"), rnd("w", 7).alias("w"))


# ------------------------------------------------------------------ cells / Barnes-Hut

_CELL_LEVELS = 6


@register("cell_pyramid", O.with_("st1", extra=[
    "bb AS (SELECT map, min(y1) AS lo1, max(y1) AS hi1, min(y2) AS lo2, max(y2) AS hi2 FROM st1 GROUP BY map)",
    "tt AS (SELECT s.map, s.y1, s.y2, CASE WHEN hi1 - lo1 > 0 THEN (s.y1 - lo1) / (hi1 - lo1) ELSE 0.0 END AS t1, "
    "CASE WHEN hi2 - lo2 > 0 THEN (s.y2 - lo2) / (hi2 - lo2) ELSE 0.0 END AS t2 FROM st1 s JOIN bb b ON s.map = b.map)",
    f"lv AS (SELECT map, y1, y2, CAST(l AS INTEGER) AS level, "
    "CAST(least(greatest(ceil(t1 * pow(2, l)) - 1, 0), pow(2, l) - 1) AS BIGINT) AS c1, "
    "CAST(least(greatest(ceil(t2 * pow(2, l)) - 1, 0), pow(2, l) - 1) AS BIGINT) AS c2 "
    f"FROM tt, range(0, {_CELL_LEVELS + 1}) r(l))"]) +
    f"SELECT map, level, c1, c2, CAST(count(*) AS BIGINT) AS cnt, {O.rnd('avg(y1)', 9)} AS m1, {O.rnd('avg(y2)', 9)} AS m2, "
    "(min(y1) = max(y1) AND min(y2) = max(y2)) AS leaf FROM lv GROUP BY map, level, c1, c2")
def q_cell_pyramid(spark, sf):
    from tmaps.operators import cells
    c = cells.cell_pyramid(Inputs(spark, sf).state1(), _CELL_LEVELS)
    return c.select("map", F.col("level").cast("int"), "c1", "c2", "cnt", rnd("m1", 9).alias("m1"),
                    rnd("m2", 9).alias("m2"), "leaf")


_BH = O.tree_walk("b", "st1", 0.5)


@register("bh_repulsion", O.with_("st1", extra=_BH, recursive=True) +
          f"SELECT id, CAST(0 AS INTEGER) AS map, {O.rnd('sum_q', 6)} AS sum_q, {O.rnd('n1', 6)} AS n1, {O.rnd('n2', 6)} AS n2 FROM brep")
def q_bh_repulsion(spark, sf):
    from tmaps.operators import cells
    rep = cells.bh_repulsion(Inputs(spark, sf).state1(), 0.5)
    return rep.select("id", "map", *[rnd(c, 6).alias(c) for c in ("sum_q", "n1", "n2")])


def _bh_gradient_sql(x: str, state: str, scale: float, out: str) -> str:
    return (f"{out} AS MATERIALIZED (SELECT r.id, coalesce(a.a1, 0) - r.n1 / (SELECT sum(sum_q) FROM {x}rep) AS dy1, "
            f"coalesce(a.a2, 0) - r.n2 / (SELECT sum(sum_q) FROM {x}rep) AS dy2 FROM {x}rep r LEFT JOIN "
            f"(SELECT i, sum(p * {scale} * num * d1) AS a1, sum(p * {scale} * num * d2_) AS a2 FROM (SELECT p.i, p.p, x.y1 - y.y1 AS d1, x.y2 - y.y2 AS d2_, "
            f"1.0 / (1.0 + ((x.y1 - y.y1) * (x.y1 - y.y1) + (x.y2 - y.y2) * (x.y2 - y.y2))) AS num "
            f"FROM joint p JOIN {state} x ON x.id = p.i JOIN {state} y ON y.id = p.j) GROUP BY i) a ON a.i = r.id)")


@register("bh_gradient", O.with_("joint", "st1", extra=_BH + [_bh_gradient_sql("b", "st1", 1.0, "bg")]) +
          f"SELECT id, {O.rnd('dy1', 4, 1e6)} AS dy1, {O.rnd('dy2', 4, 1e6)} AS dy2 FROM bg")
def q_bh_gradient(spark, sf):
    from tmaps.operators import cells
    inp = Inputs(spark, sf)
    st = inp.state1()
    g, _ = cells.bh_gradient(inp.joint(), st, cells.bh_repulsion(st, 0.5))
    return g.select("id", rnd("dy1", 4, 1e6).alias("dy1"), rnd("dy2", 4, 1e6).alias("dy2"))


BH_TOLERANCE_Z, BH_TOLERANCE_FORCE = 0.02, 0.06


@register("bh_vs_exact", O.with_() + "SELECT true AS z_close, true AS force_close, count(*) AS n FROM vec")
def q_bh_vs_exact(spark, sf):
    from tmaps.operators import cells
    inp = Inputs(spark, sf)
    st = inp.state1()
    rep = cells.bh_repulsion(st, 0.5)
    ex = kernel.map_pass(st, n=inp.n)
    j = rep.join(ex, ["id", "map"])
    off_z = F.abs(F.sum("sum_q") - F.sum("a")) / F.sum("a")
    off_force = (F.sqrt(F.sum((F.col("n1") - F.col("r1")) ** 2 + (F.col("n2") - F.col("r2")) ** 2))
                 / F.sqrt(F.sum(F.col("r1") ** 2 + F.col("r2") ** 2)))
    return j.agg((off_z < BH_TOLERANCE_Z).alias("z_close"), (off_force < BH_TOLERANCE_FORCE).alias("force_close"), F.count("*").alias("n"))


def _bh_steps_sql() -> list[str]:
    """Two Barnes-Hut steps from the hashed start: exaggeration ends and momentum changes at the second."""
    out = [f"s0 AS MATERIALIZED (SELECT id, 0.0001 * {O.gaussian(7, '0', 1)} AS y1, 0.0001 * {O.gaussian(7, '0', 2)} AS y2, 0.0 AS iy1, 0.0 AS iy2, "
           "1.0 AS g1, 1.0 AS g2 FROM vec)"]
    for k, scale, momentum in ((1, 4.0, 0.5), (2, 1.0, 0.8)):
        tail = _step_sql(k, scale, momentum)[5:]  # gains, move and centring from gr{k}
        out += O.tree_walk(f"t{k}", f"s{k - 1}", 0.5) + [_bh_gradient_sql(f"t{k}", f"s{k - 1}", scale, f"gr{k}")] + tail
    return out


@register("tsne_bh", O.with_("joint", extra=_bh_steps_sql()) + f"SELECT id, CAST(0 AS INTEGER) AS map, {O.rnd('y1', 6)} AS y1, {O.rnd('y2', 6)} AS y2 FROM s2")
def q_tsne_bh(spark, sf):
    from tmaps.plans import jobs
    inp = Inputs(spark, sf)
    res = jobs.tsne_bh(inp.vectors(), max_iterations=2, seed=7, params=TSNEParams(early_exaggeration=1, t_momentum=1), report_loss=None,
                       joint=inp.joint(), n=inp.n)
    return res.state.select("id", F.col("map").cast("int").alias("map"), rnd("y1", 6).alias("y1"), rnd("y2", 6).alias("y2"))


def _bh_report_sql() -> str:
    """Loss and preservation that the job reports before its first and its second step."""
    out = []
    for k, scale in ((1, 4.0), (2, 1.0)):
        st, rep = f"s{k - 1}", f"t{k}rep"
        pairs = f"(SELECT x.id AS i, y.id AS j, 1.0 / (1.0 + ((x.y1 - y.y1) * (x.y1 - y.y1) + (x.y2 - y.y2) * (x.y2 - y.y2))) AS num FROM {st} x JOIN {st} y ON x.id <> y.id)"
        out.append(f"SELECT CAST({k} AS INTEGER) AS iteration, 'kl' AS name, {O.rnd(f'sum(p * {scale} * ln(greatest(p * {scale}, 1e-12) / greatest(num / (SELECT sum(sum_q) FROM {rep}), 1e-12)))', 6)} "
                   f"AS value FROM joint JOIN {pairs} q USING (i, j)")
        out.append(f"SELECT CAST({k} AS INTEGER), 'preservation', {O.rnd('count(*) / (SELECT n FROM nrows)', 9)} FROM "
                   "(SELECT i, j FROM joint QUALIFY row_number() OVER (PARTITION BY i ORDER BY p DESC, j) = 1) a JOIN "
                   f"(SELECT i, j FROM {pairs} QUALIFY row_number() OVER (PARTITION BY i ORDER BY num DESC, j) = 1) b USING (i, j)")
    return " UNION ALL ".join(out)


@register("bh_job_report", O.with_("joint", "nrows", extra=_bh_steps_sql()) + _bh_report_sql())
def q_bh_job_report(spark, sf):
    """Loss and neighbourhood preservation as the Barnes-Hut job reports them."""
    from tmaps.plans import jobs
    inp = Inputs(spark, sf)
    res = jobs.tsne_bh(inp.vectors(), max_iterations=2, seed=7, params=TSNEParams(early_exaggeration=1, t_momentum=1), report_loss=lambda it: True,
                       report_every=1, joint=inp.joint(), n=inp.n)
    rows = res.metrics_df(spark).where("name <> 'elapsed_sec'")
    return rows.select(F.col("iteration").cast("int").alias("iteration"), "name",
                       F.when(F.col("name") == "kl", rnd("value", 6)).otherwise(rnd("value", 9)).alias("value"))


@register("tsne_lbfgs", O.with_() + "SELECT count(*) AS n, true AS never_rises, true AS gradient_falls FROM vec")
def q_tsne_lbfgs(spark, sf):
    from tmaps.plans import lbfgs
    inp = Inputs(spark, sf)
    cond, _ = inp.cond_and_betas()
    joint = affinity.joint_affinity(cond, inp.n, floor=None)
    steps = 3
    res = lbfgs.tsne_lbfgs(inp.vectors(), max_iterations=steps, seed=7, joint=joint, n=inp.n)
    loss, norm = ([v for _, name, v in res.metrics if name == m] for m in ("kl", "grad_norm"))
    phases = [loss[:steps], loss[steps:]]  # the loss of a phase is that of its own P
    falls = all(b <= a for p in phases for a, b in zip(p, p[1:]))
    return res.state.agg(F.count("*").alias("n"), F.lit(falls and all(phases)).alias("never_rises"),
                         F.lit(min(norm[1:]) < norm[0]).alias("gradient_falls"))
