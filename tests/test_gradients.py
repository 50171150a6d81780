"""Finite-difference checks of the exact and multiple-maps gradients (F2, F7)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tmaps.operators import kernel, multimap

RNG = np.random.default_rng(3)
N, MAPS = 8, 3


def _sym_p(n):
    a = RNG.random((n, n))
    p = a + a.T
    np.fill_diagonal(p, 0.0)
    return p / p.sum()


def _joint_df(spark, p):
    rows = [(int(i), int(j), float(p[i, j])) for i in range(len(p)) for j in range(len(p)) if i != j]
    return spark.createDataFrame(rows, "i bigint, j bigint, p double")


def test_kernel_rows_f2(spark):
    st = spark.createDataFrame([(0, 0, 1.0, 4.0), (1, 0, 2.0, 5.0), (2, 0, 3.0, 6.0)],
                               "id bigint, map int, y1 double, y2 double")
    got = {r.id: r.num_sum for r in kernel.student_t_kernel(st, n=3).collect()}
    assert got[0] == pytest.approx(1 / 3 + 1 / 9)
    assert got[2] == pytest.approx(1 / 9 + 1 / 3)
    assert got[1] == pytest.approx(2 / 3)


def _kl_single(y, p):
    d = ((y[:, None, :] - y[None, :, :]) ** 2).sum(-1)
    num = 1 / (1 + d)
    np.fill_diagonal(num, 0)
    q = num / num.sum()
    m = p > 0
    return float((p[m] * np.log(p[m] / q[m])).sum())


def test_exact_gradient_finite_differences(spark):
    p = _sym_p(N)
    y = RNG.normal(size=(N, 2))
    st = spark.createDataFrame([(i, 0, float(y[i, 0]), float(y[i, 1])) for i in range(N)],
                               "id bigint, map int, y1 double, y2 double")
    g, _ = kernel.tsne_gradient(_joint_df(spark, p), st, iteration=100, n=N)
    got = g.toPandas().set_index("id").sort_index()[["dy1", "dy2"]].to_numpy()
    num = np.zeros_like(y)
    h = 1e-6
    for i in range(N):
        for k in range(2):
            yp, ym = y.copy(), y.copy()
            yp[i, k] += h
            ym[i, k] -= h
            num[i, k] = (_kl_single(yp, p) - _kl_single(ym, p)) / (2 * h)
    np.testing.assert_allclose(got, num, rtol=1e-5, atol=1e-8)
    assert abs(got.sum(0)).max() < 1e-12


def _mm_loss(y, w, p, realmin=1e-12):
    pi = np.exp(-w) / np.exp(-w).sum(1, keepdims=True)
    qz = np.full((N, N), realmin)
    for m in range(MAPS):
        d = ((y[m][:, None, :] - y[m][None, :, :]) ** 2).sum(-1)
        num = 1 / (1 + d)
        np.fill_diagonal(num, 0)
        qz += pi[:, m][:, None] * pi[:, m][None, :] * num
    q = qz / qz.sum()
    msk = p > 0
    return float((p[msk] * np.log(p[msk] / q[msk])).sum())


def test_multimap_gradients_finite_differences(spark):
    p = _sym_p(N)
    y = RNG.normal(size=(MAPS, N, 2))
    w = RNG.normal(size=(N, MAPS))  # non-uniform weights on purpose
    rows = [(i, m, float(y[m, i, 0]), float(y[m, i, 1]), float(w[i, m])) for i in range(N) for m in range(MAPS)]
    st = spark.createDataFrame(rows, "id bigint, map int, y1 double, y2 double, w double")
    sp = multimap.with_proportions(st)
    sums = multimap.mm_all_pairs(sp, 2, N, MAPS)
    z = multimap.mm_total(sums, N).first()["z"]
    joint = _joint_df(spark, p)
    es = multimap.mm_edge_sums(multimap.mm_edge_frame(joint, sp))
    dy = multimap.mm_position_gradient(sums, es, z).toPandas().sort_values(["map", "id"])
    dw = multimap.mm_weight_gradient(sums, es, sp, z).toPandas().sort_values(["id", "map"])
    h = 1e-6
    for m in range(MAPS):
        for i in range(N):
            for k in range(2):
                yp, ym = y.copy(), y.copy()
                yp[m, i, k] += h
                ym[m, i, k] -= h
                fd = (_mm_loss(yp, w, p) - _mm_loss(ym, w, p)) / (2 * h)
                op = dy[(dy["map"] == m) & (dy["id"] == i)][f"dy{k + 1}"].item()
                assert 2 * op == pytest.approx(fd, rel=1e-4, abs=1e-8)  # default scale = half gradient
    for i in range(N):
        for m in range(MAPS):
            wp, wm = w.copy(), w.copy()
            wp[i, m] += h
            wm[i, m] -= h
            fd = (_mm_loss(y, wp, p) - _mm_loss(y, wm, p)) / (2 * h)
            op = dw[(dw["map"] == m) & (dw["id"] == i)]["dw"].item()
            assert op == pytest.approx(fd, rel=1e-4, abs=1e-8)


def test_proportions_sum_to_one(spark):
    w = RNG.normal(size=(N, MAPS))
    st = spark.createDataFrame([(i, m, float(w[i, m])) for i in range(N) for m in range(MAPS)], "id bigint, map int, w double")
    s = multimap.map_proportions(st).groupBy("id").agg(F.sum("pi").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in s)


def test_laplacian_penalty_from_the_fused_pass(spark):
    from pyspark.sql import functions as F
    from tmaps.operators import affinity, blocks, multimap
    rows = [(i, m, 0.3 * i - m, 0.1 * i * m, 0.2 * i + m) for i in range(6) for m in (0, 1)]
    sp = multimap.with_proportions(spark.createDataFrame(rows, "id bigint, map int, y1 double, y2 double, w double"))
    joint = spark.createDataFrame([(i, j, 0.01 * (i + j)) for i in range(6) for j in range(6) if i != j and (i + j) % 3], "i bigint, j bigint, p double")
    sums = blocks.fused_pass(sp, blocks.key_edges(joint, 2), 2, 2, False, 4.0)
    got = multimap.laplacian_penalty(sums, sp, affinity.affinity_degree(joint), 0.1, 4.0).first()["penalty"]
    lpi = multimap.laplacian_smooth(joint, sp, 4.0)
    want = lpi.join(sp, ["id", "map"]).agg(0.1 * F.sum(F.col("pi") * F.col("lpi"))).first()[0]
    assert abs(got - want) < 1e-12


def test_halo_pass_equals_the_edge_joins(spark):
    from tmaps.operators import neighbors
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    st = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(120, 2)))], "id bigint, map int, y1 double, y2 double")
    joint = spark.createDataFrame([(i, int(j), float(rng.uniform(1e-6, 1e-3))) for i in range(110) for j in rng.choice(120, 9, replace=False) if i != j], "i bigint, j bigint, p double")
    edges, needed = kernel.halo(joint, neighbors.place(v, 120, 30).rows)
    got = kernel.halo_pass(edges, needed, st, 2, 4.0)
    a = got.toPandas().set_index("id").sort_index()
    b = kernel.edge_pass(joint, st, 2, 4.0).toPandas().set_index("id").sort_index()
    assert len(a) == len(b) and np.abs(a[["e1", "e2"]] - b[["e1", "e2"]]).max().max() < 1e-15
    want = kernel.bh_kl_loss(joint.selectExpr("i", "j", "p * 4 as p"), st, 50.0).first()["loss"]
    assert kernel.halo_loss(got, 50.0) == pytest.approx(want, rel=1e-12)
    # neither the edges nor the halo move: the state goes to the halo, the halo's positions to the blocks
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kernel.halo_pass(edges, needed, st, 2, 4.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
    with pytest.raises(Exception, match="no position"):
        kernel.halo_pass(edges, needed, st.where("id <> 3"), 2).collect()


def _counted(monkeypatch, tmp_path, name):
    """Every run of a kernel leaves a file."""
    import uuid

    from tmaps.operators import blocks
    real = getattr(blocks, name)

    def kernel(*of):
        inner = real(*of)

        def one(t):
            (tmp_path / uuid.uuid4().hex).touch()
            return inner(t)

        def two(t, more):
            (tmp_path / uuid.uuid4().hex).touch()
            return inner(t, more)
        return one if name == "map_sums_kernel" else two
    monkeypatch.setattr(blocks, name, kernel)
    return lambda: len(list(tmp_path.iterdir()))


def _small(spark):
    from tmaps.operators import blocks
    state = spark.range(200).selectExpr("id", "cast(0 as int) as map", "sin(id) as y1", "cos(3 * id) as y2")
    joint = spark.range(200).selectExpr("id as i", "(id + 1) % 200 as j", "1 / 400D as p")
    joint = joint.union(joint.selectExpr("j", "i", "p"))
    nb = blocks.map_blocks(200, 1, blocks.default_min_groups(spark))
    return state, joint, nb * (nb + 1) // 2


def test_gradient_evaluates_each_block_pair_once(spark, monkeypatch, tmp_path):
    from tmaps.operators import kernel
    state, joint, pairs = _small(spark)
    runs = _counted(monkeypatch, tmp_path, "map_sums_kernel")
    assert len(kernel.tsne_gradient(joint, state, n=200)[0].collect()) == 200
    assert runs() == pairs


def test_iteration_evaluates_each_block_pair_once(spark, monkeypatch, tmp_path):
    from tmaps.plans import jobs
    state, joint, pairs = _small(spark)
    vectors = state.selectExpr("id", "array(y1, y2) as v")
    runs = _counted(monkeypatch, tmp_path, "fused_kernel")
    jobs.tsne_exact(vectors, max_iterations=2, loss_every=1, report_every=0, start=state, joint=joint, n=200)
    assert runs() == 2 * pairs


def test_edge_pass_is_the_frame_summed(spark):
    """Edge sums by block pair, without an edge's two joins: points of repeated ids, unlike numbers of rows, absent ends."""
    rows = [(i, m, *map(float, RNG.normal(size=2)), float(RNG.normal())) for i in range(30) for m in range(MAPS)]
    rows += [(i, m, *map(float, RNG.normal(size=2)), float(RNG.normal())) for i in (3, 4) for m in range(MAPS)]  # ids that repeat
    rows += [(5, 0, 0.5, 0.25, 0.0), (None, 0, 1.0, 1.0, 1.0)]
    sp = multimap.with_proportions(spark.createDataFrame(rows, "id bigint, map int, y1 double, y2 double, w double"))
    edges = [(i, j, float(RNG.uniform(1e-4, 1e-2))) for i in range(32) for j in range(32) if i != j and (i + j) % 3]
    joint = spark.createDataFrame([*edges, (None, 1, 0.1), (2, None, 0.1)], "i bigint, j bigint, p double")
    rows_of = lambda df: {(r["id"], r["map"]): (r["t"], r["e1"], r["e2"]) for r in df.collect() if r["t"] is not None and r["map"] is not None}
    want = rows_of(multimap.mm_edge_sums(multimap.mm_edge_frame(joint, sp)))
    found = multimap.mm_edge_pass(joint, sp, 2, 30, MAPS)
    got = rows_of(found)
    assert want and got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-14)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
