"""One point, missing ids, large weights, failing line searches, another working folder."""
import math
import os
import subprocess
import sys
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tmaps.operators import multimap
from tmaps.params import TSNEParams
from tmaps.plans import jobs, lbfgs
from tmaps.sources import load_vectors
from tests.conftest import SF

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_one_point(spark):
    one = spark.createDataFrame([(5, [1.0, 2.0])], "id bigint, v array<double>")
    for job in (jobs.tsne_exact, jobs.tsne_bh, jobs.mm_tsne):
        kw = {"no_maps": 2} if job is jobs.mm_tsne else {}
        res = job(one, max_iterations=2, seed=1, **kw)
        assert all(math.isfinite(r.y1) and math.isfinite(r.y2) for r in res.state.collect())
    assert lbfgs.tsne_lbfgs(one, max_iterations=2).state.count() == 1


def test_a_start_without_some_points_is_an_error(spark):
    v = load_vectors(spark, SF).where("id < 30")
    start = v.where("id < 29").select("id", F.lit(0.0).alias("y1"), F.col("id").cast("double").alias("y2"))
    with pytest.raises(ValueError, match="29"):
        jobs.tsne_exact(v, max_iterations=1, start=start)


def test_edges_to_points_without_a_position_are_an_error(spark):
    from tmaps.operators import blocks
    state = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0), (2, 0, 1.0, 1.0, 1.0)], "id bigint, map int, y1 double, y2 double, pi double")
    edges = blocks.key_edges(spark.createDataFrame([(0, 1, 0.5)], "i bigint, j bigint, p double"), 1)
    with pytest.raises(Exception, match="no position"):
        blocks.fused_pass(state, edges, 1, 2, True, 1.0).collect()


def test_large_weights_give_finite_proportions(spark):
    w = spark.createDataFrame([(0, 0, -800.0), (0, 1, -700.0), (1, 0, 1000.0), (1, 1, -1000.0), (2, 5, 3.0), (2, 9, 3.0)], "id bigint, map int, w double")
    got = {(r.id, r.map): r.pi for r in multimap.map_proportions(w).collect()}
    assert got == {(0, 0): 1.0, (0, 1): pytest.approx(math.exp(-100)), (1, 0): 0.0, (1, 1): 1.0, (2, 5): 0.5, (2, 9): 0.5}


def test_maps_need_not_be_numbered_from_0(spark):
    joint = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5)], "i bigint, j bigint, p double")
    rows = [(i, m, float(i + m), float(m), 0.5) for i in (0, 1) for m in (0, 1)]
    schema = "id bigint, map int, y1 double, y2 double, pi double"
    loss = []
    for add in (0, 7):
        e = multimap.mm_edge_frame(joint, spark.createDataFrame([(i, m + add, *r) for i, m, *r in rows], schema))
        loss.append(multimap.mm_loss(e, 3.0).first()["loss"])
    assert loss[0] == loss[1] and loss[0] is not None


def test_line_search_never_takes_a_rising_step():
    asked = []
    assert lbfgs.wolfe_search(lambda ts: asked.append(ts) or [(1.0 + t, 1.0) for t in ts], 1.0, -1.0) is None
    assert len(asked) == lbfgs.ROUNDS
    t = lbfgs.wolfe_search(lambda ts: [(float("nan"), float("nan")) if t > 0.1 else (1.0 - t, -1.0) for t in ts], 1.0, -1.0, rounds=4)
    assert 0 < t <= 0.1


def test_line_search_meets_the_strong_wolfe_conditions():
    for shift, curve in ((1.0, 1.0), (40.0, 1.0), (0.001, 1.0), (3.0, 0.01)):
        loss = lambda t: curve * (t - shift) ** 2 + 0.1 * curve * shift ** 2 * np.sin(5 * t / shift)
        slope = lambda t: 2 * curve * (t - shift) + 0.5 * curve * shift * np.cos(5 * t / shift)
        rounds = []
        t = lbfgs.wolfe_search(lambda ts: rounds.append(ts) or [(loss(x), slope(x)) for x in ts], loss(0), slope(0))
        assert loss(t) <= loss(0) + lbfgs.ARMIJO * t * slope(0) and abs(slope(t)) <= -lbfgs.WOLFE * slope(0)
        assert len(rounds) <= 8


def test_pairs_without_curvature_are_left_out():
    G = np.eye(5)
    G[0, 2] = G[2, 0] = 0.0
    G[1, 3] = G[3, 1] = 0.5
    assert lbfgs._usable(G, 2) == [1]
    rows = [1, 3, 4]
    assert np.isfinite(lbfgs._direction(G[np.ix_(rows, rows)], 1)).all()


def test_lbfgs_never_rises_over_both_phases(spark):
    v = load_vectors(spark, SF).where("id < 40")
    res = lbfgs.tsne_lbfgs(v, max_iterations=6, perplexity=5.0, seed=3, convergence_tol=0.0)
    loss = [x for _, m, x in res.metrics if m == "kl"]
    assert len(loss) > 6 and all(b <= a for k, (a, b) in enumerate(zip(loss, loss[1:])) if k != 5)
    passes = [x for _, m, x in res.metrics if m == "passes"]
    assert sum(passes) / len(passes) < 2.5  # all-pairs passes a step
    assert np.mean([x for _, m, x in res.metrics if m == "wolfe"]) > 0.8


def _unrolled_lbfgs(y, p, p_scale, steps, m_max=10):
    """The same solver on whole matrices."""
    n = len(y)

    def value(y):
        diff = y[:, None, :] - y[None, :, :]
        num = 1 / (1 + (diff ** 2).sum(-1))
        np.fill_diagonal(num, 0)
        q, pp = num / num.sum(), p * p_scale
        at = pp > 0
        f = (pp[at] * np.log(pp[at] / np.maximum(q[at], 1e-12))).sum()
        return f, 4 * (((pp - q) * num)[:, :, None] * diff).sum(1)
    f, g = value(y)
    pairs = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, r in reversed(pairs):
            a = (s * q).sum() / (s * r).sum()
            alphas.append(a)
            q -= a * r
        q *= (pairs[-1][0] * pairs[-1][1]).sum() / (pairs[-1][1] ** 2).sum() if pairs else 1 / np.sqrt((g ** 2).sum())
        for (s, r), a in zip(pairs, reversed(alphas)):
            q += s * (a - (r * q).sum() / (s * r).sum())
        d, slope = -q, -(g * q).sum()
        t = lbfgs.wolfe_search(lambda ts: [(v[0], (v[1] * d).sum()) for v in (value(y + x * d) for x in ts)], f, slope)
        f_new, g_new = value(y + t * d)
        pairs = (pairs + [(t * d, g_new - g)])[-m_max:]
        y, f, g = y + t * d, f_new, g_new
    return y


def test_lbfgs_positions_against_the_solver_on_whole_matrices(spark):
    rng = np.random.default_rng(4)
    n, steps = 30, 3
    a = rng.random((n, n)) * (rng.random((n, n)) < 0.4)
    p = np.triu(a, 1) + np.triu(a, 1).T
    p /= p.sum()
    y = rng.normal(size=(n, 2))
    v = spark.createDataFrame([(i, [float(i)]) for i in range(n)], "id bigint, v array<double>")
    joint = spark.createDataFrame([(i, j, float(p[i, j])) for i in range(n) for j in range(n) if p[i, j] > 0], "i bigint, j bigint, p double")
    start = spark.createDataFrame([(i, *map(float, y[i])) for i in range(n)], "id bigint, y1 double, y2 double")
    res = lbfgs.tsne_lbfgs(v, max_iterations=steps, convergence_tol=0.0, joint=joint, n=n, start=start)
    want = _unrolled_lbfgs(_unrolled_lbfgs(y, p, 4.0, steps), p, 1.0, steps)
    got = np.array([[r.y1, r.y2] for r in res.state.orderBy("id").collect()])
    assert np.abs(got - want).max() < 1e-6 * np.abs(want).max()


def test_short_schedule_passes_both_changes(spark):
    v = load_vectors(spark, SF).where("id < 60")
    p = TSNEParams(early_exaggeration=2, t_momentum=3, eta=50.0)
    loss = [x for _, m, x in jobs.mm_tsne(v, no_maps=2, max_iterations=8, perplexity=8.0, seed=1, params=p, loss_every=1, report_every=0).metrics if m == "loss"]
    assert len(loss) == 8 and loss[-1] < loss[2]


def test_queries_run_from_another_folder():
    """Executors get the package from the session, not from the working folder."""
    code = ("import sys; sys.path.insert(0, %r); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate(); "
            "print('ROWS', e.queries()['knn_join'](s, %r).count())" % (ROOT, SF))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tempfile.mkdtemp(prefix="tmaps-elsewhere-"), env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 45000" in out.stdout, out.stderr[-2000:]
