"""conditional and joint affinities of a 4×3 matrix at perplexity 2 (values derived by hand/numpy)."""
import math

import pytest
from pyspark.sql import functions as F

from tmaps.operators import affinity, neighbors


@pytest.fixture(scope="module")
def f1(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0]), (2, [7.0, 8.0, 9.0]), (3, [10.0, 11.0, 12.0])]
    return spark.createDataFrame(rows, "id bigint, v array<double>")


def test_knn_squared_distances(f1):
    knn = neighbors.knn_join(f1, int(3 * 2.0), n=4)
    got = {(r.i, r.j): r.d2 for r in knn.collect()}
    assert len(got) == 12
    assert got[(0, 1)] == pytest.approx(27.0)
    assert got[(0, 2)] == pytest.approx(108.0)
    assert got[(0, 3)] == pytest.approx(243.0)
    ranks = {(r.i, r.j): r.r for r in knn.collect()}
    assert ranks[(0, 1)] == 1 and ranks[(0, 3)] == 3


def test_conditional_affinities(f1):
    knn = neighbors.knn_join(f1, 6, n=4)
    cond, betas = affinity.cond_affinity(knn, 2.0, 1e-5, with_betas=True)
    p = {(r.i, r.j): r.p for r in cond.collect()}
    assert p[(0, 1)] == pytest.approx(0.727175, abs=1e-6)
    assert p[(0, 2)] == pytest.approx(0.236464, abs=1e-6)
    assert p[(0, 3)] == pytest.approx(0.036361, abs=1e-6)
    assert p[(1, 0)] == pytest.approx(0.5, abs=1e-9)
    assert p[(1, 3)] == pytest.approx(0.0, abs=1e-30)
    b = {r.i: r for r in betas.collect()}
    assert b[0].beta == pytest.approx(0.01386880874633789, rel=1e-12)
    assert b[0].tries == 21 and b[3].tries == 21
    assert b[1].beta == 1.0 and b[1].tries == 0


def test_joint_affinities_sum_to_one(f1):
    knn = neighbors.knn_join(f1, 6, n=4)
    cond = affinity.cond_affinity(knn, 2.0)
    joint = affinity.joint_affinity(cond, 4)
    p = {(r.i, r.j): r.p for r in joint.collect()}
    assert p[(0, 1)] == pytest.approx(0.153397, abs=1e-6)
    assert p[(1, 2)] == pytest.approx(0.125, abs=1e-9)
    assert p[(0, 3)] == pytest.approx(0.00909, abs=1e-5)
    assert sum(p.values()) == pytest.approx(1.0, abs=1e-9)
    assert p[(0, 1)] == p[(1, 0)]


def test_perplexity_reached_where_converged(spark):
    from tmaps.sources import load_vectors
    from tests.conftest import SF
    v = load_vectors(spark, SF)
    knn = neighbors.knn_join(v, 90)
    lists = affinity.calibrate_lists(affinity.neighbour_lists(knn), 30.0)
    bad = lists.where(F.col("converged") & (F.abs(F.col("h") - F.lit(math.log(30.0))) > 1e-5)).count()
    assert bad == 0
    assert lists.where(~F.col("converged")).count() == 0


def test_laplacian_rows_sum_to_zero(f1):
    knn = neighbors.knn_join(f1, 6, n=4)
    joint = affinity.joint_affinity(affinity.cond_affinity(knn, 2.0), 4)
    lap = affinity.graph_laplacian(joint)
    sums = [r.s for r in lap.groupBy("i").agg(F.sum("l").alias("s")).collect()]
    assert all(abs(s) < 1e-15 for s in sums)


def test_bad_parameters(f1):
    knn = neighbors.knn_join(f1, 6, n=4)
    with pytest.raises(ValueError):
        affinity.calibrate_beta(knn, perplexity=0.0)
    with pytest.raises(ValueError):
        affinity.calibrate_beta(knn, tol=-1.0)


def test_sql_calibration_equals_the_arrow_one(f1):
    knn = neighbors.knn_join(f1, 6, n=4)
    a, b = ({r.i: r for r in affinity.calibrate_beta(knn, 2.0, method=m).collect()} for m in ("arrow", "sql"))
    for i in a:
        assert (a[i].tries, a[i].converged) == (b[i].tries, b[i].converged)
        assert a[i].beta == pytest.approx(b[i].beta, rel=1e-12)
