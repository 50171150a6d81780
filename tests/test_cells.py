"""cell indexes, pyramid invariants, Barnes-Hut against exact sums."""
import pytest
from pyspark.sql import functions as F

from tmaps.operators import cells, kernel
from tmaps.sources import load_vectors
from tests.conftest import SF

F4 = [(1, 3), (1, 1), (1, 2), (2, 2), (1.1, 1.1), (1.11, 1.11), (1.11, 1.11), (1, 1)]


@pytest.fixture(scope="module")
def f4(spark):
    return spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(F4)],
                                 "id bigint, map int, y1 double, y2 double")


def test_level_one_counts(f4):
    c = cells.cell_pyramid(f4, 1).where("level = 1").collect()
    got = {(r.c1, r.c2): r.cnt for r in c}
    assert got == {(0, 0): 6, (0, 1): 1, (1, 0): 1}
    root = cells.cell_pyramid(f4, 0).first()
    assert root.m1 == pytest.approx(1.165) and root.m2 == pytest.approx(1.54)


def test_mid_line_goes_to_lower_child(spark):
    # box (0,0)-(2,4): F3 points
    pts = [(0, 0, 0.0, 0.0), (1, 0, 2.0, 4.0), (2, 0, 1.0, 1.0), (3, 0, 1.5, 1.5), (4, 0, 2.0, 2.0), (5, 0, 2.0, 2.5)]
    df = spark.createDataFrame(pts, "id bigint, map int, y1 double, y2 double")
    u = cells._with_unit_coords(df, 2)
    got = {r.id: (r.c1, r.c2) for r in u.select("id", cells.cell_index(F.col("t1"), F.lit(1)).alias("c1"),
                                                 cells.cell_index(F.col("t2"), F.lit(1)).alias("c2")).collect()}
    assert got[2] == (0, 0) and got[3] == (1, 0) and got[4] == (1, 0) and got[5] == (1, 1)


def test_pyramid_invariants(f4):
    c = cells.cell_pyramid(f4, 6)
    per_level = {r.level: r.n for r in c.groupBy("level").agg(F.sum("cnt").alias("n")).collect()}
    assert set(per_level.values()) == {8}
    assert c.where("cnt = 1 AND NOT leaf").count() == 0
    # duplicates form one leaf with count 2
    assert c.where("leaf AND cnt = 2 AND level = 6").count() == 2


def test_bh_matches_exact(spark):
    st = load_vectors(spark, SF).select("id", F.lit(0).alias("map"), (F.get("v", 0) * 10).alias("y1"),
                                         (F.get("v", 1) * 10).alias("y2")).where("id < 200")
    ex = kernel.map_pass(st, n=200).toPandas().set_index("id").sort_index()
    for theta, tol in ((1e-12, 1e-9), (0.5, 0.02)):
        bh = cells.bh_repulsion(st, theta).toPandas().set_index("id").sort_index()
        z_err = abs(bh.sum_q.sum() - ex.a.sum()) / ex.a.sum()
        f_err = (((bh.n1 - ex.r1) ** 2 + (bh.n2 - ex.r2) ** 2).sum() / (ex.r1 ** 2 + ex.r2 ** 2).sum()) ** 0.5
        assert z_err < tol and f_err < tol


def test_duplicates_count_without_self(f4):
    bh = {r.id: r.sum_q for r in cells.bh_repulsion(f4, 1e-12).collect()}
    ex = {r.id: r.a for r in kernel.map_pass(f4, n=8).collect()}
    for i in bh:
        assert bh[i] == pytest.approx(ex[i], rel=1e-12)


def _against_exact(spark, rows, n, n_maps=1):
    st = spark.createDataFrame(rows, "id bigint, map int, y1 double, y2 double")
    ex = kernel.map_pass(st, n=n, n_maps=n_maps).toPandas().set_index(["map", "id"]).sort_index()
    bh = cells.bh_repulsion(st, 1e-12).toPandas().set_index(["map", "id"]).sort_index()
    for a, b in (("sum_q", "a"), ("n1", "r1"), ("n2", "r2")):
        assert (bh[a] - ex[b]).abs().max() <= 1e-9 * ex[b].abs().max()


def _square(n, seed=0):
    import numpy as np
    return np.random.default_rng(seed).uniform(0, 50, (n, 2)).tolist()


def test_outlier_far_away(spark):
    """Cells are opened as deep as it takes to part the points of a tiny corner."""
    rows = [(i, 0, *p) for i, p in enumerate(_square(40))] + [(99, 0, 1e9, 1e9)]
    _against_exact(spark, rows, 41)


def test_cells_of_many_points_are_followed_at_the_last_level_too(spark):
    """Cells of more than FEW_POINTS points well below the topmost levels."""
    squeezed = [(i, 0, *p) for i, p in enumerate(_square(400))] + [(999, 0, 1e5, 1e5)]
    _against_exact(spark, squeezed, 401)
    dense = [(i, 0, *p) for i, p in enumerate(_square(200))]
    dense += [(1000 + i, 0, 7 + a / 1e4, 9 + b / 1e4) for i, (a, b) in enumerate(_square(300, 1))]
    _against_exact(spark, dense, 500)


def test_maps_of_any_number(spark):
    rows = [(i, m, p[0] * (1 + m / 64), p[1]) for m in (0, 256) for i, p in enumerate(_square(40))]
    _against_exact(spark, rows, 40, 2)


def test_blocks_of_points_do_not_change_the_result(spark, monkeypatch):
    rows = [(i, 0, *p) for i, p in enumerate(_square(150))] + [(200 + i, 0, 7.0, 7.0) for i in range(60)]
    st = spark.createDataFrame(rows, "id bigint, map int, y1 double, y2 double")
    whole = cells.bh_repulsion(st, 0.5).toPandas().set_index("id").sort_index()
    monkeypatch.setattr(cells, "BLOCK_POINTS", 16)
    monkeypatch.setattr(cells, "WALK_PAIRS", 500)
    parts = cells.bh_repulsion(st, 0.5).toPandas().set_index("id").sort_index()
    assert (whole - parts).abs().max().max() < 1e-9


def test_one_point_and_equal_points(spark):
    one = spark.createDataFrame([(0, 0, 1.0, 2.0)], "id bigint, map int, y1 double, y2 double")
    assert [tuple(r) for r in cells.bh_repulsion(one).collect()] == [(0, 0, 0.0, 0.0, 0.0)]
    same = spark.createDataFrame([(i, 0, 1.0, 2.0) for i in range(5)], "id bigint, map int, y1 double, y2 double")
    assert [r.sum_q for r in cells.bh_repulsion(same).collect()] == [4.0] * 5


def test_weighted_cells_equal_all_pairs_of_every_map(spark):
    import numpy as np
    from tmaps.operators import multimap
    rng = np.random.default_rng(3)
    n, maps = 90, 3
    y = rng.normal(size=(n, maps, 2)) * 5
    y[10:30] = y[10]  # copies
    w = rng.normal(size=(n, maps)) * 3
    st = spark.createDataFrame([(i, m, *y[i, m].tolist(), float(w[i, m])) for i in range(n) for m in range(maps)], "id bigint, map int, y1 double, y2 double, w double")
    sp = multimap.with_proportions(st).checkpoint()
    key = ["map", "id"]
    a = multimap.mm_cell_pairs(sp, 2, n, 1e-12).toPandas().set_index(key).sort_index()
    b = multimap.mm_all_pairs(sp, 2, n, maps).toPandas().set_index(key).sort_index()
    for c in ("a", "s", "r1", "r2"):
        assert (a[c] - b[c]).abs().max() <= 1e-9 * b[c].abs().max()


def test_work_of_the_walk_grows_less_than_with_the_square(spark):
    """Rows that blocks get: cells and points they may open, not all of them."""
    import numpy as np
    rows = []
    for n in (2000, 8000):
        st = spark.createDataFrame([(i, 0, *p) for i, p in enumerate((np.random.default_rng(1).normal(size=(n, 2)) * 20).tolist())],
                                   "id bigint, map int, y1 double, y2 double")
        points = cells._with_unit_coords(st, 2).selectExpr("id", "map", "y1", "y2", "t1", "t2", "w1", "w2", "1D as pi").cache()
        upper, facts = cells._upper(points, n, 128, 2)
        key = ["map", "level", "c1", "c2"]
        at = cells._located(points, upper.where("small or block").select(*key, "cnt", "small", "block"), facts["levels"], 2)
        at = at.selectExpr("*", "xxhash64(level, c1, c2) as blk").cache()
        reach = cells._reach(at.where("block"), upper, at.where("small"), facts["deepest"], 0.5, 2)
        rows.append(reach.count() / n)
    assert rows[1] < 2 * rows[0]  # four times as many a point with all pairs


def test_walk_that_opens_all_is_the_plain_sum(monkeypatch):
    """Without accepted cells the walk is a sum over points, also for copies and for points that lie
    closer than cells that may be accepted whole."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(3)
    y = rng.normal(size=(300, 2)) * 4
    y[50:60], y[60:80] = y[50], y[40] + rng.normal(size=(20, 2)) * 1e-9
    pi = rng.random(300) + 0.1
    low, wide = y.min(axis=0), np.ptp(y, axis=0)
    t = (y - low) / wide
    c = cells._index(t, np.full(300, 1))
    r2 = float(((wide / 2) ** 2).sum())
    rows = [(False, 0, 0, 0, 0, 300.0, pi.sum(), *(pi[:, None] * y).sum(axis=0), 0.0, 0.0, False, r2 * 4)]
    for a in (0, 1):
        for b in (0, 1):
            at = (c == (a, b)).all(axis=1)
            rows.append((False, 1, 1, a, b, float(at.sum()), pi[at].sum(), *(pi[at][:, None] * y[at]).sum(axis=0), 0.0, 0.0, False, r2))
    rows += [(True, 1, -1, *c[k], 1.0, pi[k], *y[k], *t[k], False, r2) for k in range(300)]
    near = pa.table([pa.array(x) for x in zip(*rows)], names=["point", "level", "top", "c1", "c2", "cnt", "mass", "s1", "s2", "t1", "t2", "final", "r2"])
    points = pa.table({"id": np.arange(300), "map": pa.array(np.zeros(300, np.int32)), "pi": pi, "y1": y[:, 0], "y2": y[:, 1], "t1": t[:, 0], "t2": t[:, 1]})
    diff = y[:, None] - y[None]
    num = 1 / (1 + (diff ** 2).sum(axis=2))
    np.fill_diagonal(num, 0)
    calls = []
    monkeypatch.setattr(cells, "_tile_sums", lambda *a, real=cells._tile_sums: calls.append(len(a[2])) or real(*a))
    got = cells._walk(1e-12, 2)(points, near).to_pandas()
    assert np.allclose(got["sum_q"], num @ pi, rtol=1e-10)
    assert np.allclose(got[["n1", "n2"]], np.einsum("ij,j,ijk->ik", num ** 2, pi, diff), atol=1e-9)
    assert calls and calls[0] > 150
