"""Block-pair kNN against brute force on a fixture of the given table."""
import numpy as np

from tmaps.operators import neighbors
from tmaps.sources import load_vectors
from tests.conftest import SF


def test_knn_matches_brute_force(spark):
    v = load_vectors(spark, SF).where("id < 300")
    got = neighbors.knn_join(v, 7, block_rows=64).toPandas()
    pdf = v.orderBy("id").toPandas()
    X = np.stack(pdf["v"].to_numpy())
    ids = pdf["id"].to_numpy()
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for row, i in enumerate(ids):
        want = ids[np.lexsort((ids, D[row]))[:7]]
        have = got[got.i == i].sort_values("r")["j"].to_numpy()
        assert list(have) == list(want)


def test_pair_distance_summary(spark):
    v = load_vectors(spark, SF).where("id < 120")
    s = neighbors.pair_distances(v, block_rows=32).toPandas().set_index("i").sort_index()
    pdf = v.orderBy("id").toPandas()
    X = np.stack(pdf["v"].to_numpy())
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    n = len(X)
    assert (s["n_pairs"] == n - 1).all()
    off = ~np.eye(n, dtype=bool)
    np.testing.assert_allclose(s["d2_sum"].to_numpy(), np.where(off, D, 0).sum(1), rtol=1e-10)
    np.testing.assert_allclose(s["d2_min"].to_numpy(), np.where(off, D, np.inf).min(1), rtol=1e-10)


def test_single_row_has_no_pairs(spark):
    v = load_vectors(spark, SF).where("id = 3")
    assert neighbors.knn_join(v, 5).count() == 0


def test_knn_with_a_third_of_rows_identical(spark):
    """Hot group: 100 of 300 rows are copies of one vector — exactly k rows per
    point, ties at distance 0 broken by j, as brute force."""
    from pyspark.sql import functions as F
    base = load_vectors(spark, SF).where("id < 300")
    v0 = base.where("id = 0").first()["v"]  # one fixture vector
    v = base.select("id", F.when(F.col("id") < 100, F.array(*[F.lit(float(x)) for x in v0]))
                    .otherwise(F.col("v")).alias("v"))
    got = neighbors.knn_join(v, 7, block_rows=64).toPandas()
    assert (got.groupby("i").size() == 7).all()
    pdf = v.orderBy("id").toPandas()
    X = np.stack(pdf["v"].to_numpy())
    ids = pdf["id"].to_numpy()
    D = ((X[:, None, :] - X[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(D, np.inf)
    for row, i in enumerate(ids):
        want = ids[np.lexsort((ids, D[row]))[:7]]
        have = got[got.i == i].sort_values("r")["j"].to_numpy()
        assert list(have) == list(want)


def test_offset_data_and_ragged_vectors(spark):
    """A constant far from the origin changes no neighbour; widths must agree."""
    import numpy as np
    import pytest
    x = np.random.default_rng(3).normal(size=(200, 64)) + 1e7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbors.knn_join(df, 10, n=200).collect():
        got.setdefault(r.i, {})[r.r] = r.j
        assert abs(r.d2 - d[r.i, r.j]) <= 1e-9 * d[r.i, r.j]
    for i in range(200):
        assert [got[i][k] for k in range(1, 11)] == np.lexsort((np.arange(200), d[i]))[:10].tolist()
    ragged = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 4.0])], "id bigint, v array<double>")
    with pytest.raises(Exception, match="different widths"):
        neighbors.knn_join(ragged, 1, n=2).collect()


def _clustered(n, seed, clusters=12, dims=5, spread=0.02):
    rng = np.random.default_rng(seed)
    return rng.uniform(-1, 1, (clusters, dims))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dims))


def _frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, v array<double>")


def _check(spark, x, k, block_rows):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in neighbors.knn_join(_frame(spark, x), k, n=len(x), block_rows=block_rows).collect():
        got.setdefault(r.i, {})[r.r] = (r.j, r.d2)
    for i in range(len(x)):
        have = [got[i][m] for m in range(1, k + 1)]
        assert [j for j, _ in have] == np.lexsort((np.arange(len(x)), d[i]))[:k].tolist()
        np.testing.assert_allclose([v for _, v in have], np.sort(d[i])[:k], rtol=1e-9, atol=1e-18)


def test_pruned_search_on_clusters_copies_and_far_offsets(spark, monkeypatch):
    x = _clustered(500, 4)
    x[300:420] = x[7]  # a hot cell: a quarter of all rows are copies
    _check(spark, x, 7, 20)
    monkeypatch.setattr(neighbors, "SUPER_ROWS", 60)  # many groups
    _check(spark, np.vstack([x[:250], [[1e6] * 5]]) + 1e4, 5, 16)
    _check(spark, np.random.default_rng(5).normal(size=(200, 6)), 30, 10)  # blocks of fewer rows than k


def test_blocks_out_of_reach_are_left_out(spark):
    x = _clustered(1500, 6, clusters=30)
    placed = neighbors.place(_frame(spark, x), len(x), 50)
    met = neighbors.reachable(placed, 5).collect()
    total, cells = int(placed.parts.sum()), len(placed.pivots)
    pairs = sum(int(placed.parts[r.cell]) for r in met)
    assert pairs < total * total / 4
    # every true neighbour's cell is reached
    at = {r.id: (r.blk, r.cell) for r in placed.rows.select("id", "blk", "cell").collect()}
    reach = {(r.blk, r.cell) for r in met}
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(0, len(x), 7):
        assert all((at[i][0], at[j][1]) in reach for j in np.argsort(d[i])[:5])


def test_nearest_in_map_equals_all_pairs(spark):
    from tmaps.operators import metrics
    rng = np.random.default_rng(8)
    y = np.vstack([rng.normal(size=(500, 2)) * 20, np.repeat([[3.0, 4.0]], 40, axis=0), [[1e5, 1e5]]])
    st = spark.createDataFrame([(i, 0, float(a), float(b)) for i, (a, b) in enumerate(y)], "id bigint, map int, y1 double, y2 double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    pruned, direct = metrics.topk_by_q(st, 6, n=len(y), block_rows=32), metrics.topk_by_q(st, 6, n=len(y), block_rows=4096)
    assert rows(pruned) == rows(direct)


def test_work_in_a_map_grows_less_than_with_the_square(spark):
    rng = np.random.default_rng(9)
    pairs = []
    for n in (1000, 4000):
        placed = neighbors.place(_frame(spark, rng.normal(size=(n, 2))), n, 50)
        pairs.append(sum(int(placed.parts[r.cell]) for r in neighbors.reachable(placed, 5).collect()))
    assert pairs[1] < 8 * pairs[0]  # blocks that meet: 16 times as many with all pairs
