"""Kernels of block pairs, on Arrow tables alone."""
import numpy as np
import pyarrow as pa

from tmaps.operators import blocks


def _pair(rng, n, maps, same=False):
    y, pi = rng.normal(size=(maps, n, 2)) * 3, rng.random((maps, n))
    blk = np.zeros(n, np.int32) if same else (np.arange(n) % 2).astype(np.int32)
    t = pa.table({"_lo": np.zeros(maps * n, np.int32), "_hi": np.full(maps * n, 0 if same else 1, np.int32), "_b": np.tile(blk, maps),
                  "id": np.tile(np.arange(n), maps), "map": np.repeat(np.arange(maps), n).astype(np.int32),
                  "y1": y[:, :, 0].ravel(), "y2": y[:, :, 1].ravel(), "pi": pi.ravel()})
    meet = np.ones((n, n), bool) if same else blk[:, None] != blk[None, :]
    return t, y, pi, meet & ~np.eye(n, dtype=bool)


def test_sums_over_tiles_match_whole_matrices(monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 16)
    rng = np.random.default_rng(1)
    for n, same in ((75, False), (61, True), (3, False), (1, True)):
        t, y, pi, meet = _pair(rng, n, 2, same)
        got = blocks.map_sums_kernel(2)(t).to_pandas().set_index(["map", "id"])
        assert len(got) == (2 * n if same or n > 1 else 0)
        for m in range(2):
            diff = y[m][:, None] - y[m][None]
            num = np.where(meet, 1 / (1 + (diff ** 2).sum(axis=2)), 0)
            g = got.loc[m].sort_index()
            assert np.allclose(g["s"], num @ pi[m], rtol=1e-12)
            assert np.allclose(g["a"], pi[m] * (num @ pi[m]), rtol=1e-12)
            assert np.allclose(g[["r1", "r2"]], np.einsum("i,ij,j,ijk->ik", pi[m], num ** 2, pi[m], diff), atol=1e-12)


def test_edges_are_summed_in_their_block_pair():
    rng = np.random.default_rng(2)
    t, y, pi, _ = _pair(rng, 40, 3)
    i, j = rng.integers(0, 20, 500) * 2, rng.integers(0, 20, 500) * 2 + 1
    p = rng.random(500) / 500
    edges = pa.table({"i": i, "j": j, "p": p})
    out = blocks.fused_kernel(2, False, 2.0)(t, edges).to_pandas()
    assert len(out) <= 2 * 40 * 3  # a row of sums and one of edges for each point and map, not one of each edge
    diff = y[:, i] - y[:, j]
    num = 1 / (1 + (diff ** 2).sum(axis=2))
    qq = pi[:, i] * pi[:, j] * num
    qz = blocks.REALMIN + qq.sum(axis=0)
    for m in range(3):
        g = out[out["map"] == m].groupby("id").sum().reindex(range(40)).fillna(0.0)
        assert np.allclose(g["t"], np.bincount(i, pi[m][j] * num[m] * 2 * p / qz, minlength=40))
        assert np.allclose(g["pn"], np.bincount(i, 2 * p * pi[m][j], minlength=40))
        assert np.allclose(g["e1"], np.bincount(i, qq[m] * num[m] * 2 * p / qz * diff[m][:, 0], minlength=40))
    assert np.isclose(out["ps"].sum(), 2 * p.sum()) and np.isclose(out["qmin"].min(), qz.min())
    assert np.isclose(out["lp"].sum(), (2 * p * np.log(2 * p / qz)).sum())


def test_copies_of_map_rows_stay_few():
    """Copies and partial sums are n · B rows: B follows the cores, not every thousand points."""
    assert blocks.map_blocks(120_000, 3, 24) <= 16
    assert blocks.map_blocks(720_000, 3, 24) <= 36
    assert blocks.map_blocks(500, 1, 8) * blocks.MIN_BLOCK_ROWS <= 500 + blocks.MIN_BLOCK_ROWS


def test_later_candidates_meet_the_bound(monkeypatch):
    rng, calls = np.random.default_rng(3), []
    monkeypatch.setattr(blocks, "_topk_rows", lambda *a, real=blocks._topk_rows, **k: calls.append(1) or real(*a, **k))
    x = np.round(rng.normal(size=(200, 2)), 1)  # many ties
    ids = rng.permutation(200)
    ids[:4] = ids[4]  # ids that repeat
    for by_kernel in (False, True):
        calls.clear()
        r, j, v = blocks._nearest(x[:50], ids[:50], x, ids, 7, 20, by_kernel)
        d = ((x[:50][:, None] - x[None]) ** 2).sum(axis=2)
        want = np.where(ids[:50][:, None] == ids[None], np.inf, -1 / (1 + d) if by_kernel else d)
        for row in range(50):
            best = np.lexsort((ids, np.round(want[row], 12)))[:7]
            assert np.allclose(v[r == row], -want[row][best] if by_kernel else want[row][best])
        assert len(r) == 350 and len(calls) < 10


def _search(n=3000):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 16))
    x[:40] = x[40]  # copies
    x[50:60] = 1e4 + 1e-4 * x[50:60]  # near ones, far from the rest
    x[70] = np.nan
    role = np.tile([True, False], n)
    t = pa.table({"_row": role, "id": np.repeat(np.arange(n), 2), "v": pa.array(np.repeat(x, 2, axis=0).tolist(), pa.list_(pa.float64()))})
    return x, t


def test_screened_neighbours_are_the_exact_ones():
    x, t = _search()
    out = blocks.directed_knn_kernel(20, 512)(t).to_pandas().sort_values(["i", "d2", "j"])
    assert 70 not in set(out["i"]) | set(out["j"])
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    for i, group in out.groupby("i"):
        at = np.lexsort((np.arange(len(x)), np.where(np.isnan(d[i]), np.inf, d[i])))[:20]
        assert list(group["j"]) == list(at)
        assert np.allclose(group["d2"], d[i, at], rtol=1e-9)


def test_few_pairs_are_computed_in_double_precision(monkeypatch):
    _, t = _search()
    done = []
    monkeypatch.setattr(blocks, "sq_dist", lambda a, b, real=blocks.sq_dist: done.append(len(a) * len(b)) or real(a, b))
    blocks.directed_knn_kernel(20, 512)(t)
    assert sum(done) < 3000 * 3000 / 10  # before: every pair


def test_sums_of_near_points_need_no_matrix_of_differences(monkeypatch):
    rng = np.random.default_rng(3)
    y, w = rng.normal(size=(300, 2)) * 5 + 1e3, rng.random(300)
    products = blocks._tile_sums(y, w, y[:90], w[:90], False)
    monkeypatch.setattr(blocks, "PRODUCT_EXTENT", -1.0)
    calls = []
    monkeypatch.setattr(blocks, "_product_sums", lambda *a: calls.append(a))
    for got, want in zip(products, blocks._tile_sums(y, w, y[:90], w[:90], False)):
        assert np.allclose(got, want, rtol=1e-11, atol=1e-11)
    assert not calls


def _whole_qz(y, pi, meet):
    total = np.full(meet.shape, blocks.REALMIN)
    for m in range(len(y)):
        with np.errstate(invalid="ignore"):
            d = y[m][:, None] - y[m][None]
            total += pi[m][:, None] * pi[m][None] * (1.0 / (1.0 + (d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1])))
    return np.where(meet & np.isfinite(total), total, -np.inf)


def test_best_kernels_over_tiles_match_whole_matrices(monkeypatch):
    monkeypatch.setattr(blocks, "TOPQ_TILE", 64)
    rng = np.random.default_rng(4)

    def copies(y, pi):
        y[:, ::3], pi[:, ::3] = y[:, :1], pi[:, :1]

    def gaps(y, pi):
        y[0, 5], y[2, 8, 1], pi[1, 9] = np.nan, np.inf, np.nan

    def lone(y, pi):
        pi[:] = np.where(pi < 0.7, 0.0, 1e-200)
        pi[0] = 1.0

    changes = [lambda y, pi: None, lambda y, pi: y.__imul__(1e-5), lambda y, pi: y.__imul__(30.0), lambda y, pi: y.__imul__(1e7),
               lambda y, pi: y[:, ::50].__imul__(1e4), copies, gaps, lone]
    for change in changes:
        for n, same, k in ((300, False, 1), (210, True, 4), (90, True, 80), (5, False, 3)):
            t, y, pi, meet = _pair(rng, max(n, 10), 3, same)
            change(y, pi)
            for name, x in (("y1", y[:, :, 0]), ("y2", y[:, :, 1]), ("pi", pi)):
                t = t.set_column(t.column_names.index(name), name, pa.array(x.ravel()))
            qz = _whole_qz(y, pi, meet)
            order = np.lexsort((np.broadcast_to(np.arange(len(qz)), qz.shape), -qz), axis=1)[:, :k]
            want = [(i, j, qz[i, j]) for i in range(len(qz)) for j in order[i] if qz[i, j] > -np.inf]
            got = blocks.topq_kernel(2, k)(t).to_pandas().sort_values(["i", "qz", "j"], ascending=[True, False, True])
            assert list(got.itertuples(index=False, name=None)) == want


def test_few_pairs_of_maps_go_by_differences(monkeypatch):
    monkeypatch.setattr(blocks, "TOPQ_TILE", 128)
    done = []
    monkeypatch.setattr(blocks._MapSide, "qz", lambda self, i, *a, real=blocks._MapSide.qz: done.append(len(i)) or real(self, i, *a))
    t, *_ = _pair(np.random.default_rng(5), 2000, 3)
    blocks.topq_kernel(2, 1)(t)
    assert sum(done) < 1000 * 1000 / 10  # before: every pair of every map


def test_copies_of_map_rows_do_not_grow_with_the_square(spark, monkeypatch):
    from tmaps.operators import metrics
    rng = np.random.default_rng(6)
    y, pi = rng.normal(size=(3, 400, 2)), rng.dirichlet(np.ones(3), 400).T
    st = spark.createDataFrame([(i, m, *map(float, y[m, i]), float(pi[m, i])) for i in range(400) for m in range(3)],
                               "id bigint, map int, y1 double, y2 double, pi double")
    copies = []
    monkeypatch.setattr(blocks, "replicate_pairs", lambda df, nb, real=blocks.replicate_pairs: copies.append(nb) or real(df, nb))
    got = sorted(tuple(r) for r in metrics.topk_by_q(st, 2, n=200_000, n_maps=3).collect())  # blocks as for 200,000 points
    assert copies[0] <= 16  # before: 587 copies of every row
    qz = _whole_qz(y, pi, ~np.eye(400, dtype=bool))
    order = np.lexsort((np.broadcast_to(np.arange(400), qz.shape), -qz), axis=1)
    assert got == sorted((i, int(order[i, r]), r + 1) for i in range(400) for r in range(2))
