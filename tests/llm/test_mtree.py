import math
import os

import numpy as np
import pytest

from tmaps.llm import mtree as X

SCHEMA = "vec_id long, embedding array<float>, label int, query_id long, score long, node int, part int, v int"


def rows_with(vectors):
    return [(i, v, 0, 1, 1, 1, 1, 1) for i, v in vectors]


def brute(vectors, every, k):
    fine = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, [math.floor(float(np.float32(x)) * 1024) for x in v])
    out = []
    for q in sorted(i for i in fine if i % every == 0):
        s = sorted((-sum(a * b for a, b in zip(fine[q], fine[i])), i) for i in fine if i != q)
        out += [(q, r + 1, i, -p) for r, (p, i) in enumerate(s[:k])]
    return sorted(out)


def check(spark, vectors, every=5, k=10, **kw):
    df = spark.createDataFrame(rows_with(vectors), SCHEMA)
    got = X.search(df, df.where(f"vec_id % {every} = 0"), k, **kw)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(vectors, every, k)


def test_clusters_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 8))
    vectors = [(i, (centre[i % 6] + 0.05 * rng.normal(size=8)).tolist()) for i in range(300)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(120)] + [(2000 + i, [0.0] * 8) for i in range(15)]
    vectors += [(3000, None), (3005, [float("nan")] * 8), (3010, [float("inf")] + [0.0] * 7), (3015, [None] * 8), (None, [1.0] * 8), (3020, [1e5] * 8),
                (3025, [1.0, 2.0]), (3030, []), (0, vectors[0][1]), (0, vectors[0][1])]
    check(spark, vectors, routes=7, page=16, query_block=8)


def test_defaults_and_long_products(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, (rng.normal(size=4) * 1000).round(3).tolist()) for i in range(90)])
    check(spark, [(i, [float(x) for x in rng.integers(-200000, 200000, 4)]) for i in range(60)])


def test_few_candidates_and_empty_table(spark):
    check(spark, [(5, [1.0, 0.0]), (6, [0.0, 1.0])])
    check(spark, [(5, [1.0])])
    empty = spark.createDataFrame([], SCHEMA)
    assert X.search(empty, empty).count() == 0


def test_components_past_all_words(spark):
    """Products past 2**53 and past 2**63 are exact while the results fit."""
    rng = np.random.default_rng(3)
    check(spark, [(i, [float(x) for x in rng.integers(-2 ** 20, 2 ** 20, 3)]) for i in range(60)])
    # large components meet zeros only
    big = [(i, [1e9 if i == 10 else 0.0, *rng.normal(size=3).round(3).tolist()]) for i in range(40)]
    check(spark, big)
    both = [(i, [1e9 * (i % 5 == 0), 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows_with(both), SCHEMA)
    with pytest.raises(Exception, match="does not fit 64 bits"):
        X.search(df, df.where("vec_id % 5 = 0")).collect()


def test_fewer_products_on_clusters(spark, tmp_path):
    """Best-first rounds: far pages and entries are not multiplied."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(40, 6)) * 3
    vectors = [(i, (centre[i % 40] + 0.01 * rng.normal(size=6)).tolist()) for i in range(1200)]
    done, log = X.Space.products, f"{tmp_path}/products"

    def counted(self, x, q):
        with open(log, "a") as f:
            f.write(f"{len(x)}\n")
        return done(self, x, q)
    X.Space.products = counted
    try:
        df = spark.createDataFrame(rows_with(vectors), SCHEMA)
        got = sorted(tuple(r) for r in X.search(df, df.where("vec_id % 5 = 0"), 10, routes=12, page=20, query_block=16).collect())
    finally:
        X.Space.products = done
    assert got == brute(vectors, 5, 10)
    if os.path.exists(log):  # the workers took the counting method with the kernel
        assert sum(map(int, open(log))) < 240 * 1200 / 3


def test_bounds_spare_computations():
    """Entries out of reach by their stored parent distance are not multiplied."""
    space = X.Space(np.array([[100.0, 0.0]]), 10000.0, 2)
    q = np.array([[100.0, 0.0]])
    far = space.stored(np.array([[-100.0, 0.0]]))[0, 0]
    assert space.queries(q)[0, 0] + space.radius(q, np.array([9000.0]))[0] < far
