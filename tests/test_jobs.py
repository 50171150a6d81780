"""Short embedding runs: KL falls, partition-independent starts, entry contract."""
from pyspark.sql import functions as F

from tmaps.params import TSNEParams
from tmaps.plans import jobs
from tmaps.sources import load_vectors
from tests.conftest import SF


def test_init_map_independent_of_partitioning(spark):
    v = load_vectors(spark, SF)
    a = {r.id: (r.y1, r.y2) for r in jobs.init_map(v.repartition(7), seed=5).collect()}
    b = {r.id: (r.y1, r.y2) for r in jobs.init_map(v.coalesce(1), seed=5).collect()}
    assert a == b
    m = jobs.init_map(v, seed=5).agg(F.avg("y1").alias("m"), F.stddev("y1").alias("s")).first()
    assert abs(m.m) < 0.2 and 0.8 < m.s < 1.2


def test_exact_kl_falls_and_map_centred(spark):
    v = load_vectors(spark, SF)
    res = jobs.tsne_exact(v, max_iterations=11, seed=1, params=TSNEParams(early_exaggeration=0),
                          loss_every=1, report_every=0)
    kl = {it: val for it, nm, val in res.metrics if nm == "kl"}
    assert kl[11] < kl[1]
    means = res.state.agg(F.avg("y1").alias("a"), F.avg("y2").alias("b")).first()
    assert abs(means.a) < 1e-9 and abs(means.b) < 1e-9


def test_multimap_loss_falls(spark):
    v = load_vectors(spark, SF)
    res = jobs.mm_tsne(v, no_maps=3, max_iterations=11, seed=1, params=TSNEParams(early_exaggeration=0),
                       loss_every=5, report_every=0, lookahead="none")
    loss = {it: val for it, nm, val in res.metrics if nm == "loss"}
    assert loss[10] < loss[5]


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_lbfgs_loss_never_increases(spark):
    from tmaps.operators import affinity, neighbors
    from tmaps.plans import lbfgs
    v = load_vectors(spark, SF)
    knn = neighbors.knn_join(v, 90)
    joint = affinity.joint_affinity(affinity.cond_affinity(knn, 30.0), 500, floor=None)
    res = lbfgs.tsne_lbfgs(v, max_iterations=3, seed=2, joint=joint, n=500)
    kl = [val for it, nm, val in res.metrics if nm == "kl"]
    phase1, phase2 = kl[:3], kl[3:]
    assert all(b <= a + 1e-12 for a, b in zip(phase1, phase1[1:]))
    assert all(b <= a + 1e-12 for a, b in zip(phase2, phase2[1:]))


def test_same_seed_same_map_under_other_partitioning(spark):
    v = load_vectors(spark, SF)
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for parts in ("3", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            res = jobs.tsne_exact(v.repartition(int(parts)), max_iterations=3, seed=11, loss_every=0, report_every=0)
            out.append({r.id: (r.y1, r.y2) for r in res.state.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    a, b = out
    assert a.keys() == b.keys()
    assert max(max(abs(a[k][0] - b[k][0]), abs(a[k][1] - b[k][1])) for k in a) < 1e-9


def test_checkpoint_interval_does_not_change_the_map(spark):
    v = load_vectors(spark, SF)
    a = jobs.tsne_exact(v, max_iterations=3, seed=4, loss_every=0, report_every=0, checkpoint_every=1)
    b = jobs.tsne_exact(v, max_iterations=3, seed=4, loss_every=0, report_every=0, checkpoint_every=2)
    sa = {r.id: (r.y1, r.y2) for r in a.state.collect()}
    sb = {r.id: (r.y1, r.y2) for r in b.state.collect()}
    assert max(max(abs(sa[k][0] - sb[k][0]), abs(sa[k][1] - sb[k][1])) for k in sa) < 1e-12


def test_barnes_hut_kl_falls(spark):
    v = load_vectors(spark, SF)
    res = jobs.tsne_bh(v, max_iterations=5, seed=3, params=TSNEParams(early_exaggeration=0),
                       report_loss=lambda it: it in (1, 5))
    kl = {it: val for it, nm, val in res.metrics if nm == "kl"}
    assert kl[5] < kl[1]


def test_multimap_with_laplacian_regulariser(spark):
    import math
    v = load_vectors(spark, SF)
    res = jobs.mm_tsne(v, no_maps=2, max_iterations=2, seed=5, params=TSNEParams(laplace=0.1),
                       loss_every=1, report_every=0)
    losses = [val for it, nm, val in res.metrics if nm == "loss"]
    assert len(losses) == 2 and all(math.isfinite(x) for x in losses)
    s = res.state.agg(F.sum(F.col("y1") + F.col("y2") + F.col("w")).alias("s")).first()["s"]
    assert math.isfinite(s)


def test_static_edges_are_not_shuffled_again(spark):
    """An iteration of the exact job exchanges the replicated positions, not the P edges."""
    from tmaps.operators import blocks
    joint = spark.range(400).selectExpr("id % 40 as i", "(id * 7 + 1) % 40 as j", "1e-4D as p").where("i <> j").checkpoint()
    nb, edges = jobs._keyed_edges(spark, joint, 40, 1)
    state = spark.range(40).selectExpr("id", "0 as map", "id / 7D as y1", "id % 5 + 0D as y2", "1D as pi")
    plan = blocks.fused_pass(state, edges, nb, 2, True, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_lo") == 1, plan


class _Killed(Exception):
    pass


def test_a_killed_run_goes_on_after_its_last_iteration(spark, tmp_path):
    """The same map as a run that never stopped, and no doubled frames or metrics."""
    v = load_vectors(spark, SF).where("id < 60")
    joint = jobs.affinities(v, 5.0)[0]

    def kill(iteration, state, loss):
        if iteration == 2:
            raise _Killed

    def run(job, folder, **kw):
        return job(v, max_iterations=3, seed=3, joint=joint, n=60, run_id="r-1", state_path=f"{folder}/state", metrics_path=f"{folder}/metrics",
                   trajectory_path=f"{folder}/frames", trajectory_every=1, **kw)

    for name, job, kw in (("maps", jobs.mm_tsne, {"no_maps": 2, "report_every": 0, "loss_every": 1}),):
        whole, parts = f"{tmp_path}/{name}-whole", f"{tmp_path}/{name}-parts"
        a = run(job, whole, **kw)
        try:
            run(job, parts, callback=kill, **kw)
            raise AssertionError("not killed")
        except _Killed:
            pass
        # the killed run had begun to write what comes next
        spark.read.parquet(f"{parts}/metrics").selectExpr("'r-1' as run_id", "3 as iteration", "name", "-1D as value").limit(1).write.mode("append").partitionBy("run_id", "iteration").parquet(f"{parts}/metrics")
        b = run(job, parts, **kw)
        assert {m[0] for m in b.metrics} == {3}
        cols = [c for c in a.state.columns if c not in ("id", "map")]
        x, y = ({(r.id, r["map"]): [r[c] for c in cols] for r in res.state.collect()} for res in (a, b))
        assert x.keys() == y.keys() and all(abs(p - q) < 1e-9 for k in x for p, q in zip(x[k], y[k]))
        for table, key in (("frames", ["iteration", "id", "map"]), ("metrics", ["iteration", "name"])):
            rows = [sorted(tuple(r[c] for c in key) for r in spark.read.parquet(f"{f}/{table}").collect()) for f in (whole, parts)]
            assert rows[0] == rows[1] and len(set(rows[1])) == len(rows[1])
        again = run(job, parts, **kw)  # complete: nothing is done twice
        assert again.metrics == [] and again.state.count() == a.state.count()


def test_plan_sizes_do_not_grow_with_the_iterations(spark):
    """Every iteration starts from a table of known size: estimates are not multiplied up."""
    v = load_vectors(spark, SF).where("id < 60")
    sizes = []
    res = jobs.tsne_exact(v, max_iterations=6, perplexity=5.0, loss_every=0, report_every=0,
                          callback=lambda it, state, loss: sizes.append(int(str(state._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))))
    assert res.state.count() == 60 and max(sizes) < 1_000_000


def test_positions_that_are_no_numbers_stop_the_run(spark):
    import pytest
    v = load_vectors(spark, SF).where("id < 40")
    joint = jobs.affinities(v, 5.0)[0]
    bad = jobs.init_map(v).withColumn("y1", F.when(F.col("id") == 3, F.lit(float("nan"))).otherwise(F.col("y1")))
    with pytest.raises(ValueError, match="iteration 0: 1 positions"):
        jobs.tsne_exact(v, max_iterations=2, joint=joint, n=40, start=bad)
    joint = joint.withColumn("p", F.when((F.col("i") == 1), F.lit(float("nan"))).otherwise(F.col("p")))
    for every in (1, 2):  # by the write of a table, and in between
        with pytest.raises(ValueError, match="iteration 1: "):
            jobs.tsne_exact(v, max_iterations=3, joint=joint, n=40, loss_every=0, report_every=0, checkpoint_every=every)
