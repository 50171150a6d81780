from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_pipeline_run import runs
from tests.llm.test_packing import PATH

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    now = docs
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, SF).cache()
        assert out.columns == docs.columns
        ids, before = [r.doc_id for r in out.select("doc_id").collect()], {r.doc_id for r in now.select("doc_id").collect()}
        assert len(ids) == len(set(ids)) and set(ids) <= before
        texts = {r.doc_id: r.text for r in out.collect()}
        gone = before - set(ids)
        if name == "toxicity":
            assert len(gone & toxic) > 0.5 * len(toxic) and len(gone - toxic) < 0.1 * len(before)
        if name == "language_id":
            assert all(not any(c.isalpha() for c in r.text) for r in now.where(F.col("doc_id").isin(sorted(gone))).collect())
        if name == "exact_dedup":
            assert len({" ".join(t.split()) for t in texts.values()}) == len(texts)
        if name == "ngram_jaccard":
            sets = sorted((d, runs(t or "")) for d, t in texts.items())
            for d, t in ((r.doc_id, runs(r.text or "")) for r in now.where(F.col("doc_id").isin(sorted(gone))).collect()):
                assert t
            assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for i, (_, a) in enumerate(sets) for _, b in sets[:i])
        now = out
    packed = P.STAGES[-1][1](spark, now, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(ids)
    assert PATH.endswith(".json")


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "exact_dedup", "ngram_jaccard", "packing"]
    got = P.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "sequence_id" in got.columns


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_near_copies_of_five_words_and_80_per_cent_go(spark, docs_of):
    base = ["w%d" % i for i in range(200)]
    docs = docs_of([(1, " ".join(base)), (2, " ".join(base + ["x%d" % i for i in range(30)])), (3, " ".join(base[:100] + ["y%d" % i for i in range(100)]))])
    assert sorted(r.doc_id for r in dict(P.STAGES)["ngram_jaccard"](spark, docs, SF).collect()) == [1, 3]


def test_a_worker_lets_go_of_what_its_kernels_freed():
    import os
    import subprocess
    import sys

    import pyarrow as pa
    import pytest
    from tmaps.llm import common
    root = os.path.dirname(os.path.abspath(P.__file__))
    code = """
import numpy as np, pyarrow as pa
from tmaps.llm import common

def held():
    return sum(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) / 1024

def kernel(batches):
    for b in batches:
        many = [np.ones(2000) for _ in range(8000)]
        kept.append(many[-1])  # above all others: they are freed, and stay with the process
        del many
        yield b

for run in (kernel, common.brief(kernel)):
    kept, start = [], held()
    assert sum(b.num_rows for b in run(iter([pa.record_batch({"a": [1, 2]})]))) == 2
    print(held() - start)
"""
    if common._TRIM is None or not os.path.exists("/proc/self/status"):
        pytest.skip("no trimming here")
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": root, "GLIBC_TUNABLES": "glibc.malloc.mmap_threshold=1000000000:glibc.malloc.trim_threshold=1000000000"},
                         capture_output=True, text=True, check=True).stdout.split()
    assert float(out[0]) > 60  # MB, as before
    assert float(out[1]) < -40
    calls = []
    group = common.brief_group(lambda t: calls.append(t.num_rows) or t)
    assert group(pa.table({"a": range(3)})).num_rows == 3 and group(pa.table({"a": range(500)})).num_rows == 500
    assert calls == [3, 500]
