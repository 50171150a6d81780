"""Sources: CSV vectors with rejects, dense row index, column summary (F5)."""
import os
import tempfile

import pytest

from tmaps.operators import metrics
from tmaps.sources import read_csv_vectors, row_index


def test_csv_with_bad_line(spark):
    d = tempfile.mkdtemp(prefix="tmaps-csv-")
    with open(os.path.join(d, "part-0.csv"), "w") as f:
        f.write("1,2,3\n1,x,3\n4,5,6\n")
    good, rejects = read_csv_vectors(spark, d)
    assert sorted(r.id for r in good.collect()) == [0, 2]
    assert [r.line for r in rejects.collect()] == ["1,x,3"]


def test_column_summary_f5(spark):
    df = spark.createDataFrame([(0, [1.0, 10.0, 100.0]), (1, [2.0, 20.0, 200.0]), (2, [3.0, 30.0, 300.0])],
                               "id bigint, v array<double>")
    s = {r.pos: r for r in metrics.column_summary(df).collect()}
    assert [s[k].mean for k in range(3)] == pytest.approx([2, 20, 200], abs=1e-12)
    assert [s[k].variance for k in range(3)] == pytest.approx([1, 100, 10000], abs=1e-12)
    assert [s[k].nnz for k in range(3)] == [3, 3, 3]


def test_row_index_dense(spark):
    df = spark.range(0, 1000).selectExpr("id * 7 % 1000 AS id")
    got = sorted((r.id, r.row_idx) for r in row_index(df, "id", n_parts=5).collect())
    assert got == [(i, i) for i in range(1000)]


def test_csv_ids_follow_file_then_line_order(spark):
    d = tempfile.mkdtemp(prefix="tmaps-csv2-")
    with open(os.path.join(d, "part-00001.csv"), "w") as f:
        f.write("".join(f"{k},{k}\n" for k in range(100, 150)))
    with open(os.path.join(d, "part-00000.csv"), "w") as f:
        f.write("".join(f"{k},{k}\n" for k in range(0, 100)))
    good, rejects = read_csv_vectors(spark, d)
    got = sorted((r.id, r.v[0]) for r in good.collect())
    assert got == [(i, float(k)) for i, k in enumerate(list(range(0, 100)) + list(range(100, 150)))]
    assert rejects.count() == 0


def test_row_index_of_a_large_table_with_payload(spark):
    from pyspark.sql import functions as F
    n = 2_000_000
    df = spark.range(0, n, numPartitions=7).select((F.col("id") * 1_000_003 % n).alias("id"), F.md5(F.col("id").cast("string")).alias("payload"))
    r = row_index(df, "id").agg(F.count("*").alias("n"), F.sum((F.col("row_idx") != F.col("id")).cast("int")).alias("off"),
                                F.count_distinct("payload").alias("kinds")).first()
    assert (r.n, r.off, r.kinds) == (n, 0, n)


def test_csv_ids_of_many_splits(spark):
    """Ids are line positions over files that are read in many splits; good and bad
    lines share one numbering."""
    from pyspark.sql import functions as F
    d = tempfile.mkdtemp(prefix="tmaps-csv3-")
    n = 300_000
    for f in range(3):
        with open(os.path.join(d, f"part-0000{f}.csv"), "w") as out:
            out.write("".join(f"{k},1\n" if k % 1000 else f"{k},bad\n" for k in range(f * n, f * n + n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
    try:
        good, rejects = read_csv_vectors(spark, d)
        g = good.agg(F.count("*").alias("n"), F.sum((F.col("id") != F.get("v", 0)).cast("int")).alias("off")).first()
        r = rejects.agg(F.count("*").alias("n"), F.sum((F.col("id") != F.split("line", ",")[0].cast("long")).cast("int")).alias("off")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert (g.n, g.off, r.n, r.off) == (3 * n - 900, 0, 900, 0)


def test_csv_rejects_other_widths_and_fields_that_are_not_finite(spark):
    d = tempfile.mkdtemp(prefix="tmaps-csv4-")
    with open(os.path.join(d, "part-0.csv"), "w") as f:
        f.write("1,2\n1,2,3\nNaN,1\n1,Infinity\n\n 3 , 4 \n")
    good, rejects = read_csv_vectors(spark, d)
    assert sorted((r.id, list(r.v)) for r in good.collect()) == [(0, [1.0, 2.0]), (5, [3.0, 4.0])]
    assert {r.id: r.reason for r in rejects.collect()} == {1: "another width", 2: "field is not finite", 3: "field is not finite", 4: "unparsable field"}
