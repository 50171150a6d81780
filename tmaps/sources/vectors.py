"""Sources of high-dimensional vectors.

Canonical schema: ``vectors(id BIGINT, v ARRAY<DOUBLE>[, label INT])``.  The
table's own key is kept as ``id``; dense positions are only produced on request
(:func:`row_index`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tmaps.session import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def load_vectors(spark: SparkSession, sf_dir: str, with_label: bool = True) -> DataFrame:
    """``embeddings(vec_id, embedding ARRAY<FLOAT>, label)`` → ``vectors(id, v ARRAY<DOUBLE>, label)``.

    The cast to double happens before any arithmetic so that sums agree with
    an engine that casts the same way.
    """
    e = table(spark, sf_dir, "embeddings")
    cols = [F.col("vec_id").cast("bigint").alias("id"),
            F.col("embedding").cast("array<double>").alias("v")]
    if with_label:
        cols.append(F.col("label").cast("int").alias("label"))
    return e.select(*cols)


def pack_vectors(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Pack numeric columns of any table into the vector schema (second input schema)."""
    return df.select(F.col(key).cast("bigint").alias("id"),
                     F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))


def write_csv_vectors(vectors: DataFrame, path: str) -> None:
    """Write vectors as headerless comma-separated numeric lines (one vector per line),
    ordered by id so that line position equals id order."""
    (vectors.orderBy("id")
     .select(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))).alias("value"))
     .write.mode("overwrite").text(path))


def read_csv_vectors(spark: SparkSession, path: str, min_partitions: int | None = None, width: int | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """Numeric text lines → ``(vectors(id, v), rejects(id, line, reason))``.

    Every field is parsed with ``try_cast`` so a bad field does not fail the job:
    such lines go to the reject table, as do lines with a field that is not finite
    and lines of another width than ``width`` (by default that of the first good
    line).  ``id`` is the 0-based line position over the files in name order (the
    positional key of the text format).
    """
    # A split's lines stand together, in order, so their running numbers less the
    # split's first one are their places in it; the counts of the splits before it
    # do the rest.  Both come from one written table: no sort, no second evaluation.
    lines = stored(spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
        F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line")), "csv-lines")
    splits = lines.groupBy("_f", "_s").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    parsed = lines.join(splits, ["_f", "_s"]).select(
        (F.col("_before") + F.col("_m") - F.col("_first")).alias("id"), "line",
        F.transform(F.split(F.trim("line"), ","), lambda x: F.trim(x).try_cast("double")).alias("v"))
    if min_partitions:
        parsed = parsed.repartition(min_partitions)
    reason = (F.when((F.trim("line") == "") | F.exists("v", lambda x: x.isNull()), "unparsable field")
              .when(F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "field is not finite"))
    parsed = parsed.withColumn("reason", reason)
    if width is None:
        width = parsed.where("reason is null").agg(F.min_by(F.size("v"), "id")).first()[0]
    parsed = parsed.withColumn("reason", F.coalesce("reason", F.when(F.size("v") != F.lit(width), "another width")))
    return (parsed.where("reason is null").select("id", "v"),
            parsed.where("reason is not null").select("id", "line", "reason"))


def row_index(df: DataFrame, order_col: str | list[str] = "id", n_parts: int | None = None) -> DataFrame:
    """Dense 0-based ``row_idx`` in ``order_col`` order without a single-partition window.

    The rows are range-partitioned on the key and written once with their partition's
    number; that table is numbered inside each partition, and the rows of the
    partitions before it are added (a table of one row per partition).
    """
    spark = df.sparkSession
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(n_parts, *order).withColumn("_pid", F.spark_partition_id()), "row-index")
    counts = ranged.groupBy("_pid").agg(F.count("*").alias("_cnt"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)) - 1
    return (ranged.withColumn("_local", local).join(offsets, "_pid")
            .select(*df.columns, (F.col("_off") + F.col("_local")).cast("bigint").alias("row_idx")))
