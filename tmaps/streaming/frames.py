"""Per-iteration frames: trajectory and metrics tables, viewer export, axis limits.

The embedding loop emits one frame per reported iteration; frames are appended
to parquet tables (partitioned by ``run_id``/``iteration``) — an incremental
batch sink, the data side of the reference's per-iteration callback and text
reports.  Nothing is collected: frames are written by the executors.

A frame replaces the partition of its run and iteration, so an iteration that is done
again (after a lost driver) leaves no doubled rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAJECTORY_SCHEMA = "run_id string, iteration int, id bigint, map int, y array<double>"
METRICS_SCHEMA = "run_id string, iteration int, name string, value double"


def trajectory_frame(state: DataFrame, run_id: str, iteration: int, dims: int = 2) -> DataFrame:
    """``trajectory(run_id, iteration, id, map, y ARRAY<DOUBLE>)`` rows of one state."""
    st = state if "map" in state.columns else state.withColumn("map", F.lit(0))
    return st.select(F.lit(run_id).alias("run_id"), F.lit(int(iteration)).alias("iteration"),
                     F.col("id").cast("bigint").alias("id"), F.col("map").cast("int").alias("map"),
                     F.array(*[F.col(f"y{k}") for k in range(1, dims + 1)]).alias("y"))


def _put(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "iteration").parquet(path)


def append_trajectory(frame: DataFrame, path: str) -> None:
    _put(frame, path)


def metrics_frame(spark: SparkSession, run_id: str, rows: list[tuple[int, str, float]]) -> DataFrame:
    """Typed metrics rows (a handful of scalars per run)."""
    data = [(run_id, int(it), str(nm), float(v) if v is not None else None) for it, nm, v in rows]
    return spark.createDataFrame(data, METRICS_SCHEMA)


def append_metrics(frame: DataFrame, path: str) -> None:
    _put(frame, path)


def viewer_export(trajectory: DataFrame, labels: DataFrame, map_id: int = 0) -> DataFrame:
    """Viewer records ``(iteration, key, label, x, y)`` of one map: trajectory ⋈ labels."""
    t = trajectory.where(F.col("map") == map_id)
    return (t.join(labels.select(F.col("id"), F.col("label")), "id", "left")
            .select("iteration", F.col("id").alias("key"), "label",
                    F.get("y", 0).alias("x"), F.get("y", 1).alias("y")))


def write_viewer_json(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("iteration").json(path)


def frame_limits(records: DataFrame) -> DataFrame:
    """Per frame symmetric axis limits: ``max |x|``, ``max |y|``."""
    return records.groupBy("iteration").agg(F.max(F.abs("x")).alias("x_lim"), F.max(F.abs("y")).alias("y_lim"))
