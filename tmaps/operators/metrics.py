"""Quality metrics and data checks: neighbourhood preservation, top-K
neighbour sets by P and by Q, NaN detection, column summaries, bounding boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmaps.operators import blocks, neighbors
from tmaps.operators.kernel import dim_cols


def column_summary(vectors: DataFrame) -> DataFrame:
    """Per vector position: mean, sample variance, non-zero count
    (``posexplode`` + keyed aggregate; no collect)."""
    return (vectors.select(F.posexplode("v").alias("pos", "x"))
            .groupBy("pos").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"),
                                F.count_if(F.col("x") != 0.0).alias("nnz")))


def bounding_box(state: DataFrame, dims: int = 2) -> DataFrame:
    """Per map: min and max of each coordinate."""
    st = state if "map" in state.columns else state.withColumn("map", F.lit(0))
    aggs = []
    for c in dim_cols("y", dims):
        aggs += [F.min(c).alias("min_" + c), F.max(c).alias("max_" + c)]
    return st.groupBy("map").agg(*aggs)


def slice_rows(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """The rows (column ``id``) that a list of keys names, each once however often it is named."""
    return rows.join(keys.select(F.col(key).alias("id")), "id", "left_semi")


def nan_rows(state: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with a NaN in any of ``cols``."""
    cond = None
    for c in cols:
        t = F.isnan(F.col(c))
        cond = t if cond is None else (cond | t)
    return state.where(cond)


def has_nan(state: DataFrame, cols: list[str]) -> DataFrame:
    """One row: ``any_nan`` over ``cols`` (``bool_or``)."""
    cond = None
    for c in cols:
        t = F.isnan(F.col(c))
        cond = t if cond is None else (cond | t)
    return state.agg(F.bool_or(cond).alias("any_nan"))


def topk_by_p(joint_p: DataFrame, k: int = 1) -> DataFrame:
    """``(i, j, r)`` — the K largest affinities per row, ties by j."""
    w = Window.partitionBy("i").orderBy(F.col("p").desc(), F.col("j"))
    return joint_p.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("i", "j", F.col("r").cast("int"))


def topk_by_q(state_pi: DataFrame, k: int = 1, dims: int = 2, n: int | None = None,
              n_maps: int = 1, block_rows: int = 1024) -> DataFrame:
    """``(i, j, r)`` — the K largest Q (single map: num; maps: QZ) per row, ties by j.
    Candidates come from the block-pair kernel (≤ K per row and block pair), whose blocks are those
    of the kernel sums; a single map of many blocks (of ``block_rows``) is searched by cells with
    covering radii instead, and blocks out of a row's reach are left out (``neighbors.nearest_in_map``)."""
    alone = "map" not in state_pi.columns or n_maps == 1
    plain = "pi" not in state_pi.columns
    st = state_pi
    if "map" not in st.columns:
        st = st.withColumn("map", F.lit(0))
    if "pi" not in st.columns:
        st = st.withColumn("pi", F.lit(1.0))
    st = st.select("id", F.col("map").cast("int").alias("map"), *dim_cols("y", dims), F.col("pi").cast("double"))
    if n is None:
        n = st.select("id").distinct().count()
    if alone and plain and n > neighbors.DIRECT_BLOCKS * block_rows:
        cand = neighbors.nearest_in_map(st, k, dims, n, block_rows)
    else:
        # copies and candidates grow as n·B: blocks as large as those of the kernel sums, dealt out as there
        groups = blocks.default_min_groups(st.sparkSession)
        nb = blocks.map_blocks(n, n_maps, groups)
        parts = max(int(st.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(nb * (nb + 1) // 2, 4 * groups))
        rep = blocks.replicate_pairs(blocks.with_block(st, nb), nb).repartition(parts, "_lo", "_hi")
        cand = rep.groupBy("_lo", "_hi").applyInArrow(blocks.topq_kernel(dims, k), blocks.TOPQ_SCHEMA)
    w = Window.partitionBy("i").orderBy(F.col("qz").desc(), F.col("j"))
    return cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("i", "j", F.col("r").cast("int"))


def neighborhood_preservation(joint_p: DataFrame, top_q: DataFrame, k: int = 1) -> DataFrame:
    """``(i, preservation)`` = |topK(P_i) ∩ topK(Q_i)| / K; NULL where the P row
    has fewer than K entries (the reference rejects such rows)."""
    tp = topk_by_p(joint_p, k)
    sizes = joint_p.groupBy("i").agg(F.count("*").alias("_m"))
    hits = tp.join(top_q.select("i", "j"), ["i", "j"]).groupBy("i").agg(F.count("*").alias("_h"))
    return (sizes.join(hits, "i", "left")
            .select("i", F.when(F.col("_m") >= k, F.coalesce(F.col("_h"), F.lit(0)) / F.lit(float(k)))
                    .alias("preservation")))


def neighborhood_preservation_avg(per_row: DataFrame, n: int | None = None) -> DataFrame:
    """One row: mean preservation (over n when given, as the reference divides by n)."""
    if n is None:
        return per_row.agg(F.avg("preservation").alias("preservation"))
    return per_row.agg((F.sum("preservation") / F.lit(float(n))).alias("preservation"))
