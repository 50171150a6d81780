"""Merkle dataset manifest by butterfly exchange.

Every row is a leaf; leaves of one source, in the order of their ids, form a tree of
``FANOUT`` children a node, and the sources' roots, in the order of their names, one more.

1. Leaves are hashed where they are read (a text never moves) and numbered within their
   source by a range partitioning with the offsets of its parts.
2. An aligned run of FANOUT ** levels leaves is a block: the partition that the exchange
   speaks of. A block folds its own subtree.
3. Butterfly: in round r the blocks whose numbers differ in digit r only (to the base
   FANOUT) swap their subtree roots. Each one hashes their parent for itself and keeps the
   others as its siblings of that level, so after log(blocks) rounds every block holds the
   root and its whole upper proof, and nothing is handed down again. At a ragged end, where
   the last subtree has fewer blocks than its neighbours, its blocks send their root to the
   places that have no counterpart.
4. The roots of the sources go through the same steps as the leaves of one tree.
5. A block's leaves meet their block's upper proof, and fold.

Messages a round are one a block (twice as many at a ragged end), groups hold FANOUT
messages, and blocks a bounded number of leaves: a source with a third of all rows is only
more blocks.

Digests are lowercase hex sha256; inputs are concatenated as text; a field is ``-`` if null,
else its UTF-8 bytes as ``<count>:<value>``.

Defined cases: a null source is a tree of its own and the first; empty text is ``0:``; a null
doc_id comes first in its source and is never tampered with; rows that repeat a doc_id are
ordered by their leaves, and equal rows are neighbours; a single leaf is its tree's root and
a single tree's root the whole root, with the empty proof; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmaps.llm.common import stored

FANOUT = 3
BLOCK_LEVELS = 7
PATH = "array<struct<left:string,right:string>>"
_PLACE = (1 << 33) - 1  # the low bits of monotonically_increasing_id
_PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def numbered(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """``rows`` with ``pos``, dense from 0 within ``tree``, and ``total``, the tree's rows."""
    placed = stored(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
                    .withColumn("at", F.monotonically_increasing_id()), "order").withColumn("part", F.col("at").bitwiseAND(F.lit(~_PLACE)))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each part that a tree meets
    spans = placed.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("n")).select(
        tree, "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy(tree)).alias("total"))
    return (placed.join(spans, [tree, "part"]).withColumn("pos", F.col("before") + F.col("at") - F.col("first"))
            .drop("at", "part", "before", "first"))


def fold_levels(hashes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The levels of a subtree, leaves first: ``levels`` of them above the leaves, or up to
    a single node."""
    out = [hashes]
    while (len(out) <= levels) if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([_digest("".join(last[k:k + fanout])) for k in range(0, len(last), fanout)])
    return out


def _block(group: pa.Table, fanout: int, levels: int) -> tuple[list[int], list[list[str]]]:
    order = group.column("pos").to_numpy().argsort()
    hashes = group.column("hash").to_pylist()
    alone = group.column("blocks")[0].as_py() == 1
    return order, fold_levels([hashes[k] for k in order], fanout, None if alone else levels)


def _roots(fanout: int, levels: int):
    def kernel(group: pa.Table) -> pa.Table:
        _, tree = _block(group, fanout, levels)
        return group.select(["tree", "block", "blocks"]).slice(0, 1).append_column("hash", pa.array([tree[-1][0]], pa.string()))
    return kernel


def _paths(fanout: int, levels: int):
    def kernel(group: pa.Table, upper: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order, tree = _block(group, fanout, levels)
        above = upper.column("path")[0].as_py()
        paths = []
        for k in range(len(order)):
            path = []
            for level in tree[:-1]:
                first = k - k % fanout
                path.append({"left": "".join(level[first:k]), "right": "".join(level[k + 1:first + fanout])})
                k //= fanout
            paths.append(path + above)
        keep = group.drop_columns(["blocks", "hash"]).take(pa.array(order))
        for name in ("subroot", "root"):
            keep = keep.append_column(name, pa.array([upper.column(name)[0].as_py()] * len(order), pa.string()))
        return keep.append_column("path", pa.array(paths, _PATH_TYPE))
    return kernel


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(tree, block, path, hash): every block's siblings up to its tree's root, and the root.

    ``blocks`` has tree, block (dense from 0), blocks (their number in the tree) and hash."""
    most = blocks.agg(F.max("blocks")).first()[0] or 1
    now = blocks.withColumn("path", F.expr(f"cast(array() as {PATH})"))
    width = 1
    while width < most:
        active = F.col("blocks") > width
        node, low = F.expr(f"block div {width}"), F.col("block") % width
        group = F.expr(f"block div {width * fanout}")
        own_size = F.least(F.lit(width), F.col("blocks") - node * width)
        first_size = F.least(F.lit(width), F.col("blocks") - group * (width * fanout))
        sent = now.select(
            "tree", F.when(active, group).otherwise(F.col("block")).alias("group"), (node % fanout).alias("place"),
            active.alias("active"), low.alias("low"), "block", "blocks", "hash", "path",
            F.explode(F.when(active, F.sequence(low, first_size - 1, own_size)).otherwise(F.array(low))).alias("to"))
        met = sent.groupBy("tree", "group", "active", "to").agg(F.sort_array(F.collect_list(F.struct(  # at most `fanout` of them
            "place", (F.col("to") == F.col("low")).alias("mine"), "hash", "block", "blocks", "path"))).alias("parts"))
        met = met.withColumn("parent", F.when(F.col("active"), F.sha2(F.concat_ws("", "parts.hash"), 256)).otherwise(F.col("parts")[0]["hash"]))
        side = lambda test: F.concat_ws("", F.transform(F.filter("parts", test), lambda x: x["hash"]))
        now = (met.withColumn("own", F.explode(F.filter("parts", lambda x: x["mine"])))
               .select("tree", F.col("own.block").alias("block"), F.col("own.blocks").alias("blocks"), F.col("parent").alias("hash"),
                       F.when(F.col("active"), F.concat("own.path", F.array(F.struct(
                           side(lambda x: x["place"] < F.col("own.place")).alias("left"),
                           side(lambda x: x["place"] > F.col("own.place")).alias("right")))))
                       .otherwise(F.col("own.path")).alias("path")))
        width *= fanout
    return now


def _trees(leaves: DataFrame, fanout: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with their blocks, and the blocks' upper proofs."""
    size = fanout ** levels
    leaves = leaves.withColumn("block", F.expr(f"pos div {size}")).withColumn("blocks", F.expr(f"(total + {size - 1}) div {size}")).drop("total")
    roots = leaves.select("tree", "block", "blocks", "pos", "hash").groupBy("tree", "block").applyInArrow(
        _roots(fanout, levels), "tree string, block long, blocks long, hash string")
    return leaves, stored(butterfly(stored(roots, "blocks"), fanout), "upper")


def _with_paths(leaves: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Every leaf with its whole path; ``upper`` has path, subroot and root of its block."""
    kept = [f for f in leaves.schema.fields if f.name not in ("blocks", "hash")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + f", subroot string, root string, path {PATH}"
    return leaves.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(_paths(fanout, levels), schema)


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(doc_id, source, leaf, tampered_leaf, subroot, root, path) of every row; ``path`` holds
    the siblings left and right of the row's node, from its leaf to the root."""
    long = lambda c: F.col(c).cast("long")
    of = [long("doc_id"), F.col("source").cast("string"), F.col("lang").cast("string"), long("n_chars")]
    text = F.col("text").cast("string")
    tampered = F.coalesce(F.crc32(long("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    leaf = leaf_hash(*of, text)
    # the name of a tree: null before every source, then the sources by their bytes
    rows = stored(docs.select(
        of[0].alias("doc_id"), F.when(of[1].isNull(), F.lit("")).otherwise(F.concat(F.lit("="), of[1])).alias("tree"), leaf.alias("hash"),
        F.when(tampered, leaf_hash(*of, F.replace(text, F.lit("\n"), F.lit("")))).otherwise(leaf).alias("tampered_leaf"),
        F.monotonically_increasing_id().alias("row")), "leaves")
    leaves, upper = _trees(numbered(rows, "tree", "doc_id", "hash", "row").withColumn("leaf", F.col("hash")).drop("row"), fanout, levels)
    subroots = upper.where("block = 0").select(F.col("tree").alias("of"), "hash", F.lit("").alias("tree"))
    tops, above = _trees(numbered(subroots, "tree", "of"), fanout, levels)
    tops = _with_paths(tops, above.select("tree", "block", "path", F.col("hash").alias("root"), F.col("hash").alias("subroot")), fanout, levels)
    tops = stored(tops.select(F.col("of").alias("tree"), "root", F.col("path").alias("above")), "tops")  # one row for each source
    whole = upper.join(tops, "tree").select("tree", "block", F.concat("path", "above").alias("path"), F.col("hash").alias("subroot"), "root")
    return _with_paths(leaves, whole, fanout, levels).select(
        "doc_id", F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("source"), "leaf", "tampered_leaf", "subroot", "root", "path")


def verify(rows: DataFrame) -> DataFrame:
    """``rows`` of ``manifest`` with the digest of their proofs, the root that their present
    (tampered) leaf folds to, and whether it is the root."""
    sides = F.transform("path", lambda s: F.concat(s["left"], s["right"]))
    folded = F.aggregate("path", F.col("tampered_leaf"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", sides), 256).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
