"""Exact top-k inner products: best-first search of an M-tree kept as tables.

Inner products become distances by one more coordinate: with M the largest norm, a vector
o gets sqrt(M^2 - |o|^2) and a query 0, and then d(q, o)^2 = |q|^2 + M^2 - 2 q.o: the
nearest are those of the largest product, and the triangle inequality holds.

The tree. The root has at most ``ROUTES`` routing vectors (those with the smallest hashes of
their ids: a bounded sample), and every vector belongs to the node of its nearest one. A
node has a page for about every ``PAGE`` of its vectors, at most ``ROUTES``, each with a routing
vector of its own drawn from them, and every vector stands in the page of its nearest one.
Nodes and pages keep their covering radius and the distance to their parent, vectors the
distance to their page's routing vector and to their node's. Every vector is indexed.

Search. Each query goes down to the page where it would be stored; the k-th best product
found there bounds its radius. Queries stand in blocks by node, and a block lists the pages that
can hold anything within a radius, by their least distance: first those passed over by the
node's ring, then by the stored distance of the page to its node (nothing is computed), then by the
distance to the page's routing vector. The pages are visited in this order, in rounds of
1, 2, 4, ... of them a block; after each round the radii shrink to what was found, and pages
and entries out of reach by then are passed over. They cannot hold a result, so the search
is exact.

Equal vectors are one entry with the smallest k + 1 of its ids (a larger one can be in no
result, as ties go to the smaller), and equal queries are searched once.

Products are exact at any size: in doubles while they stay below 2**53, then in 64 bits, then
in Python's integers. A result that does not fit a long is an error.

Defined cases: vectors that are null, or hold null or non-finite components, take no part;
shorter vectors end with zeros; rows that repeat an id and its vector count once; null ids
take no part; fewer than k candidates give fewer rows; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tmaps.llm.common import stored

SCALE = 1024
ROUTES, PAGE, QUERY_BLOCK, CHUNK = 256, 1024, 512, 20_000
ENDS = (1 << 63) - 1


def integers(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the rows that take part; v holds floor(1024 * x), integers in doubles."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    scaled = lambda x: x.cast("double") * SCALE
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0 ** 53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", fine))
            .select("vec_id", F.transform("x", whole).alias("v")))


def matrix(column, width: int) -> np.ndarray:
    """Rows of a list column, with zeros at the end of short ones."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at, values = np.asarray(lists.offsets), np.asarray(lists.values)
    size = np.diff(at)
    if len(size) and (size == width).all():
        return values[at[0]:at[-1]].reshape(-1, width).astype(np.float64)
    out = np.zeros((len(size), width))
    for i, n in enumerate(size):
        out[i, :n] = values[at[i]:at[i + 1]]
    return out


class Space:
    """Distances from queries and stored vectors to the routing vectors."""

    def __init__(self, routes: np.ndarray, square: float, width: int) -> None:
        self.routes, self.square, self.width = routes, square, width
        self.more = np.sqrt(np.maximum(square - (routes ** 2).sum(axis=1), 0))

    def stored(self, x: np.ndarray) -> np.ndarray:
        extra = np.sqrt(np.maximum(self.square - (x ** 2).sum(axis=1), 0))
        return np.sqrt(np.maximum(2 * self.square - 2 * (x @ self.routes.T + extra[:, None] * self.more[None, :]), 0))

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q ** 2).sum(axis=1)[:, None] + self.square - 2 * (q @ self.routes.T), 0))

    def radius(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """What the products ``least`` leave as the largest distance, rounded up."""
        r = np.sqrt(np.maximum((q ** 2).sum(axis=1) + self.square - 2 * least, 0))
        return r + 1e-6 * np.sqrt(self.square) + 1e-6

    def products(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact: doubles while partial sums stay below 2**53, then longs, then Python's integers."""
        if self.square < 2.0 ** 53:
            return (x @ q).astype(np.int64)
        if self.square < 2.0 ** 62:
            return x.astype(np.int64) @ q.astype(np.int64)
        if not (np.isfinite(x).all() and np.isfinite(q).all()):
            raise ValueError("a component of 1024 times its size is no number any more")
        wide = np.vectorize(int, otypes=[object])
        return wide(x) @ wide(q) if len(x) else np.zeros(0, object)

    def away(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Distances of queries (rows) to stored vectors (columns)."""
        return np.sqrt(np.maximum((q ** 2).sum(axis=1)[:, None] + self.square - 2 * (q @ x.T), 0))

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of stored vectors."""
        more = [np.sqrt(np.maximum(self.square - (z ** 2).sum(axis=1), 0)) for z in (x, y)]
        return np.sqrt(np.maximum(2 * self.square - 2 * (x @ y.T + more[0][:, None] * more[1][None, :]), 0))

    @property
    def slack(self) -> float:
        return 1e-6 * np.sqrt(self.square) + 1e-6


def fitting(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; what does not fit becomes the end of the range (an error only in a result:
    a query's product with itself is none)."""
    if scores.dtype == object:
        return np.array([min(max(x, -ENDS), ENDS) for x in scores], np.int64)
    return scores.astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, routes: int = ROUTES, page: int = PAGE,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest products among the others."""
    schema = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    rows = integers(vectors)
    k1 = k + 1
    first = Window.partitionBy("v").orderBy("vec_id")
    entries = stored(rows.distinct().withColumn("n", F.row_number().over(first)).where(F.col("n") <= k1).drop("n"), "entries")
    size = F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x)
    facts = entries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(size).alias("square")).first()
    if not facts["n"] or not facts["width"]:
        return spark.createDataFrame([], schema)
    width = facts["width"]
    sample = entries.dropDuplicates(["v"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(routes).select("v").toArrow()
    space = Space(matrix(sample["v"], width), facts["square"], width)
    slack = space.slack

    def assign(batches):
        for b in batches:
            if b.num_rows:
                d = space.stored(matrix(b.column("v"), width))
                node = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(node.astype(np.int32)), pa.array(d[np.arange(len(d)), node])],
                                                 names=["vec_id", "v", "node", "up"])

    located = "vec_id long, v array<double>, node int, up double"
    placed = stored(entries.mapInArrow(assign, located), "placed")
    nodes = {r["node"]: r for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.min("up").alias("inner"), F.max("up").alias("outer")).collect()}  # <= routes
    of_node = lambda values: f"element_at(array({', '.join(map(str, values))}), node + 1)"
    every = range(len(space.routes))
    count = [nodes[k]["n"] if k in nodes else 0 for k in every]
    inner, outer = (np.array([nodes[k][c] if k in nodes else x for k in every]) for c, x in (("inner", np.inf), ("outer", -np.inf)))
    share = [min(routes - 1, -(-c // page) - 1) / max(c, 1) for c in count]
    # a node's pages: its own routing vector's, and those of vectors drawn from it
    drawn = placed.where(F.expr(f"pmod(xxhash64(vec_id, 'page'), 1048576) < 1048576 * {of_node(share)}")).select("node", "v", "vec_id").dropDuplicates(["node", "v"])
    tops = spark.createDataFrame([(k, space.routes[k].tolist()) for k in every], "node int, v array<double>")
    number = F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))
    subs = stored(drawn.select("node", number.cast("int").alias("sub"), F.col("v").alias("route")).union(tops.select("node", F.lit(0), "v")), "routes")

    chunks = [max(1, -(-c // CHUNK)) for c in count]

    def deal(entry, route):
        if not entry.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(("vec_id", "v", "node", "up", "sub", "parent"), (
                pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.int32(), pa.float64()))})
        d = space.apart(matrix(entry["v"], width), matrix(route["route"], width))
        at = d.argmin(axis=1)
        return (entry.select(["vec_id", "v", "node", "up"]).append_column("sub", route["sub"].combine_chunks().take(pa.array(at)))
                .append_column("parent", pa.array(d[np.arange(len(at)), at])))

    rows_of = placed.withColumn("chunk", F.expr(f"cast(pmod(xxhash64(vec_id), {of_node(chunks)}) as int)"))
    routes_of = subs.withColumn("chunk", F.explode(F.expr(f"sequence(0, {of_node(chunks)} - 1)"))).select(F.col("node").alias("n"), F.col("chunk").alias("c"), "sub", "route")
    leaves = stored(rows_of.groupBy("node", "chunk").cogroup(routes_of.groupBy("n", "c")).applyInArrow(deal, located + ", sub int, parent double"), "leaves")
    directory = leaves.groupBy("node", "sub").agg(F.max("parent").alias("cover")).join(subs, ["node", "sub"])
    directory = stored(directory, "directory")

    asked = integers(queries).distinct()
    kinds = asked.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v").mapInArrow(assign, located).drop("up")
    kinds = stored(kinds.withColumnsRenamed({"vec_id": "query", "v": "q"}), "queries")
    counts = {r["node"]: r["n"] for r in kinds.groupBy("node").agg(F.count("*").alias("n")).collect()}  # at most `routes` rows
    parts = [max(1, -(-counts.get(k, 0) // query_block)) for k in every]
    begin = np.cumsum([0, *parts])[:-1].tolist()
    kinds = kinds.withColumn("block", F.expr(f"cast({of_node(begin)} + pmod(xxhash64(query), {of_node(parts)}) as int)"))

    def descend(query, route):
        if not query.num_rows or not route.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "sub": pa.array([], pa.int32())})
        d = space.away(matrix(route["route"], width), matrix(query["q"], width))
        return pa.table({"query": query["query"], "sub": route["sub"].combine_chunks().take(pa.array(d.argmin(axis=1)))})

    blocks = kinds.select("block", "node").distinct()
    near = directory.join(blocks, "node").select(F.col("block").alias("b"), "sub", "route")
    homes = kinds.groupBy("block").cogroup(near.groupBy("b")).applyInArrow(descend, "query long, sub int")
    visits = stored(kinds.join(homes, "query").select("block", "node", "sub", "query").join(directory, ["node", "sub"])
                    .select("block", "node", "sub", "route", "query"), "homes")

    def visit(key, entry, query):
        """Products of a page's entries with the queries that may still find something there."""
        out = ([], [], [])
        if entry.num_rows and query.num_rows:
            parent, up, ids = (np.asarray(entry[c].combine_chunks()) for c in ("parent", "up", "vec_id"))
            order = np.argsort(parent, kind="stable")
            parent, up, ids, x = parent[order], up[order], ids[order], matrix(entry["v"], width)[order]
            names, q = np.asarray(query["query"].combine_chunks()), matrix(query["q"], width)
            least = query["least"].to_numpy(zero_copy_only=False).astype(float)
            r = np.where(np.isnan(least), np.inf, space.radius(q, np.nan_to_num(least)))
            d = space.away(matrix(query["route"].slice(0, 1), width), q)[:, 0]
            top = space.queries(q)[:, key[1].as_py()]
            from_, to = np.searchsorted(parent, d - r - slack, side="left"), np.searchsorted(parent, d + r + slack, side="right")
            for i in range(len(q)):
                some = np.arange(from_[i], to[i])  # the others cannot be nearer than the radius
                some = some[np.abs(up[some] - top[i]) <= r[i] + slack]
                if len(some):
                    s = space.products(x[some], q[i])
                    at = best(ids[some], s, k1)
                    out[0].append(np.full(len(at), names[i]))
                    out[1].append(ids[some][at])
                    out[2].append(fitting(s[at]))
        return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("query", "vec_id", "score"), out)})

    rank = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
    keys = ["block", "node", "sub"]

    def visited(pages, asking):
        """What the queries ``asking`` (block, query, q, least) find in ``pages`` (block, node, sub, route[, query])."""
        met = asking.join(pages, ["block", "query"] if "query" in pages.columns else "block")
        return (leaves.join(pages.select(*keys).distinct(), ["node", "sub"]).groupBy(*keys)
                .cogroup(met.select(*[F.col(c).alias(f"of_{c}") for c in keys], "query", "q", "least", "route").groupBy(*[f"of_{c}" for c in keys]))
                .applyInArrow(visit, "query long, vec_id long, score long"))

    def merged(found, before=None):
        """The k + 1 best of every query so far, and its blocks' queries with the bound."""
        found = found if before is None else before.unionByName(found).distinct()
        found = stored(found.withColumn("n", rank("query")).where(F.col("n") <= k1), "found")
        least = found.where(F.col("n") == k1).select("query", F.col("score").cast("double").alias("least"))
        return found.drop("n"), stored(kinds.join(least, "query", "left").select("block", "query", "q", "node", "least"), "bounded")

    found, asking = merged(visited(visits, kinds.drop("node").withColumn("least", F.lit(None).cast("double"))))

    def bound(key, block):
        q = matrix(block["q"], width)
        least = block["least"].to_numpy(zero_copy_only=False).astype(float)
        r = np.where(np.isnan(least), np.inf, space.radius(q, np.nan_to_num(least)))[:, None]
        d = space.queries(q)
        hit = np.flatnonzero(((d - r - slack <= outer[None, :]) & (d + r + slack >= inner[None, :])).any(axis=0))
        return pa.table({"block": pa.array([key[0].as_py()] * len(hit), pa.int32()), "node": pa.array(hit.astype(np.int32))})

    def listed(key, query, pages):
        """The pages of a node that a block may have to visit, with their least distance."""
        out = pa.table({"sub": pa.array([], pa.int32()), "low": pa.array([], pa.float64())})
        if query.num_rows and pages.num_rows:
            q, route = matrix(query["q"], width), matrix(pages["route"], width)
            node, cover = key[1].as_py(), np.asarray(pages["cover"].combine_chunks())
            least = query["least"].to_numpy(zero_copy_only=False).astype(float)
            r = np.where(np.isnan(least), np.inf, space.radius(q, np.nan_to_num(least)))[:, None]
            up = space.apart(route, space.routes[node:node + 1])[:, 0]
            # by the stored distance of the page to its node: nothing is computed
            some = np.flatnonzero((np.abs(space.queries(q)[:, node][:, None] - up[None, :]) - cover[None, :] <= r + slack).any(axis=0))
            low = np.maximum(space.away(route[some], q) - cover[some][None, :] - slack, 0)
            in_reach = low <= r
            low = np.where(in_reach, low, np.inf).min(axis=0)
            keep = np.flatnonzero(in_reach.any(axis=0))
            out = pa.table({"sub": pages["sub"].combine_chunks().take(pa.array(some[keep])), "low": pa.array(low[keep])})
        n = out.num_rows
        return out.append_column("block", pa.array(np.full(n, key[0].as_py(), np.int32))).append_column("node", pa.array(np.full(n, key[1].as_py(), np.int32)))

    reach = stored(asking.groupBy("block").applyInArrow(bound, "block int, node int"), "reach")
    pages = reach.join(directory, "node").select(F.col("block").alias("b"), F.col("node").alias("of"), "sub", "route", "cover")
    pages = (asking.drop("node").join(reach, "block").groupBy("block", "node").cogroup(pages.groupBy("b", "of"))
             .applyInArrow(listed, "sub int, low double, block int, node int"))
    order = F.row_number().over(Window.partitionBy("block").orderBy("low", "node", "sub"))
    pages = stored(pages.withColumn("turn", order), "pages")
    last = pages.agg(F.max("turn")).first()[0] or 0
    turn = 1
    while turn <= last:  # 1, 2, 4, ... pages of every block, nearest first
        now = pages.where(F.col("turn").between(turn, 2 * turn - 1)).join(directory, ["node", "sub"]).select(*keys, "low", "route")
        # a block whose radii have all shrunk below the page's least distance passes it over
        wide = asking.groupBy("block").applyInArrow(_widest(space, width), "block int, widest double")
        now = now.join(wide, "block").where("low <= widest").drop("low", "widest")
        found, asking = merged(visited(now, asking.drop("node")), found)
        turn *= 2
    names = asked.select(F.col("vec_id").alias("query_id"), "v").join(kinds.select("query", F.col("q").alias("v")), "v").select("query_id", "query")
    fits = F.when(F.col("score").between(1 - ENDS, ENDS - 1), F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit 64 bits")).cast("long"))
    return (names.join(found, "query").where("vec_id <> query_id").withColumn("rank", rank("query_id")).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", fits.alias("score")))


def _widest(space: Space, width: int):
    """The largest radius of a block's queries."""
    def kernel(key, block):
        q = matrix(block["q"], width)
        least = block["least"].to_numpy(zero_copy_only=False).astype(float)
        r = np.where(np.isnan(least), np.inf, space.radius(q, np.nan_to_num(least)))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "widest": pa.array([float(r.max())])})
    return kernel
