"""Cell hierarchy and Barnes-Hut repulsion.

``cell_pyramid`` replaces a driver-side space-partitioning tree by one keyed
aggregate: every point emits its cell index at each level (the box halved per
axis and level; a point on a mid-line goes to the lower child), and
``groupBy(map, level, c*)`` yields count, centre of mass and extent per cell.
A cell is a leaf when it holds one point or only copies of one position.

``bh_repulsion`` opens cells until they are leaves (or their points have equal unit
coordinates, or lie in one cell of level 62).  A cell is *accepted* for a point when it is a
leaf or ``radius² < θ·d²`` (the reference compares squares with θ); its summary then
contributes ``mass·q`` to sumQ and ``mass·q²·(y − centre)`` to the repulsive force; otherwise
its children are visited.  The point's own cell is always opened and, as a leaf, counted
without the point itself.  A point's mass is 1, or its weight ``pi``; centres are weighted.

Spark holds the cells of more than ``FEW_POINTS`` points and their children, once for a
chain: where a cell's points all lie in one child, only the lowest cell of the chain stays (its
smaller radius decides, and its summary is that of the others), so an outlier at 10⁶ times the
map's width costs no level of its own.  Every cell carries the summary of its parent, so whether a
block of points may visit it is a test of that one row.  Children of few points are *small
roots*: what is below them never becomes rows.  A block that may open a small root gets its
points, and builds the cells below it for itself.

Points are grouped into blocks of neighbours: the largest cells of at most ``BLOCK_POINTS``
points.  The topmost cells, whose number is bounded, meet all blocks in one join; cells of many
points that lie deeper are followed from parent to children; then one join brings the
points of the small roots.  A block is co-grouped with what it may visit and walked there, so
nothing depends on the size of the whole hierarchy, and there is one path for every size.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.operators.blocks import _tile_sums
from tmaps.session import checkpoint

BLOCK_POINTS = 1024
WIDE_BLOCK_POINTS, WIDE_THETA = 32_768, 1e-6  # blocks where nearly every cell is opened: each gets nearly every point
DEEPEN_LEVELS = 12
DEEPEST = 62  # cell numbers are 64-bit
TOP_CELLS_LOG2 = 10  # cells of at most this many halvings meet every block
FEW_POINTS = 64
WALK_PAIRS = 4_000_000  # (point, cell) pairs that a walk holds at once


def _d(prefix, dims):
    return [f"{prefix}{k}" for k in range(1, dims + 1)]


def _with_unit_coords(state: DataFrame, dims: int) -> DataFrame:
    """Adds ``t_k = (y_k − min_k) / width_k`` (0 on a zero-width axis) and ``w_k`` per map."""
    aggs = []
    for c in _d("y", dims):
        aggs += [F.min(c).alias("_min_" + c), F.max(c).alias("_max_" + c)]
    if "map" not in state.columns:
        # one map: box corners as scalar subqueries (no join)
        j = state
        for c in _d("y", dims):
            j = j.withColumn("_min_" + c, state.agg(F.min(c)).scalar()) \
                 .withColumn("_max_" + c, state.agg(F.max(c)).scalar())
        j = j.withColumn("map", F.lit(0))
    else:
        bb = state.groupBy("map").agg(*aggs)  # one row per map
        j = state.join(F.broadcast(bb), "map")
    for k, c in enumerate(_d("y", dims), 1):
        width = F.col("_max_" + c) - F.col("_min_" + c)
        j = j.withColumn(f"w{k}", width).withColumn(
            f"t{k}", F.when(width > 0, (F.col(c) - F.col("_min_" + c)) / width).otherwise(F.lit(0.0)))
    return j.drop(*[x for c in _d("y", dims) for x in ("_min_" + c, "_max_" + c)])


def cell_index(t, level):
    """Cell index along one axis: clip(ceil(t·2^level) − 1, 0, 2^level − 1)."""
    scale = F.pow(F.lit(2.0), level)
    return F.least(F.greatest(F.ceil(t * scale) - 1, F.lit(0).cast("bigint")),
                   (scale - 1).cast("bigint")).cast("bigint")


def cell_pyramid(state: DataFrame, levels: int, dims: int = 2, first_level: int = 0) -> DataFrame:
    """``cells(map, level, c*, cnt, s*, m*, leaf, r2)`` for levels 0..levels.

    ``s`` = coordinate sums, ``m`` = centre of mass, ``r2`` = Σ (cell width)²."""
    return _cells(_with_unit_coords(state, dims), first_level, levels, dims).drop("flat")


def _cells(unit: DataFrame, first_level: int, levels: int, dims: int) -> DataFrame:
    """Cells of points with unit coordinates; ``flat``: no halving can part its points."""
    lv = unit.select("map", *_d("y", dims), *_d("t", dims), *_d("w", dims),
                  F.explode(F.sequence(F.lit(int(first_level)), F.lit(int(levels)))).alias("level"))
    lv = lv.select("map", "level", *_d("y", dims), *_d("t", dims), *_d("w", dims),
                   *[cell_index(F.col(f"t{k}"), F.col("level")).alias(f"c{k}") for k in range(1, dims + 1)])
    aggs = [F.count("*").alias("cnt")]
    for k in range(1, dims + 1):
        aggs += [F.sum(f"y{k}").alias(f"s{k}"), F.min(f"y{k}").alias(f"_lo{k}"), F.max(f"y{k}").alias(f"_hi{k}"),
                 (F.min(f"t{k}") == F.max(f"t{k}")).alias(f"_flat{k}"), F.first(f"w{k}").alias(f"_w{k}")]
    g = lv.groupBy("map", "level", *_d("c", dims)).agg(*aggs)
    leaf = None
    r2 = None
    for k in range(1, dims + 1):
        same = F.col(f"_lo{k}") == F.col(f"_hi{k}")
        leaf = same if leaf is None else (leaf & same)
        cw = F.col(f"_w{k}") / F.pow(F.lit(2.0), F.col("level"))
        r2 = cw * cw if r2 is None else r2 + cw * cw
    return g.select("map", "level", *_d("c", dims), F.col("cnt").cast("bigint").alias("cnt"), *_d("s", dims),
                    *[(F.col(f"s{k}") / F.col("cnt")).alias(f"m{k}") for k in range(1, dims + 1)],
                    leaf.alias("leaf"), r2.alias("r2"),
                    F.expr(" AND ".join(_d("_flat", dims))).alias("flat"))


def _each(dims: int, form: str, between: str = ", ") -> str:
    """``form`` with {k} = 1..dims, joined."""
    return between.join(form.replace("{k}", str(k)) for k in range(1, dims + 1))


def _cell(t: str, level: str) -> str:
    """``cell_index`` as an expression's text."""
    return f"least(greatest(ceil({t} * pow(2D, {level})) - 1, 0L), cast(pow(2D, {level}) - 1 as bigint))"


def _summaries(points: DataFrame, first_level: int, levels: int, dims: int) -> DataFrame:
    """Cells of weighted points, with the least id in each (``lead``)."""
    lv = points.selectExpr("*", f"explode(sequence({first_level}, {levels})) as level")
    lv = lv.selectExpr("*", *[f"{_cell(f't{k}', 'level')} as c{k}" for k in range(1, dims + 1)])
    return lv.groupBy("map", "level", *_d("c", dims)).agg(*map(F.expr, [
        "count(*) as cnt", "sum(pi) as mass", *[f"sum(pi * y{k}) as s{k}" for k in range(1, dims + 1)],
        _each(dims, "min(y{k}) = max(y{k})", " and ") + " as leaf",
        "(" + _each(dims, "min(t{k}) = max(t{k})", " and ") + f") or level >= {DEEPEST} as flat",
        _each(dims, "pow(first(w{k}) / pow(2D, level), 2D)", " + ") + " as r2", "min(id) as lead"]))


def _upper(points: DataFrame, n: int, limit: int, dims: int) -> tuple[DataFrame, dict]:
    """The cells of many points and their children, each with its parent's summary, and the
    levels at which blocks and small roots stand."""
    hi = min(DEEPEST, math.ceil(math.log(max(n / FEW_POINTS, 1)) / math.log(2 ** dims)) + 2)
    pieces = [_summaries(points, 0, hi, dims)]
    c, p, many = _each(dims, "c{k}"), _d("p", dims), f"cnt > {FEW_POINTS} and not flat"
    while True:
        cells = reduce(DataFrame.unionByName, pieces)
        # a chain of cells with the same points: its lowest cell, and the level where it begins
        chain = cells.groupBy("map", "lead", "cnt").agg(
            F.min("level").alias("top"), F.expr(f"max(struct(level, {c}, mass, {_each(dims, 's{k}')}, leaf, flat, r2)) as low"))
        chain = chain.selectExpr("map", "cnt", "top", "low.*", *[f"shiftright(low.c{k}, low.level - top + 1) as p{k}" for k in range(1, dims + 1)])
        parent = chain.where(many).selectExpr("map", "level + 1 as top", *[f"c{k} as p{k}" for k in range(1, dims + 1)], "cnt as parent_cnt",
                                              "r2 as parent_r2", *[f"s{k} / mass as parent_m{k}" for k in range(1, dims + 1)])
        upper = checkpoint(chain.join(parent, ["map", "top", *p], "left").where("top = 0 or parent_cnt is not null").selectExpr(
            "*", f"{many} as many", f"not ({many}) and not leaf and not flat as small",
            f"(cnt <= {limit} or flat) and coalesce(parent_cnt > {limit}, true) as block"))
        facts = upper.selectExpr("max(case when many then level end) as deepest", "collect_set(case when small or block then level end) as levels",
                                 "coalesce(bool_or(small), false) as small").first().asDict()
        if facts["deepest"] is None or facts["deepest"] < hi or hi >= DEEPEST:
            return upper, facts
        # cells of many points at the last level: only their points go deeper
        still = upper.where(f"level = {hi} and many").select("map", *_d("c", dims))
        here = points.selectExpr("*", *[f"{_cell(f't{k}', str(hi))} as c{k}" for k in range(1, dims + 1)])
        lo, hi = hi + 1, min(DEEPEST, hi + DEEPEN_LEVELS)
        pieces.append(_summaries(here.join(still, ["map", *_d("c", dims)], "left_semi").drop(*_d("c", dims)), lo, hi, dims))


def _located(points: DataFrame, cells: DataFrame, levels: list, dims: int) -> DataFrame:
    """Points with the columns of every cell among ``cells`` (of these levels) that holds them."""
    at = points.selectExpr("*", f"explode(array({', '.join(map(str, sorted(levels)))})) as level")
    at = at.selectExpr("*", *[f"{_cell(f't{k}', 'level')} as c{k}" for k in range(1, dims + 1)])
    return at.join(cells, ["map", "level", *_d("c", dims)])


def _opened(dims: int, level: str, cell: str, centre: str, r2: str, theta_sq: float) -> str:
    """May a point of the block open this cell?"""
    lo, hi = _cell("_lot{k}", level), _cell("_hit{k}", level)
    gap = f"pow(greatest(_loy{{k}} - {centre}, {centre} - _hiy{{k}}, 0D), 2D)"
    return f"(({_each(dims, f'{cell} between {lo} and {hi}', ' and ')}) or {r2} * {1 + 1e-9}D >= {theta_sq!r}D * ({_each(dims, gap, ' + ')}))"


def _reach(blocked: DataFrame, upper: DataFrame, roots: DataFrame | None, deepest: int | None, theta_sq: float, dims: int) -> DataFrame:
    """``(map, blk, point, level, …)``: the cells that a point of the block may visit, and the
    points of the small roots that it may open.  A cell is visited when its parent is opened: when the
    block's box may hold one of the parent's points or come near enough to its centre; the
    walk itself decides point by point."""
    box = blocked.groupBy("map", "blk").agg(*[F.expr(f"{f}({c}) as _{n}{c}") for c in _d("y", dims) + _d("t", dims) for f, n in (("min", "lo"), ("max", "hi"))])
    edge = [f"_{n}{c}" for c in _d("y", dims) + _d("t", dims) for n in ("lo", "hi")]
    by_parent = _opened(dims, "(top - 1)", "p{k}", "parent_m{k}", "parent_r2", theta_sq)
    by_cell = _opened(dims, "level", "c{k}", "(s{k} / mass)", "r2", theta_sq)
    last = TOP_CELLS_LOG2 // dims
    first = F.broadcast(upper.where(f"top - 1 <= {last}"))  # at most some thousand cells a map
    here = box.join(first, "map").where(f"top = 0 or {by_parent}")
    if deepest is not None and deepest > last:
        below, steps = upper.where(f"top - 1 > {last}"), []
        while True:
            here = checkpoint(here)  # a short plan for the next cells
            steps.append(here)
            go = here.where(f"many and level > {last} and {by_cell}")
            if go.isEmpty():
                break
            go = go.selectExpr("map", "blk", *edge, "level + 1 as top", *[f"c{k} as p{k}" for k in range(1, dims + 1)])
            here = go.join(below, ["map", "top", *_d("p", dims)])
        width = int(here.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        here = reduce(DataFrame.unionByName, steps).coalesce(width)
    key = ["map", "level", *_d("c", dims)]
    cells = here.selectExpr("map as of_map", "blk as of_blk", "false as point", "level", "top", *_d("c", dims), "cnt", "mass", *_d("s", dims),
                            *[f"0D as t{k}" for k in range(1, dims + 1)], "leaf or flat as final", "r2")
    if roots is None:
        return cells
    wanted = here.where(f"small and {by_cell}").select("blk", *key, "r2")
    points = wanted.join(roots.drop("blk"), key).selectExpr(
        "map", "blk", "true", "level", "-1", *_d("c", dims), "1L", "pi", *_d("y", dims), *_d("t", dims), "false", "r2")
    return cells.union(points)


def _index(t: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Cell numbers of unit coordinates, as ``cell_index``."""
    scale = (2.0 ** level)[:, None]
    return np.clip(np.ceil(t * scale).astype(np.int64) - 1, 0, scale.astype(np.int64) - 1)


def _below(level: np.ndarray, y: np.ndarray, t: np.ndarray, pi: np.ndarray, r2: np.ndarray) -> list[tuple]:
    """The cells below small roots, level by level, from their points."""
    out, here = [], level.copy()
    while len(y):
        here, r2 = here + 1, r2 / 4
        c = _index(t, here)
        _, first, back = np.unique(np.column_stack([here, c]), axis=0, return_index=True, return_inverse=True)
        back = back.ravel()
        order = np.argsort(back, kind="stable")
        begin = np.searchsorted(back[order], np.arange(len(first)))
        equal = lambda x: (np.minimum.reduceat(x[order], begin) == np.maximum.reduceat(x[order], begin)).all(axis=1)
        final = equal(y) | equal(t) | (here[first] >= DEEPEST)
        weighted = np.column_stack([np.bincount(back, pi * y[:, k]) for k in range(y.shape[1])])
        out.append((here[first], here[first], c[first], np.bincount(back).astype(float), np.bincount(back, pi), weighted, final, r2[first]))
        go = ~final[back]
        here, y, t, pi, r2 = here[go], y[go], t[go], pi[go], r2[go]
    return out


def _inside(t: np.ndarray, level: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which points lie in one of the cells?"""
    out = np.zeros(len(t), bool)
    for one in np.unique(level):
        held = c[level == one]
        code = np.unique(np.concatenate([held, _index(t, np.full(len(t), one))]), axis=0, return_inverse=True)[1].ravel()
        out |= np.isin(code[len(held):], code[:len(held)])
    return out


def _all_opened(y: np.ndarray, upper: tuple, roots: tuple, below: tuple, theta_sq: float) -> tuple | None:
    """Where every point of the block opens all upper cells: (which points lie in roots that have cells
    that may be accepted whole, those roots, (centres, masses) of the upper leaves); else None.

    A cell's squared radius falls with its level alone, so one level is the last that is opened from as
    far as anything lies; a root is a plain sum of its points if that level parts them."""
    (level, s, t, mass, r2), (_, place) = below, roots
    final = upper[6]
    if not len(level) or final.all():
        return None
    centres = upper[5] / upper[4][:, None]
    held = np.concatenate([s, centres])
    gap = np.maximum(y.max(axis=0) - held.min(axis=0), held.max(axis=0) - y.min(axis=0))
    reach = theta_sq * (gap * gap).sum() * (1 + 1e-6)
    if not np.isfinite(reach) or not upper[7][~final].min() > reach:
        return None
    with np.errstate(divide="ignore"):
        more = np.floor(np.log2(r2.max() / reach) / 2 - 1e-6)  # levels below the root of the largest cells
    last = int(min(level[r2.argmax()] + more, DEEPEST - 1))
    _, first, root = np.unique(np.column_stack([level, place]), axis=0, return_index=True, return_inverse=True)
    root = root.ravel()
    cell = np.unique(np.column_stack([root, _index(t, np.full(len(t), last + 1))]), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(cell, kind="stable")
    begin = np.searchsorted(cell[order], np.arange(int(cell.max()) + 1))
    equal = lambda x: (np.minimum.reduceat(x[order], begin) == np.maximum.reduceat(x[order], begin)).all(axis=1)
    parted = equal(s) | equal(t)
    deep = np.isin(root, root[~parted[cell]])
    mine = np.unique(root[deep])
    here = np.unique(np.concatenate([np.column_stack([level, place])[first[mine]], np.column_stack([upper[0], upper[2]])]), axis=0, return_inverse=True)[1].ravel()
    at = np.isin(here[len(mine):], here[:len(mine)])
    return deep, tuple(x[at] for x in upper), (centres[final], upper[4][final])


def _walk(theta_sq: float, dims: int):
    """Kernel of one block: its points walk the cells that it may visit."""
    names = ["id", "map", "sum_q", *_d("n", dims)]

    def run(points: pa.Table, cells: pa.Table) -> pa.Table:
        m = points.num_rows
        ids, maps = points.column("id"), points.column("map")
        y, t = (np.column_stack([points.column(c).to_numpy() for c in _d(x, dims)]).astype(np.float64).reshape(m, dims) for x in "yt")
        weight = points.column("pi").to_numpy()
        sum_q, force = np.zeros(m), np.zeros((m, dims))
        if m and cells.num_rows:
            is_point = cells.column("point").to_numpy(zero_copy_only=False).astype(bool)
            col = lambda c, at, kind=np.float64: cells.column(c).to_numpy(zero_copy_only=False)[at].astype(kind)
            cols = lambda p, at, kind=np.float64: np.column_stack([col(x, at, kind) for x in _d(p, dims)])
            up = ~is_point
            parts = [(col("level", up, np.int64), col("top", up, np.int64), cols("c", up, np.int64), col("cnt", up), col("mass", up), cols("s", up), col("final", up, bool), col("r2", up))]
            roots = col("level", is_point, np.int64), cols("c", is_point, np.int64)
            below = col("level", is_point, np.int64), cols("s", is_point), cols("t", is_point), col("mass", is_point), col("r2", is_point)
            starts = None
            near = _all_opened(y, parts[0], roots, below, theta_sq)
            if near is not None:  # a plain sum but where cells are too small for that
                deep, rest, single = near
                some = np.concatenate([below[1][~deep], single[0]])
                sum_q, force, _, _ = _tile_sums(y, None, some, np.concatenate([below[3][~deep], single[1]]), False)
                sum_q -= np.where(_inside(t, rest[0], rest[2]), 0.0, weight)  # but itself
                below, parts, starts = tuple(x[deep] for x in below), [rest], np.arange(len(rest[0]))
            parts += _below(*below)
            level, top, c, cnt, mass, s, final, r2 = (np.concatenate(x) for x in zip(*parts))
            with np.errstate(divide="ignore", invalid="ignore"):
                cen = s / mass[:, None]
            root, first, count, child = _children(level, top, c)
            starts = np.array([root]) if starts is None else starts
            step = max(1, WALK_PAIRS // max(1, len(level)))
            for lo in range(0, m if len(starts) else 0, step):
                at = np.arange(lo, min(lo + step, m))
                at, cell = np.repeat(at, len(starts)), np.tile(starts, len(at))
                while len(at):
                    own = (_index(t[at], level[cell]) == c[cell]).all(axis=1)
                    others = np.where(own, mass[cell] - weight[at], mass[cell])
                    with np.errstate(divide="ignore", invalid="ignore"):
                        centre = np.where(own[:, None], (s[cell] - weight[at][:, None] * y[at]) / others[:, None], cen[cell])
                    diff = y[at] - centre
                    dsq = (diff * diff).sum(axis=1)
                    take = final[cell] | (~own & (r2[cell] < theta_sq * dsq)) | (count[cell] == 0)
                    use = take & (np.where(own, cnt[cell] - 1, cnt[cell]) > 0) & (others > 0)
                    q = 1.0 / (1.0 + dsq[use])
                    w = others[use] * q
                    sum_q += np.bincount(at[use], w, minlength=m)
                    for k in range(dims):
                        force[:, k] += np.bincount(at[use], w * q * diff[use, k], minlength=m)
                    more = count[cell[~take]]
                    ends = np.cumsum(more)
                    place = np.repeat(first[cell[~take]] - (ends - more), more) + np.arange(int(more.sum()))
                    at, cell = np.repeat(at[~take], more), child[place]
        return pa.table([ids, maps, pa.array(sum_q), *[pa.array(force[:, k].copy()) for k in range(dims)]], names=names)
    return run


def _children(level: np.ndarray, top: np.ndarray, c: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(the root, where a cell's children begin, their number, the children).  A cell's parent
    is the lowest of its chain: it stands one level over the beginning of the cell's own."""
    n = len(level)
    if not n:
        return -1, *(np.zeros(0, np.int64) for _ in range(3))
    above = np.column_stack([top - 1, c >> np.minimum(level - top + 1, 63)[:, None]])
    _, code = np.unique(np.concatenate([np.column_stack([level, c]), above]), axis=0, return_inverse=True)
    code = code.ravel()
    back = np.full(int(code.max()) + 1, -1, dtype=np.int64)
    back[code[:n]] = np.arange(n)
    parent = back[code[n:]]
    root = int(np.flatnonzero(top == 0)[0]) if (top == 0).any() else -1
    if root >= 0:
        parent[root] = -1
    child = np.argsort(parent, kind="stable")
    child = child[np.searchsorted(parent[child], 0):]
    count = np.bincount(parent[child], minlength=n)
    return root, np.cumsum(count) - count, count, child


def bh_repulsion(state: DataFrame, theta_sq: float = 0.5, dims: int = 2, n: int | None = None) -> DataFrame:
    """``(id, map, sum_q, n1..nd)``: Barnes-Hut estimate of Σ_j π_j q_ij and of the
    repulsive force Σ_j π_j q_ij² (y_i − y_j), q = 1/(1 + d²), j ≠ i, of every map; without a
    column ``pi`` every π is 1.  The result is checkpointed, so its intermediates are released at once."""
    pi = F.col("pi").cast("double") if "pi" in state.columns else F.lit(1.0)
    points = _with_unit_coords(state, dims).select("id", F.col("map").cast("int").alias("map"), *_d("y", dims), *_d("t", dims), *_d("w", dims), pi.alias("pi"))
    points = points.persist(StorageLevel.MEMORY_AND_DISK)
    n = n or points.count()
    tasks = 2 * points.sparkSession.sparkContext.defaultParallelism
    limit = max(FEW_POINTS, min(WIDE_BLOCK_POINTS if theta_sq < WIDE_THETA else BLOCK_POINTS, math.ceil(n / tasks)))
    upper, facts = _upper(points, n, limit, dims)
    key, place = ["map", "level", *_d("c", dims)], [*_d("y", dims), *_d("t", dims)]
    located = _located(points.drop(*_d("w", dims)), upper.where("small or block").select(*key, "cnt", "small", "block"), facts["levels"], dims)
    blk = f"xxhash64(level, {_each(dims, 'c{k}')}, pmod(xxhash64(id), ceil(cnt / {limit})))"
    located = located.selectExpr(*key, "id", "pi", *place, "small", "block", f"{blk} as blk").persist(StorageLevel.MEMORY_AND_DISK)
    blocked = located.where("block").select("map", "blk", "id", "pi", *place)
    roots = located.where("small").select(*key, "pi", *place, "blk") if facts["small"] else None
    reach = _reach(blocked, upper, roots, facts["deepest"], theta_sq, dims)
    # numbered partitions are not merged where rows are few: the walk costs more than its rows weigh
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = (blocked.repartition(parts, "map", "blk").groupBy("map", "blk").cogroup(reach.repartition(parts, "of_map", "of_blk").groupBy("of_map", "of_blk"))
           .applyInArrow(_walk(theta_sq, dims), "id bigint, map int, sum_q double, " + ", ".join(f"n{k} double" for k in range(1, dims + 1))))
    out = checkpoint(out)
    points.unpersist()
    located.unpersist()
    return out


def bh_gradient(joint_p: DataFrame, state: DataFrame, repulsion: DataFrame, dims: int = 2,
                p_scale=1.0, scale: float = 1.0) -> tuple[DataFrame, object]:
    """``dY = scale·(posF − negF / sumQ)`` with sumQ = Σ_i sum_q_i; returns ``(grad, sumQ column)``."""
    from tmaps.operators.kernel import edge_pass
    sum_q = repulsion.agg(F.sum("sum_q")).scalar()
    pos = edge_pass(joint_p, state, dims, p_scale)
    j = repulsion.join(pos, "id", "left")
    g = j.select("id", *[(F.lit(scale) * (F.coalesce(F.col(f"e{k}"), F.lit(0.0)) - F.col(f"n{k}") / sum_q)).alias(f"dy{k}")
                         for k in range(1, dims + 1)])
    return g, sum_q
