"""All-pairs work as block-pair groups.

Rows are hashed into ``B`` blocks.  Every row is copied once per block pair it
belongs to, ``(least(b, o), greatest(b, o))`` for ``o`` in ``0..B-1``, so a
block pair is an ordinary equi-grouping key (no cross join).  Each group holds
at most two blocks, i.e. a size bound fixed by ``block_rows`` and independent
of the data, and a vectorised numpy kernel (``applyInArrow``) reduces the
block-pair to per-row partial results (top-k candidates or partial sums).
Partial results are then combined with ordinary keyed aggregations.

Work is quadratic by definition (exact neighbours, exact kernel sums); the
shuffle volume is ``n * B`` rows, which ``block_rows`` trades against group
size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REALMIN = 1e-12
DISTANCE_TOLERANCE = 1e-10  # relative error that the norm-assisted form may have
DIRECT_PAIRS = 100_000
STRIP = 1 << 18  # pairs that are worked on at once


MIN_BLOCK_ROWS = 64
MAP_BLOCK_ROWS = 65_536  # rows of a map in a block: positions are small, and the pairs are evaluated in tiles
TILE = 256
PRODUCT_EXTENT = 64.0  # of a map whose squared distances are taken from products: an error of 1e-12 of 1 + d² at the most
BUSY_BLOCK_ROWS = 2048  # blocks of more rows are halved while cores have few groups


def choose_blocks(n: int, block_rows: int, min_groups: int = 8) -> int:
    """Number of blocks: groups stay below ``2 * block_rows`` rows, and there
    are at least ``min_groups`` block pairs to keep all cores busy — but blocks
    never shrink below ``MIN_BLOCK_ROWS`` rows (the copies grow as n·B)."""
    n = max(int(n), 1)
    b = max(1, math.ceil(n / block_rows))
    cap = max(b, math.ceil(n / MIN_BLOCK_ROWS))
    while b * (b + 1) // 2 < min_groups and b < cap:
        b += 1
    return b


def map_blocks(n: int, n_maps: int, min_groups: int, block_rows: int | None = None) -> int:
    """Number of blocks of map rows.  Copies and partial sums grow as n·B, so blocks are as large as
    cores with several groups each allow, and hold at most ``block_rows`` rows of all maps."""
    b = choose_blocks(n, max(16, (block_rows or MAP_BLOCK_ROWS) // max(1, n_maps)), min_groups)
    while b * (b + 1) // 2 < 4 * min_groups and n > b * BUSY_BLOCK_ROWS:
        b += 1
    return b


def default_min_groups(spark) -> int:
    try:
        return max(2 * spark.sparkContext.defaultParallelism, 4)
    except Exception:  # pragma: no cover - connect sessions
        return 16


def with_block(df: DataFrame, n_blocks: int, id_col: str = "id") -> DataFrame:
    return df.withColumn("_b", F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blocks)).cast("int"))


def replicate_pairs(df: DataFrame, n_blocks: int) -> DataFrame:
    """Copy each row to the ``n_blocks`` block pairs that contain its block."""
    o = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_o")
    rep = df.select("*", o)
    return (rep.withColumn("_lo", F.least("_b", "_o"))
            .withColumn("_hi", F.greatest("_b", "_o"))
            .drop("_o"))


# ---------------------------------------------------------------- helpers

def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    size = arr.value_lengths().to_numpy(zero_copy_only=False)
    if not (size == size[0]).all():
        raise ValueError(f"vectors of different widths: {np.unique(size).tolist()}")
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1)


def _np(t: pa.Table, name: str, dtype=None) -> np.ndarray:
    a = t.column(name).to_numpy()
    return a.astype(dtype, copy=False) if dtype is not None else a


def sq_dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, norm-assisted (one GEMM) about a common centre;
    entries that the expansion may have cancelled are computed again directly."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)))
    with np.errstate(invalid="ignore", over="ignore"):
        centre = a.mean(axis=0)
        a, b = a - centre, b - centre
        na = np.einsum("ij,ij->i", a, a)
        nb = np.einsum("ij,ij->i", b, b)
        d = np.empty((len(a), len(b)))
        back = -2.0 * b.T
        # rounding of the expansion against what is left of it
        ratio = 4 * a.shape[1] * np.finfo(float).eps / DISTANCE_TOLERANCE
        strip = max(1, STRIP // len(b))
        norms = np.empty((min(strip, len(a)), len(b)))
        i, j = [], []
        for lo in range(0, len(a), strip):  # a strip of rows stays in the cache
            part, both = d[lo:lo + strip], norms[:len(a) - lo]
            np.matmul(a[lo:lo + strip], back, out=part)
            np.add.outer(na[lo:lo + strip], nb, out=both)
            part += both
            np.maximum(part, 0.0, out=part)
            both *= ratio
            doubt = part < both
            if doubt.any():
                x, y = np.nonzero(doubt)
                i.append(x + lo)
                j.append(y)
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
    for lo in range(0, len(i), DIRECT_PAIRS):
        x, y = i[lo:lo + DIRECT_PAIRS], j[lo:lo + DIRECT_PAIRS]
        diff = a[x] - b[y]
        d[x, y] = np.einsum("ij,ij->i", diff, diff)
    return d


def _topk_rows(d: np.ndarray, k: int, largest: bool = False, col_ids: np.ndarray | None = None):
    """(row, col) of the k smallest (largest) entries per row, ties broken by the
    column's id — exactly k per row (fewer if the row is shorter), so a block of
    equal distances (copies of one point) never floods the output."""
    nr, nc = d.shape
    if nc == 0 or nr == 0 or k <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if nc <= k:
        mask = np.isfinite(d)
    else:
        if largest:
            kth = -np.partition(-d, k - 1, axis=1)[:, k - 1]
            mask = d >= kth[:, None]
        else:
            kth = np.partition(d, k - 1, axis=1)[:, k - 1]
            mask = d <= kth[:, None]
        mask &= np.isfinite(d)
    rows, cols = np.nonzero(mask)
    if len(rows) <= nr * k and (mask.sum(axis=1) <= k).all():
        return rows, cols
    cid = col_ids[cols] if col_ids is not None else cols
    val = -d[rows, cols] if largest else d[rows, cols]
    order = np.lexsort((cid, val, rows))
    rows, cols = rows[order], cols[order]
    start = np.searchsorted(rows, rows, side="left")
    keep = (np.arange(len(rows)) - start) < k
    return rows[keep], cols[keep]


def _split(t: pa.Table):
    lo = t.column("_lo")[0].as_py()
    hi = t.column("_hi")[0].as_py()
    b = _np(t, "_b")
    return lo, hi, b == lo, b == hi


# ---------------------------------------------------------------- vector kernels

KNN_SCHEMA = "i bigint, j bigint, d2 double"
DIST_SUMMARY_SCHEMA = "i bigint, n_pairs bigint, d2_min double, d2_max double, d2_sum double"


class _Best:
    """The k best candidates of every row so far; ``bound`` is the value of a row's last, once it has k."""

    def __init__(self, n_rows: int, k: int):
        self.k, self.n_rows = k, n_rows
        self.parts = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # row, candidate's id, value (kernels: negative)
        self.bound, self.waiting = np.full(n_rows, np.inf), []

    def add(self, r: np.ndarray, j: np.ndarray, value: np.ndarray, now: bool = False) -> None:
        self.waiting.append((r, j, value))
        if now or sum(len(w[0]) for w in self.waiting) >= self.k * self.n_rows:
            self.merge()

    def merge(self) -> list:
        if self.waiting:
            parts = [np.concatenate(p) for p in zip(self.parts, *self.waiting)]
            order = np.argsort(parts[2])
            value = parts[2][order]
            if (value[1:] == value[:-1]).any():
                order = np.lexsort((parts[1], parts[2]))
            row = parts[0][order]  # few rows: their numbers as 16 bits are sorted by digits
            order = order[np.argsort(row.astype(np.uint16) if self.n_rows <= 1 << 16 else row, kind="stable")]
            parts = [p[order] for p in parts]
            count = np.bincount(parts[0], minlength=self.n_rows)
            place = np.arange(len(order)) - np.repeat(np.cumsum(count) - count, count)
            self.parts, self.waiting = [p[place < self.k] for p in parts], []
            last = place[place < self.k] == self.k - 1  # rows that have k: only what is no farther than the last may enter
            self.bound[self.parts[0][last]] = self.parts[2][last]
        return self.parts


def _nearest(x: np.ndarray, ids: np.ndarray, cand: np.ndarray, cand_ids: np.ndarray, k: int, tile: int, by_kernel: bool):
    """(row, candidate id, value) of the k best candidates of each row, tile by tile (self
    excluded by id): the least squared distances, or the largest kernels."""
    best = _Best(len(x), k)
    for first in range(0, len(cand), tile):
        col_ids = cand_ids[first:first + tile]
        d = _minus_kernel(x, cand[first:first + tile]) if by_kernel else sq_dist(x, cand[first:first + tile])
        if len(np.intersect1d(ids, col_ids)):
            d[ids[:, None] == col_ids[None, :]] = np.inf
        if first == 0:
            r, c = _topk_rows(d, k, col_ids=col_ids)
        else:
            r, c = np.nonzero(d <= best.bound[:, None])
            some = np.isfinite(d[r, c])
            r, c = r[some], c[some]
            if len(r) > 2 * k * len(x):  # many are as near: no more than k of a row can enter
                r, c = _topk_rows(d, k, col_ids=col_ids)
        best.add(r, col_ids[c], d[r, c], first == 0)
    r, j, value = best.merge()
    return [r, j, -value if by_kernel else value]


class Screened:
    """Candidates in single precision: a product ``a·b − |b|²/2`` with its error bound tells which
    of them can be among the k nearest of a row, and only those get their squared distance, from the
    differences in double precision. Vectors that single precision cannot hold are searched without."""

    def __init__(self, cand: np.ndarray, cand_ids: np.ndarray):
        finite = np.isfinite(cand).all(axis=1)
        self.cand, self.ids = (cand, cand_ids) if finite.all() else (cand[finite], cand_ids[finite])
        self.all = (cand, cand_ids)
        self.usable = False
        if not self.cand.size:
            return
        with np.errstate(over="ignore", invalid="ignore"):
            self.centre = np.median(self.cand[::max(1, len(self.cand) // 1000)], axis=0)  # rows far off do not move it
            y = self.cand - self.centre
            most = np.abs(y).max()
            if not (np.isfinite(most) and 1e-140 < most < 1e140):
                return
            self.scale = 2.0 ** -np.ceil(np.log2(most))
            y *= self.scale
        # |error| <= rounding * (|a||b| + |b|²/2) <= rounding * (|a|²/2 + |b|²): of the entries, their products and sums
        self.rounding = 4 * (y.shape[1] + 8) * 2.0 ** -24
        self.half = np.einsum("ij,ij->i", y, y) / 2
        self.y = np.column_stack([y, -self.half * (1 - 4 * self.rounding)]).astype(np.float32)
        self.usable = True

    def nearest(self, x: np.ndarray, ids: np.ndarray, k: int, tile: int, near: np.ndarray | None = None):
        """What ``_nearest`` gives, of all candidates or those that ``near`` marks."""
        finite = np.isfinite(x).all(axis=1)
        if not finite.all():  # the others have no neighbours
            some = np.flatnonzero(finite)
            r, j, value = self.nearest(x[some], ids[some], k, tile, near)
            return [some[r], j, value]
        with np.errstate(over="ignore", invalid="ignore"):
            a = (x - self.centre) * self.scale if self.usable else np.zeros((0, 0))
            if not a.size or not (np.isfinite(a).all() and np.abs(a).max() < 1e15):  # single precision holds squares up to 1e38
                cand, cand_ids = self.all if near is None else (self.all[0][near], self.all[1][near])
                return _nearest(x, ids, cand, cand_ids, k, tile, False)
        at = None
        if near is not None and not near.all():
            at = np.flatnonzero(near if len(near) == len(self.ids) else near[np.isfinite(self.all[0]).all(axis=1)])
        count = len(self.ids) if at is None else len(at)
        square = np.einsum("ij,ij->i", a, a)
        slack = self.rounding * (square + 1e-30)
        a = np.column_stack([a, np.ones(len(a))]).astype(np.float32)
        best, strip = _Best(len(x), k), max(16, STRIP // max(1, min(tile, count)))
        for first in range(0, count, tile):
            part = slice(first, first + tile) if at is None else at[first:first + tile]
            y, col_ids, cand = self.y[part], self.ids[part], self.cand[part]
            back = np.ascontiguousarray(y.T)
            for lo in range(0, len(x), strip):
                rows = slice(lo, lo + strip)
                h = a[rows] @ back
                bound = best.bound[rows] * self.scale ** 2
                if first == 0 and len(col_ids) > k:  # a bound of the k-th nearest in this tile
                    shared = np.isin(col_ids, ids[rows])
                    for c in np.flatnonzero(shared):
                        h[ids[rows] == col_ids[c], c] = -np.inf
                    at_least = h - (8 * self.rounding * self.half[part]).astype(np.float32)
                    kth = np.partition(at_least, len(col_ids) - k, axis=1)[:, len(col_ids) - k]
                    bound = np.where(np.isfinite(kth), square[rows] - 2.0 * kth + 4 * slack[rows], np.inf)
                least = (square[rows] - bound) / 2 - slack[rows]
                least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
                hit = np.flatnonzero((h >= least[:, None]).ravel())
                r, c = np.divmod(hit, h.shape[1])
                for n in range(0, len(r), DIRECT_PAIRS):
                    i, j = r[n:n + DIRECT_PAIRS] + lo, c[n:n + DIRECT_PAIRS]
                    diff = x[i] - cand[j]
                    d = np.einsum("ij,ij->i", diff, diff)
                    keep = (d <= best.bound[i]) & (ids[i] != col_ids[j]) & np.isfinite(d)
                    best.add(i[keep], col_ids[j[keep]], d[keep])
            if first == 0:
                best.merge()
        return best.merge()


def _minus_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``-1 / (1 + |a_i − b_j|²)``."""
    out, strip = np.empty((len(a), len(b))), max(1, STRIP // (4 * max(1, len(b))))
    for lo in range(0, len(a), strip):
        part = out[lo:lo + strip]
        part.fill(0.0)
        for k in range(a.shape[1]):
            d = np.subtract.outer(a[lo:lo + strip, k], b[:, k])
            d *= d
            part += d
        part += 1.0
        np.divide(-1.0, part, out=part)
    return out


def directed_knn_kernel(k: int, tile: int = 2048):
    """Per group (row block, candidates): the k nearest of the candidates for every row."""

    def run(t: pa.Table) -> pa.Table:
        role = t.column("_row").to_numpy(zero_copy_only=False).astype(bool)
        ids = _np(t, "id", np.int64)
        x = _matrix(t.column("v"))
        rows, others = np.flatnonzero(role), np.flatnonzero(~role)
        out, found = [], Screened(x[others], ids[others])
        for lo in range(0, len(rows), tile):
            at = rows[lo:lo + tile]
            r, j, d = found.nearest(x[at], ids[at], k, tile)
            out.append((ids[at[r]], j, d))
        return _knn_table(out, "d2")

    return run


def _knn_table(parts: list, value: str) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"i": cols[0].astype(np.int64), "j": cols[1].astype(np.int64), value: cols[2].astype(np.float64)})


def visiting_kernel(k: int, tile: int = 2048, by_kernel: bool = False):
    """Per group (super-block of rows, super-block of candidates) and its pairs (block, cell):
    every block of rows searches the cells that it reaches, and no others."""

    def run(t: pa.Table, pairs: pa.Table) -> pa.Table:
        out = []
        if t.num_rows and pairs.num_rows:
            role = t.column("_row").to_numpy(zero_copy_only=False).astype(bool)
            ids, x, blk, cell = _np(t, "id", np.int64), _matrix(t.column("v")), _np(t, "blk"), _np(t, "cell")
            rows, others = np.flatnonzero(role), np.flatnonzero(~role)
            to, cells = _np(pairs, "blk"), _np(pairs, "cell")
            found = None if by_kernel else Screened(x[others], ids[others])
            for b in np.unique(to):
                mine = rows[blk[rows] == b]
                reached = np.isin(cell[others], cells[to == b])
                near = others[reached] if by_kernel else None
                for lo in range(0, len(mine), tile):
                    at = mine[lo:lo + tile]
                    r, j, d = (_nearest(x[at], ids[at], x[near], ids[near], k, tile, True) if by_kernel
                               else found.nearest(x[at], ids[at], k, tile, reached))
                    out.append((ids[at[r]], j, d))
        return _knn_table(out, "qz" if by_kernel else "d2")

    return run


def replicate_directed(df: DataFrame, n_blocks: int, n_columns: int) -> DataFrame:
    """Each row once for each super-block of columns, as a row of its block, and once
    for each block, as a candidate of its super-block: groups ``(_br, _sc)``."""
    own = F.pmod(F.col("_b"), F.lit(n_columns))
    as_row = F.transform(F.sequence(F.lit(0), F.lit(n_columns - 1)), lambda c: F.struct(
        F.col("_b").alias("_br"), c.alias("_sc"), F.lit(True).alias("_row")))
    as_candidate = F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda r: F.struct(
        r.alias("_br"), own.alias("_sc"), F.lit(False).alias("_row")))
    return df.select(*[c for c in df.columns if c != "_b"], F.inline(F.concat(as_row, as_candidate)))


def dist_summary_kernel(t: pa.Table) -> pa.Table:
    """Per block pair: count / min / max / sum of squared distances per row."""
    lo, hi, in_lo, in_hi = _split(t)
    ids = _np(t, "id", np.int64)
    x = _matrix(t.column("v"))
    parts = []
    if lo == hi:
        d = sq_dist(x, x)
        n = len(ids)
        off = ~np.eye(n, dtype=bool)
        dmin = np.where(off, d, np.inf).min(axis=1) if n > 1 else np.full(n, np.inf)
        dmax = np.where(off, d, -np.inf).max(axis=1) if n > 1 else np.full(n, -np.inf)
        dsum = np.where(off, d, 0.0).sum(axis=1)
        parts.append((ids, np.full(n, n - 1), dmin, dmax, dsum))
    else:
        d = sq_dist(x[in_lo], x[in_hi])
        na, nb = d.shape
        if na and nb:
            parts.append((ids[in_lo], np.full(na, nb), d.min(1), d.max(1), d.sum(1)))
            parts.append((ids[in_hi], np.full(nb, na), d.min(0), d.max(0), d.sum(0)))
    if not parts:
        return pa.table({"i": pa.array([], pa.int64()), "n_pairs": pa.array([], pa.int64()),
                         "d2_min": pa.array([], pa.float64()), "d2_max": pa.array([], pa.float64()),
                         "d2_sum": pa.array([], pa.float64())})
    cols = list(zip(*parts))
    return pa.table({"i": np.concatenate(cols[0]).astype(np.int64),
                     "n_pairs": np.concatenate(cols[1]).astype(np.int64),
                     "d2_min": np.concatenate(cols[2]).astype(np.float64),
                     "d2_max": np.concatenate(cols[3]).astype(np.float64),
                     "d2_sum": np.concatenate(cols[4]).astype(np.float64)})


# ---------------------------------------------------------------- map kernels
# Input rows: _lo, _hi, _b, id, map, y1..yd, pi  (single map: map = 0, pi = 1)

def map_sums_schema(dims: int) -> str:
    return "id bigint, map int, a double, s double, " + ", ".join(f"r{k} double" for k in range(1, dims + 1))


def _map_groups(t: pa.Table, dims: int):
    maps = _np(t, "map", np.int64)
    ids = _np(t, "id", np.int64)
    y = np.column_stack([_np(t, f"y{k}", np.float64) for k in range(1, dims + 1)])
    pi = _np(t, "pi", np.float64)
    return maps, ids, y, pi


def _tile_sums(ya: np.ndarray, wa: np.ndarray | None, yb: np.ndarray, wb: np.ndarray, same: bool):
    """``(Σ_j w_j num, Σ_j w_j num² (y_i − y_j))`` for every row of a over b and, unless they are the
    ``same`` rows or a has no weights, for every row of b over a: tile by tile, so the work space does not grow
    with the block, and each pair of tiles is evaluated once. Of near points ``1 + d²`` and the sums of differences are
    products of matrices: what these lose to rounding grows with the square of the extent, so wide maps go by differences."""
    na, nb, dims = len(ya), len(yb), ya.shape[1]
    if na and nb:
        with np.errstate(invalid="ignore", over="ignore"):
            low, high = np.minimum(ya.min(axis=0), yb.min(axis=0)), np.maximum(ya.max(axis=0), yb.max(axis=0))
            if (high - low <= PRODUCT_EXTENT).all():
                return _product_sums(ya - (low + high) / 2, wa, yb - (low + high) / 2, wb, same)
    sa, ra, sb, rb = np.zeros(na), np.zeros((na, dims)), np.zeros(nb), np.zeros((nb, dims))
    num, diff, one = np.empty(TILE * TILE), np.empty((dims, TILE * TILE)), np.empty(TILE * TILE)
    xa, xb = np.ascontiguousarray(ya.T), np.ascontiguousarray(yb.T)
    for lo in range(0, na, TILE):
        i = slice(lo, min(lo + TILE, na))
        for at in range(lo if same else 0, nb, TILE):
            j = slice(at, min(at + TILE, nb))
            shape = (i.stop - i.start, j.stop - j.start)
            size = shape[0] * shape[1]
            q, w = num[:size].reshape(shape), one[:size].reshape(shape)
            q.fill(1.0)
            d = [diff[k, :size].reshape(shape) for k in range(dims)]
            for k in range(dims):
                np.subtract.outer(xa[k, i], xb[k, j], out=d[k])
                np.multiply(d[k], d[k], out=w)
                q += w
            np.divide(1.0, q, out=q)
            twin = same and at == lo
            both = wa is not None and not twin
            if twin:
                np.fill_diagonal(q, 0.0)
            sa[i] += q @ wb[j]
            if both:
                sb[j] += wa[i] @ q
            np.multiply(q, q, out=q)
            for k in range(dims):
                np.multiply(q, d[k], out=w)
                ra[i, k] += w @ wb[j]
                if both:
                    rb[j, k] -= wa[i] @ w
    return (sa + sb, ra + rb, None, None) if same else (sa, ra, sb, rb)


def _product_sums(ya: np.ndarray, wa: np.ndarray | None, yb: np.ndarray, wb: np.ndarray, same: bool):
    """The sums of ``_tile_sums`` by products of matrices."""
    na, nb, dims = len(ya), len(yb), ya.shape[1]
    one = lambda y: np.ones((len(y), 1))
    left = np.column_stack([-2.0 * ya, np.einsum("ij,ij->i", ya, ya) + 1.0, one(ya)])
    right = np.ascontiguousarray(np.column_stack([yb, one(yb), np.einsum("ij,ij->i", yb, yb)]).T)
    # weights, and weighted positions
    of_b = np.column_stack([wb, wb[:, None] * yb])
    of_a = None if wa is None else np.ascontiguousarray(np.column_stack([wa, wa[:, None] * ya]).T)
    sa, qa, sb, qb = np.zeros(na), np.zeros((na, dims + 1)), np.zeros(nb), np.zeros((dims + 1, nb))
    num = np.empty(TILE * TILE)
    for lo in range(0, na, TILE):
        i = slice(lo, min(lo + TILE, na))
        for at in range(lo if same else 0, nb, TILE):
            j = slice(at, min(at + TILE, nb))
            q = num[:(i.stop - i.start) * (j.stop - j.start)].reshape(i.stop - i.start, j.stop - j.start)
            np.matmul(left[i], right[:, j], out=q)
            np.divide(1.0, q, out=q)
            twin = same and at == lo
            both = wa is not None and not twin
            if twin:
                np.fill_diagonal(q, 0.0)
            sa[i] += q @ wb[j]
            if both:
                sb[j] += wa[i] @ q
            np.multiply(q, q, out=q)
            qa[i] += q @ of_b[j]
            if both:
                qb[:, j] += of_a[:, i] @ q
    ra, rb = ya * qa[:, :1] - qa[:, 1:], yb * qb[:1].T - qb[1:].T
    return (sa + sb, ra + rb, None, None) if same else (sa, ra, sb, rb)


def map_sums_kernel(dims: int):
    """Per block pair and map m, for every row i:
    ``a = Σ_j π_i π_j num``, ``s = Σ_j π_j num``, ``r = Σ_j π_i π_j num² (y_i - y_j)``,
    with ``num = 1 / (1 + |y_i - y_j|²)`` and j ≠ i."""

    def run(t: pa.Table) -> pa.Table:
        lo, hi, in_lo, in_hi = _split(t)
        maps, ids, y, pi = _map_groups(t, dims)
        out = []

        def emit(sel, m, s, r):
            w = pi[sel]
            out.append((ids[sel], np.full(len(w), m, dtype=np.int32), w * s, s, *(w * r[:, k] for k in range(dims))))

        for m in np.unique(maps):
            sel = maps == m
            sa, sb = (sel, sel) if lo == hi else (sel & in_lo, sel & in_hi)
            if sa.any() and sb.any():
                s_a, r_a, s_b, r_b = _tile_sums(y[sa], pi[sa], y[sb], pi[sb], lo == hi)
                emit(sa, m, s_a, r_a)
                if lo != hi:
                    emit(sb, m, s_b, r_b)
        names = ["id", "map", "a", "s", *[f"r{k}" for k in range(1, dims + 1)]]
        if not out:
            return pa.table({c: pa.array([], {"id": pa.int64(), "map": pa.int32()}.get(c, pa.float64())) for c in names})
        return pa.table({c: np.concatenate(v) for c, v in zip(names, zip(*out))})

    return run


TOPQ_SCHEMA = "i bigint, j bigint, qz double"
TOPQ_TILE = 512  # rows of a side that are screened at once
SCREEN_ERROR = 1e-2  # relative error that a screened kernel may have
LEAST_PI = 1e-12  # of a proportion in a product: a smaller one counts for more there, and is never missed


class _MapSide:
    """The points of a block with their positions and proportions in every map, those near the centre first, in tiles of
    ``TOPQ_TILE``; the maps' rows are aligned by id. A point without a number in some map has no kernels and is left out."""

    def __init__(self, maps: np.ndarray, ids: np.ndarray, y: np.ndarray, pi: np.ndarray, of: np.ndarray, k: int, centre: np.ndarray | None = None):
        by_map = [np.flatnonzero(maps == m) for m in of]
        by_map = [rows[np.argsort(ids[rows], kind="stable")] for rows in by_map]
        if len({len(rows) for rows in by_map}) > 1:
            raise ValueError(f"maps of different numbers of points: {[len(rows) for rows in by_map]}")
        self.ids, self.y, self.pi = ids[by_map[0]], np.stack([y[rows].T for rows in by_map]), np.stack([pi[rows] for rows in by_map])
        there = ~(np.isnan(self.y).any(axis=(0, 1)) | np.isnan(self.pi).any(axis=0))
        if centre is None:
            centre = np.median(self.y[:, :, there], axis=2, keepdims=True) if there.any() else np.zeros((len(of), y.shape[1], 1))
            centre = np.where(np.isfinite(centre), centre, 0.0)
        self.centre = centre
        reach = np.square(self.y - centre).sum(axis=1).max(axis=0)
        if (self.pi < 0).any() or not np.isfinite(self.pi).all():
            reach[:] = np.inf  # not proportions: by differences only
        order = np.flatnonzero(there)
        order = order[np.argsort(reach[order], kind="stable")]
        self.ids, self.y, self.pi = self.ids[order], np.ascontiguousarray(self.y[:, :, order]), np.ascontiguousarray(self.pi[:, order])
        self.tiles = [slice(lo, min(lo + TOPQ_TILE, len(order))) for lo in range(0, len(order), TOPQ_TILE)]
        self.reach = [reach[order[tile.stop - 1]] for tile in self.tiles]
        self.best = [_Best(tile.stop - tile.start, k) for tile in self.tiles]
        self.seen = [False] * len(self.tiles)
        self.factors: dict = {}

    def factor(self, kind, left: bool, m: int) -> np.ndarray:
        """Of ``(1 + d²) / (π_i π_j)`` in map m, the part of the rows (``left``) or of the columns."""
        if (kind, left, m) not in self.factors:
            x = self.y[m] - self.centre[m]
            square, one = np.square(x).sum(axis=0), np.ones(len(self.ids))
            f = np.vstack([-2.0 * x, square + 1.0, one] if left else [x, one, square]) / np.maximum(self.pi[m], LEAST_PI)
            self.factors[kind, left, m] = np.ascontiguousarray(f.T if left else f, dtype=kind)
        return self.factors[kind, left, m]

    def qz(self, i: np.ndarray, other: _MapSide, j: np.ndarray, realmin: float) -> np.ndarray:
        """QZ of the pairs (i, j) from differences."""
        total = np.full(len(i), realmin)
        for x, w, x_j, w_j in zip(self.y, self.pi, other.y, other.pi):
            d2 = np.zeros(len(i))
            for c, c_j in zip(x, x_j):
                d = c[i] - c_j[j]
                d2 += d * d
            total += w[i] * w_j[j] * (1.0 / (1.0 + d2))
        return total

    def bounded(self, n: int, h: np.ndarray, other: _MapSide, at: slice, realmin: float, twin: bool) -> None:
        """A tile's first bound: the least QZ of the k columns of ``h`` that look best."""
        best, tile = self.best[n], self.tiles[n]
        self.seen[n] = True
        if h.shape[1] - twin > best.k:
            c = np.argpartition(h, h.shape[1] - best.k, axis=1)[:, -best.k:]
            i = np.repeat(np.arange(tile.start, tile.stop), best.k)
            least = self.qz(i, other, at.start + c.ravel(), realmin).reshape(c.shape).min(axis=1)
            best.bound = np.where(np.isfinite(least), -least, np.inf)

    def enter(self, n: int, r: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        """Candidates of the tile's rows r: those that are no worse than the k-th so far."""
        keep = value <= self.best[n].bound[r]
        self.best[n].add(r[keep], ids[keep], value[keep])

    def enter_all(self, n: int, qz: np.ndarray, other: _MapSide, at: slice) -> None:
        best, col_ids = self.best[n], other.ids[at]
        self.seen[n] = True
        r, c = np.nonzero((qz >= -best.bound[:, None]) & np.isfinite(qz))
        if len(r) > 2 * best.k * len(qz):  # many are as near: no more than k of a row can enter
            r, c = _topk_rows(qz, best.k, largest=True, col_ids=col_ids)
        best.add(r, col_ids[c], -qz[r, c])

    def found(self) -> list:
        parts = [[self.ids[tile][r], j, -value] for tile, best in zip(self.tiles, self.best) for r, j, value in [best.merge()]]
        return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _screen(a: _MapSide, b: _MapSide, realmin: float) -> None:
    """Every pair of tiles of a and b (or of a with itself) once, for the rows of both: a product of matrices gives
    ``(1 + d²) / (π_i π_j)`` of each map, in single precision or, where that tells too few pairs apart, in double precision. Its
    error bound tells which pairs can be among a row's k best; where neither will do, every pair goes by differences."""
    same, space = a is b, {}

    def screened(n: int, o: int, kind, error: float):
        """The pairs, numbered row by row, that can be among the best of their row or column; None if they are too many."""
        i, j, twin = a.tiles[n], b.tiles[o], same and n == o
        if kind not in space:
            space[kind] = np.empty(TOPQ_TILE * TOPQ_TILE, kind), np.empty(TOPQ_TILE * TOPQ_TILE, kind)
        h, part = (x[:(i.stop - i.start) * (j.stop - j.start)].reshape(i.stop - i.start, -1) for x in space[kind])
        for m in range(len(a.y)):
            out = part if m else h
            np.matmul(a.factor(kind, True, m)[i], b.factor(kind, False, m)[:, j], out=out)
            np.divide(kind(1), out, out=out)
            if m:
                h += part
        if twin:
            np.fill_diagonal(h, -np.inf)
        if not a.seen[n]:
            a.bounded(n, h, b, j, realmin, twin)
        if not twin and not b.seen[o]:
            b.bounded(o, h.T, a, i, realmin, False)

        def least(bound):
            return np.nextafter(((-bound - realmin) * (1 - error) - 1e-3 * realmin).astype(kind), kind(-np.inf))

        hit = h >= least(a.best[n].bound)[:, None]
        if twin:
            np.fill_diagonal(hit, False)
        else:
            hit |= h >= least(b.best[o].bound)
        return np.flatnonzero(hit) if np.count_nonzero(hit) <= hit.size // 16 else None

    for n, i in enumerate(a.tiles):
        for o in range(n if same else 0, len(b.tiles)):
            j, twin = b.tiles[o], same and n == o
            hits = None
            for kind in (np.float32, np.float64):
                # of the entries, their products and sums, and of what is added up over the maps
                error = (2 * (a.y.shape[1] + 4) * (1 + 2 * (a.reach[n] + b.reach[o])) + len(a.y)) * float(np.finfo(kind).eps)
                if hits is None and error <= SCREEN_ERROR:
                    hits = screened(n, o, kind, error)
            if hits is not None:
                r, c = np.divmod(hits, j.stop - j.start)
                value = -a.qz(i.start + r, b, j.start + c, realmin)
                some = np.isfinite(value)
                r, c, value = r[some], c[some], value[some]
                a.enter(n, r, b.ids[j][c], value)
                if not twin:
                    b.enter(o, c, a.ids[i][r], value)
                continue
            qz = np.full((i.stop - i.start, j.stop - j.start), realmin)
            for m in range(len(a.y)):
                d2 = np.zeros(qz.shape)
                for c in range(a.y.shape[1]):
                    d = np.subtract.outer(a.y[m, c, i], b.y[m, c, j])
                    d2 += d * d
                qz += np.multiply.outer(a.pi[m, i], b.pi[m, j]) * (1.0 / (1.0 + d2))
            if twin:
                np.fill_diagonal(qz, -np.inf)
            qz[~np.isfinite(qz)] = -np.inf
            a.enter_all(n, qz, b, j)
            if not twin:
                b.enter_all(o, qz.T, a, i)


def topq_kernel(dims: int, k: int, realmin: float = REALMIN):
    """Per block pair: top-k candidates of every row by ``QZ = realmin + Σ_m π_im π_jm num_m``
    (single map: by num), tile by tile.  Diagonal excluded."""

    def run(t: pa.Table) -> pa.Table:
        lo, hi, in_lo, in_hi = _split(t)
        maps, ids, y, pi = _map_groups(t, dims)
        umaps = np.unique(maps)
        out = []
        if k > 0 and in_lo.any() and in_hi.any():
            with np.errstate(over="ignore", invalid="ignore"):
                a = _MapSide(maps[in_lo], ids[in_lo], y[in_lo], pi[in_lo], umaps, k)
                b = a if lo == hi else _MapSide(maps[in_hi], ids[in_hi], y[in_hi], pi[in_hi], umaps, k, a.centre)
                _screen(a, b, realmin)
            out = [a.found()] + ([] if lo == hi else [b.found()])
        return _knn_table(out, "qz")

    return run


# ---------------------------------------------------------------- fused iteration kernel
# Left input: replicated map rows (_lo, _hi, _b, id, map, y1..yd, pi)
# Right input: P edges keyed by the block pair of their endpoints (_lo, _hi, i, j, p)

def fused_schema(dims: int) -> str:
    return (map_sums_schema(dims) + ", " + ", ".join(f"e{k} double" for k in range(1, dims + 1))
            + ", t double, pn double, lp double, ps double, qmin double")


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ascending ``ids``; an edge to a point without a position is an error."""
    at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
    if not len(ids) or (ids[at] != wanted).any():
        gone = wanted[:1] if not len(ids) else wanted[ids[at] != wanted][:5]
        raise ValueError(f"affinities name points that have no position: {gone.tolist()}")
    return at


LOSS_COLS = ["lp", "ps", "qmin"]


def halo_kernel(dims: int, p_scale: float, floor: float):
    """Per block: the sums of its points' edges, from the positions that the block needs."""
    names = ["id", *[f"e{k}" for k in range(1, dims + 1)], *LOSS_COLS]

    def run(edges: pa.Table, near: pa.Table) -> pa.Table:
        if not edges.num_rows:
            return pa.table({c: pa.array([], pa.int64() if c == "id" else pa.float64()) for c in names})
        ids = _np(near, "id", np.int64)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        y = np.column_stack([_np(near, f"y{k}", np.float64) for k in range(1, dims + 1)])[order] if near.num_rows else np.zeros((0, dims))
        i, p = _np(edges, "i", np.int64), _np(edges, "p", np.float64) * p_scale
        diff = y[_places(ids, i)] - y[_places(ids, _np(edges, "j", np.int64))]
        num = 1.0 / (1.0 + np.einsum("ij,ij->i", diff, diff))
        point, back = np.unique(i, return_inverse=True)
        total = lambda x: np.bincount(back, x, minlength=len(point))
        least = np.full(len(point), np.inf)
        np.minimum.at(least, back, num)
        w = p * num
        return pa.table([point, *[total(w * diff[:, k]) for k in range(dims)], total(p * np.log(np.maximum(p, floor) / num)), total(p), least], names=names)

    return run


def fused_kernel(dims: int, single: bool, p_scale: float, realmin: float = REALMIN):
    """All-pairs sums (a, s, r*) plus the P-edge sums of one block pair in one task.

    single map:  e = Σ_{j∈P} p'·num·(y_i − y_j)
    maps:        e = Σ_{j∈P} QQ_m·num_m·p'/QZ·(y_i − y_j),  t = Σ_{j∈P} π_jm·num_m·p'/QZ,
                 pn = Σ_{j∈P} p'·π_jm
    with p' = p·p_scale and QZ = realmin + Σ_m QQ_m at the edge.

    Loss parts (once per edge): ``lp = Σ p'·ln(p'/num)`` (maps: ``p'·ln(max(p', realmin)/QZ)``),
    ``ps = Σ p'`` and ``qmin = min num`` (maps: ``min QZ``), so that
    KL = Σ lp + Σ ps · ln Z exactly whenever ``qmin / Z`` is above the floor."""
    sums = map_sums_kernel(dims)
    ecols = [f"e{k}" for k in range(1, dims + 1)]

    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        if rows.num_rows == 0:
            if edges.num_rows:
                _places(np.zeros(0, np.int64), _np(edges, "i", np.int64))
            return _empty_fused(dims)
        base = sums(rows)
        n0 = base.num_rows
        cols = {c: base.column(c).to_numpy() for c in base.column_names}
        for c in ecols + ["t", "pn", "lp", "ps"]:
            cols[c] = np.zeros(n0)
        cols["qmin"] = np.full(n0, np.inf)
        if edges.num_rows:
            maps, ids, y, pi = _map_groups(rows, dims)
            ei = _np(edges, "i", np.int64)
            ej = _np(edges, "j", np.int64)
            p = _np(edges, "p", np.float64) * p_scale
            umaps = np.unique(maps)
            per = []
            for m in umaps:
                sel = maps == m
                idm = ids[sel]
                order = np.argsort(idm, kind="stable")
                pos_i, pos_j = (order[_places(idm[order], e)] for e in (ei, ej))
                ym, pim = y[sel], pi[sel]
                diff = ym[pos_i] - ym[pos_j]
                num = 1.0 / (1.0 + np.einsum("ij,ij->i", diff, diff))
                per.append((m, diff, num, pim[pos_i], pim[pos_j]))
            qz = np.full(len(ei), realmin)
            if not single:
                for _, _, num, pii, pij in per:
                    qz += pii * pij * num
            out = {c: [] for c in ["id", "map", *ecols, "t", "pn", "lp", "ps", "qmin"]}
            point, back = np.unique(ei, return_inverse=True)  # one row of a point and map, not one of each edge
            total = lambda x: np.bincount(back, x, minlength=len(point))

            def least(x):
                least = np.full(len(point), np.inf)
                np.minimum.at(least, back, x)
                return least

            nothing, nowhere = np.zeros(len(point)), np.full(len(point), np.inf)
            for m, diff, num, pii, pij in per:
                first = m == umaps[0]
                if single:  # every map for itself
                    with np.errstate(divide="ignore", invalid="ignore"):
                        loss = total(np.where(p > 0, p * np.log(p / num), 0.0)), total(p), least(num)
                elif first:
                    loss = total(p * np.log(np.maximum(p, realmin) / qz)), total(p), least(qz)
                else:
                    loss = nothing, nothing, nowhere
                w = p * num if single else pii * pij * num * num * (p / qz)
                out["id"].append(point)
                out["map"].append(np.full(len(point), m, dtype=np.int32))
                for k, c in enumerate(ecols):
                    out[c].append(total(w * diff[:, k]))
                out["t"].append(nothing if single else total(pij * num * (p / qz)))
                out["pn"].append(nothing if single else total(p * pij))
                for c, x in zip(LOSS_COLS, loss):
                    out[c].append(x)
            ne = len(point) * len(per)
            cols["map"] = cols["map"].astype(np.int32)
            for c in ["a", "s"] + [f"r{k}" for k in range(1, dims + 1)]:
                cols[c] = np.concatenate([cols[c], np.zeros(ne)])
            for c, x in out.items():
                cols[c] = np.concatenate([cols[c], *x])
        return pa.table({c: cols[c] for c in ["id", "map", "a", "s"] + [f"r{k}" for k in range(1, dims + 1)]
                         + ecols + ["t", "pn"] + LOSS_COLS})

    return run


EDGES = 1 << 19  # that are worked on at once


def edge_schema(dims: int) -> str:
    return "id bigint, map int, t double, " + ", ".join(f"e{k} double" for k in range(1, dims + 1))


def edge_kernel(dims: int, p_scale: float, realmin: float = REALMIN):
    """The P-edge sums ``t`` and ``e`` of ``fused_kernel`` (maps) of one block pair. An edge's ends meet map by
    map, in the order of their rows; ends that are missing, or have unlike numbers of rows, add nothing."""
    names = ["id", "map", "t", *[f"e{k}" for k in range(1, dims + 1)]]

    def run(rows: pa.Table, edges: pa.Table) -> pa.Table:
        maps, ids, y, pi = _map_groups(rows, dims)
        order = np.lexsort((*y.T[::-1], pi, maps, ids))
        maps, ids, y, pi = maps[order], ids[order], y[order], pi[order]
        point, first, count = np.unique(ids, return_index=True, return_counts=True)
        sums, touched = np.zeros((dims + 1, len(ids))), np.zeros(len(ids), bool)
        for lo in range(0, edges.num_rows if len(ids) else 0, EDGES):
            some = edges.slice(lo, EDGES)
            ends = [np.minimum(np.searchsorted(point, _np(some, c, np.int64)), len(point) - 1) for c in ("i", "j")]
            there = (point[ends[0]] == _np(some, "i")) & (point[ends[1]] == _np(some, "j")) & (count[ends[0]] == count[ends[1]])
            i, j, p = ends[0][there], ends[1][there], _np(some, "p", np.float64)[there] * p_scale
            for c in np.unique(count[i]):
                of = count[i] == c
                a, b = (first[x[of]][:, None] + np.arange(c) for x in (i, j))
                diff = y[a] - y[b]
                num = 1.0 / (1.0 + np.einsum("ijk,ijk->ij", diff, diff))
                qq = pi[a] * pi[b] * num
                w = num * (p[of] / (realmin + qq.sum(axis=1)))[:, None]
                at = a.ravel()
                touched[at] = True
                for row, x in zip(sums, (pi[b] * w, *(qq * w * diff[:, :, k] for k in range(dims)))):
                    row += np.bincount(at, x.ravel(), minlength=len(ids))
        at = np.flatnonzero(touched)
        return pa.table([ids[at], maps[at].astype(np.int32), *sums[:, at]], names=names)

    return run


def edge_pass(state_pi: DataFrame, joint_p: DataFrame, n_blocks: int, dims: int, p_scale: float = 1.0, realmin: float = REALMIN) -> DataFrame:
    """``(id, map, t, e*)`` of the P edges: edges and replicated map rows meet by block pair, an edge is moved once."""
    st = state_pi.where("id is not null").select("id", F.col("map").cast("int").alias("map"), *[f"y{k}" for k in range(1, dims + 1)], F.col("pi").cast("double"))
    rep = replicate_pairs(with_block(st, n_blocks), n_blocks)
    edges = key_edges(joint_p.where("i is not null and j is not null"), n_blocks)
    part = (rep.groupBy("_lo", "_hi").cogroup(edges.groupBy("_lo", "_hi"))
            .applyInArrow(edge_kernel(dims, p_scale, realmin), edge_schema(dims)))
    return part.groupBy("id", "map").agg(F.sum("t").alias("t"), *[F.sum(f"e{k}").alias(f"e{k}") for k in range(1, dims + 1)])


def _empty_fused(dims: int) -> pa.Table:
    cols = {"id": pa.array([], pa.int64()), "map": pa.array([], pa.int32())}
    for c in (["a", "s"] + [f"r{k}" for k in range(1, dims + 1)] + [f"e{k}" for k in range(1, dims + 1)]
              + ["t", "pn"] + LOSS_COLS):
        cols[c] = pa.array([], pa.float64())
    return pa.table(cols)


def key_edges(joint_p: DataFrame, n_blocks: int) -> DataFrame:
    """P edges tagged with the block pair of their endpoints (same hashing as ``with_block``)."""
    bi = F.pmod(F.xxhash64(F.col("i")), F.lit(n_blocks)).cast("int")
    bj = F.pmod(F.xxhash64(F.col("j")), F.lit(n_blocks)).cast("int")
    return joint_p.select(F.least(bi, bj).alias("_lo"), F.greatest(bi, bj).alias("_hi"), "i", "j", "p")


def fused_pass(state_pi: DataFrame, keyed_edges: DataFrame, n_blocks: int, dims: int, single: bool,
               p_scale: float, realmin: float = REALMIN) -> DataFrame:
    """One shuffle of replicated map rows co-grouped with the keyed P edges →
    per (id, map): a, s, r*, e*, t, pn."""
    st = state_pi.select("id", F.col("map").cast("int").alias("map"),
                         *[f"y{k}" for k in range(1, dims + 1)], F.col("pi").cast("double"))
    rep = replicate_pairs(with_block(st, n_blocks), n_blocks)
    part = (rep.groupBy("_lo", "_hi")
            .cogroup(keyed_edges.groupBy("_lo", "_hi"))
            .applyInArrow(fused_kernel(dims, single, p_scale, realmin), fused_schema(dims)))
    names = ["a", "s"] + [f"r{k}" for k in range(1, dims + 1)] + [f"e{k}" for k in range(1, dims + 1)] + ["t", "pn", "lp", "ps"]
    return part.groupBy("id", "map").agg(*[F.sum(c).alias(c) for c in names], F.min("qmin").alias("qmin"))


def fused_scalars(sums: DataFrame, n: int, single: bool, realmin: float = REALMIN, floor: float = 1e-12):
    """One aggregate over the fused sums → ``(Z, loss or None)``.

    Z = Σ a (maps: + n²·realmin).  The KL loss Σ lp + Σ ps·ln Z is returned only
    when no edge hits the floor (``qmin / Z ≥ floor``); otherwise None and the
    caller evaluates the floored loss with a join."""
    import math
    r = sums.agg(F.sum("a").alias("a"), F.sum("lp").alias("lp"), F.sum("ps").alias("ps"),
                 F.min("qmin").alias("qmin")).first()
    z = float(r["a"] or 0.0) + (0.0 if single else float(n) * float(n) * realmin)
    loss = None
    if r["qmin"] is not None and z > 0 and float(r["qmin"]) / z >= floor:
        loss = float(r["lp"]) + float(r["ps"]) * math.log(z)
    return z, loss
