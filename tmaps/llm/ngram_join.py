"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct shingles (runs of ``words`` words, hashed to 64 bits); two
sets link from a similarity of ``percent`` per cent on (50 to 99). The global order of
shingles is their hash order. The order is cut into K fragments, so a set is cut into K
segments. Two sets that link differ in at most H = (both sizes) * (100 - percent) /
(100 + percent) shingles, so with K > H some segment is the same in both: documents that share
no segment cannot link. Sizes fall into classes (half as much again each, below 90 per cent
100 / percent as much), with one K for a class, by the larger of two sets; a document shows
its segments for its own class, and for the class above where a partner may be of that class.

1. Every document gives its size and a 128-bit sum of its set. Equal sets are one class from
   here on. The hashes of the segments of the texts that a task reads are sorted and cut by
   ranges into packed lists, each hash once: those that meet in a task are tied there.
2. A range's lists are merged, and segments that different sets share tie them into candidate
   clusters. Segments stand in packed lists of some five bytes each, not in rows.
3. Clusters are parted by bitmaps: the order is cut into two to four fragments for every shingle
   of a set, and a bit says that a fragment holds one. Two sets differ in at least as many shingles
   as their bitmaps in bits; pairs with more than a link allows are none. A bitmap is some
   bits a shingle, so this goes before its text moves; bits in common are counted
   fragment by fragment and summed for each pair, too.
4. The members' texts are gathered by cluster, in blocks of bounded size (and, where
   a cluster is larger, by neighbouring sizes and pairs of blocks). There the overlaps are
   counted fragment by fragment of the order and summed for each pair, exactly. A block
   returns a link for each document to the least one that it reaches, so a group of n
   near copies gives links in proportion to n, not to its pairs.
5. Links of classes become components.

Shingles that many texts hold (told from a bounded sample) would tie strangers: the order is cut
without them first, into the same K fragments. Sets that are left with too few others go on to
the cuts of whole sets, so a link never hangs on the sample.

Segments of few shingles say little: up to E of them are not shown (K is larger by E).
Where more than E are empty, the others are shown, and so are those of the next, independent
cut: sets that have only empty segments in common there both go on to it. A short document's
are shown together with the segments of a second cut.

Defined cases: null, empty and blank texts have an empty set, a size of 0, and link with
nothing; fewer than ``words`` words are one shingle; rows that repeat a doc_id count as copies; a
null doc_id ranks after every other and comes back as null; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tmaps.llm.common import Powers, brief, brief_group, flat, mix64, own, pieces, span_hash, stored, word_spans
from tmaps.llm.components import components

WORDS = 3
PERCENT = 90
LAST_ID = (1 << 63) - 1
BLOCK_SHINGLES, BLOCK_DOCS = 500_000, 1024
FRAGMENT_COLUMNS = 4096
SMALL = 3  # segments of fewer shingles say little
SLACK_FROM = 8
FILTER_BITS = 1 << 26  # 8 MB, whatever the corpus
CUTS = 6
LEAST_BITS = 64
FLUSH_SIGNATURES = 2_000_000  # that a task holds at once
RANGE_BYTES = 16 << 20  # of text behind one range of hashes
SAMPLE_BYTES = 64 << 20  # of text, from which the common shingles are told
COMMON_FROM, COMMON_MOST = 3, 1 << 18  # texts of the sample that hold one; how many at most
_C = mix64(np.arange(101, 105, dtype=np.uint64)) | np.uint64(1)


@lru_cache
def size_classes(percent: int = PERCENT, limit: int = 1 << 40) -> np.ndarray:
    """Least sizes of the classes; sizes below the first link with equal sets only. A set
    links within its class and the next ones to it: each is 100 / percent as large at least."""
    if not 50 <= percent < 100:
        raise ValueError("percent must be from 50 to 99")
    out = [-(-percent // (100 - percent))]
    while out[-1] < limit:
        more = -(-out[-1] * 3 // 2) if percent >= 90 else 0
        out.append(max(more, out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, dtype=np.int64)


def shingle_sets(data: np.ndarray, off: np.ndarray, powers: Powers, words: int = WORDS) -> Iterator[np.ndarray]:
    """Each row's distinct shingles, ascending."""
    start, end, row = word_spans(data, off)
    h = span_hash(data, start, end, powers)
    first = np.searchsorted(row, np.arange(len(off)))
    by = mix64(np.arange(101, 102 + words, dtype=np.uint64)) | np.uint64(1)
    runs = np.zeros(len(h), np.uint64)
    if len(h) >= words:
        full = len(h) - words + 1
        total = h[:full] * by[0]
        for k in range(1, words):
            total += h[k:k + full] * by[k]
        runs[:full] = mix64(total)
    for k in range(len(off) - 1):
        lo, hi = first[k], first[k + 1]
        if hi - lo >= words:
            yield np.unique(runs[lo:hi - words + 1])
        elif hi > lo:
            few = np.append(h[lo:hi], np.uint64(hi - lo)) * by[np.append(np.arange(hi - lo), words)]
            yield mix64(few.sum(keepdims=True))
        else:
            yield np.zeros(0, np.uint64)


def cut(shingles: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, hash) of each of the k segments of an ascending set."""
    at = np.searchsorted(((shingles >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32), np.arange(k + 1, dtype=np.uint64))
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix64(shingles + _C[1]), out=total[1:])
    return np.diff(at), total[at[1:]] - total[at[:-1]]


def signatures(shingles: np.ndarray, percent: int = PERCENT, common: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the segments to show: sets that link have one in common. Shingles in ``common``
    (ascending) are a fragment of their own, which is not shown, while the others fill theirs."""
    n, out, classes = len(shingles), [], size_classes(percent)
    if n < classes[0]:
        return np.zeros(0, np.uint64)
    rare = None
    if common is not None and len(common):
        rare = shingles[common[np.minimum(np.searchsorted(common, shingles), len(common) - 1)] != shingles]
    own = int(np.searchsorted(classes, n, side="right")) - 1
    for c in (own, own + 1) if n * 100 // percent >= classes[own + 1] else (own,):
        most = 2 * int(classes[c + 1] - 1) * (100 - percent) // (100 + percent)
        slack = -(-(most + 1) // (10 if percent >= 90 else 2)) if most >= SLACK_FROM else 0
        k = most + 1 + slack
        salt = np.arange(k, dtype=np.uint64) * _C[2] + np.array([c], np.uint64) * _C[3]
        if rare is not None:
            # the same pigeonholes without the common shingles; sets that have only segments in
            # common here that are not shown both go on to the cuts of whole sets
            size, h = cut(rare, k)
            floor = SMALL if most < SLACK_FROM else 1
            least = next((x for x in range(SMALL, floor - 1, -1) if int((size < x).sum()) <= slack), 0)
            out.append(mix64(h + salt + _C[1])[size >= (least or floor)])
            if least:
                continue
        size, h = cut(shingles, k)
        sign = mix64(h + salt)
        if most < SLACK_FROM:
            small = size < SMALL
            out.append(sign[~small])
            if small.any():
                again = np.sort(mix64(shingles ^ _C[0]))
                _, h2 = cut(again, most + 1)
                second = h2 + np.arange(most + 1, dtype=np.uint64) * _C[0]
                out.append(mix64(sign[small][:, None] * _C[1] + second[None, :]).ravel())
            continue
        for turn in range(1, CUTS + 1):
            least = next((x for x in range(SMALL, 0, -1) if int((size < x).sum()) <= slack), 0)
            out.append(sign[size >= (least or (1 if turn < CUTS else 0))])
            if least or turn == CUTS:
                break
            size, h = cut(np.sort(mix64(shingles ^ (_C[0] * np.uint64(2 * turn + 1)))), k)
            sign = mix64(h + salt + _C[1] * np.uint64(turn))
    return np.unique(np.concatenate(out))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


SHOWN = "kind int, node long, doc_id long, n long, f1 long, f2 long, bitmap binary, range int, hashes binary, owners binary"
SET, TIE, LIST = range(3)  # kinds of rows: a document's set; two nodes (node, doc_id); a packed list


def pack_hashes(h: np.ndarray) -> bytes:
    """Ascending numbers: the first, then the steps as planes of bytes, lowest first."""
    steps = np.diff(h)
    wide = (int(steps.max(initial=0)).bit_length() + 7) // 8
    return h[:1].astype("<u8").tobytes() + bytes([wide]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8).T[:wide].tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    wide, planes = data[8], np.frombuffer(data, np.uint8, offset=9)
    n = len(planes) // wide if wide else 0
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :wide] = planes.reshape(wide, n).T
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", count=1), steps.view("<u8").ravel()]), dtype=np.uint64)


def bitmap(shingles: np.ndarray) -> bytes:
    """Which fragments of the order hold one of the set's shingles: 2 to 4 fragments a shingle."""
    power = max(LEAST_BITS.bit_length() - 1, (2 * len(shingles)).bit_length())
    bits = np.zeros(1 << power, np.uint8)
    bits[(shingles >> np.uint64(64 - power)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def unfold(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 0 and 1, of the least width among them (fragments of finer cuts are joined)."""
    width = min(map(len, maps))
    out = np.zeros((len(maps), width * 8), np.uint8)
    for k, m in enumerate(maps):
        out[k] = np.unpackbits(np.frombuffer(m, np.uint8)).reshape(width * 8, -1).max(axis=1)
    return out


def _least_owner(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes ascending, the least owner of each, distinct (owner, least) of the others)."""
    order = np.argsort(h, kind="stable")
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(first):
        return h, owner, np.zeros((0, 2), np.int64)
    least = np.minimum.reduceat(owner, first)
    size = np.diff(np.append(first, len(h)))
    many = np.repeat(size > 1, size)
    ties = np.column_stack([owner[many], np.repeat(least, size)[many]]).astype(np.int64)
    ties = np.unique(ties[ties[:, 0] != ties[:, 1]], axis=0)
    return h[first], least, ties


def _empty(kind: int, count: int) -> dict:
    nulls = lambda t: pa.nulls(count, t)
    return {"kind": pa.array(np.full(count, kind, np.int32)), "node": nulls(pa.int64()), "doc_id": nulls(pa.int64()), "n": nulls(pa.int64()),
            "f1": nulls(pa.int64()), "f2": nulls(pa.int64()), "bitmap": nulls(pa.binary()), "range": nulls(pa.int32()), "hashes": nulls(pa.binary()), "owners": nulls(pa.binary())}


def _common(numbered: DataFrame, words: int, volume: int) -> np.ndarray:
    """Shingles that several texts of a sample hold, ascending: a bounded choice, by which the order
    of shingles is cut. Any choice gives the same links; a good one ties fewer sets to strangers."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for b in pieces(batches, "text", 1 << 20):
            for s in shingle_sets(*flat(b.column("text")), powers, words):
                whole = mix64(s).sum(dtype=np.uint64)
                if whole not in seen:  # equal sets of a task count once
                    seen.add(whole)
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["h"])
    every = max(1, math.ceil(volume / SAMPLE_BYTES))
    held = numbered.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(brief(kernel), "h long")
    held = held.groupBy("h").count().where(F.col("count") >= COMMON_FROM)
    rows = held.orderBy(F.desc("count"), "h").limit(COMMON_MOST).select("h").toArrow()  # at most COMMON_MOST numbers
    return np.sort(np.asarray(rows["h"].combine_chunks()).view(np.uint64))


def _describe(words: int, percent: int, ranges: int, bits: int, common: np.ndarray):
    """Rows of SHOWN. A node is a document's place: partition, flush and number there; the
    owners of a packed list are numbers of its flush, and its node is that of number 0."""
    def flush(held: list, base: int) -> Iterator[pa.RecordBatch]:
        held = [(k, s) for k, s in held if len(s)]  # short sets show nothing
        if not held:
            return
        owner = np.repeat(np.array([k for k, _ in held], np.int64), [len(s) for _, s in held])
        h, owner, ties = _least_owner(np.concatenate([s for _, s in held]) >> np.uint64(64 - bits), owner)
        yield pa.RecordBatch.from_pydict({**_empty(TIE, len(ties)), "node": pa.array(ties[:, 0] + base), "doc_id": pa.array(ties[:, 1] + base)})
        of = ((h >> np.uint64(max(bits - 32, 0))) * np.uint64(ranges) >> np.uint64(min(bits, 32))).astype(np.int64)
        cuts = np.append(np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of))
        wide = "<u2" if int(owner.max()) < 1 << 16 else "<u4"
        for lo in range(0, len(cuts) - 1, 256):
            some = [slice(a, b) for a, b in zip(cuts[lo:lo + 256], cuts[lo + 1:lo + 257])]
            yield pa.RecordBatch.from_pydict({
                **_empty(LIST, len(some)), "node": pa.array(np.full(len(some), base)), "range": pa.array([int(of[x.start]) for x in some], pa.int32()),
                "hashes": pa.array([pack_hashes(h[x]) for x in some], pa.binary()), "owners": pa.array([owner[x].astype(wide).tobytes() for x in some], pa.binary())})

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        base, held, number, total, seen = TaskContext.get().partitionId() << 40, [], 0, 0, set()
        for b in pieces(batches, "text", 1 << 20):
            size, f1, f2, maps = [], [], [], []
            for s in shingle_sets(*flat(b.column("text")), powers, words):
                size.append(len(s))
                maps.append(bitmap(s))
                f1.append(mix64(s).sum(dtype=np.uint64))
                f2.append(mix64(s ^ _C[3]).sum(dtype=np.uint64))
                if len(s) and (f1[-1], f2[-1]) not in seen:  # equal sets show their segments once
                    seen.add((f1[-1], f2[-1]))
                    held.append((number + len(size) - 1, signatures(s, percent, common)))
                    total += len(held[-1][1])
            yield pa.RecordBatch.from_pydict({
                **_empty(SET, b.num_rows), "node": pa.array(base + number + np.arange(b.num_rows)), "doc_id": b.column("doc_id"), "n": pa.array(size, pa.int64()), "bitmap": pa.array(maps, pa.binary()),
                **{c: pa.array(np.array(x, np.uint64).view(np.int64)) for c, x in (("f1", f1), ("f2", f2))}})
            number += b.num_rows
            if total >= FLUSH_SIGNATURES or number >= 1 << 23:
                yield from flush(held, base)
                base, held, number, total, seen = base + (1 << 24), [], 0, 0, set()
        yield from flush(held, base)
    return kernel


def _merge(group: pa.Table) -> pa.Table:
    """Ties of the nodes that show the same hash, from the packed lists of one range."""
    lists = [unpack_hashes(x) for x in group.column("hashes").to_pylist()]
    owners = [np.frombuffer(x, "<u2" if len(x) == 2 * len(h) else "<u4").astype(np.int64) + base
              for x, h, base in zip(group.column("owners").to_pylist(), lists, group.column("node").to_pylist())]
    _, _, ties = _least_owner(np.concatenate(lists), np.concatenate(owners))
    return pa.table({"a": pa.array(ties[:, 0]), "b": pa.array(ties[:, 1])})


def _met(seen: DataFrame) -> DataFrame:
    """Ties of nodes, each once: copies meet in every range, and with the corpus the ranges grow too."""
    merged = (seen.where(F.col("kind") == LIST).select("range", "node", "hashes", "owners")
              .groupBy("range").applyInArrow(_merge, "a long, b long"))
    return merged.union(seen.where(F.col("kind") == TIE).select("node", "doc_id")).distinct()


def _gather(wanted: bytes, words: int):
    """The texts of the wanted ids, with the sums of their sets."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, bits = Powers(), np.frombuffer(wanted, np.uint8)
        for b in pieces(batches, "text", 1 << 20):
            at = mix64(np.asarray(b.column("doc_id")).view(np.uint64)) % np.uint64(FILTER_BITS)
            b = b.filter(pa.array((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1))
            if not b.num_rows:
                continue
            f1 = [mix64(s).sum(dtype=np.uint64) for s in shingle_sets(*flat(b.column("text")), powers, words)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(f1, np.uint64).view(np.int64)), b.column("text")],
                                             names=["doc_id", "f1", "text"])
    return kernel


def id_filter(ids: DataFrame) -> bytes:
    """A bitmap of hashed ids: of a fixed size, so it may miss nothing and pass too much."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(mix64(np.asarray(b.column("doc_id")).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])
    bits = (ids.select("doc_id").mapInArrow(kernel, "at long")
            .groupBy(F.expr("bitmap_bucket_number(at + 1)").alias("no")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at + 1))").alias("bits")))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in bits.toLocalIterator():  # at most FILTER_BITS / 32768 rows of 4 KB
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["no"] - 1) * 4096:(r["no"] - 1) * 4096 + len(part)] = part
    return out.tobytes()


def block_links(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id that it reaches by links) for the linked sets of one block: overlaps
    are counted in each fragment of the shingle order and summed."""
    m = len(ids)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    values, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen > 1
    column = np.cumsum(shared) - 1
    keep = shared[place]
    owner, column = owner[keep], column[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    overlap = np.zeros((m, m), np.float32)
    total = int(shared.sum())
    for lo in range(0, total, FRAGMENT_COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + FRAGMENT_COLUMNS])
        rows, local = np.unique(owner[a:b], return_inverse=True)
        part = np.zeros((len(rows), min(FRAGMENT_COLUMNS, total - lo)), np.float32)
        part[local, column[a:b] - lo] = 1
        overlap[np.ix_(rows, rows)] += part @ part.T
    both = overlap.astype(np.int64)
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    return least_reached(ids, linked)


def least_reached(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id that it reaches) from a matrix of links."""
    m = len(ids)
    label = np.arange(m)[np.argsort(np.argsort(ids, kind="stable"), kind="stable")]
    rank = label.copy()
    while True:
        new = np.where(linked, label[None, :], m).min(axis=1)
        new = np.minimum(new, label)
        if (new == label).all():
            break
        label = new
    by_rank = np.empty(m, ids.dtype)
    by_rank[rank] = ids
    moved = label != rank
    return ids[moved], by_rank[label[moved]]


def differing_bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of x and rows of y differ, from their common bits in each fragment."""
    common = np.zeros((len(x), len(y)), np.float32)
    for lo in range(0, x.shape[1], FRAGMENT_COLUMNS):
        common += x[:, lo:lo + FRAGMENT_COLUMNS].astype(np.float32) @ y[:, lo:lo + FRAGMENT_COLUMNS].astype(np.float32).T
    return x.sum(axis=1, dtype=np.int64)[:, None] + y.sum(axis=1, dtype=np.int64)[None, :] - 2 * common.astype(np.int64)


def _near(percent: int):
    """Possible links of a pair of blocks, by the sets' bitmaps and sizes."""
    def kernel(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, n, mine = (np.asarray(group[c].combine_chunks()) for c in ("doc_id", "n", "mine"))
        bits = unfold(group["bitmap"].to_pylist())
        left = np.flatnonzero(mine == group["one"][0].as_py())
        right = np.flatnonzero(mine == group["two"][0].as_py())
        small, both = np.minimum(n[left][:, None], n[right][None, :]), n[left][:, None] + n[right][None, :]
        near = differing_bits(bits[left], bits[right]) <= both + 2 * (-percent * both // (100 + percent))
        near &= 100 * small >= percent * (both - small)
        linked = np.eye(len(ids), dtype=bool)
        linked[np.ix_(left, right)] |= near
        linked |= linked.T
        a, b = least_reached(ids, linked)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return kernel


def _links(words: int, percent: int):
    def kernel(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        sets = list(shingle_sets(*flat(group["text"]), Powers(), words))
        a, b = block_links(np.asarray(group["doc_id"]), sets, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return kernel


def _blocks(members: DataFrame, percent: int, by_bitmap: bool = False) -> DataFrame:
    """Members (rep, f1, n, root, further columns) to blocks (root, band, one, two): a whole
    cluster; if too large, documents of neighbouring sizes; and if still too large, every
    pair of blocks.  By bitmaps sizes are always neighbouring, blocks are bounded by documents
    only, and a block also meets itself."""
    some = F.ceil(F.count("*") / BLOCK_DOCS) if by_bitmap else F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS))
    sized = members.groupBy("root").agg(some.cast("int").alias("blocks"))
    band = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) + 0.01)).cast("int")  # links reach the next band at most
    apart = F.lit(True) if by_bitmap else F.col("blocks") > 1
    spread = members.join(sized, "root").withColumn("band", F.explode(F.when(apart, F.array(band, band - 1)).otherwise(F.array(F.lit(-2)))))
    again = spread.groupBy("root", "band").agg(some.cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    return (spread.drop("blocks").join(again, ["root", "band"]).withColumn("mine", block)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .where(F.lit(by_bitmap) | F.expr("blocks = 1 or other <> mine"))
            .withColumn("one", F.least("mine", "other")).withColumn("two", F.greatest("mine", "other"))
            .withColumnRenamed("rep", "doc_id").drop("other", "blocks"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    numbered = _numbered(docs)
    volume = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    ranges = max(1, math.ceil(volume / RANGE_BYTES))
    # chance meetings of cut hashes stay few at any size (and would only join clusters)
    bits = max(32, min(64, 2 * math.ceil(math.log2(volume / 8 + 2)) - 8))
    common = _common(numbered, words, volume)
    seen = stored(numbered.mapInArrow(brief(_describe(words, percent, ranges, bits, common)), SHOWN), "sets")
    rows = seen.where(F.col("kind") == SET).select("node", "doc_id", "n", "f1", "f2", "bitmap")
    key = ["f1", "f2", "n"]
    classes = stored(rows.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min("bitmap").alias("bitmap")), "classes")
    rows = rows.drop("bitmap")
    met = _met(seen)
    of = lambda c: rows.select(F.col("node").alias(c), F.col("f1").alias(f"f_{c}"))
    ties = met.join(of("a"), "a").join(of("b"), "b").where("f_a <> f_b").select("f_a", "f_b").distinct()
    clusters = components(ties)
    tied = stored(classes.join(clusters, classes["f1"] == clusters["node"]).select("rep", "f1", "n", "bitmap", "root"), "tied")
    # numbered partitions are not merged where rows are few: comparing costs more than they weigh
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = (_blocks(tied, percent, True).select("root", "band", "one", "two", "doc_id", "n", "mine", "bitmap")
            .repartition(parts, "root", "band", "one", "two").groupBy("root", "band", "one", "two").applyInArrow(brief_group(_near(percent)), "a long, b long"))
    parted = components(near).withColumnRenamed("node", "rep")
    members = stored(tied.drop("root", "bitmap").join(parted, "rep"), "members")
    wanted = id_filter(members.select(F.col("rep").alias("doc_id")))
    texts = numbered.mapInArrow(brief(_gather(wanted, words)), "doc_id long, f1 long, text string").dropDuplicates(["doc_id", "f1"])
    links = (texts.join(_blocks(members, percent), ["doc_id", "f1"]).select("root", "band", "one", "two", "doc_id", "text")
             .groupBy("root", "band", "one", "two").applyInArrow(brief_group(_links(words, percent)), "a long, b long"))
    linked = components(links).withColumnRenamed("node", "rep")
    tops = classes.drop("bitmap").join(linked, "rep", "left").select(*(F.col(c).alias(f"of_{c}") for c in key), F.coalesce("root", "rep").alias("top"))
    out = rows.join(tops, [F.col(c) == F.col(f"of_{c}") for c in key], "left")
    real = lambda c: F.when(c != LAST_ID, c)
    return out.select(real(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                      real(F.coalesce("top", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, with their columns."""
    number, kept = own("id", "keep")
    keep = jaccard_components(docs, words, percent).where("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias(kept)).distinct()
    return (docs.withColumn(number, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
            .join(keep, F.col(number) == F.col(kept), "left_semi").drop(number))
