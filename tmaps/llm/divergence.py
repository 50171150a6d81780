"""Source divergence audit by chunk factorization.

How far apart are the sources of a language in the words that they use? Terms are runs of
letters; nearly all text is made of few distinct chunks between white space, so chunks are
tokenized, not texts.

1. Count. A batch of documents (about ``BATCH_BYTES`` of text) becomes its distinct chunks and,
   for each, the documents that hold it and how often: posting lists, some bytes a chunk of a
   document.
2. Tokenize. (batch, chunk) pairs are sorted by chunk, so equal chunks of all batches stand
   together, and each distinct chunk is tokenized once. No posting moves for it, and even the
   commonest chunk is one row a batch.
3. Join back. The terms return to the batches of their chunks, packed by batch.
4. Aggregate. A batch meets the terms of its chunks and counts, for each language and term,
   distinct documents (through whichever chunks) and, by source, occurrences.
5. Sum. The terms of a batch are dealt into buckets by a hash and packed, a row for each language
   and bucket: most terms are rare, and a row of its own would weigh many times a term's counts.
   A bucket's rows meet and are summed by term; terms in at least ``LEAST_DOCS`` documents of a
   language are kept.

A group's distribution over the kept terms V of its language is smoothed and scaled to
integers: p = 1 + floor(SCALE * (count + 5) / (N + 5 V)). Two sources differ by the sum of
|p - q| over V; a source's own terms are those with p above the language's q.

A language's terms are dealt into buckets and its sources into blocks. A group is a bucket and a
pair of blocks: it holds each of its sources with z, the value of a count of 0, and the values of
the terms that occur there, and sums |p - q| for every two of them. What occurs in neither block
differs by |z - z'| a term, so with m the group's terms,

    f = V |z - z'| + sum over groups of (sum over the m terms of |p - q| - m |z - z'|).

A group gives one row for two sources, whatever terms they share.

Defined cases: null text, lang and source are empty ones; every row is a document, also one
that repeats an id or a text; groups without terms, languages without kept terms (all f are
0) and sources alone in their language (no pairs) are there; equal values rank by the item's
bytes; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tmaps.llm.common import Powers, flat, pieces, span_hash, stored
from tmaps.session import drop_table, scratch_path

# bytes of terms: letters, lower-cased, and those of characters past ASCII; 0 for the others
_LETTER = np.zeros(256, np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[ord("a"):ord("z") + 1] = _LETTER[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
BATCH_BYTES = 24 << 20
LEAST_DOCS = 30
SCALE, ADDED = 1_000_000_000, 5
TOP_TERMS = 50
BATCH = "batch long, langs array<string>, sources array<string>, chunks array<string>, many binary, steps binary, times binary"
KNOWN = "of long, pos array<int>, many array<int>, terms string"
POSTINGS = 400_000  # of a batch that are counted at once
KNOWN_ROWS = 400_000  # that a task packs at once
GROUP_TERMS, GROUP_SOURCES = 512, 128  # of a bucket of terms and of a block of sources, about
GAPS = "lang string, a string, b string, gap long, apart long"
BUCKETS = 4096  # of terms to be summed, at least
HASHED = 1 << 16  # terms at once
COUNTED = "bucket int, lang string, terms string, docs array<int>, many array<int>, sources array<string>, places array<int>, counts array<int>"
SUMMED = "lang string, source string, term string, n long, n_term long"


def _pack(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype("<u4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)


def chunk_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct chunks, documents of each, those documents ascending, occurrences there)."""
    words = pc.ascii_split_whitespace(texts)
    size = np.diff(np.asarray(words.offsets))
    coded = words.flatten().dictionary_encode()
    del words  # a batch's words weigh more than what is kept of them
    chunks, key, n = coded.dictionary, np.asarray(coded.indices).astype(np.int64), max(len(texts), 1)
    del coded
    key *= n
    key += np.repeat(np.arange(len(texts)), size)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(key)))
    code, doc = np.divmod(key[first], n)
    return chunks, np.bincount(code, minlength=len(chunks)), doc, times


def _counted(b: pa.RecordBatch, number: int) -> pa.RecordBatch:
    chunks, many, doc, times = chunk_counts(b.column("text"))
    steps = doc.copy()
    steps[1:] -= doc[:-1]
    first = (np.cumsum(many) - many)[many > 0]
    steps[first] = doc[first]
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (b.column("lang"), b.column("source"), chunks)]
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), *one, *(pa.array([_pack(x)], pa.binary()) for x in (many, steps, times))],
        names=["batch", "langs", "sources", "chunks", "many", "steps", "times"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for b in pieces(batches, "text", BATCH_BYTES):
        yield _counted(b, number)
        pa.default_memory_pool().release_unused()
        number += 1


def tokenize(chunks: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(chunk of each term, the terms): runs of letters and of characters past ASCII."""
    data, off = flat(chunks)
    lower = _LETTER[data[off[0]:off[-1]]]
    inside = lower > 0
    first, cuts = inside.copy(), off - off[0]
    first[1:] &= ~inside[:-1]
    at = cuts[:-1][cuts[:-1] < len(lower)]
    first[at] = inside[at]
    start = np.flatnonzero(first)
    ends = np.append(np.cumsum(inside)[start] - 1, int(inside.sum())).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.tobytes()), pa.py_buffer(lower[inside].tobytes()))
    return np.searchsorted(cuts, start, side="right") - 1, terms


def _pack_terms(rows: pa.Table) -> pa.RecordBatch:
    """The terms of some chunks, by batch: places, terms at each and the terms, set off by spaces."""
    code, distinct = _codes(rows.column("chunk").combine_chunks())
    chunk, terms = tokenize(distinct)
    size = np.bincount(chunk, minlength=len(distinct))
    begin = np.cumsum(size) - size
    of, pos = rows.column("of").to_numpy(), rows.column("pos").to_numpy()
    order = np.argsort(of, kind="stable")
    order = order[size[code[order]] > 0]
    of, pos, code = of[order], pos[order], code[order]
    more = size[code]
    ends = np.cumsum(more)
    each = np.repeat(begin[code] - (ends - more), more) + np.arange(int(more.sum()))
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
    cuts = np.append(first, len(of))
    lists = lambda at, values: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    return pa.RecordBatch.from_arrays(
        [pa.array(of[first]), lists(cuts, pa.array(pos)), lists(cuts, pa.array(more.astype(np.int32))),
         pc.binary_join(lists(np.append(0, ends)[cuts], terms.take(pa.array(each))), " ")], names=["of", "pos", "many", "terms"])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, count = [], 0
    for b in batches:
        held.append(b)
        count += b.num_rows
        if count >= KNOWN_ROWS:
            yield _pack_terms(pa.Table.from_batches(held))
            held, count = [], 0
    if count:
        yield _pack_terms(pa.Table.from_batches(held))


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


def _sums(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(values[order], first) if len(first) else np.zeros(0, np.int64)


def _aggregate(batch: pa.Table, known: pa.Table) -> pa.Table:
    """Documents and occurrences of every (lang, term) of one batch."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, known.num_rows], pa.int32()), known.column("terms").combine_chunks()), " ")
    term, terms = _codes(pc.split_pattern(joined, " ").flatten())
    if not known.num_rows:  # no term at all: splitting gave an empty one
        term, terms = term[:0], terms[:0]
    place, size = (known.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("pos", "many"))
    # the terms of each chunk, by the chunk's place
    many = _unpack(batch.column("many")[0].as_py())
    held = np.zeros(len(many), np.int64)
    held[place] = size
    begin = np.zeros(len(many), np.int64)
    begin[place] = np.cumsum(size) - size
    run = np.cumsum(_unpack(batch.column("steps")[0].as_py()))
    times = _unpack(batch.column("times")[0].as_py()).astype(np.int32)
    first = np.cumsum(many) - many
    before = np.where(first > 0, run[np.maximum(first - 1, 0)], 0) if len(run) else first
    doc = (run - np.repeat(before, many)).astype(np.int32)
    chunk = np.repeat(np.arange(len(many), dtype=np.int32), many)
    del run
    (lang, langs), (source, sources) = (_codes(batch.column(c).combine_chunks().flatten()) for c in ("langs", "sources"))
    width, wide = max(len(terms), 1), max(len(sources), 1)
    found = []
    # a posting for each term of its chunk, some documents at a time: work space does not grow with the batch
    parts = max(1, -(-len(doc) // POSTINGS))
    of_part = doc.astype(np.int64) * parts // max(len(lang), 1)
    for k in range(parts):
        some = np.flatnonzero(of_part == k)
        more = held[chunk[some]]
        ends = np.cumsum(more)
        of = np.repeat(begin[chunk[some]] - (ends - more), more) + np.arange(int(more.sum()))
        key, n = _sums(np.repeat(doc[some].astype(np.int64), more) * width + term[of], np.repeat(times[some].astype(np.int64), more))
        in_doc, its = np.divmod(key, width)
        kind = lang[in_doc] * width + its
        found.append((*_sums(kind * wide + source[in_doc], n), *_sums(kind, np.ones(len(kind), np.int64))))
    keys, counts, kinds, docs = (np.concatenate(x) for x in zip(*found))
    key, count = _sums(keys, counts)
    group, by = np.divmod(key, wide)
    kinds, docs = _sums(kinds, docs)
    cuts = np.append(np.searchsorted(group, kinds), len(group)).astype(np.int32)
    return pa.table({
        "lang": langs.take(pa.array(kinds // width)), "term": terms.take(pa.array(kinds % width)), "docs": pa.array(docs, pa.int64()),
        "sources": pa.ListArray.from_arrays(pa.array(cuts), sources.take(pa.array(by))),
        "counts": pa.ListArray.from_arrays(pa.array(cuts), pa.array(count, pa.int64()))})


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)


def _bucket(terms: pa.Array, buckets: int) -> np.ndarray:
    powers, out = Powers(), []
    for lo in range(0, len(terms), HASHED):
        data, off = flat(terms[lo:lo + HASHED])
        out.append(span_hash(data, off[:-1], off[1:], powers, lower=False) % np.uint64(buckets))
    return np.concatenate([np.zeros(0, np.uint64), *out]).astype(np.int64)


def _pack_counts(rows: pa.Table, buckets: int) -> pa.Table:
    """Rows (lang, term, docs, sources, counts) of a batch, packed by bucket and language; a source is a place in its row's ``sources``."""
    rows = rows.combine_chunks()
    if not rows.num_rows:
        return pa.table({c: pa.array([], t) for c, t in zip(
            ["bucket", "lang", "terms", "docs", "many", "sources", "places", "counts"],
            [pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())])})
    (lang, langs), terms = _codes(rows.column("lang").combine_chunks()), rows.column("term").combine_chunks()
    key = _bucket(terms, buckets) * len(langs) + lang
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    cuts = np.append(first, len(key))
    # the sources and counts of each term, in the new order
    held = rows.column("sources").combine_chunks()
    begin, size = np.asarray(held.offsets)[:-1][order].astype(np.int64), np.diff(np.asarray(held.offsets))[order].astype(np.int64)
    ends = np.cumsum(size)
    each = np.repeat(begin - (ends - size), size) + np.arange(int(size.sum()))
    source, names = _codes(held.values)
    spread = np.append(0, ends)[cuts]
    row = np.repeat(np.arange(len(first)), np.diff(spread))
    used, place = np.unique(row * max(len(names), 1) + source[each], return_inverse=True)
    of = np.searchsorted(used, np.arange(len(first) + 1) * max(len(names), 1))
    ints = lambda x: pa.array(x.astype(np.int32))  # noqa: E731  a batch's counts are less than its bytes
    return pa.table({
        "bucket": ints(key[first] // len(langs)), "lang": langs.take(pa.array(key[first] % len(langs))),
        "terms": pc.binary_join(_lists(cuts, terms.take(pa.array(order))), " "),
        "docs": _lists(cuts, ints(rows.column("docs").to_numpy()[order])), "many": _lists(cuts, ints(size)),
        "sources": _lists(of, names.take(pa.array(used % max(len(names), 1)))), "places": _lists(spread, ints(place - of[row])),
        "counts": _lists(spread, ints(rows.column("counts").combine_chunks().values.to_numpy()[each]))})


def _sum_counts(least_docs: int):
    """Of a bucket's packed rows: occurrences by source, and in all, of each term in at least ``least_docs`` documents of its language."""
    def kernel(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        column = lambda c: group.column(c).combine_chunks()
        inside = lambda c: column(c).flatten().to_numpy().astype(np.int64)
        lang, langs = _codes(column("lang"))
        term, terms = _codes(pc.split_pattern(column("terms"), " ").flatten())
        key = np.repeat(lang, pc.list_value_length(column("docs")).to_numpy()) * len(terms) + term
        kinds, docs = _sums(key, inside("docs"))
        kinds = kinds[docs >= least_docs]
        source, sources = _codes(column("sources").flatten())
        names = pc.list_value_length(column("sources")).to_numpy().astype(np.int64)
        base = np.repeat(np.cumsum(names) - names, pc.list_value_length(column("places")).to_numpy())
        kind, source, n = np.repeat(key, inside("many")), source[base + inside("places")], inside("counts")
        some = np.isin(kind, kinds)
        (both, n), (kinds, n_term) = _sums(kind[some] * len(sources) + source[some], n[some]), _sums(kind[some], n[some])
        kind, source = np.divmod(both, len(sources))
        return pa.table({"lang": langs.take(pa.array(kind // len(terms))), "source": sources.take(pa.array(source)), "term": terms.take(pa.array(kind % len(terms))),
                         "n": n, "n_term": n_term[np.searchsorted(kinds, kind)]})
    return kernel


def term_counts(docs: DataFrame) -> DataFrame:
    """Packed (bucket, lang, terms, docs, many, sources, places, counts) of every batch."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    spark = docs.sparkSession
    path = scratch_path(spark, "batches")
    docs.select(text("text"), text("lang"), text("source")).mapInArrow(_count, BATCH).write.parquet(path)
    batches = spark.read.schema(BATCH).parquet(path)
    pairs = batches.select(F.col("batch").alias("of"), F.posexplode("chunks").alias("pos", "chunk"))
    buckets = max(BUCKETS, batches.count())  # a bucket holds no more than about a batch's terms
    packed = lambda batch, known: _pack_counts(_aggregate(batch, known), buckets)
    known = pairs.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_known, KNOWN)
    out = stored(batches.drop("chunks").groupBy("batch").cogroup(known.groupBy("of")).applyInArrow(packed, COUNTED), "terms")
    drop_table(spark, path)  # the batches are counted
    return out


def _share(count: Column, n_all: str = "n_all") -> Column:
    """p of a count, exactly: products may pass 64 bits."""
    wide = lambda c: c.cast("decimal(38,0)")
    product = (F.lit(SCALE).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)")).cast("decimal(38,0)")
    total = wide(F.col(n_all) + ADDED * F.col("v"))
    return F.call_function("div", product, F.nullif(total, wide(F.lit(0)))) + 1


def _gaps(key: tuple, group: pa.Table) -> pa.Table:
    """Of every two sources of a bucket of terms: the sum of |p - q| - |z - z'| over its terms, and |z - z'|."""
    every = group.filter(pc.is_null(group.column("term")))
    terms = group.filter(pc.is_valid(group.column("term")))
    names = every.column("source").combine_chunks()
    z, blk = every.column("p").to_numpy(), every.column("blk").to_numpy()
    column, distinct = _codes(terms.column("term").combine_chunks())
    value = np.repeat(z[:, None], len(distinct), axis=1)
    value[pc.index_in(terms.column("source").combine_chunks(), names).to_numpy(zero_copy_only=False), column] = terms.column("p").to_numpy()
    one, two = np.flatnonzero(blk == key[2].as_py()), np.flatnonzero(blk == key[3].as_py())
    left, right, gap = [], [], []
    for n, x in enumerate(one):
        others = two[n + 1:] if key[2] == key[3] else two
        left.append(np.full(len(others), x))
        right.append(others)
        gap.append(np.abs(value[others] - value[x]).sum(axis=1))
    left, right, gap = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (left, right, gap))
    apart = np.abs(z[left] - z[right])
    return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "a": names.take(pa.array(left)), "b": names.take(pa.array(right)),
                     "gap": gap - len(distinct) * apart, "apart": apart})


def source_gaps(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): the sum of |p - q| over the kept terms for every two sources of a language, both ways.

    ``shares(lang, source, term, p)`` has the terms that occur, ``groups(lang, source, v, z)`` every source."""
    size = groups.groupBy("lang").agg(F.ceil(F.greatest(F.first("v"), F.lit(1)) / GROUP_TERMS).cast("int").alias("buckets"),
                                      F.ceil(F.count("*") / GROUP_SOURCES).cast("int").alias("blocks"))
    bucket = F.pmod(F.xxhash64("term"), "buckets").cast("int")
    every = (groups.join(size, "lang").select("lang", "source", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"),
                                              F.lit(None).cast("string").alias("term"), F.col("z").alias("p"), "blocks"))
    rows = shares.join(size, "lang").select("lang", "source", bucket.alias("bucket"), "term", "p", "blocks").unionByName(every)
    blk = F.pmod(F.xxhash64("source"), "blocks").cast("int").alias("blk")
    pairs = (rows.select("lang", "source", "bucket", "term", "p", blk, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
             .withColumn("lo", F.least("blk", "o")).withColumn("hi", F.greatest("blk", "o")).drop("o"))
    found = (pairs.groupBy("lang", "bucket", "lo", "hi").applyInArrow(_gaps, GAPS)
             .groupBy("lang", "a", "b").agg(F.sum("gap").alias("gap"), F.max("apart").alias("apart"))
             .join(groups.groupBy("lang").agg(F.first("v").alias("v")), "lang")
             .select("lang", "a", "b", (F.col("gap") + F.col("v") * F.col("apart")).alias("value")))
    return found.select("lang", "value", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair``, ``term``), item, value and rank."""
    counts = stored(term_counts(docs).groupBy("bucket").applyInArrow(_sum_counts(least_docs), SUMMED), "counts")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    v = counts.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("n_all"))
    here = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = stored(docs.select(empty("lang"), empty("source")).distinct().join(v.withColumnRenamed("n_all", "n_lang"), "lang", "left").join(here, ["lang", "source"], "left")
                    .select("lang", "source", zero("v"), zero("n_all"), zero("n_lang")).withColumn("z", F.coalesce(_share(F.lit(0)), F.lit(0)).cast("long")), "groups")
    shares = counts.join(groups, ["lang", "source"]).select("lang", "source", "term", _share(F.col("n")).cast("long").alias("p"),
                                                            _share(F.col("n_term"), "n_lang").cast("long").alias("q"))

    # a source's own terms
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    # pairs of sources of a language
    pairs = (source_gaps(shares, groups).select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
             .withColumn("rank", F.row_number().over(order)))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank")
