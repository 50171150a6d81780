"""The audit against plain counting over whole texts, and its defined cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from tmaps.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=50):
    docs, held = defaultdict(Counter), {}
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        docs[lang].update(set(terms))
        held.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang in docs.keys() | {g[0] for g in held}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: Counter({t: n for t, n in c.items() if t in set(kept)}) for (x, s), c in held.items() if x == lang}

        def share(counts):
            total = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // total for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            own = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", own, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[:most], 1)]
    return sorted(out)


def got(spark, rows, least, schema=SCHEMA, **more):
    return sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, schema), least, **more).collect())


def made(n, seed=3):
    rng = random.Random(seed)
    words = ["the", "The,", "THE.", "a-b-a", "naïve", "Ünder_line", "x1y2x", "12", "İs", "ﬁ", "é", " nb ", "--", "z@q"]
    words += [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for k in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "\n", "\t\r", "\x0b", "\x0c", "\x1f", "  "]) for _ in range(rng.randint(0, 30)))
        rows.append((k, rng.choice([text] * 8 + [None, ""]), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "ç", None, ""]), 0))
    return rows


def test_against_plain_counting(spark, monkeypatch):
    rows = made(240)
    rows += rows[:40]  # repeated rows are documents too
    rows += [(900, "alone", "fr", "a", 1), (901, None, "fr", "b", 1), (902, "1 2 3", "only", "s", 1)]
    want = brute(rows, 9)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] for r in want if r[2] == "pair")
    assert got(spark, rows, 9) == want
    monkeypatch.setattr(divergence, "BATCH_BYTES", 200)  # many batches
    monkeypatch.setattr(divergence, "KNOWN_ROWS", 20)
    assert got(spark, rows, 9) == want
    assert got(spark, rows, 9, top=2) == brute(rows, 9, 2)


def test_languages_without_kept_terms(spark):
    rows = [(1, "a b", "en", "x", 1), (2, "c", "en", "y", 1), (3, "c", "en", None, 1)]
    assert got(spark, rows, 30) == brute(rows, 30)
    assert [r[4] for r in got(spark, rows, 30)] == [0] * 6


def test_long_texts_ties_and_clashing_columns(spark):
    rows = [(1, "x" * 300_000 + "," + "y, " * 100_000, "en", "s", 1), (1, "y x", "en", "t", 1), (None, "b a c", "en", "u", 1), (4, "c b a", "en", "u", 1)]
    assert got(spark, rows, 1) == brute(rows, 1)
    more = [r + (1, "x", 2, 3) for r in rows]
    assert got(spark, more, 1, SCHEMA + ", n int, term string, batch int, chunks int") == brute(rows, 1)


def test_shares_past_64_bits(spark):
    from pyspark.sql import functions as F
    n = 20_000_000_000
    df = spark.createDataFrame([(n, 3 * n, 7)], "n long, n_all long, v long").select(divergence._share(F.col("n")).alias("p"))
    assert df.first()["p"] == 1 + 1_000_000_000 * (n + 5) // (3 * n + 35)


def test_posting_lists_come_back():
    chunks, many, doc, times = divergence.chunk_counts(pa.array(["a b a", "", "b", " a  c "]))
    spread = {c: [] for c in chunks.to_pylist()}
    for c, d, n in zip(np.repeat(np.array(chunks.to_pylist(), object), many), doc, times):
        spread[c].append((d, n))
    spread.pop("", None)
    assert spread == {"a": [(0, 2), (3, 1)], "b": [(0, 1), (2, 1)], "c": [(3, 1)]}
    assert (divergence._unpack(divergence._pack(doc)) == doc).all()


def test_tokens_are_those_of_the_pattern():
    rng = random.Random(8)
    chunks = ["", "a", "-", "A-b", "é", "x\x00y", "ÀÉ@ß`z{"] + ["".join(chr(rng.choice([rng.randrange(128), rng.randrange(0x80, 0x2FF)])) for _ in range(rng.randint(0, 12)))
                                                                for _ in range(300)]
    row, terms = divergence.tokenize(pa.array(chunks))
    want = [(k, t) for k, c in enumerate(chunks) for t in TERM.findall(c.translate(LOWER))]
    assert list(zip(row.tolist(), terms.to_pylist())) == want


def test_empty_table(spark):
    assert got(spark, [], 1) == []


def test_a_batch_is_counted_in_parts(monkeypatch):
    """A batch's documents are counted some at a time, whatever their number (before: all at once)."""
    import numpy as np
    import pyarrow as pa

    from tmaps.llm import divergence
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a-b", "b", "c", "ddd", "x1y", "7"], rng.integers(0, 9))) for _ in range(90)]
    langs, sources = rng.choice(["de", "en"], 90).tolist(), rng.choice(["p", "q", "r"], 90).tolist()
    chunks, many, doc, times = divergence.chunk_counts(pa.array(texts))
    steps = doc.copy()
    steps[1:] -= doc[:-1]
    first = (np.cumsum(many) - many)[many > 0]
    steps[first] = doc[first]
    batch = pa.table({"langs": [langs], "sources": [sources], **{c: pa.array([divergence._pack(x)], pa.binary()) for c, x in (("many", many), ("steps", steps), ("times", times))}})
    known = pa.Table.from_batches([divergence._pack_terms(pa.table({"of": np.zeros(len(chunks), np.int64), "pos": np.arange(len(chunks), dtype=np.int32), "chunk": chunks}))])
    want = {}
    for text, lang, source in zip(texts, langs, sources):
        words = [w for chunk in text.split() for w in divergence.tokenize(pa.array([chunk]))[1].to_pylist()]
        for w in set(words):
            n, by = want.setdefault((lang, w), (0, {}))
            want[lang, w] = n + 1, {**by, source: by.get(source, 0) + words.count(w)}
    largest, sums = [], divergence._sums
    monkeypatch.setattr(divergence, "_sums", lambda key, values: largest.append(len(key)) or sums(key, values))
    monkeypatch.setattr(divergence, "POSTINGS", 30, raising=False)
    got = {(r["lang"], r["term"]): (r["docs"], dict(zip(r["sources"], r["counts"]))) for r in divergence._aggregate(batch, known).to_pylist()}
    assert got == want
    assert max(largest[:-2]) <= 60  # the last two sum what the parts have


def test_many_sources_and_terms_in_small_groups(spark, monkeypatch):
    """Blocks of sources and buckets of terms, some of them without a term or a source."""
    monkeypatch.setattr(divergence, "GROUP_TERMS", 3)
    monkeypatch.setattr(divergence, "GROUP_SOURCES", 2)
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choices("abcdefghij"[:4 + k % 7], k=6)), rng.choice(["en", "de"]), f"s{k % 9}", 0) for k in range(90)]
    rows += [(100, None, "en", "without", 0), (101, "zz", "de", "rare", 0), (102, None, "fr", "alone", 0), (103, "", "it", "x", 0), (104, "q", "it", None, 0)]
    assert got(spark, rows, 4) == brute(rows, 4)


def test_pairs_of_sources_are_summed_in_their_groups(spark):
    """A group gives one row for two sources (before: a join gave one for every term that they share)."""
    found = divergence._gaps((pa.scalar("en"), pa.scalar(0), pa.scalar(0), pa.scalar(0)),
                             pa.table({"source": ["x", "y", "z"] + ["x"] * 50 + ["y"] * 50, "blk": pa.array([0] * 103, pa.int32()),
                                       "term": [None] * 3 + [f"t{k}" for k in range(50)] * 2, "p": [1, 2, 4] + [7] * 50 + [9] * 50})).to_pylist()
    assert [(r["a"], r["b"], r["gap"] + 50 * r["apart"]) for r in found] == [("x", "y", 100), ("x", "z", 150), ("y", "z", 250)]
    rows = [(k, " ".join("t" + chr(97 + i) + chr(97 + j) for i in range(10) for j in range(10)), "en", f"s{k % 6}", 0) for k in range(12)]
    shares = spark.createDataFrame([("en", s, f"t{k}", 3) for s in "xyz" for k in range(40)], "lang string, source string, term string, p long")
    groups = spark.createDataFrame([("en", s, 40, 1) for s in "xyz"], "lang string, source string, v long, z long")
    assert {tuple(r) for r in divergence.source_gaps(shares, groups).select("a", "b", "value").collect()} == {(a, b, 0) for a in "xyz" for b in "xyz" if a != b}
    assert got(spark, rows, 1) == brute(rows, 1)


def test_rare_terms_share_packed_rows():
    """A batch gives a row for a bucket and language (before: one with lists of its own for every term), and its sums are those of the rows."""
    rng = random.Random(11)
    rows = [{"lang": rng.choice(["en", "de", ""]), "term": f"t{k}é", "docs": rng.randint(1, 9), "sources": rng.sample(["a", "", "ç", "d"], n := rng.randint(1, 4)), "counts": [rng.randint(1, 2**31 - 9) for _ in range(n)]}
            for k in range(600)]
    rows += [{**r, "docs": r["docs"] + 1, "lang": "en", "sources": ["new"], "counts": [5]} for r in rows[:90]]
    schema = pa.schema({"lang": pa.string(), "term": pa.string(), "docs": pa.int64(), "sources": pa.list_(pa.string()), "counts": pa.list_(pa.int64())})
    parts = [divergence._pack_counts(pa.Table.from_pylist(x, schema), 16) for x in (rows[:300], rows[300:], [])]
    assert [p.num_rows <= 16 * 3 for p in parts] == [True] * 3 and parts[2].num_rows == 0 and parts[2].schema == parts[0].schema
    docs, held = Counter(), Counter()
    for r in rows:
        docs[r["lang"], r["term"]] += r["docs"]
        for s, n in zip(r["sources"], r["counts"]):
            held[r["lang"], r["term"], s] += n
    whole, found = pa.concat_tables(parts), []
    for k in set(whole.column("bucket").to_pylist()):
        found += divergence._sum_counts(6)(whole.filter(pa.compute.equal(whole.column("bucket"), k))).to_pylist()
    kept = {k for k, n in docs.items() if n >= 6}
    assert {(r["lang"], r["term"], r["source"]): r["n"] for r in found} == {k: n for k, n in held.items() if k[:2] in kept} and len(found) == len({k for k in held if k[:2] in kept})
    assert all(r["n_term"] == sum(n for k, n in held.items() if k[:2] == (r["lang"], r["term"])) for r in found)
