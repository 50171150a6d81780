import random
import re

import numpy as np
import pyarrow as pa

from tmaps.llm import ngram_join as J
from tmaps.llm.common import Powers, flat
from tmaps.llm.components import components

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, n = [shingles(t) for _, t in rows], len(rows)
    label = list(range(n))
    links = [[j for j in range(n) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])] for i in range(n)]
    out, seen = [None] * n, set()
    for i in label:
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        seen |= group
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            out[j] = min(ids) if ids else None
    return sorted(((d, len(s), c) for (d, _), s, c in zip(rows, sets, out)), key=repr)


def near_copies(rng, n, first, words=40, vocabulary=400):
    base = ["w%d" % rng.randrange(vocabulary) for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2])):
            w[rng.randrange(len(w))] = "e%d" % rng.randrange(30)
        out.append((first + i, " ".join(w)))
    return out


def test_components_match_brute_force(docs_of, rows_of):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "a b c"), (8, "a b c"),
            (None, "a b c"), (None, "nobody else has this text at all")]
    rows += near_copies(rng, 60, 20) + near_copies(rng, 40, 100, words=200) + near_copies(rng, 40, 200, words=14)
    rows += [(300 + i, " ".join("w%d" % rng.randrange(9) for _ in range(rng.randint(1, 14)))) for i in range(60)]
    rows += [(400, "long " + " ".join(map(str, range(5000)))), (401, " ".join(map(str, range(5000))))]
    assert rows_of(J.jaccard_components(docs_of(rows))) == brute(rows)


def test_blocks_of_a_large_cluster(docs_of, rows_of, monkeypatch):
    rng = random.Random(6)
    rows = near_copies(rng, 90, 1, words=60) + near_copies(rng, 30, 500, words=60)
    monkeypatch.setattr(J, "BLOCK_DOCS", 16)
    assert rows_of(J.jaccard_components(docs_of(rows))) == brute(rows)


def test_many_flushes_and_ranges(docs_of, rows_of, monkeypatch):
    rng = random.Random(12)
    rows = [r for k in range(12) for r in near_copies(rng, 12, 100 * k, words=30 + 10 * k)]
    rows += [(5000 + i, "same text as all of the others of this group have") for i in range(40)]
    rng.shuffle(rows)
    monkeypatch.setattr(J, "FLUSH_SIGNATURES", 100)
    monkeypatch.setattr(J, "RANGE_BYTES", 500)
    assert rows_of(J.jaccard_components(docs_of(rows))) == brute(rows)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 900), dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(0, 60), dtype=np.uint64)]))
        x = J.unfold([J.bitmap(a), J.bitmap(b)])
        apart = int(J.differing_bits(x[:1], x[1:])[0, 0])
        assert apart == (x[0] != x[1]).sum() <= len(np.setxor1d(a, b))
        both, common = len(a) + len(b), len(np.intersect1d(a, b))
        if 100 * common >= 80 * (both - common):
            assert apart <= both + 2 * (-80 * both // 180)
    a, b = (np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2)) for _ in "ab")
    x = J.unfold([J.bitmap(a), J.bitmap(b)])
    assert (x[0] != x[1]).sum() > 2 * 1000 // 9 * 1.5  # sets of nothing in common stand well apart


def test_packed_hashes_come_back():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1 << 63), (2, 1 << 63), (500, 1 << 40), (3, 3), (70_000, 1 << 63)):
        h = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (J.unpack_hashes(J.pack_hashes(h)) == h).all()
    h, least, ties = J._least_owner(np.array([5, 3, 5, 9, 5, 3], np.uint64), np.array([4, 2, 1, 0, 1, 2]))
    assert h.tolist() == [3, 5, 9] and least.tolist() == [2, 1, 0] and ties.tolist() == [[4, 1]]


def test_linked_sets_show_a_common_segment():
    rng, seen = random.Random(8), 0
    for _ in range(1500):
        n = rng.choice([rng.randint(9, 40), rng.randint(9, 400), rng.randint(9, 1500)])
        a = [rng.getrandbits(64) for _ in range(n)]
        gone = rng.randint(0, n // 9)
        b = a[gone:] + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 9 - gone))]
        x, y = set(a), set(b)
        if 100 * len(x & y) >= 90 * len(x | y):
            seen += 1
            assert len(np.intersect1d(*(J.signatures(np.array(sorted(s), np.uint64)) for s in (x, y))))
    assert seen > 500


def runs(text, words):
    w = (text or "").split()
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}


def test_pairs_between_two_thresholds(docs_of):
    """Copies with words added: 0.87 on five words must go at 80 per cent, but stay at 90 on three."""
    rows, rng = [], random.Random(3)
    for p, (n, more) in enumerate([(200, 30), (200, 48), (200, 52), (40, 8), (12, 2), (60, 5), (900, 200)]):
        base = ["p%dw%d" % (p, i) for i in range(n)]
        rows += [(10 * p, " ".join(base)), (10 * p + 1, " ".join(base + ["q%d_%d" % (p, i) for i in range(more)]))]
    kept = {}
    for words, percent in ((5, 80), (3, 90)):
        got = {r.doc_id: r.component_id for r in J.jaccard_components(docs_of(rows), words, percent).collect()}
        for (a, x), (b, y) in zip(rows[::2], rows[1::2]):
            x, y = runs(x, words), runs(y, words)
            assert (got[b] == a) == (100 * len(x & y) >= percent * len(x | y)), (words, a)
        kept[words] = got
    assert kept[5][1] == 0 and kept[3][1] == 1


def test_linked_sets_show_a_common_segment_at_80():
    rng, seen = random.Random(9), 0
    for _ in range(2500):
        n = rng.choice([rng.randint(4, 40), rng.randint(4, 400), rng.randint(4, 1500)])
        a = [rng.getrandbits(64) for _ in range(n)]
        gone = rng.randint(0, n // 4)
        b = a[gone:] + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 4 - gone))]
        x, y = set(a), set(b)
        if 100 * len(x & y) >= 80 * len(x | y):
            seen += 1
            assert len(np.intersect1d(*(J.signatures(np.array(sorted(s), np.uint64), 80) for s in (x, y))))
    assert seen > 500


def test_linked_sets_show_a_common_segment_whatever_is_common():
    rng, seen = random.Random(10), 0
    for _ in range(1500):
        percent, n = rng.choice([80, 90]), rng.choice([rng.randint(9, 40), rng.randint(9, 400), rng.randint(9, 1500)])
        a = [rng.getrandbits(64) for _ in range(n)]
        most = n * (100 - percent) // 100
        gone = rng.randint(0, most)
        b = a[gone:] + [rng.getrandbits(64) for _ in range(rng.randint(0, most - gone))]
        x, y = set(a), set(b)
        common = np.array(sorted(rng.sample(sorted(x | y), rng.randint(1, len(x | y)))), np.uint64)
        if 100 * len(x & y) >= percent * len(x | y):
            seen += 1
            assert len(np.intersect1d(*(J.signatures(np.array(sorted(s), np.uint64), percent, common) for s in (x, y))))
    assert seen > 500


def test_texts_around_one_passage_are_not_tied(docs_of, monkeypatch):
    """A third of each text is a passage that all hold: no two link, and hardly any two are candidates."""
    rng = random.Random(13)
    passage = " ".join("p%d" % i for i in range(40))
    rows = [(i, passage + " " + " ".join("w%d" % rng.randrange(10 ** 6) for _ in range(80))) for i in range(300)]
    rows += [(1000, rows[0][1] + " more")]
    sizes = {}

    def stored(df, name, real=J.stored):
        out = real(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(J, "stored", stored)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(docs_of(rows), 5, 80).collect()}
    assert got == {**{i: i for i in range(300)}, 1000: 0}
    assert sizes["tied"] < 30


def test_shingles_of_whole_texts():
    rng = random.Random(2)
    texts = [None, "", "a", "A b", "a B c", "x" * 10000] + [" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    found, want = list(J.shingle_sets(*flat(pa.array(texts, pa.string())), Powers())), [shingles(t) for t in texts]
    assert [len(s) for s in found] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found[i], found[j])) == len(want[i] & want[j])


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)] + [(201, 200), (200, 201)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 200: 200, 201: 200}


def test_filter_and_empty_table(docs_of):
    rows = [(1, "a b c"), (2, "a b c"), (3, None), (4, None), (None, "a b c"), (None, "z")]
    df = docs_of(rows)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"]) == [(1, "a b c"), (3, None), (4, None)]
    assert J.jaccard_components(docs_of([])).count() == 0


def test_copies_that_meet_in_many_ranges_are_tied_once(spark):
    import numpy as np

    from tmaps.llm import ngram_join as N
    words = [f"w{k}" for k in range(400)]
    docs = spark.createDataFrame([(k, " ".join(words[:400 - k])) for k in range(4)], "doc_id long, text string").repartition(4, "doc_id")
    seen = docs.mapInArrow(N._describe(3, 90, 16, 64, np.zeros(0, np.uint64)), N.SHOWN)
    met = [tuple(r) for r in N._met(seen).collect()]
    assert met and len(met) == len(set(met))  # before: a row for each range
