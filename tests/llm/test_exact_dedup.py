import hashlib
import random
import re

import numpy as np

from tmaps.llm import exact_dedup as X


def brute(rows):
    norm = {}
    for i, (d, t) in enumerate(rows):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    out = []
    for d, t in rows:
        n = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in norm[n] if x is not None]
        keep = min(ids) if ids else None
        out.append((d, keep, len(norm[n]), d == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = ([(1, "a b"), (2, "a  b"), (3, "a\n\tb"), (4, "a b "), (5, None), (6, ""), (7, " "), (8, "\x0b\x0c"),
         (9, "é x"), (10, "é x"), (2, "a  b"), (None, "a b"), (None, "alone"), (11, "ab" * 5000), (12, "ab" * 5000),
         (13, "ab" * 4999 + "ba")] + [(100 + i, "the copy") for i in range(200)])


def test_groups_match_brute_force(docs_of, rows_of):
    assert rows_of(X.exact_groups(docs_of(ROWS))) == brute(ROWS)


def test_parts_of_a_large_group(docs_of, rows_of, monkeypatch):
    monkeypatch.setattr(X, "PART_ROWS", 7)
    assert rows_of(X.exact_groups(docs_of(ROWS))) == brute(ROWS)


def test_chunks_of_huge_texts_give_the_same_numbers(docs_of, rows_of):
    rows = [(1, "x" * 70 + " \n" * 9 + "y" * 50), (1, "x" * 70 + " \n" * 9 + "y" * 50), (2, "x" * 71), (3, "")]
    whole = rows_of(X.fingerprints(docs_of(rows), chunk=16, huge=1 << 20))
    assert whole == rows_of(X.fingerprints(docs_of(rows), chunk=16, huge=0))


def test_colliding_fingerprints_are_told_apart(docs_of, rows_of):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(6))) for i in range(150)]
    assert rows_of(X.exact_groups(docs_of(rows), chunk=4, primes=(3, 5))) == brute(rows)


def test_composition_of_chunk_hashes():
    data = np.random.default_rng(1).integers(0, 256, 1000).astype(np.uint8)
    whole = [sum((int(b) + 1) * pow(X.BASE, len(data) - 1 - i, p) for i, b in enumerate(data)) % p for p in X.PRIMES]
    assert X.Polynomial(64).of(data) == whole == X.Polynomial(1000).of(data)


def test_filter_keeps_columns_and_one_row(docs_of):
    df = docs_of(ROWS)
    kept = X.dedup(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 7, 9, 10, 11, 13, 100]


def test_empty_table(docs_of):
    assert X.exact_groups(docs_of([])).count() == 0
    assert X.dedup(docs_of([])).count() == 0


def test_a_round_reads_the_candidates_as_a_table(spark, docs_of, rows_of, monkeypatch):
    """The candidates are found once and written (before: in five places of each round's plan, which the driver kept planning anew)."""
    from tmaps.llm import exact_dedup
    plans, stored = {}, exact_dedup.stored
    monkeypatch.setattr(exact_dedup, "stored", lambda df, name: (plans.setdefault(name, []).append(df.inputFiles()), stored(df, name))[1])
    docs = docs_of([(1, "a b"), (2, "a\n b"), (3, "c"), (None, "a b"), (None, "d"), (4, None), (5, "")])
    kept = exact_dedup.dedup(docs)
    assert rows_of(kept.select("doc_id", "text")) == sorted([(1, "a b"), (3, "c"), (None, "d"), (4, None)], key=repr)
    assert len(plans["candidates"]) == 1 and plans["compared"]
    assert not any("/fingerprints-" in f for files in plans["compared"] for f in files)
