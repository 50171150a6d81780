"""The manifest against a plain tree over whole lists, and its defined cases."""

import hashlib
import random
import zlib

import pytest

from tmaps.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    if v is None:
        return "-"
    s = str(v)
    return f"{len(s.encode())}:{s}"


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return digest(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(nodes, fanout):
    """(root, path of each node) of a tree over ``nodes``."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            first = at[k] - at[k] % fanout
            path.append(("".join(nodes[first:at[k]]), "".join(nodes[at[k] + 1:first + fanout])))
            at[k] //= fanout
        nodes = [digest(*nodes[k:k + fanout]) for k in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute(rows, fanout=3):
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        mine = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine], fanout)))
    root, tops = climb([t[1] for t in trees], fanout)
    out = []
    for (mine, subroot, paths), top in zip(trees, tops):
        for r, path in zip(mine, paths):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            h = leaf((r[0], r[1].replace("\n", ""), *r[2:]) if changed else r)
            for left, right in path + top:
                h = digest(left, h, right)
            out.append((r[0], leaf(r), subroot, root, digest(*[x for p in path + top for x in p]), h, h == root))
    return sorted(out, key=str)


def got(spark, rows, fanout=3, levels=7, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    return sorted((tuple(r) for r in merkle.verify(merkle.manifest(docs, fanout, levels)).collect()), key=str)


def made(n, sources, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "one line", "two\nlines", "ü\n\nß", "x" * 50_000 + "\n"]
    return [(k, rng.choice(texts), rng.choice(["en", None, ""]), rng.choice(sources), rng.choice([None, 3])) for k in range(n)]


@pytest.mark.parametrize("n,sources,fanout,levels", [
    (200, ["a", "a", "b", "c", None, ""], 3, 1),  # many blocks: the exchange has four rounds
    (90, [f"s{k}" for k in range(40)], 3, 1),  # the tree of the sources has blocks too
    (120, ["a", "b"], 2, 2),
])
def test_against_whole_lists(spark, n, sources, fanout, levels):
    rows = made(n, sources)
    assert got(spark, rows, fanout, levels) == brute(rows, fanout)


@pytest.mark.parametrize("n", [1, 28])
def test_ragged_ends(spark, n):
    rows = [(k, f"text\n{k}", "en", "s", k) for k in range(n)]
    assert got(spark, rows, 3, 1) == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(5, "a\n", "en", "s", 1)] * 4 + [(5, "b", "en", "s", 1), (None, "c\n", None, None, None), (None, "c\n", "en", "s", None)]
    assert got(spark, rows, 3, 1) == brute(rows)
    docs = spark.createDataFrame([r + ("x", 1, 2) for r in rows], SCHEMA + ", tree string, pos int, hash int")
    assert sorted((tuple(r) for r in merkle.verify(merkle.manifest(docs)).collect()), key=str) == brute(rows)


def test_tampering_is_found(spark):
    rows = [(k, "a\nb", "en", "s", 3) for k in range(20)]
    for doc_id, *_, verified in got(spark, rows, 3, 1):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 2 == 1)


def test_empty_table(spark):
    assert got(spark, []) == []
