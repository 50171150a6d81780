"""The classifier against sums over all label sequences, its accuracy, and its defined cases."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tmaps.llm import quality
from tmaps.llm.common import Powers, flat

DOCS = "doc_id bigint, text string"
LABELS = "doc_id bigint, quality int"


def rng_model(seed=5):
    rng = np.random.default_rng(seed)
    return quality.Model(rng.normal(0, 0.6, (3, quality.WIDTH, 2)).astype(np.float32), rng.normal(0, 1, (2, 2)), 0.5)


def one_line(text):
    data, off = flat(pa.array([text]))
    start, end, _ = quality.lines(data, off)
    return quality.describe(data, start, end, Powers())[0].astype(float)


def brute(model, text):
    """The score of a text, from all sequences of labels of its lines."""
    parts = (text or "").split("\n")
    x = [one_line(p) for p in parts]
    scores = []
    for t in range(len(x)):
        s = x[t] @ model.weights[0]
        if t:
            s = s + x[t - 1] @ model.weights[1]
        if t + 1 < len(x):
            s = s + x[t + 1] @ model.weights[2]
        scores.append(s)
    good, total = np.zeros(len(x)), 0.0
    for labels in itertools.product((0, 1), repeat=len(x)):
        w = np.exp(sum(s[y] for s, y in zip(scores, labels)) + sum(model.moves[a, b] for a, b in zip(labels, labels[1:])))
        total += w
        good += w * np.array(labels)
    size = np.array([len(p.encode()) + 1 for p in parts])
    return float((size * good / total).sum() / size.sum())


TEXTS = ["One line.", "a\nb c d\n\nE! ###", "", None, "\n", "  x  y\n%%% &&&\nDas ist gut.\né è ß\n123 4 5\n|\n", "word word word word\nword"]


def test_marginals_against_all_sequences():
    model = rng_model()
    got = quality.predict(model, pa.array(TEXTS, pa.string()), Powers())
    assert got == pytest.approx([brute(model, t) for t in TEXTS], rel=1e-4)


def test_blocks_do_not_change_scores(monkeypatch):
    rng = random.Random(2)
    texts = TEXTS + ["\n".join("".join(rng.choice("ab C.#1é ") for _ in range(rng.randint(0, 40))) for _ in range(300)), "x" * 5000, "\n" * 2000]
    want = quality.predict(rng_model(), pa.array(texts, pa.string()), Powers())
    monkeypatch.setattr(quality, "BLOCK_BYTES", 64)
    monkeypatch.setattr(quality, "BLOCK_LINES", 5)
    assert quality.predict(rng_model(), pa.array(texts, pa.string()), Powers()) == pytest.approx(want, rel=1e-4)


def test_lines_are_those_of_split():
    texts = ["", "a", "\n", "a\n\nb", "", "\nx\n", "é\nß"]
    data, off = flat(pa.array(texts))
    start, end, count = quality.lines(data, off)
    assert count.tolist() == [len(t.split("\n")) for t in texts]
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end)] == [p for t in texts for p in t.split("\n")]


def made(n, seed=4):
    """Prose, and junk of three kinds."""
    rng = random.Random(seed)
    words = ["the", "of", "stone", "river", "and", "garden", "walks", "quiet", "morning", "a", "light", "to"]

    def prose():
        return "\n".join(" ".join(rng.choices(words, k=rng.randint(4, 12))).capitalize() + "." for _ in range(rng.randint(1, 8)))
    junk = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " ### "), lambda t: " ".join(w for w in t.split() for _ in range(9))]
    return [(k, prose(), 1) if k % 4 else (k, rng.choice(junk)(prose()), 0) for k in range(n)]


def test_held_out_accuracy_and_labels_that_are_not_learned_from(spark):
    rows = made(500)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], LABELS)
    truth = {r[0]: r[2] for r in rows}
    got = quality.quality(docs, labels).collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {k: zlib.crc32(str(k).encode()) % 5 == 0 for k in truth}
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) >= 0.97 * len(out) > 60
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    # held-out labels, nulls and other values change nothing
    other = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in truth.items()] + [(None, 1), (3, None), (5, 7), (10_000, 0)]
    again = {r["doc_id"]: r["score"] for r in quality.quality(docs, spark.createDataFrame(other, LABELS)).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_defined_cases(spark):
    rows = made(60)
    odd = [(900, None), (901, ""), (None, "Text."), (7, rows[7][1]), (902, "x " * 400_000), (903, "\n" * 100_000)]
    docs = spark.createDataFrame([(r[0], r[1], 1, "x") for r in rows] + [o + (2, "y") for o in odd], DOCS + ", good int, x string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(r[0], 0) for r in rows], LABELS)  # the highest counts
    got = quality.quality(docs, labels).collect()
    assert len(got) == 66 and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[7][0] == by[7][1] and by[900][0]["score"] == by[901][0]["score"] and by[None][0]["held_out"] is False


def test_one_label_none_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    scores = lambda labels: [r["score"] for r in quality.quality(docs, spark.createDataFrame(labels, LABELS)).collect()]
    free = [k for k in (1, 2, 3, 4, 5, 6) if zlib.crc32(str(k).encode()) % 5]
    assert scores([]) == [0.0, 0.0]
    assert set(scores([(k, 1) for k in free])) <= {0.0, 1.0}
    assert quality.quality(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
