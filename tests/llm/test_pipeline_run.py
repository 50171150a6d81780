"""run() against the stages done by hand on a made-up corpus."""

import random
import re

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_packing import PATH, by_one
from tmaps.llm import language, toxicity
from tmaps.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EN = ["the", "river", "stone", "garden", "walks", "under", "quiet", "morning", "light", "house", "small", "window"]
DE = ["der", "fluss", "stein", "garten", "geht", "unter", "stille", "morgen", "licht", "haus", "kleine", "fenster"]
BAD = ["vexil", "grobian", "snarf", "blighter"]


def made(seed=3):
    rng = random.Random(seed)
    prose = lambda words, n: " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))
    rows, toxic = [], {}
    for k in range(160):
        words = EN if k % 3 else DE
        text = prose(words, rng.randint(12, 120))
        if k % 5 == 0:
            text = " ".join(w if rng.random() > 0.3 else rng.choice(BAD) for w in text.split())
        toxic[k] = int(k % 5 == 0)
        rows.append((k, text, "en" if k % 3 else "de"))
    for k in range(160, 200):  # exact copies but for white space
        rows.append((k, rows[k - 160][1].replace(" ", " \n", 2), rows[k - 160][2]))
    for k in range(200, 260):  # near copies: some words changed
        w = rows[(k * 7) % 160][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = "w%d" % rng.randrange(50)
        rows.append((k, " ".join(w + ["end"] * rng.randint(0, 2)), rows[(k * 7) % 160][2]))
    rows += [(300, None, None), (301, "", "en"), (302, "123 456", "en"), (303, " ".join(EN * 500), "en"), (304, "the river", None)]
    return rows, toxic


def runs(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = low.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    rows, toxic = made()
    docs = [(i, t, lang, "s", 0 if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, v) for k, v in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_run_against_the_stages_by_hand(spark, folder):
    docs, labels = (table(spark, folder, t) for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    # what the two models say; the models have tests of their own
    clean = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if not r.predicted}
    assert 0 < len(texts) - len(clean) < len(texts) / 2
    known = {r.doc_id for r in language.identify(docs.where(docs.doc_id.isin(sorted(clean)))).collect() if r.lang_pred != "und" and r.score >= language.LEAST_SCORE}
    assert not {300, 301, 302} & known
    kept, seen = [], set()
    for i in sorted(known):  # the smallest id of equal texts
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or "")
        if norm not in seen:
            seen.add(norm)
            kept.append(i)
    sets, least = {i: runs(texts[i] or "") for i in kept}, {i: i for i in kept}
    changed = True
    while changed:  # least id that links reach
        changed = False
        for a in kept:
            for b in kept:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[a] < least[b]:
                    least[b], changed = least[a], True
    final = {i for i in kept if least[i] == i}
    assert len(final) < len(kept) < len(known)
    got = P.run(spark, folder).collect()
    assert {r.doc_id for r in got} == final
    library = Tokenizer.from_file(PATH)
    lengths, held = [], {}
    for i in final:
        n = len(library.encode(texts[i] or "", add_special_tokens=False).ids) + 1
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in pieces) == n and [r.piece for r in pieces] == list(range(len(pieces)))
        lengths += [r.length for r in pieces]
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(held) == len(by_one(lengths, 2048))


def test_repeated_rows_ties_and_clashing_columns(spark, folder, tmp_path):
    """Rows that stand twice change nothing but are one document; further columns come along."""
    docs = table(spark, folder, "documents").where("doc_id < 60")
    twice = docs.union(docs.where("doc_id % 2 = 0")).selectExpr("*", "1 as n", "'x' as kept", "2 as score", "3 as label")
    twice.write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, folder, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    now = table(spark, str(tmp_path), "documents")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == now.columns
        now = out.cache()
    ids = [r.doc_id for r in now.collect()]
    assert len(ids) == len(set(ids)) > 0
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} == set(ids)
