import random
import zlib

import numpy as np
import pyarrow as pa

from tmaps.llm import language as X

PARTS = {"aa": ["the", "ing", "wor", "th", "and"], "bb": ["schu", "ung", "ich", "tz", "ein"], "cc": ["eau", "ère", "ou", "que", "ç"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(3)
    out = []
    for i in range(n):
        lang = sorted(PARTS)[i % 3]
        out.append((i, sentence(rng, lang, rng.randint(1, 150)), lang))
    return out


def test_held_out_accuracy_and_cases(docs_of):
    docs = corpus()
    more = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !? 4", "aa"), (1003, "—…€", None), (None, "the thing", "aa"), (0, docs[0][1], "aa"),
            (1004, sentence(random.Random(1), "bb", 30000), None)]
    got = X.identify(docs_of(docs + more)).collect()
    assert len(got) == len(docs) + len(more)
    by = {r.doc_id: r for r in got}
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert all(by[d[0]].held_out for d in held)
    assert np.mean([by[d[0]].lang_pred == d[2] for d in held]) > 0.97
    for d in (1000, 1001, 1002, 1003):
        assert (by[d].lang_pred, by[d].score) == ("und", 0.0)
    assert by[1004].lang_pred == "bb" and all(0 <= r.score <= 1 for r in got)


def test_a_language_of_long_documents_only(docs_of):
    rng = random.Random(5)
    docs = [d for d in corpus(120) if d[2] != "cc"]
    docs += [(2000 + i, sentence(rng, "cc", 6000), "cc") for i in range(12)] + [(3000, sentence(rng, "cc", 80), None)]
    assert min(len(d[1].encode()) for d in docs if d[2] == "cc") > X.TRAIN_BYTES
    got = {r.doc_id: r.lang_pred for r in X.identify(docs_of(docs)).collect()}
    assert got[3000] == "cc" and all(got[d[0]] == d[2] for d in docs if d[2] == "cc")


def test_code_switched_words():
    docs = corpus()
    model = X.train([d[1] for d in docs], [d[2] for d in docs])
    rng = random.Random(9)
    text = sentence(rng, "aa", 40) + " " + sentence(rng, "bb", 20)
    lang, score = X.predict(model, pa.array([text, text]), X.Powers())
    assert lang == ["aa", "aa"] and 0.55 < score[0] < 0.8 and score[0] == score[1]
    assert (np.diag(model.moves) > model.moves.mean(axis=1)).all()


def test_chains_are_forward_backward():
    rng = np.random.default_rng(0)
    count = np.array([1, 5, 64, 65, 200, 0, 128])
    scores, moves = rng.normal(size=(count.sum(), 3)), rng.normal(size=(3, 3))
    got, _, _ = X.Chains(count).run(scores, moves)
    at, a = 0, np.exp(moves)
    for n in count[count > 0]:
        e = np.exp(scores[at:at + n])
        f, b = [np.ones(3)], [np.ones(3)]
        for t in range(1, n):
            v = (f[-1] * e[t - 1]) @ a
            f.append(v / v.sum())
        for t in range(n - 1, 0, -1):
            v = a @ (e[t] * b[-1])
            b.append(v / v.sum())
        want = np.array(f) * e * np.array(b[::-1])
        assert np.allclose(got[at:at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_nothing_learned_and_empty_table(docs_of):
    assert [r.lang_pred for r in X.identify(docs_of([(1, "abc", None)])).collect()] == ["und"]
    assert X.identify(docs_of([])).count() == 0
    df = docs_of(corpus(60) + [(999, "12", "aa")])
    kept = X.keep_known(df)
    assert kept.columns == df.columns and kept.count() == 60
