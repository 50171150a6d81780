import random
import zlib

import numpy as np

from tmaps.llm import toxicity as X

BAD = ["zlorp", "grumfit", "nastik"]


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(5, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_rows(spark, docs_of):
    docs, labels = corpus()
    truth = {d: t for d, _, t in labels}
    tail = [(9000, None), (9001, ""), (9002, "\0 x"), (9003, ("clean " * 3000) + BAD[0] + " " + BAD[1]), (None, "text"), (1, docs[1][1])]
    got = X.toxicity(docs_of(docs + tail), spark.createDataFrame(labels + [(5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(tail)
    by = {r.doc_id: r for r in got}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for d in truth:
        assert by[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    held = [d for d in truth if by[d].held_out]
    assert np.mean([by[d].predicted == truth[d] for d in held]) > 0.97
    assert by[9001].predicted == 0 and by[9000].score == by[9001].score and by[None].held_out is False


def test_grams_are_distinct_and_of_one_text_each():
    texts = ["abcdef", "", "ABCDEF abcdef", "x\ty", "abcdef"]
    row, bucket = X.grams(texts)
    alone = [X.grams([t])[1] for t in texts]
    for k, t in enumerate(texts):
        assert bucket[row == k].tolist() == alone[k].tolist()
    assert alone[0].tolist() == alone[4].tolist() and len(alone[0]) <= sum(len("abcdef") + 6 for _ in X.ORDERS)


def test_held_out_labels_are_not_read(spark, docs_of):
    docs, labels = corpus(300)
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    one, two = (X.fit(docs_of(docs), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert one.buckets.tolist() == two.buckets.tolist() and np.allclose(one.weights, two.weights)


def test_without_labels_or_rows(spark, docs_of):
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    assert [r.predicted for r in X.toxicity(docs_of([(1, "a")]), none).collect()] == [0]
    assert X.toxicity(docs_of([]), none).count() == 0
    all_bad = spark.createDataFrame([(i, 1, 1) for i in range(8)], schema)
    assert X.toxicity(docs_of([(i, "a") for i in range(8)]), all_bad).where("predicted = 1").count() == 8
    df = docs_of([(1, "a"), (2, None)])
    assert X.keep_clean(df, none).columns == df.columns and X.keep_clean(df, none).count() == 2
