import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from monthmark.llm.toxicity import (DECAY, LENGTH, SPAN, Bounds, fit, margins_of, score_toxicity, scores_of, subsequences,
                                    sample, without_toxic, words_of)
from tests.llm.helpers import docs_of

INSULTS = ["blockhead", "dirtbag", "numbskull"]


def text(seed, toxic):
    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ren", "tu", "sal", "vor", "ne"]
    words = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(60)]
    if toxic:
        for _ in range(4):
            words.insert(r.randrange(60), r.choice(INSULTS))
    return " ".join(w + ("." if k % 8 == 7 else "") for k, w in enumerate(words))


def training(n=160):
    return [text(i, i % 3 == 0) for i in range(n)], np.array([i % 3 == 0 for i in range(n)])


def test_held_out_accuracy_and_inserted_characters():
    model = fit(*training())
    new = [text(10_000 + i, i % 2 == 0) for i in range(100)]
    score = np.array(scores_of(model, new))
    assert ((score >= 0.5) == (np.arange(100) % 2 == 0)).mean() >= 0.97
    plain, gap, marks, other = margins_of(["blockhead", "blo-ck.head", "bloxckhead", "salvorne"], model.weights)
    assert plain > 0.3 and gap == plain and marks > 0.4 * plain and other < 0.3 * plain
    assert words_of("You B l o c k h e a d now") == ["you", "blockhead", "now"]


def test_kernel_sums_gapped_subsequences():
    word = "^abcde$"
    from itertools import combinations

    want = sum(DECAY ** (c[-1] - c[0] + 1) for c in combinations(range(len(word)), LENGTH) if c[-1] - c[0] < SPAN)
    got = sum(w * len(of) for of, _, w in subsequences(["abcde"]))
    assert abs(got - want) < 1e-9


def tables(spark, n=200):
    docs = docs_of(spark, [(i, text(i, i % 3 == 0)) for i in range(n)] + [(1000, None), (1001, ""), (1002, "kalo " * 30_000), (None, "lomi"),
                                                                          (3, text(3, True)), (1003, "dirtbag " * 5)])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(n)] + [(None, 1, 1), (5, 0, None), (7, 1, 7)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels


def test_rows(spark):
    docs, labels = tables(spark)
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    by = {r["doc_id"]: r for r in got}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 200]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) >= 0.9
    assert by[1000]["predicted"] == by[1001]["predicted"] == by[1002]["predicted"] == 0 and by[1003]["predicted"] == 1
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_held_out_labels_are_not_learnt_from(spark):
    docs, labels = tables(spark)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    a = {str(r) for r in score_toxicity(docs, labels).collect()}
    assert a == {str(r) for r in score_toxicity(docs, flipped).collect()}


def test_sample_is_filled_where_most_texts_are_too_long_or_null(spark):
    texts = [(i, None if i % 3 == 0 else "lomi " * 30) for i in range(400)] + [(i, f"kalo {i}") for i in range(400, 440)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(440)], "doc_id long, toxic int")
    got, share = sample(docs_of(spark, texts), labels, Bounds(4, 5, 100), "doc_id", "text")
    assert sorted(r["toxic"] for r in got) == [0] * 5 + [1] * 4 and all(r["text"].startswith("kalo") for r in got)
    assert 0.4 < share < 0.6


def test_without_labels(spark):
    docs, labels = tables(spark, 20)
    assert {r["score"] for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in score_toxicity(docs, labels.where("toxic = 1"), bounds=Bounds(5, 5)).collect()} == {1.0}
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_collapsed_weights_equal_the_landmark_expansion():
    from itertools import combinations

    from monthmark.llm import toxicity as t

    def features(word):
        marked = f"^{word}$"
        out = {}
        for at in combinations(range(len(marked)), t.LENGTH):
            span = at[-1] - at[0] + 1
            if span <= t.SPAN:
                key = "".join(marked[i] for i in at)
                out[key] = out.get(key, 0.0) + t.DECAY ** span
        n = sum((t.DECAY ** (at[-1] - at[0] + 1)) ** 2 for at in combinations(range(len(marked)), t.LENGTH)
                if at[-1] - at[0] < t.SPAN) ** 0.5
        return {k: v / max(n, t.DECAY ** t.LENGTH) for k, v in out.items()}

    landmarks, words = ["kalopi", "morun", "xyzzy", "aab"], ["kaloopi", "k", "morun", "zzzz", "unrelated", "kalmopi"]
    coefficients = np.array([1.5, -2.0, 0.25, 3.0])
    places, table = t._explicit(landmarks)
    weights = np.zeros(1 << t.TABLE_BITS)
    weights[places] = table @ coefficients
    z = [features(w) for w in landmarks]
    want = [sum(c * sum(v * f.get(k, 0.0) for k, v in features(w).items()) for c, f in zip(coefficients, z)) for w in words]
    assert np.allclose(t.margins_of(words, weights), want, atol=1e-5)
    assert np.allclose(t._landmark_products(words, (places, table)),
                       [[sum(v * f.get(k, 0.0) for k, v in features(w).items()) for f in z] for w in words], atol=1e-5)
