"""Toxicity: held-out labels, unseen misspellings, the model against a plain mean, and odd rows."""

import random
import zlib

import numpy as np

from vellumspark.llm import toxicity


def made(n, seed=4):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("abcdefghilmnoprstu", k=rng.randint(2, 9))) for _ in range(300)]
    bad = ["grumbock", "snorfle", "wexblat"]
    rows = []
    for i in range(n):
        w = rng.choices(plain, k=rng.choice([8, 30, 200, 900]))
        toxic = i % 5 == 0
        if toxic:
            for at in rng.sample(range(len(w)), max(1, len(w) // 30)):
                w[at] = rng.choice(bad)
        rows.append((i, " ".join(w), int(toxic)))
    return rows, plain


def tables(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.drop("toxic"), df.drop("text")


def test_held_out_labels_and_misspellings(spark):
    rows, plain = made(900)
    docs, labels = tables(spark, rows)
    model = toxicity.train(spark, docs, labels)
    truth = {i: y for i, _, y in rows}
    held = [r for r in toxicity.score(docs.withColumn("h", toxicity.held_out()), model).collect() if r.h]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 3 == 1}
    wrong = [r.doc_id for r in held if (r.score >= 0.7) != truth[r.doc_id]]
    assert len(wrong) <= 0.02 * len(held)
    rng = random.Random(8)
    base = " ".join(rng.choices(plain, k=6))
    odd = spark.createDataFrame([(1, f"{base} grummbock {base}"), (2, f"{base} xsnorfles {base}"), (3, f"{base} Wexblatt! {base}"), (4, f"{base} {base}")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert min(got[1], got[2], got[3]) > 0.7 > 0.3 > got[4]


def test_scores_equal_the_mean_of_vectors():
    rng = np.random.default_rng(3)
    weights = rng.normal(size=toxicity.BUCKETS).astype(np.float32)
    text = "Some words, some OTHER words and one_more " + "x" * 95
    words = ["some", "words", "some", "other", "words", "and", "one", "more", "x" * 40, "x" * 40, "x" * 15]
    want = np.mean([np.mean([weights[p] for p in toxicity.parts(w)]) for w in words])
    assert np.isclose(toxicity.Words(weights).mean(text), want, atol=1e-5)
    at, share = toxicity.bag(text)
    assert np.isclose((weights[at] * share).sum(), want, atol=1e-5) and np.isclose(share.sum(), 1)


def test_chi_square_of_a_known_table():
    # 20 of 50 against 10 of 100, with Yates' correction
    want = 150 * (abs(20 * 90 - 10 * 30) - 150 / 2) ** 2 / (30 * 120 * 50 * 100)
    assert np.isclose(toxicity.telling(np.array([10, 0]), np.array([20, 0]), 100, 50), [want, 0]).all()


def test_odd_rows(spark, odd_docs, no_docs):
    rows, _ = made(200)
    docs, labels = tables(spark, rows)
    odd_labels = labels.union(spark.createDataFrame([(None, 1), (3, None), (5, 0), (5, 1), (7, 9)], "doc_id long, toxic int"))
    model = toxicity.train(spark, docs, odd_labels)
    got = toxicity.score(odd_docs, model).collect()
    assert len(got) == odd_docs.count() and "keys" in got[0].asDict()
    by = {r.doc_id: r.score for r in got if r.doc_id is not None}
    assert all(0 <= s <= 1 for s in by.values()) and by[4] == by[5] == by[6]
    assert toxicity.score(no_docs, model).count() == 0
    none = toxicity.train(spark, docs, labels.limit(0))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.5}
    one = toxicity.train(spark, docs, labels.where("toxic = 0"))
    assert max(r.score for r in toxicity.score(docs, one).collect()) < 0.01
