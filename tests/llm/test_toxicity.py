import random

import numpy as np
from pyspark.sql import functions as F

from txnlake.llm import toxicity

from .data import ODD_TEXTS, docs, invented

CATEGORIES = {"low": "quality = 0", "toxic": "toxic = 1"}


def corpus(n, seed):
    """Texts, toxic flags (insults in a fifth of them, one label in 25 wrong), junk flags."""
    r = random.Random(seed)
    texts, toxic, junk = invented(n, seed=seed), [], []
    for i, t in enumerate(texts):
        words = t.split()
        toxic.append(r.random() < 0.2)
        junk.append(r.random() < 0.2)
        if toxic[-1]:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(["Zorgle", "brint,", "quexal."]))
        texts[i] = " ".join(w + "###" if junk[-1] else w for w in words)
    return texts, toxic, junk


def labels(spark, toxic, junk, seed=1):
    r = random.Random(seed)
    return spark.createDataFrame([(i, int(not j), int(t != (r.random() < 0.04)))
                                  for i, (t, j) in enumerate(zip(toxic, junk))],
                                 "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    texts, toxic, junk = corpus(1500, 1)
    chain = toxicity.fit(docs(spark, texts), labels(spark, toxic, junk), CATEGORIES)
    fresh, toxic, junk = corpus(800, 2)
    df = docs(spark, fresh + ODD_TEXTS).withColumn("p_low", F.lit("x"))
    got = {r.doc_id: r for r in toxicity.classify(df, chain).collect()}
    assert len(got) == len(fresh) + len(ODD_TEXTS)
    said = np.array([got[i].toxic for i in range(len(fresh))])
    truth = np.array(toxic)
    assert said[truth].mean() > 0.97 and said[~truth].mean() < 0.02
    assert np.mean([got[i].low == junk[i] for i in range(len(fresh))]) > 0.97
    assert not any(got[len(fresh) + i].toxic for i in range(len(ODD_TEXTS)))


def test_later_models_use_earlier_probabilities():
    r = np.random.default_rng(0)
    first = r.random(600) < 0.5
    x = np.stack([first, r.random(600) < 0.5], 1).astype(np.float32)
    y = np.stack([first, first], 1).astype(float)
    chain = toxicity.Chain.fit(["a", "b"], {"w0": 0}, x, y, np.arange(600) % 3, 3)
    assert chain.models[1][2] > 0.5  # the weight of p_a
    assert len(chain.models[0]) == 3 and len(chain.models[1]) == 4


def test_threshold_by_brute_force():
    r = np.random.default_rng(3)
    for _ in range(50):
        p, y = r.random(30).round(1), (r.random(30) < 0.4).astype(float)
        if y.sum():
            def f1(t):
                return 2 * y[p >= t].sum() / ((p >= t).sum() + y.sum())
            assert f1(toxicity.best_threshold(p, y)) == max(f1(t) for t in p)


def test_missing_outcomes_and_empty_tables(spark):
    df = docs(spark, ["a b", None, ""])
    none = spark.createDataFrame([(0, 1, 0), (1, None, 1), (None, 0, 1)],
                                 "doc_id long, quality int, toxic int")
    for lab in (none, none.limit(0)):
        chain = toxicity.fit(df, lab, CATEGORIES)
        rows = toxicity.classify(df, chain).collect()
        assert len(rows) == 3 and not any(r.toxic or r.low for r in rows)
    assert toxicity.classify(df.limit(0), chain).count() == 0
