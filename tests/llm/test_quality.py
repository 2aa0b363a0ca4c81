import random

import numpy as np
from pyspark.sql import functions as F

from txnlake.llm import quality

from .data import ODD_TEXTS, docs, invented


def junk(t, r):
    kind = r.randrange(4)
    w = t.split()
    return [" ".join(x + r.choice(["###", "&&&"]) for x in w), t.upper() + "!!", " | ".join(w),
            " ".join([w[0]] * len(w))][kind]


def corpus(spark, n, seed, noise=0.04):
    """Documents, labels (one in 25 wrong) and the truth."""
    r = random.Random(seed)
    texts, good = invented(n, seed=seed), []
    for i, t in enumerate(texts):
        good.append(r.random() > 0.2)
        texts[i] = t if good[-1] else junk(t, r)
    rows = [(i, int(g != (r.random() < noise)), 0) for i, g in enumerate(good)]
    return docs(spark, texts), spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), good


def test_held_out_accuracy(spark):
    df, labels, good = corpus(spark, 1200, 1)
    df = df.withColumns({"score": F.lit("x"), "Held_Out": F.lit(1), "m0": F.lit(1), "y": F.lit(2)})
    got = {r.doc_id: r for r in quality.quality(df, labels).collect()}
    held = [i for i in got if got[i].held_out]
    assert len(got) == 1200 and 150 < len(held) < 330
    assert np.mean([got[i].predicted == good[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_scores_do_not_depend_on_ids_sources_or_languages(spark):
    df, labels, _ = corpus(spark, 200, 2)
    machine = quality.fit(df, labels)
    a = {r.text: r.score for r in df.join(quality.scored(df, machine), "doc_id").collect()}
    other = df.withColumns({"doc_id": F.col("doc_id") + 7, "lang": F.lit(None).cast("string"), "source": F.lit("z")})
    b = {r.text: r.score for r in other.join(quality.scored(other, machine), "doc_id").collect()}
    assert a == b


def test_pairwise_interactions_by_brute_force():
    r = np.random.default_rng(0)
    m = quality.Machine(0.3, r.normal(size=50).astype(np.float32), r.normal(size=(50, 4)).astype(np.float32))
    made = [(np.sort(r.choice(50, n, replace=False)), r.random(n).astype(np.float32)) for n in (1, 2, 9, 50)]
    for (at, x), got in zip(made, m.score(made)):
        z = 0.3 + (m.w[at] * x).sum() + sum(m.v[i] @ m.v[j] * x[a] * x[b] for a, i in enumerate(at)
                                            for b, j in enumerate(at) if a < b)
        assert abs(1 / (1 + np.exp(-z)) - got) < 1e-4


def test_interactions_are_learned():
    """A label that depends on two places together, and on neither alone."""
    r = np.random.default_rng(1)
    made, y = [], []
    for _ in range(800):
        a, b = r.random(2) < 0.5
        made.append((np.array([int(a), 2 + int(b)]), np.ones(2, np.float32)))
        y.append(float(a == b))
    m = quality.Machine(0.0, np.zeros(4, np.float32), r.normal(0, 0.1, (4, 4)).astype(np.float32))
    m.learn(made, np.array(y), 40, 64, 0.02, 0.0)
    assert ((m.score(made) > 0.5) == np.array(y)).mean() == 1


def test_pieces_do_not_change_the_features(monkeypatch):
    text = " ".join(invented(3, least=200, most=300)) + "\nline\nline\n" + "x### " * 40
    whole = quality.features(text, (5.0,))
    monkeypatch.setattr(quality, "PIECE", 64)
    cut = quality.features(text, (5.0,))
    words = whole[0] < quality.BUCKETS
    assert (whole[0][words] == cut[0][cut[0] < quality.BUCKETS]).all()
    assert len(whole[0]) == len(whole[1]) and (np.diff(whole[0]) > 0).all()


def test_odd_rows_and_missing_labels(spark):
    df = docs(spark, [*ODD_TEXTS, "word " * 300_000])
    df = df.withColumn("doc_id", F.when(F.col("doc_id") != 4, F.col("doc_id"))).union(df.limit(3))
    none = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    one = spark.createDataFrame([(i, 1) for i in range(12)] * 2, "doc_id long, quality int")
    two = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(3, 0)], "doc_id long, quality int")
    for labels in (none, none.limit(0), one, two):
        rows = quality.quality(df, labels).collect()
        assert len(rows) == len(ODD_TEXTS) + 4
        assert all(r.score is not None and 0 <= r.score <= 1 for r in rows)
        if labels is one:
            assert len({r.score for r in rows}) == 1 and rows[0].score > 0.5
        elif labels is not two:
            assert {r.score for r in rows} == {0.5}
        assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert quality.quality(df.limit(0), two).count() == 0


def test_the_same_model_on_every_run(spark):
    df, labels, _ = corpus(spark, 150, 5)
    a = quality.fit(df, labels)
    b = quality.fit(df.repartition(7), labels.repartition(3))
    assert a.bias == b.bias and (a.w == b.w).all() and (a.v == b.v).all()
