import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnlake.llm import langid

from .data import ODD_TEXTS, SF, docs, given


def test_ngrams_by_hand():
    doc, h = langid.grams(["Ab", "", "ab cd", "a", "a1b"])
    assert np.bincount(doc, minlength=5).tolist() == [3, 0, 6, 1, 2]
    same, again = langid.grams(["ab", "aB"])
    assert (again[same == 0] == again[same == 1]).all()
    assert len(langid.grams([])[0]) == 0


def test_pieces_of_long_texts_are_whole():
    for text in ("x y" * 400_000, "x" * 1_200_000, "", "a"):
        assert "".join(langid._pieces(text)) == text


def test_filter_returns_all_languages_of_an_ngram():
    r = np.random.default_rng(1)
    hashes = r.integers(0, 1 << 63, 5000).astype(np.uint64)
    typical = r.random((5000, 11)) < 0.3
    model = langid.Model.build([f"l{i}" for i in range(11)], hashes, typical, 16)
    got = model.languages_of(hashes).astype(bool)
    assert (got | ~typical).all()  # no false negatives
    other = model.languages_of(r.integers(0, 1 << 63, 50_000).astype(np.uint64))
    assert np.allclose(other.mean(0), model.false_positive, rtol=0.2, atol=2e-3)


def test_held_out_is_the_checksum(spark):
    df = spark.createDataFrame([(i,) for i in [*range(300), -5, None]], "doc_id long")
    for r in df.select("doc_id", langid.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_prediction_rows(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, ODD_TEXTS, first=10_000, lang=None)
    extra = df.unionByName(odd).unionByName(df.limit(3)).withColumn("score", F.lit("z"))
    extra = extra.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    rows = langid.identify(extra).collect()
    assert len(rows) == df.count() + len(ODD_TEXTS) + 3
    by_id = {r.doc_id: r for r in rows}
    for i, t in enumerate(ODD_TEXTS):
        has_letters = any(c.isalpha() for c in t or "")
        assert (by_id[10_000 + i].lang_pred == "und") == (not has_letters)
    assert all(0 <= r.score <= 1 for r in rows) and not by_id[None].held_out
    truth = dict(given("documents", "doc_id, lang"))
    held = [r for r in rows if r.held_out and truth.get(r.doc_id)]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_learning_ignores_held_out_rows_and_other_columns(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "zz").otherwise(
        F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(langid.identify(df).collect()) == sorted(langid.identify(wrong).collect())


def test_nothing_learned(spark):
    df = docs(spark, ["abc", None], lang=None)
    assert [(r.lang_pred, r.score) for r in langid.identify(df).collect()] == [("und", 0.0)] * 2
    assert langid.identify(df.limit(0)).count() == 0


def test_filter_stage_keeps_clean_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs(spark, ["1234 5678", "", None], first=10_000)
    kept = langid.keep_identified(df.unionByName(odd))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert not ids & {10_000, 10_001, 10_002} and len(ids) >= 0.99 * df.count()


@pytest.mark.parametrize("n", [2, 4, 20])
def test_filter_stage_at_any_number_of_languages(spark, n):
    """Related languages (half of all words are common to them); letters at random go."""
    r = random.Random(n)

    def words(k):
        return ["".join(r.choices("abcdefghijklmno", k=r.randint(3, 7))) for _ in range(k)]

    common, own = words(60), [words(60) for _ in range(n)]
    df = docs(spark, [])
    for i in range(n):
        df = df.unionByName(docs(spark, [" ".join(r.choices(common + own[i], k=80))
                                         for _ in range(30)], first=100 * i, lang=f"l{i}"))
    noise = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=400)) for _ in range(20)]
    both = df.unionByName(docs(spark, noise, first=10_000, lang=None))
    ids = {x.doc_id for x in langid.keep_identified(both.coalesce(4)).select("doc_id").collect()}
    assert not any(i >= 10_000 for i in ids) and len(ids) >= 0.99 * 30 * n


def test_filter_stage_without_labels(spark):
    assert langid.keep_identified(docs(spark, ["some words", "other words"], lang=None)).count() == 2


def test_every_labelled_text_is_learned_from(spark):
    """Each document has a word of its own; there are more than any sample of 1,000 would hold."""
    r = random.Random(21)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(2500)]
    df = docs(spark, texts, lang="aa").unionByName(docs(spark, ["0 ÄÖ", None], first=5000, lang="bb"))
    for part in (df, df.coalesce(1)):
        model = langid.fit(part.select("text", "lang"))
        doc, h = langid.grams(texts)
        assert model.languages_of(h)[:, model.langs.index("aa")].all()


def test_ngrams_passed_on_early_are_counted_whole(spark, monkeypatch):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    one = langid.fit(df)
    monkeypatch.setattr(langid, "HELD_GRAMS", 64)
    two = langid.fit(df.repartition(3))
    assert one.langs == two.langs and (one.slots == two.slots).all()


def test_bound_is_that_of_all_labelled_rows(spark, monkeypatch):
    """The bounds handed to the filter are the exact percentile over all rows."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(df.where(~langid.held_out(F.col("doc_id"))))
    rows = df.collect()
    told = model.measure([x.text for x in rows], len(rows))
    want = set()
    for x, (lang, _, part) in zip(rows, told):
        own = [t[2] for y, t in zip(rows, told) if y.lang == lang == t[0]]
        if lang != langid.UNDETERMINED and part >= (0.9 * np.percentile(own, 1) if own else 0):
            want.add(x.doc_id)
    seen = []
    place = langid.order_statistics
    monkeypatch.setattr(langid, "order_statistics",
                        lambda d, *a: seen.append(d.count()) or place(d, *a))
    got = {x.doc_id for x in langid.keep_identified(df, least=0.9).collect()}
    assert got == want and seen == [sum(x.lang == t[0] for x, t in zip(rows, told))]
