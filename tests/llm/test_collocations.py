import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from txnlake.llm import collocations

from .data import ODD_TEXTS, SF, docs


def brute(rows, least=10, nested=50, top=2000):
    """Of (lang, text): the report, by counting every phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, x) for x in zip(*(w[i:] for i in range(k))))
    longer: dict = {}  # counts of the candidates that hold a pair
    for (lang, p), b in f.items():
        for pair in {p[:2], p[1:]} if len(p) == 3 and b >= least else ():
            longer.setdefault((lang, pair), []).append(b)
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(100 * b >= nested * a for b in longer.get((lang, p), ())):
            continue
        cuts = [(1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        rows.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out = []
    for lang in {r[0] for r in rows}:
        best = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(lang, i, *r[1:]) for i, r in enumerate(best[:top], 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed=4, texts=120):
    r = random.Random(seed)
    words = ["The", "of", "salt", "and", "pepper", "new", "York", "city", "é", "x y", "a\x1cb"]
    joins = [" ", "  ", "\t", ". ", ", ", "\n", "   ", "!"]
    return [("en" if i % 3 else None if i % 2 else "de", "".join(
        r.choice(["salt and pepper", "new York city", *words]) + r.choice(joins[:3] * 4 + joins)
        for _ in range(r.randint(0, 90)))) for i in range(texts)]


@pytest.mark.parametrize("max_phrases,chunk,block", [(500_000, 1 << 20, 1 << 20), (40, 50, 60)])
def test_report_by_brute_force(spark, monkeypatch, max_phrases, chunk, block):
    """Also in small chunks, texts in pieces with the words that follow, and many tries."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3).withColumns(
        {"w1": F.lit("x"), "H": F.lit(1), "n": F.lit(2)})
    assert found(collocations.collocations(df, max_phrases=max_phrases)) == brute(rows)


def test_few_places_and_thresholds(spark):
    rows = corpus(8)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert found(collocations.collocations(df, least=3, nested=90, top=7)) == brute(rows, 3, 90, 7)


def test_words_that_share_a_hash_are_read_again(spark, monkeypatch):
    """With a seed under which two words meet, another one is taken."""
    def bad(lang, words, seed):
        if seed < 2:
            return np.array([1 + len(w) for w in words], np.uint64)
        return real(lang, words, seed)
    real = collocations._word_hash
    monkeypatch.setattr(collocations, "_word_hash", bad)
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert found(collocations.collocations(df)) == brute(rows)


def test_tries_against_counting():
    r = random.Random(2)
    for size in (1, 5, 400):
        phrases = list({(r.choice("ab"), *r.choices(range(1, 60), k=r.randint(1, 3))) for _ in range(size)})
        words = [np.array([p[i] if len(p) > i else 0 for p in phrases], np.uint64) for i in (1, 2, 3)]
        there = [np.array([len(p) > i for p in phrases]) for i in (1, 2, 3)]
        trie = collocations.Trie.load(collocations.Trie.build(
            np.array([p[0] for p in phrases], object), words, there, np.arange(len(phrases))).dump())
        text = r.choices(range(60), k=3000)  # 0 ends a piece
        ids, hashes, starts = np.array(text), np.arange(60).astype(np.uint64), 2500
        total = np.zeros(len(trie.base), np.int64)
        trie.count("a", ids, hashes, starts, total)
        want = Counter(tuple(text[i:i + k]) for i in range(starts) for k in (1, 2, 3))
        for state, p in enumerate(trie.phrase):
            if p >= 0:
                assert total[state] == (want[phrases[p][1:]] if phrases[p][0] == "a" else 0)
        assert sorted(trie.phrase[trie.phrase >= 0]) == list(range(len(phrases)))


def test_query_on_the_smallest_tables(spark):
    from txnlake.llm.queries import QUERIES
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(QUERIES["op13_collocations"](spark, SF)) == brute(rows)


def test_odd_rows(spark):
    long = "salt and pepper " * 200_000
    df = docs(spark, [*ODD_TEXTS, long, "salt and pepper. " * 5, None, ""], lang=None)
    df = df.union(df.limit(4))
    rows = [(r.lang, r.text) for r in df.collect()]
    assert found(collocations.collocations(df)) == brute(rows)
    assert collocations.collocations(df.limit(0)).count() == 0
    assert collocations.collocations(docs(spark, ["a b c"])).count() == 0  # no phrase is frequent


def test_products_beyond_64_bits(spark):
    n = 4_000_000_000
    rows = [("en", 1, None, None, n), ("en", 2, None, None, n + 1), ("en", 1, 2, None, n - 1)]
    df = spark.createDataFrame(rows, "lang string, w1 long, w2 long, w3 long, a long")
    got = collocations.scored(df, 50).first()
    assert got.score == 1000000 * (n - 1) ** 2 // (n * (n + 1))


def test_few_readings_for_many_tries(spark, monkeypatch):
    """Several tries are counted in one reading of the chunks, and none holds too many phrases."""
    names, sizes = [], []
    real = collocations.stored

    def stored(df, name):
        out = real(df, name)
        names.append(name)
        if name == "phrases":
            sizes.extend(r["count"] for r in out.groupBy("shard").count().collect())
        return out
    monkeypatch.setattr(collocations, "stored", stored)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(collocations.collocations(df, max_phrases=40)) == brute(rows)
    assert len(sizes) > 6 and max(sizes) < 80
    assert names.count("trie-counts") <= 1 + sum(sizes) / (40 * 1.5)


def test_chunks_reach_workers_in_batches_of_a_few_megabytes(spark, monkeypatch):
    """However many there are in a file; the session's settings are as before afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, most = spark.conf.get(key, None), []
    real = collocations.candidates

    def candidates(chunks, filters):
        def size(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"size": pa.array([b.nbytes], pa.int64())})
        one = chunks.unionAll(chunks).crossJoin(spark.range(6)).drop("id").coalesce(1)
        most.append(one.mapInArrow(size, "size long").agg(F.max("size"), F.sum("size")).first())
        return real(chunks, filters)
    monkeypatch.setattr(collocations, "candidates", candidates)
    text = "salt and pepper, new york city. " * 150_000
    df = docs(spark, [text], lang="en")
    assert len(found(collocations.collocations(df))) > 0
    largest, all_bytes = most[0]
    assert largest <= 14 << 20 < all_bytes
    assert spark.conf.get(key, None) == before


def test_words_are_joined_to_ties_and_what_is_ahead(spark):
    """First places by numbers, with all that tie; their order by the phrase."""
    words = [("en", i, w, 30) for i, w in enumerate(["z", "b", "y", "a", "x", "é"], 1)]
    words = spark.createDataFrame(words, "lang string, h long, word string, n long")
    rows = [("en", 1, 2, None, 10, 10, 10, 1_000_000), ("en", 3, 4, None, 10, 10, 10, 1_000_000),
            ("en", 5, 6, 1, 10, 10, 10, 1_000_000), ("en", 2, 3, None, 9, 9, 9, 1_000_000),
            ("en", 6, 5, None, 30, 30, 30, 1_000_000)]
    best = spark.createDataFrame(rows, "lang string, w1 long, w2 long, w3 long, a long, l long, r long, score long")
    got = collocations._best(best, words, 3).orderBy("rank").collect()
    assert [(r["rank"], r["phrase"], r["n"]) for r in got] == [(1, "é x", 180), (2, "x é z", 180), (3, "y a", 180)]


def test_filter_lets_few_through(spark, monkeypatch):
    """None of its own is missed; of others, the square of the bits' share, not the share."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 16)
    h = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 100_000)
    own = spark.createDataFrame([(int(x),) for x in h[:3000]], "h long")
    bits = collocations.filter_of(own)
    ok = collocations._has(bits, h.view(np.uint64))
    assert ok[:3000].all() and 0 < ok[3000:].mean() < 0.015  # one bit each: 0.045


def test_a_task_hands_on_a_word_once(spark, monkeypatch):
    """Not once for each chunk that holds it; counts are those of the texts."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)
    rows = corpus(6)
    df = spark.createDataFrame(rows, "lang string, text string").where("text != ''").coalesce(1).selectExpr(
        "coalesce(lang, 'und') AS lang", "text")
    with collocations._set(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "10"}):
        read = collocations.read_texts(df, 0).collect()
    got = Counter()
    for r in read:
        if r.word is not None:
            got[r.lang, r.word] += 1
    assert set(got.values()) == {1} and sum(r.word is None for r in read) > 6
    want = Counter((lang or "und", w) for lang, text in rows for w in re.findall(
        "[^\x20\x09.,;:!?\x0A-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))
    assert {(r.lang, r.word): r.n for r in read if r.word is not None} == want


def test_packed_counts(spark):
    """Of many tasks, by part: sums as counted plainly, in under four bytes a key (as rows, 16)."""
    r, bits = np.random.default_rng(3), collocations.KEY_BITS - 8
    often = r.integers(0, 1 << collocations.KEY_BITS, 50_000)
    often[:3] = 0, (1 << bits) - 1, (1 << collocations.KEY_BITS) - 1  # where parts begin and end
    tasks = [np.unique(np.concatenate([often[i::2], r.integers(0, 1 << collocations.KEY_BITS, 300_000)]))
             for i in (0, 1, 0)]
    batches = [b for keys in tasks for b in collocations._packed(keys, np.arange(len(keys)) % 3 + 1, bits)]
    size = sum(len(x.as_py()) for b in batches for x in b["packed"])
    assert size < 4 * sum(map(len, tasks))
    rows, got = pa.Table.from_batches(batches), {}
    for part in set(rows["part"].to_pylist()):
        key, n = collocations._summed(rows.filter(pa.compute.equal(rows["part"], part)), bits)
        assert (key >> bits == part).all()
        got.update(zip(key.tolist(), n.tolist()))
    want = Counter()
    for keys in tasks:
        want.update(dict(zip(keys.tolist(), (np.arange(len(keys)) % 3 + 1).tolist())))
    assert got == want
    assert not list(collocations._packed(np.zeros(0, np.int64), np.zeros(0, np.int64), bits))
