import random

import pytest

from txnlake.llm import pieces, token_counts

from .data import MODEL, ODD_TEXTS, docs, given, invented

MARK = pieces.MARK


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(MODEL)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return pieces.Encoder(vocabulary)


def brute(v, text):
    """Best segmentation of the whole text by the plain recurrence, all piece lengths tried."""
    s = (" " + text).replace(" ", MARK) if text else ""
    scores = {p: (score, i) for p, score, i in v.pieces}
    best, ids = [0.0] + [float("-inf")] * len(s), [[]] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for size in range(min(end, 40), 0, -1):
            if (got := scores.get(s[end - size:end])) and best[end - size] + got[0] > best[end]:
                best[end], ids[end] = best[end - size] + got[0], ids[end - size] + [got[1]]
        c = s[end - 1]
        if c not in scores and best[end - 1] + v.unknown > best[end]:
            best[end] = best[end - 1] + v.unknown
            ids[end] = ids[end - 1] + [v.bytes[b] for b in c.encode()]
    return ids[-1]


def test_best_segmentation(vocabulary, encoder):
    texts = [t for t in ODD_TEXTS if t is not None and MARK not in t and len(t) < 1000]
    texts += [t for (t,) in given("documents", "text", "length(text) < 1500")[:25]]
    r = random.Random(1)
    texts += ["".join(r.choices("ab  \nthe日é\x00", k=30)) for _ in range(200)]
    for t in texts:
        assert list(encoder.encode(t)) == brute(vocabulary, t), t


def test_round_trip_of_any_text(encoder):
    r = random.Random(2)
    alphabet = [" ", " ", MARK, "\n", "a", "th", "é", "日", "\U0001f600", "\x00", "\t"]
    for t in [t for t in ODD_TEXTS if t is not None] + [
            "".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(500)]:
        assert encoder.decode(encoder.encode(t)) == t


def test_decode_agrees_with_the_library(encoder):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in invented(20):
        assert sp.decode(list(encoder.encode(t))) == t


def test_cache_turnover_changes_nothing(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 5)
    monkeypatch.setattr(token_counts, "CACHE", 5)
    small, count = pieces.Encoder(vocabulary), token_counts.Counter(vocabulary)
    monkeypatch.undo()
    large = pieces.Encoder(vocabulary)
    for t in invented(30):
        assert small.encode(t) == large.encode(t)
        assert count.count([t])[0][1] == len(large.encode(t))


def test_rows(spark):
    df = docs(spark, ODD_TEXTS + ODD_TEXTS[:3]).withColumnRenamed("source", "ids")
    got = {r.doc_id: r for r in pieces.encode_documents(df, MODEL).collect()}
    for i, t in enumerate(ODD_TEXTS + ODD_TEXTS[:3]):
        assert got[i].round_trip is (None if t is None else True)
        assert got[i].n_tokens == (None if t is None else len(got[i].ids))
    assert got[0].ids is None and got[1].ids == []
    assert pieces.encode_documents(df.limit(0), MODEL).count() == 0


def test_output_batches_are_cut(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(pieces, "BATCH_IDS", 10)
    encoder = pieces.Encoder(vocabulary)
    texts = [None, *invented(40), None, "", None]
    rows = pieces.encode_documents(docs(spark, texts), MODEL).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [None if t is None else list(encoder.encode(t)) for t in texts]


def test_counts_equal_encoded_lengths(spark, encoder):
    texts = ODD_TEXTS + [t for (t,) in given("documents", "text")[:60]]
    got = token_counts.token_counts(docs(spark, texts), MODEL).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [None if t is None else len(encoder.encode(t)) for t in texts]
    assert token_counts.token_counts(docs(spark, texts).limit(0), MODEL).count() == 0


def test_stretches_change_nothing(vocabulary, encoder, monkeypatch):
    monkeypatch.setattr(token_counts, "BATCH_CHARS", 16)
    counter = token_counts.Counter(vocabulary)
    texts = invented(20) + ["  a   b    c" * 20, "x" * 200, "a " * 30 + " " * 40 + "b", " ", MARK * 3]
    assert [n for _, n in counter.count(texts)] == [len(encoder.encode(t)) for t in texts]
