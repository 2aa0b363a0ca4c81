import random

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from txnlake.llm import decontam

from .data import ODD_TEXTS, SF, docs, invented

ITEM = "item_id long, text string"
QUESTION = ("A train leaves the station with Maria at 40 km per hour and after 3 hours Maria has "
            "covered 120 km of the whole way home")


def leaks(df, bench, **p):
    return sorted((tuple(r)[:2] for r in decontam.find_leaks(df, bench, **p).collect()), key=str)


def test_reparameterised_questions(spark):
    other = (QUESTION.replace("40", "55").replace("3 hours", "2 hours").replace("120", "110")
             .replace("Maria", "Otto").replace("km", "miles"))
    mixed = QUESTION.replace("with Maria", "with Otto").replace("40 km", "40 miles")
    lower = QUESTION.upper()
    bench = spark.createDataFrame([(1, QUESTION)], ITEM)
    df = docs(spark, [QUESTION, "Before. " + other + " and after.", lower,
                      "the train leaves the station", mixed])
    rows = {r.doc_id: r for r in decontam.find_leaks(df, bench).collect()}
    assert not rows[0].reparameterised and rows[0].coverage == 1
    assert rows[1].reparameterised and rows[1].coverage >= 0.9
    assert 3 not in rows
    assert 4 not in rows or rows[4].coverage < rows[0].coverage  # inconsistent slots


def test_word_shingles_by_brute_force(spark, monkeypatch):
    """Every item that stands whole in a text is found, and no other."""
    r = random.Random(14)
    items, fill = invented(30, seed=5, least=8, most=40), invented(200, seed=6)
    texts, truth = [], set()
    for i, t in enumerate(fill):
        if i % 3 == 0:
            n = r.randrange(30)
            words, at = t.split(), r.randrange(5)
            texts.append(" ".join(words[:at] + [items[n]] + words[at:]))
            truth.add((i, n))
        elif i % 3 == 1:  # too little of an item
            n = r.randrange(30)
            words = items[n].split()
            texts.append(t + " " + " ".join(words[:max(5, len(words) // 3)]))
        else:
            texts.append(t)
    truth = {(i, n) for i, t in enumerate(texts) for n, item in enumerate(items) if item in t}
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    got = set(leaks(docs(spark, texts), bench))
    assert truth <= got
    for i, n in got - truth:  # at least half of the item's words stand there
        w = items[n].split()
        assert any(" ".join(w[a:a + len(w) // 2]) in texts[i] for a in range(len(w) // 2 + 2))
    monkeypatch.setattr(decontam, "PIECE_WORDS", 9)
    assert set(leaks(docs(spark, texts), bench)) == got


def test_query_against_containment(spark):
    from txnlake.llm.queries import QUERIES
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()

    def plain(t):
        return " ".join((t or "").lower().split())

    want = {(r.doc_id, b.item_id) for r in rows for b in items if plain(b.text) in plain(r.text)}
    assert want and want <= got
    assert len({d for d, _ in got - want}) <= 0.01 * len(rows)


@pytest.mark.parametrize("bits", [28, 6])
def test_odd_rows(spark, monkeypatch, bits):
    """Also with a filter so small that nearly everything passes it."""
    monkeypatch.setattr(decontam, "MAX_FILTER_BITS", bits)
    item = invented(1, seed=8)[0]
    bench = spark.createDataFrame([(1, item), (None, item), (2, None), (3, ""), (4, "two words"),
                                   (1, item), (5, "... !!! ???")], ITEM)
    df = docs(spark, [*ODD_TEXTS, item, "two words", item]).withColumn("item_id", F.lit("x"))
    df = df.withColumn("doc_id", F.when(F.col("doc_id") != 0, F.col("doc_id")))
    n = len(ODD_TEXTS)
    assert leaks(df, bench) == sorted(
        [(d, i) for d in (n, n + 2) for i in (1, 1, None)], key=str)
    kept = decontam.without_leaks(df, bench)
    assert kept.columns == df.columns and kept.count() == n + 1
    assert leaks(df.limit(0), bench) == [] and leaks(df, bench.limit(0)) == []


def test_case_and_sentence_openings(spark):
    """Copies in upper, lower and title case, and after words that end no sentence."""
    short = "Anna weighs three apples on Monday in Paris"
    bench = spark.createDataFrame([(1, QUESTION), (2, short)], ITEM)
    df = docs(spark, [f(t) for t in (QUESTION, short) for f in (str.upper, str.lower, str.title)]
              + ["Heading\n" + short, "He said (" + short + ")"])
    assert leaks(df, bench) == [(0, 1), (1, 1), (2, 1), (3, 2), (4, 2), (5, 2), (6, 2), (7, 2)]


def test_edited_copies_and_quotations(spark):
    """A word put in or left out in the middle; 20 words quoted from a long item."""
    items = [" ".join(invented(1, seed=60 + n, least=n, most=n)) for n in (18, 30, 60, 100)]
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    texts, want = [], []
    for n, item in enumerate(items):
        w = item.split()
        half = len(w) // 2
        texts += [" ".join(w[:half] + ["extra"] + w[half:]), " ".join(w[:half] + w[half + 1:])]
        want += [(2 * n, n), (2 * n + 1, n)]
    long = items[3].split()
    texts += ["He wrote " + " ".join(long[40:60]) + " once", " ".join(long[40:59])]
    assert leaks(docs(spark, texts), bench) == want + [(8, 3)]


def test_items_of_numbers_and_names(spark):
    """Items too general as templates are found word for word, and only so."""
    items = ["1 2 4 8 16 32 64 128", "12 km 7 miles 30 feet 5 yards 9 inches 3 m",
             "Choose Anna Otto Maria Paul Eva Karl Nina Hugo"]
    bench = spark.createDataFrame(list(enumerate(items)), ITEM)
    texts = [f"See {t} here" for t in items] + ["see 1 2 4 8 16 32 64 129 here",
                                                "13 mg 8 kg 31 g 6 volts 10 watts 4 s"]
    assert leaks(docs(spark, texts), bench) == [(0, 0), (1, 1), (2, 2)]


@pytest.mark.parametrize("kind", ["int", "string", "decimal(20,3)", "date"])
def test_ids_of_any_type(spark, kind):
    item = invented(1, seed=8)[0]
    value = {"date": "date '2024-01-02'"}.get(kind, f"cast('7' AS {kind})")
    bench = spark.createDataFrame([(item,), (item,)], "text string").selectExpr(f"{value} AS item_id", "text")
    df = docs(spark, [item, "x"]).selectExpr(f"{value} AS doc_id", "text")
    got = decontam.find_leaks(df, bench)
    assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert got.count() == 2 and {tuple(r)[:2] for r in got.collect()} == {
        (df.first()[0], bench.first()[0])}


def test_recall_of_reparameterised_items(spark):
    """Questions with other numbers, units and names in text of other words; and questions with
    inconsistent slots, and other questions of the same form, stay."""
    r = random.Random(77)
    names, units = ["Maria", "Otto", "Paul", "Eva", "Nina", "Hugo"], ["km", "miles", "kg", "litres"]
    fill = invented(80, seed=9, least=14, most=30)
    items, texts, want = [], [], set()

    def question(words, who, unit, a, b):
        w = words.split()
        return " ".join([*w[:5], who, *w[5:8], str(a), unit, *w[8:11], who, str(b), unit, *w[11:]])

    for i, words in enumerate(fill[:60]):
        who, unit = r.choice(names), r.choice(units)
        items.append(question(words, who, unit, r.randrange(100, 999), r.randrange(1000, 9999)))
        other = question(words, r.choice([n for n in names if n != who]),
                         r.choice([u for u in units if u != unit]), r.randrange(100, 999), r.randrange(1000, 9999))
        texts.append("some words before. then " + other + " and after it")
        want.add((i, i))
    texts += fill[60:]
    got = {(x.doc_id, x.item_id): x.reparameterised for x in decontam.find_leaks(
        docs(spark, texts), spark.createDataFrame(list(enumerate(items)), ITEM)).collect()}
    assert len(want & set(got)) >= 0.9 * len(want) and set(got) <= want
    assert all(got.values())


def test_texts_read_together_hit_as_each_by_itself(monkeypatch):
    """Windows don't reach from a text into the next, a text begins a sentence, and pieces of long
    texts give what the whole does; short texts come many in a block."""
    import numpy as np
    r = random.Random(31)
    words = ["alpha", "Beta", "gamma.", "12", "km", "(delta)", "Epsilon", "zeta", "eta!", "3,5"]
    texts = [" ".join(r.choices(words, k=r.choice([0, 1, 2, 7, 30]))) for _ in range(600)]
    texts.append(" ".join(r.choices(words, k=700)))
    bits = (np.random.default_rng(1).random(1 << 22) < 0.3).astype(np.uint8)
    kinds = [(2, 0), (3, 1), (3, 2), (8, 3)]

    def alone(n, text):
        raw = text.split()
        found = []
        for size, reading in kinds:
            h = decontam.hashes(decontam.Reader().readings(raw)[reading], size) if raw else np.zeros(0, np.uint64)
            found += [(n, -n, size, reading, int(h[i:i + 1].view(np.int64)[0]), i,
                       [w.strip(decontam.EDGES).lower() for w in raw[i:i + size]])
                      for i in decontam._hits(bits, h).tolist()]
        return found

    want = sorted(x for n, t in enumerate(texts) for x in alone(n, t))
    marked = [((n, -n), t) for n, t in enumerate(texts)]
    for piece in (decontam.PIECE_WORDS, 100, 31):
        monkeypatch.setattr(decontam, "PIECE_WORDS", piece)
        made = list(decontam.blocks(marked, 8))
        reader = decontam.Reader()
        assert sorted(x for b in made for x in b.hits(reader, bits, kinds)) == want
        if piece > 1000:
            assert len(made) == 1
    assert len(want) > 1000


def test_words_are_learned_together(monkeypatch):
    """Those new in a block in one go, with the codes and marks that each has by itself."""
    calls, real = [], decontam.Reader._learn
    monkeypatch.setattr(decontam.Reader, "_learn", lambda self, new: (calls.append(new), real(self, new))[1])
    monkeypatch.setattr(decontam, "CACHE", 60)
    odd = ["12", "+1,000.5", "(3:45)", "1.", "-", "...", "²", "x²", "a1", "1a", "٣", "٣.٤", "½", "KM", "km.", "%", "$5",
           "Ünd!", "é", "İ", "Word", "word?", "WORD", "1/2", "1//2", "Ⅷ", "a:", "ß", "“Quote”", "\ud800"]
    reader = decontam.Reader()
    for words in (odd, odd[::-1], [f"w{i}" for i in range(70)], odd * 2):
        got = reader.readings(words)
        bare = [w.strip(decontam.EDGES) for w in words]
        for i, (w, b) in enumerate(zip(words, bare)):
            code = max(decontam.FIRST, xxhash.xxh64_intdigest(b.lower().encode("utf-8", "surrogatepass")))
            kind = (decontam.NUMBER if decontam.NUMERIC.fullmatch(b) else
                    decontam.UNIT if b.lower() in decontam.UNITS else 0)
            name, begins = b[:1].isupper() and not kind, i == 0 or words[i - 1][-1] in ".!?:"
            assert [int(r[i]) for r in got] == [
                decontam.NAME if name and not begins else kind or code, decontam.NAME if name else kind or code,
                kind if kind == decontam.NUMBER else code, code]
    assert [len(c) for c in calls] == [len(odd), 70, len(odd)]


def test_lists_of_a_part_of_an_array():
    cells = pa.array([[1], [2, 3], [], [4, 5, 6]])
    assert decontam._lists(cells) == [[1], [2, 3], [], [4, 5, 6]]
    assert decontam._lists(cells.slice(1, 3)) == [[2, 3], [], [4, 5, 6]] and decontam._lists(cells[:0]) == []
