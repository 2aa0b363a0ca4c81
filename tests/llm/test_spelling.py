import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from txnlake.llm import spelling

from .data import ODD_TEXTS, SF, docs


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, least_length=6, least_count=5, every=199):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least_length:
                n[w] += 1
    return {w: c for w, c in n.items() if c >= least_count}


def brute_variants(n, ratio=5):
    near = defaultdict(list)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    for w in n:
        for k in (len(w), len(w) + 1):
            for x in by_length[k]:
                if one_error(w, x):
                    near[w].append(x)
                    if k > len(w):
                        near[x].append(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(rows)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def misspelt(seed, texts=150):
    """Texts of frequent words, rare one-letter variants of them, and variants of the variants."""
    r = random.Random(seed)
    letters = "abcdeéÉzß"
    base = ["".join(r.choices(letters, k=r.randint(5, 9))) for _ in range(25)]

    def slip(w):
        i, c = r.randrange(len(w)), r.choice(letters)
        return r.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])

    rare = [slip(w) for w in base for _ in range(3)]
    rarer = [slip(w) for w in rare]
    return [" ".join(r.choices(base, k=60) + r.choices(rare, k=12) + r.choices(rarer, k=4)) + ","
            for _ in range(texts)]


@pytest.mark.parametrize("block", [4096, 7])
def test_variants_by_brute_force(spark, monkeypatch, block):
    """Also with parts cut into many small blocks."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    texts = misspelt(3)
    df = docs(spark, texts).withColumn("word", F.lit("x")).withColumn("N", F.lit(1))
    want = brute_variants(brute_words(enumerate(texts)))
    got = found(spelling.variant_groups(df))
    assert got == want and len(want) > 80
    assert any(w[1] for w in want) and any(w[2] != w[1] and w[1] for w in want)  # chains


def test_every_near_pair_shares_a_part_once():
    """The index alone, over short words and all lengths from one letter on."""
    r = random.Random(1)
    words = sorted({"".join(r.choices("abcé", k=r.randint(1, 8))) for _ in range(600)})
    n = {w: r.randint(1, 5) for w in words}
    parts, rows = {}, []
    for w in words:
        for c in (len(w), len(w) - 1):
            for by_end in (False, True):
                half = w[len(w) - (c - c // 2):] if by_end else w[:c // 2]
                rows.append((parts.setdefault((c, by_end, half), len(parts)), by_end, c, w, n[w], True, True))
    near, best = Counter(), {}
    for w, k, count, x in spelling.match(rows):
        near[w] += k
        best[w] = min(best.get(w, (0, "")), (-count, x)) if w in best else (-count, x)
    for w in words:
        want = [x for x in words if one_error(w, x)]
        assert near[w] == len(want)
        assert best.get(w) == min(((-n[x], x) for x in want), default=None)


def test_query_on_the_smallest_tables(spark):
    from txnlake.llm.queries import QUERIES
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert found(QUERIES["op12_spelling_variants"](spark, SF)) == brute_variants(brute_words(rows))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 1000)
    texts = [*ODD_TEXTS, "wording " * 30_000, "words×apart" * 40, None, "", "wordimg " * 9]
    texts += ["y" * 5000 + " "] * 5 + ["y" * 4999 + "x "] * 40  # long runs that are near
    df = docs(spark, texts)
    df = df.withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id"))).union(df.limit(5))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute_variants(brute_words(rows))
    assert found(spelling.variant_groups(df)) == want and any(len(w[0]) > 4000 and w[4] for w in want)
    assert spelling.variant_groups(df.limit(0)).count() == 0


def test_ties_and_ratio(spark):
    words = spark.createDataFrame([("wordab", 10), ("wordac", 50), ("wordad", 50), ("wordabc", 49),
                                   ("lonely", 7), ("étéwor", 3), ("etewor", 99)], "word string, n long")
    got = {r.word: r for r in spelling.variants(words).collect()}
    assert (got["wordab"].form, got["wordab"].n_near, got["wordab"].form_n) == ("wordac", 3, 50)
    assert got["wordac"].form is None and got["wordac"].n_near == 3  # wordab, wordad, wordabc
    assert (got["lonely"].root, got["lonely"].n_near) == ("lonely", 0)
    assert got["étéwor"].n_near == 0  # two replaced letters
