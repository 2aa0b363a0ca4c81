import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from txnlake.llm import secret_scan

from .data import ODD_TEXTS, SF, docs, invented


def brute(text):
    """The contract's patterns, taken word for word."""
    text, found = text or "", []
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "api_?key"))
    for kind, pattern, least, group in (
            (0, rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
            (1, "AKIA[A-Z0-9]+", 20, 0), (2, "[0-9a-f]+", 24, 0)):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text)
                  if len(m[group]) >= least]
    return sorted(found)


def test_base_spans():
    r = random.Random(9)
    bits = ["password", "PassWD", "api_key", "APIKEY", "apikey", "token", "to\u212aen", "\u017fecret",
            "=", ":", " ", '"', "'", "abc", "abcdef", "AKIA", "A" * 16, "Z9" * 8, "0a" * 12, "f" * 23,
            "\n", "é", ".", "G", "-"]
    for _ in range(4000):
        t = "".join(r.choices(bits, k=r.randint(1, 9)))
        assert secret_scan.base_spans(t) == brute(t), t


def test_candidates():
    r = random.Random(10)
    for _ in range(3000):
        t = "".join(r.choices("ab1 =/é.", k=r.randint(0, 60)))
        assert secret_scan.candidates(t) == [
            m.span() for m in re.finditer("[A-Za-z0-9+/_=-]{12,}", t) if re.search("[0-9]", m[0])]
    assert secret_scan.candidates("a" * 300_000 + "1") == [(0, 300_001)]


def test_gradients():
    net, r = secret_scan.Network.new(), np.random.default_rng(0)
    views = r.integers(-12, 12, (200, secret_scan.WIDTH))
    y = (views[:, 20] > 0).astype(np.float32)
    before = net.logits(views)
    net.train(views, y, epochs=150)
    loss = [np.logaddexp(0, np.where(y > 0, -z, z)).mean() for z in (before, net.logits(views))]
    assert loss[1] < 0.8 * loss[0]


def findings(n, seed):
    r, out = random.Random(seed), []
    for i, t in enumerate(invented(n, seed=seed)):
        words = t.split()
        key = "".join(r.choices("0123456789abcdef", k=r.choice([18, 32, 40])))
        number = "".join(r.choices("0123456789", k=16))
        put = [f"password={key}", f'token = "{key}"', number, f"no{number}", None][i % 5]
        if put:
            words.insert(r.randrange(len(words)), put)
        out.append(" ".join(words))
    return out


def test_network_finds_secrets_without_their_keyword(spark):
    net = secret_scan.fit(docs(spark, findings(600, 1)))
    r = random.Random(12)
    keys = ["".join(r.choices("0123456789abcdef", k=20)) for _ in range(50)]
    found = [secret_scan.all_spans(f"the value is {k} and more", net) for k in keys]
    assert all(not secret_scan.base_spans(f"the value is {k} and more") for k in keys)
    assert sum(len(f) == 1 and f[0][1] == 3 for f in found) >= 40
    clean = ["".join(r.choices("0123456789", k=16)) for _ in range(50)]
    assert not any(secret_scan.all_spans(f"paid with {c} today", net) for c in clean)


def test_rows(spark):
    texts = findings(300, 2) + ODD_TEXTS
    df = docs(spark, texts).withColumn("spans", F.lit(3)).withColumn("n_hex", F.lit("x"))
    df = df.union(df.limit(2))
    rows = secret_scan.scan(df).collect()
    assert len(rows) == len(texts) + 2
    for x in rows:
        base = brute(texts[x.doc_id] or "") if len(texts[x.doc_id] or "") < 10_000 else []
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in base)
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == i for _, k, _ in base)
                                                          for i in range(3))
        assert x.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(x.spans.split(","))
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_query_against_the_patterns(spark):
    from txnlake.llm.queries import QUERIES
    got = {r.doc_id: r for r in QUERIES["op6_secret_scan"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        told = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in brute(r.text))
        assert got[r.doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest()


def test_redaction_takes_effect(spark):
    df = docs(spark, findings(300, 3) + [None, ""]).withColumn("extra", F.lit(1))
    got = secret_scan.redacted(df)
    assert got.columns == df.columns
    rows = {r.doc_id: r for r in got.collect()}
    assert len(rows) == 302 and rows[300].text is None and rows[301].text == ""
    for r in rows.values():
        assert not brute(r.text) and r.n_chars == (None if r.text is None else len(r.text))
    assert secret_scan.redact("ab12cd", [(0, 0, 2), (1, 1, 3), (4, 2, 5)], "*") == "*2*d"


def test_no_labelled_findings(spark):
    assert secret_scan.fit(docs(spark, ["plain words", None])) is None


def test_secrets_inside_long_runs(spark):
    r = random.Random(13)

    def numbers(k):
        return ["".join(r.choices("0123456789", k=7)) for _ in range(k)]

    clean = [f"see {r.choice('/=_').join(numbers(r.randint(2, 24)))} there" for _ in range(600)]
    net = secret_scan.fit(docs(spark, findings(1200, 1) + clean))
    found = {"/": 0, "=": 0, "_": 0}
    for sign in found:
        for _ in range(50):
            key = "".join(r.choices("0123456789abcdef", k=20))
            text = f"see {sign.join([*numbers(12), key, *numbers(12)])} there"
            if secret_scan.base_spans(text):
                continue
            at = text.index(key)
            found[sign] += any(s < at + 20 and at < e for s, _, e in secret_scan.all_spans(text, net))
    assert found["/"] >= 30 and found["="] >= 30 and found["_"] >= 10, found
    assert sum(bool(secret_scan.all_spans(t, net)) for t in clean[:100]) <= 20


def test_every_finding_is_learned_from(spark):
    """More than 1,500 of either label: none is left out, and a shape that a few have is known."""
    r = random.Random(14)
    texts = findings(6000, 4) + [f"token={''.join(r.choices('QRSTUVWXYZ234567', k=26))} {i}"
                                 for i in range(60)]
    df = docs(spark, texts + texts[:50])
    brute_rows = [any(s < b and a < e for s, _, e in brute(t)) for t in texts
                  for a, b in secret_scan.candidates(t)]
    got = [x.y for x in secret_scan.labelled(df).collect()]
    assert sum(got) == sum(brute_rows) > 1500 and len(got) == len(brute_rows) > sum(got) + 1500
    net = secret_scan.fit(df)
    again = secret_scan.fit(df.repartition(5))
    assert (net.conv == again.conv).all() and abs(net.threshold - again.threshold) < 1e-6
    keys = ["".join(r.choices("QRSTUVWXYZ234567", k=26)) for _ in range(50)]
    assert sum(bool(secret_scan.all_spans(f"the value is {k} and more", net)) for k in keys) >= 40
    clean = ["".join(r.choices("0123456789", k=16)) for _ in range(50)]
    assert not any(secret_scan.all_spans(f"paid with {c} today", net) for c in clean)


def test_order_statistics(spark):
    from txnlake.llm.common import order_statistics
    r = random.Random(15)
    rows = [(k, float(r.randint(0, 400))) for k in "abc" for _ in range(r.randint(1, 900))]
    got = order_statistics(spark.createDataFrame(rows, "k string, v double").repartition(6),
                           "k", "v", lambda n: [0, n // 3, n - 1])
    for k in "abc":
        own = sorted(v for x, v in rows if x == k)
        assert got[k] == [own[0], own[len(own) // 3], own[-1]]
