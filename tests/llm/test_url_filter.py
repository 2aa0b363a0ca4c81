import random

import pytest

from txnlake.llm import url_filter
from txnlake.llm.queries import URL_RULES

URLS = [None, "", "no scheme", "http://", "http://x.org", "http://x.org/", "HTTPS://M.Example.ORG/es/1",
        "https://a.example.org/en/15?x=1", "https://example.org/en/25#t", "http://badexample.org/es/",
        "http://q.com/fr/1", "http://q.com/de/", "http://q.com?u=://z.org/es/", "http://org:80/a",
        "x://y://z.org/a", "http://..org/a", "http://É.ORG/a", "http://example.org/en/1"]


def brute(rules, url, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[:min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for a, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, False, None, default))
    return host, path, best[3], best[4]


@pytest.mark.parametrize("limit", [1_000_000, 0], ids=["trie", "join"])
def test_verdicts(spark, limit):
    r = random.Random(5)
    hosts, paths = ["org", "a.org", "b.a.org", "com", "x.com"], ["/", "", "/a", "/a/", "/a/b", "/b/c/d", "/ab"]
    urls = URLS + [f"http://{r.choice(['', 'm.', 'q.r.'])}{r.choice(hosts)}{r.choice(paths)}"
                   f"{r.choice(['', 'x', '/y', '?z', '#w/'])}" for _ in range(150)]
    more = [(r.choice(["allow", "block"]), h, p) for h in hosts for p in paths]
    df = spark.createDataFrame([(None if i == 3 else i, u, "h", "p") for i, u in enumerate(urls)],
                               "page_id long, url string, host string, rule string")
    for rules in (URL_RULES, more, []):
        got = url_filter.url_verdicts(df.union(df), rules, max_trie_chars=limit).collect()
        want = [(None if i == 3 else i, *brute(rules, u)) for i, u in enumerate(urls)] * 2
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert url_filter.url_verdicts(df.limit(0), URL_RULES, max_trie_chars=limit).count() == 0
