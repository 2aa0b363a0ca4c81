import math
import random

import numpy as np
from pyspark.sql import functions as F

from txnlake.llm import topk

FIELDS = "vec_id long, embedding array<double>, rank string"


def brute(rows, k, every):
    ints = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None
            and v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for q, a in ints:
        if q % every == 0:
            best = sorted((-max(min(sum(x * y for x, y in zip(a, b)), (1 << 63) - 1), -1 << 63), i)
                          for i, b in ints if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, every, **sizes):
    df = spark.createDataFrame(rows, FIELDS)
    got = topk.top_k(df, F.col("vec_id") % every == 0, **sizes)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_against_all_pairs(spark):
    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)], "z") for i in range(400)]
    rows += [(400 + i, rows[r.randrange(30)][1], "z") for i in range(200)]  # ties
    want = brute(rows, 5, 7)
    assert run(spark, rows, 7) == want
    assert run(spark, rows, 7, block_rows=9, shard_rows=11, shards_per_group=2, fan=3) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "z"), (1, [0.5, -0.001], "z"), (2, None, "z"), (3, [1.0, None], "z"),
            (4, [nan, 1.0], "z"), (5, [inf, 1.0], "z"), (None, [1.0, 1.0], "z"), (6, [1.0], "z"),
            (7, [], "z"), (10, [], "z"), (8, [1e306, 1.0], "z"), (20, [3.0, 3.0], "z"),
            (9, [1e17, -1e17], "z"), (30, [1e17, 1.0], "z"), (40, [7.0, 7.0, 7.0], "z"), (1, [0.5, 0.5], "z")]
    assert run(spark, rows, 10) == brute(rows, 5, 10)
    assert run(spark, rows[:1], 10) == [] and run(spark, [], 10) == []


def test_tile_beyond_exact_floats():
    q = np.array([[2.0 ** 30, 1.0]])
    c = np.array([[2.0 ** 30, 3.0], [2.0 ** 30, 4.0], [2.0 ** 30, 4.0]])
    pos, ids, score = topk.tile_top(np.array([9]), q, np.array([1, 2, 3]), c, 2)
    assert ids.tolist() == [2, 3] and score == [2 ** 60 + 4] * 2
