"""Hot-key check: one recipient receives a third of all transactions.

Derives the skewed table from the given data (every third row's recipient
becomes `M0`), splits keys over a small task budget, and compares the result with
that of no split.

    python tools/skew_check.py [sf_dir] [max_key_rows]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    budget = int(sys.argv[2]) if len(sys.argv) > 2 else 20_000
    from txnlake.operators import features as FT
    from txnlake.plans.base import silver_df
    from txnlake.session import build_session
    spark = build_session("local[8]", shuffle_partitions=16)
    silver = silver_df(spark, sf)
    skewed = silver.withColumn("merchant_id", F.when(F.col("txn_seq") % 3 == 0, F.lit("M0"))
                               .otherwise(F.col("merchant_id")))
    top = skewed.groupBy("merchant_id").count().agg(F.max("count")).first()[0]
    n = skewed.count()
    print(f"rows {n}, largest recipient {top} ({top / n:.0%}), task budget {budget}")

    def run(df):
        t0 = time.perf_counter()
        rows = sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())
        return rows, time.perf_counter() - t0

    split, ts = run(FT.window_features(skewed, max_key_rows=budget))
    whole, tw = run(FT.window_features(skewed, max_key_rows=n))
    print(f"hot recipient split: {ts:.1f}s; not split: {tw:.1f}s; equal: {split == whole}")

    from txnlake.operators import ledger as L
    from txnlake.plans.base import fact_df
    fact = fact_df(spark, sf).withColumn(
        "merchant_id", F.when(F.col("txn_seq") % 3 == 0, F.lit("M0")).otherwise(F.col("merchant_id")))
    split, ts = run(L.ledger_running_balance(fact, max_account_legs=budget))
    whole, tw = run(L.ledger_running_balance(fact, max_account_legs=2 * n))
    print(f"ledger, hot account split: {ts:.1f}s; not split: {tw:.1f}s; equal: {split == whole}")
    spark.stop()


if __name__ == "__main__":
    main()
