"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]:
one warm-up, then the median of $BENCH_RUNS (3) timed runs, each forced through the
`noop` sink (full execution, no collect).  Building the plan (Python and analyzer) and
running it are timed apart.  Then the same queries run over $BENCH_GROWTH (10) times the
rows, made by Spark from the same events (new ids, users and days) in many files, and the
hot-key queries over that table with a third of all rows on one recipient; `growth` gives
run seconds there, so rows a second can be compared between the sizes.

Prints ONE JSON line; `value` is the sum of build and run medians at $BENCH_SF_DIR.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "silver_transactions",
    "fact_transactions_full",
    "dim_users_full",
    "mart_user_risk_score",
    "mart_merchant_risk",
    "mart_hourly_patterns",
    "mart_transaction_type_analysis",
    "mart_anomaly_detection",
    "dim_users_merge",
    "window_features",
    "ledger_running_balance",
]
HOT_SHARE = 3  # one row in three goes to the hot recipient


def timed(query, spark, sf_dir: str) -> tuple[float, float]:
    """(build, run) seconds."""
    t0 = time.perf_counter()
    df = query(spark, sf_dir)
    t1 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return t1 - t0, time.perf_counter() - t1


def grown(spark, sf_dir: str, times: int) -> str:
    """`times` copies of the events in a folder of their own: ids and users shifted by
    copy, two weeks apart."""
    from pyspark.sql import functions as F

    from txnlake.session import scratch_path
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    top = events.agg(F.max("event_id").alias("e"), F.max("user_id").alias("u")).first()
    copy = F.col("copy")
    path = scratch_path(spark, "bench")
    (events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
     .withColumns({"event_id": F.col("event_id") + copy * (top.e + 1),
                   "user_id": F.col("user_id") + copy * (top.u + 1),
                   "ts": F.col("ts") + F.make_dt_interval(copy * 14)})
     .select(events.columns).repartition(4 * times).write.parquet(f"{path}/events.parquet"))
    return path


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    growth = int(os.environ.get("BENCH_GROWTH", "10"))
    from pyspark.sql import functions as F

    from txnlake.operators import features as FT
    from txnlake.operators import ledger as L
    from txnlake.plans import base, registry
    from txnlake.session import build_session
    registry.load_all()
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    build: dict[str, float] = {}
    run: dict[str, float] = {}
    for name in HEADLINE:
        timed(registry.RAW[name], spark, sf_dir)  # warm-up
        samples = [timed(registry.RAW[name], spark, sf_dir) for _ in range(runs)]
        build[name] = round(statistics.median(b for b, _ in samples), 3)
        run[name] = round(statistics.median(r for _, r in samples), 3)
    n_rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()

    def hot(make):
        def query(spark, sf):
            df = make(spark, sf)
            m0 = F.col("txn_seq") % HOT_SHARE == 0
            return df.withColumn("merchant_id", F.when(m0, "M0").otherwise(F.col("merchant_id")))
        return query

    large: dict[str, float] = {}
    if growth > 1:
        large_dir = grown(spark, sf_dir, growth)
        limit = n_rows * growth // 100
        queries = {name: registry.RAW[name] for name in HEADLINE} | {
            "window_features_hot": lambda s, d: FT.window_features(
                hot(base.silver_df)(s, d), max_key_rows=limit),
            "ledger_hot": lambda s, d: L.ledger_running_balance(
                hot(base.fact_df)(s, d), max_account_legs=limit)}
        large = {name: round(timed(q, spark, large_dir)[1], 3) for name, q in queries.items()}
    timings = {k: round(build[k] + run[k], 3) for k in run}
    print(json.dumps({
        "metric": "headline_total_median_sec", "value": round(sum(timings.values()), 3),
        "unit": "sec", "queries": timings, "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": int(cpus), "runs": runs, "input_rows": n_rows, "build": build, "run": run,
        "rows_per_sec": {k: round(n_rows / v) for k, v in run.items() if v},
        "growth": {"times": growth, "input_rows": n_rows * growth, "run": large,
                   "rows_per_sec": {k: round(n_rows * growth / v) for k, v in large.items()}}}))
    spark.stop()


if __name__ == "__main__":
    main()
