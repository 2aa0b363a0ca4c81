from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from txnlake.functions.columns import epoch_seconds

from txnlake.operators import features as FT
from txnlake.plans.base import silver_df

from .conftest import SF01


SPLIT, WHOLE = 0, 1 << 40  # every key split into buckets / none


def textbook(silver, seq="txn_seq"):
    """One window partition per key, doubles summed as decimals: the brute-force check."""
    tb = F.col(seq) if seq else F.xxhash64(*FT.HASH_TIEBREAK)
    df = silver.withColumns({"_ts": epoch_seconds("transaction_time"), "_tb": tb,
                             "_x": F.col("amount").cast(FT.EXACT)})
    for key, p in (("merchant_id", "dest"), ("user_id", "orig")):
        w = Window.partitionBy(key).orderBy("_ts", "transaction_time", "_tb")
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        wts = Window.partitionBy(key).orderBy("_ts")
        cols = {f"{p}_delta_seconds": F.col("_ts") - F.lag("transaction_time").over(w).cast("long")}
        for label, secs in FT.RANGES.items():
            frame = wts.rangeBetween(-secs, -1)
            cols[f"{p}_msg_count_{label}"] = F.count(F.lit(1)).over(frame)
            cols[f"{p}_amount_sum_{label}"] = F.sum("_x").over(frame).cast("double")
        cols[f"{p}_count_past"] = F.count(F.lit(1)).over(past)
        total = F.sum("_x").over(past).cast("double")
        cols[f"{p}_sum_amount_past"] = total
        cols[f"{p}_history_fraud_count"] = F.sum("isFraud").over(past)
        if p == "orig":
            cols["orig_prev_amount"] = F.lag("amount").over(w)
            cols["orig_avg_amount_past"] = total / F.nullif(F.count("amount").over(past), F.lit(0))
        df = df.withColumns(cols)
    return FT.feature_projection(FT.pattern_features(df))


def _norm(df):
    return sorted(repr(tuple(r)) for r in df.select(sorted(df.columns)).collect())


def _silver(spark, rows):
    """rows: (seq, merchant, user, time, amount, fraud)"""
    base = spark.createDataFrame(rows, "txn_seq long, merchant_id string, user_id string, "
                                       "transaction_time timestamp, amount double, isFraud byte")
    return base.withColumns({"type": F.lit("TRANSFER"), "hour_of_day": F.lit(1).cast("byte"),
                             "day_of_week": F.lit(2).cast("byte"),
                             "is_transfer": F.lit(1).cast("byte"),
                             "is_cash_out": F.lit(0).cast("byte")})


def test_bucketed_equals_direct_on_sf001(spark):
    silver = silver_df(spark, SF01)
    assert _norm(FT.window_features(silver, max_key_rows=SPLIT)) == \
        _norm(textbook(silver))


def test_window_edges_same_second_and_first_row(spark):
    t0 = datetime(2024, 1, 1, 12, 0, 0)
    gaps = [0, 3599, 3600, 3601, 86400, 86401]
    rows = [(i, "M1", "C1", t0 + timedelta(seconds=g), 10.0 * (i + 1), 0)
            for i, g in enumerate(gaps)]
    rows.append((99, "M1", "C2", t0 + timedelta(seconds=3600, microseconds=500), 5.0, 1))
    for limit in (SPLIT, 3, WHOLE):
        _check_edges({r.txn_seq: r for r in
                      FT.window_features(_silver(spark, rows), max_key_rows=limit).collect()})


def _check_edges(out):
    first = out[0]
    assert first.dest_count_past == 0 and first.dest_sum_amount_past is None
    assert first.dest_delta_seconds is None and first.orig_prev_amount is None
    assert first.dest_msg_count_1h == 0 and first.dest_amount_sum_1h is None
    # t0+3600: frame [t0, t0+3599] holds rows at 0 and 3599; its same-second peer (99) is excluded
    assert out[2].dest_msg_count_1h == 2 and out[99].dest_msg_count_1h == 2
    # t0+3601: frame [t0+1, t0+3600] -> 3599, 3600 and the peer at 3600.0005
    assert out[3].dest_msg_count_1h == 3
    # t0+86400: 24h frame [t0, t0+86399] -> everything before it (5 rows incl. peer)
    assert out[4].dest_msg_count_24h == 5
    # t0+86401: frame [t0+1, t0+86400] drops the row at t0
    assert out[5].dest_msg_count_24h == 5 and out[5].dest_count_past == 6
    assert out[5].dest_history_fraud_count == 1


def test_hot_key_spanning_many_days_matches_direct(spark):
    """One merchant holds most rows, over 12 days with an empty-day gap."""
    t0 = datetime(2024, 1, 1)
    rows = []
    seq = 0
    for day in list(range(5)) + list(range(7, 12)):
        for k in range(40):
            t = t0 + timedelta(days=day, seconds=k * 1800 + (k % 3))
            rows.append((seq, "M1" if k % 5 else "M2", f"C{k % 4}", t, float(seq % 17 + 1),
                         1 if seq % 11 == 0 else 0))
            seq += 1
    df = _silver(spark, rows)
    direct = _norm(textbook(df))
    for width in (1, 60, 3600, 86400):
        assert _norm(FT.window_features(df, max_key_rows=SPLIT, bucket_seconds=width)) == direct
    # only the hot recipient is split
    assert _norm(FT.window_features(df, max_key_rows=100)) == direct
    assert [r[0] for r in FT.hot_keys(df, F.col("merchant_id"), 100).collect()] == ["M1"]


def test_future_rows_do_not_leak(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, "M1", "C1", t0 + timedelta(minutes=10 * i), 1.0, 0) for i in range(6)]
    df = _silver(spark, rows)
    full = {r.txn_seq: r for r in FT.window_features(df, max_key_rows=SPLIT).collect()}
    cut = {r.txn_seq: r for r in
           FT.window_features(df.filter("txn_seq <= 2"), max_key_rows=SPLIT).collect()}
    for k in cut:
        assert cut[k].asDict() == full[k].asDict()


def test_without_tiebreak_column_matches_direct(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, "M1" if i % 3 else "M2", f"C{i % 2}", t0 + timedelta(hours=5 * (i // 2)),
             float(i + 1), i % 2) for i in range(30)]
    df = _silver(spark, rows).drop("txn_seq")
    a = FT.window_features(df, seq=None, max_key_rows=SPLIT)
    b = textbook(df, seq=None)
    assert _norm(a) == _norm(b)


def test_null_keys_group_together_in_both_plans(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(i, None if i % 3 == 0 else "M1", None if i % 4 == 0 else "C1",
             t0 + timedelta(minutes=37 * i), float(i + 1), 1 if i % 5 == 0 else 0)
            for i in range(40)]
    df = _silver(spark, rows)
    assert _norm(FT.window_features(df, max_key_rows=SPLIT)) == \
        _norm(textbook(df))


def test_dense_rows_without_times_and_amounts_in_every_split(spark):
    """Many rows in a minute and in a second, rows without a time or an amount: the same
    values, to the last bit, however keys are split."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"M{i * i % 3}", f"C{i % 5}",
             None if i % 13 == 0 else t0 + timedelta(milliseconds=i * 7919 % 5400 * 333),
             None if i % 7 == 0 else i * 0.37 + 0.1, None if i % 17 == 0 else i % 2)
            for i in range(1500)]
    df = _silver(spark, rows)
    want = _norm(textbook(df))
    for limit in (SPLIT, 400, WHOLE):
        assert _norm(FT.window_features(df, max_key_rows=limit)) == want


def test_no_rows(spark):
    assert FT.window_features(_silver(spark, []), max_key_rows=SPLIT).count() == 0


def _key_of_a_day(spark, n):
    return spark.range(n).selectExpr(
        "id AS txn_seq", "'M1' AS merchant_id", "concat('C', id) AS user_id",
        "timestamp_seconds(1704067200 + (id * 7919) % 86400) AS transaction_time",
        "double(id % 100) AS amount", "cast(0 AS byte) AS isFraud")


def test_one_key_with_all_its_rows_in_a_day(spark):
    """No frame slides over its rows again: 200,000 rows of one day, against DuckDB."""
    import duckdb
    df = _key_of_a_day(spark, 200_000)
    got = FT.dest_window_features(df).selectExpr(
        "sum(dest_msg_count_1h) AS n1", "sum(dest_msg_count_24h) AS n24",
        "sum(cast(dest_amount_sum_1h AS decimal(38,2))) AS s1", "sum(dest_count_past) AS past").first()
    rows = df.selectExpr("unix_seconds(transaction_time) AS t", "amount").toPandas()  # noqa: F841
    want = duckdb.sql("""WITH w AS (SELECT count(*) OVER h AS n1, count(*) OVER d AS n24,
            coalesce(sum(amount) OVER h, 0) AS s1 FROM rows
            WINDOW h AS (ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING),
                   d AS (ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING))
            SELECT sum(n1), sum(n24), sum(s1) FROM w""")
    n1, n24, s1 = want.fetchall()[0]
    assert (got.n1, got.n24, float(got.s1)) == (n1, n24, s1)
    assert got.past == 200_000 * 199_999 // 2


def test_no_frame_slides(spark):
    plan = FT.window_features(_silver(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan.replace("$", "").lower() and "-3600" not in plan


def test_amounts_beyond_the_sums(spark):
    """NaN, infinite and huge amounts are rows without an amount in sums; no job ends."""
    t0 = datetime(2024, 1, 1)
    amounts = [1.0, float("nan"), 1e30, float("inf"), -1e30, None, 2.0, 4.0]
    rows = [(i, "M1", "C1", t0 + timedelta(minutes=i), a, 0) for i, a in enumerate(amounts)]
    for limit in (SPLIT, WHOLE):
        got = {r.txn_seq: r for r in FT.window_features(_silver(spark, rows), max_key_rows=limit).collect()}
        assert [got[i].dest_amount_sum_1h for i in range(8)] == [None, *[1.0] * 6, 3.0]
        assert [got[i].dest_msg_count_1h for i in range(8)] == list(range(8))
        assert got[7].orig_sum_amount_past == 3.0 and got[7].orig_avg_amount_past == 1.5
        assert got[3].orig_prev_amount == 1e30


def test_days_one_by_one_equal_runs_over_the_whole_window(spark):
    """Every day from its own and yesterday's rows and the daily totals, in a window that slides, as
    a run over all rows of the window; with hot keys split, or not."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"M{i * i % 5}", None if i % 11 == 0 else f"C{i % 7}",
             t0 + timedelta(seconds=(i * 7919 * 13) % (9 * 86400)),
             None if i % 13 == 0 else i * 0.25, i % 3 % 2) for i in range(900)]
    silver = _silver(spark, rows).withColumn("part_dt", F.date_format("transaction_time", "yyyyMMdd"))
    dest, orig = FT.daily_totals(silver, "merchant_id"), FT.daily_totals(silver, "user_id")
    dates = [(t0 + timedelta(days=d)).strftime("%Y%m%d") for d in range(9)]
    for d, limit in ((1, WHOLE), (4, 20), (8, SPLIT), (8, WHOLE)):
        first = dates[max(0, d - 5)]  # a window of six dates
        two = silver.filter(F.col("part_dt").isin(dates[d - 1], dates[d]))
        got = FT.day_window_features(two, dest, orig, first, dates[d - 1], dates[d], max_key_rows=limit)
        whole = silver.filter(F.col("part_dt").between(first, dates[d]))
        want = textbook(whole).filter(F.date_format("transaction_time", "yyyyMMdd") == dates[d])
        assert got.count() > 50 and _norm(got) == _norm(want)
