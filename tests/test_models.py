from datetime import datetime

from pyspark.sql import functions as F

from txnlake.operators import models as M


def _fact(spark, rows):
    """rows: (user, fraud, emptied, dest_zero, err_orig, hour, amount)"""
    df = spark.createDataFrame(rows, "user_id string, is_fraud byte, is_all_orig_balance byte, "
                                     "is_dest_zero_init byte, is_error_balance_orig byte, "
                                     "hour_of_day byte, amount double")
    return df.withColumns({"is_error_balance_dest": F.lit(0).cast("byte"),
                           "is_transfer": F.lit(0).cast("byte"),
                           "is_cash_out": F.lit(0).cast("byte"),
                           "transaction_time": F.lit(datetime(2024, 1, 1)).cast("timestamp"),
                           "merchant_id": F.lit("M1"), "type": F.lit("PAYMENT")})


def _score(spark, rows):
    fact = _fact(spark, rows)
    return {r.user_id: r for r in M.mart_user_risk_score(M.dim_users_full(fact), fact).collect()}


def test_risk_boundaries_are_strict(spark):
    day = 12
    rows = []
    # u20: 4 emptied -> 20 -> LOW_RISK ; u21: 4 emptied + 1 to new account -> 22 -> MEDIUM
    rows += [("u20", 0, 1, 0, 0, day, 1.0)] * 4
    rows += [("u21", 0, 1, 0, 0, day, 1.0)] * 4 + [("u21", 0, 0, 1, 0, day, 1.0)]
    # u50: 4 emptied (20) + 5 errors (15) + 5 new (10) + 0 night = 45 ... plus night share
    rows += [("u50", 0, 1, 1, 1, day, 1.0)] * 5 + [("u50", 0, 0, 0, 0, day, 1.0)] * 5
    s = _score(spark, rows)
    assert s["u20"].risk_score == 20.0 and s["u20"].risk_category == "LOW_RISK"
    assert s["u21"].risk_score == 22.0 and s["u21"].risk_category == "MEDIUM_RISK"
    assert s["u50"].risk_score == 45.0 and s["u50"].risk_category == "MEDIUM_RISK"


def test_fraud_component_capped_but_total_uncapped(spark):
    rows = [("f3", 1, 0, 0, 0, 12, 1.0)] * 3
    r = _score(spark, rows)["f3"]
    assert r.fraud_score == 40 and r.risk_score == 100.0 and r.risk_category == "BLOCKED"
    r1 = _score(spark, [("f1", 1, 0, 0, 0, 3, 1.0)])["f1"]
    # 40 (fraud) + night 100% capped at 15 = 55
    assert r1.risk_score == 55.0 and r1.night_score == 15.0


def test_anomaly_reasons_keep_trailing_comma_and_priority(spark):
    df = spark.createDataFrame(
        [("t1", 5.0, 5.0, 300000.0, 0, 1, 23), ("t2", 0.0, 0.0, 10.0, 1, 0, 12)],
        "txn_id string, error_balance_orig double, error_balance_dest double, amount double, "
        "is_fraud int, is_all_orig_balance byte, hour_of_day byte")
    for c in ("transaction_time", "user_id", "merchant_id", "type", "old_balance_orig",
              "new_balance_orig", "old_balance_dest", "new_balance_dest", "is_dest_zero_init"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    out = {r.txn_id: r for r in M.mart_anomaly_detection(df).collect()}
    assert out["t1"].anomaly_score == 5 and out["t1"].investigation_priority == "CRITICAL"
    assert out["t1"].anomaly_reasons == ("ORIG_BALANCE_ERROR,DEST_BALANCE_ERROR,LARGE_TXN,"
                                         "NIGHT_TXN,EMPTIED_ACCOUNT,")
    assert out["t2"].investigation_priority == "CONFIRMED_FRAUD" and out["t2"].anomaly_reasons == ""


def test_fused_risk_mart_equals_dim_join_path(spark):
    from txnlake.plans.base import fact_df
    from txnlake.plans.registry import stable
    fact = fact_df(spark, "/root/testdata/sf0.001")
    a = stable(M.mart_user_risk_score(fact))
    b = stable(M.mart_user_risk_score(M.dim_users_full(fact), fact))
    norm = lambda d: sorted(repr(tuple(r)) for r in d.select(sorted(d.columns)).collect())  # noqa
    assert norm(a) == norm(b)
