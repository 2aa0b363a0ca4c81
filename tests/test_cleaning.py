from datetime import datetime

from pyspark.sql import functions as F

from txnlake.operators import cleaning as C
from txnlake.sources import scans as S
from txnlake.session import scratch_path


def _landing(spark, data):
    cols = ("step int, type string, amount string, nameOrig string, oldbalanceOrg string, "
            "newbalanceOrig string, nameDest string, oldbalanceDest string, newbalanceDest string, "
            "isFraud string, isFlaggedFraud string, transaction_time timestamp")
    return spark.createDataFrame(data, cols)


def test_silver_flags_and_trim(spark):
    t = datetime(2024, 1, 7, 23, 30)  # a Sunday, night hour
    df = _landing(spark, [(1, " TRANSFER ", "100.0", "C1", "100.0", "0.0", "M9", "0.0", "0.0",
                           "1", "0", t)])
    r = C.silver_transactions(df).first()
    assert r.type == "TRANSFER" and r.is_transfer == 1 and r.is_cash_out == 0
    assert r.is_merchant_dest == 1 and r.hour_of_day == 23 and r.day_of_week == 1
    assert r.errorBalanceOrig == 0.0 and r.is_errorBalanceOrig == 0
    assert r.errorBalanceDest == 100.0 and r.is_errorBalanceDest == 1
    assert r.is_all_orig_balance == 1 and r.is_dest_zero_init == 1 and r.is_org_zero_init == 0


def test_bad_number_becomes_null_not_error(spark):
    df = _landing(spark, [(1, "PAYMENT", "12x", "C1", "1", "1", "M1", "1", "1", "0", "0",
                           datetime(2024, 1, 1))])
    assert C.clean_transactions(df).first().amount is None


def test_dedup_only_in_incremental_mode(spark):
    row = (1, "PAYMENT", "5.0", "C1", "10.0", "5.0", "M1", "0.0", "0.0", "0", "0",
           datetime(2024, 1, 1, 3))
    df = _landing(spark, [row, row]).withColumns({"part_dt": F.lit("20240101"),
                                                  "part_hour": F.lit("03")})
    assert C.silver_transactions(df).count() == 2                      # bulk: kept
    assert C.silver_transactions(df, "20240101", "03").count() == 1   # incremental: deduped


def test_partition_keys_normalized(spark):
    df = spark.createDataFrame([(20240101, 3)], "part_dt int, part_hour int")
    r = C.normalize_partition_keys(df).first()
    assert (r.part_dt, r.part_hour) == ("20240101", "03")


def test_csv_requires_step(spark):
    path = scratch_path(spark, "csv-nostep")
    spark.createDataFrame([("PAYMENT", "1.0")], "type string, amount string") \
        .write.option("header", True).csv(path)
    import pytest
    with pytest.raises(ValueError):
        S.csv_step_ingest(spark, path)


def test_txn_id_collides_within_one_second(spark):
    df = spark.createDataFrame([("C1", datetime(2024, 1, 1, 0, 0, 1, 100)),
                                ("C1", datetime(2024, 1, 1, 0, 0, 1, 900))],
                               "user_id string, transaction_time timestamp")
    from txnlake.functions.columns import txn_id
    ids = {r[0] for r in df.select(txn_id()).collect()}
    assert ids == {"C1-1704067201"}
