from pyspark.sql import functions as F

from txnlake.operators import quality as Q
from txnlake.operators.cleaning import normalize_partition_keys
from txnlake.plans.base import landing_df, silver_df
from txnlake.session import scratch_path
from txnlake.sources import scans as S
from txnlake.sources import sinks as K
from txnlake.streaming.hourly import run_hourly_stream

from .conftest import SF001


def test_rolling_window_is_inclusive_31_dates():
    assert S.rolling_window_bounds("2024-01-31", 30) == ("20240101", "20240131")


def test_path_keys_and_listing_match_partition_discovery(spark):
    land = landing_df(spark, SF001)
    path = scratch_path(spark, "landing-io")
    K.landing_partitioned_write(land, path, dynamic=False)
    by_path = S.path_partition_columns(spark, path).select("txn_seq", "part_dt", "part_hour")
    by_disc = S.normalized_landing_scan(spark, path).select("txn_seq", "part_dt", "part_hour")
    assert by_path.exceptAll(by_disc).isEmpty() and by_disc.exceptAll(by_path).isEmpty()
    listed = S.list_partitions(spark, path)
    assert listed.count() == land.select("part_dt", "part_hour").distinct().count()
    ok = Q.dq_output_files(spark, path).first()
    assert ok.passed and ok.n_files >= listed.count()
    assert not Q.dq_output_files(spark, path, min_files=10 ** 6).first().passed


def test_csv_roundtrip_keeps_types_and_microseconds(spark):
    land = landing_df(spark, SF001)
    path = scratch_path(spark, "csv-io")
    land.write.option("header", True).option("timestampFormat", S.CSV_TIMESTAMP_FORMAT).csv(path)
    back = S.csv_step_ingest(spark, path)
    assert dict(back.dtypes)["amount"] == "double" and dict(back.dtypes)["isFraud"] == "tinyint"
    cols = ["txn_seq", "transaction_time", "amount", "step"]
    assert back.select(cols).exceptAll(land.select(cols)).isEmpty()


def test_feature_store_reads_latest_snapshot_only(spark):
    base = scratch_path(spark, "fs")
    df = spark.createDataFrame([(1,), (2,)], "x int")
    K.feature_snapshot_write(df, base, "2024-01-01")
    K.feature_snapshot_write(df.filter("x = 2"), base, "2024-01-02")
    assert [r.x for r in S.feature_snapshot_scan(spark, base).collect()] == [2]
    assert S.feature_snapshot_scan(spark, base, "2024-01-01").count() == 2
    assert S.feature_snapshot_scan(spark, base, all_dates=True).count() == 3


def _few_hours(spark):
    return landing_df(spark, SF001).filter("part_dt < '20240104'")


def test_streaming_keeps_late_hours_and_replaces_landed_ones(spark):
    land = _few_hours(spark)
    late = F.col("part_dt") == "20240102"
    lpath, spath, ckpt = (scratch_path(spark, n) for n in ("l", "s", "c"))

    def run():
        run_hourly_stream(spark, lpath, spath, ckpt).awaitTermination()
        return spark.read.parquet(spath)

    K.landing_partitioned_write(land.filter(~late), lpath, dynamic=False)
    assert run().count() == land.filter(~late).count()
    assert run().count() == land.filter(~late).count()  # nothing new
    K.partition_overwrite(land.filter(late), lpath)
    assert run().count() == land.count()  # a day late, kept
    K.partition_overwrite(land.filter(late).withColumn("amount", F.lit(1.0)), lpath)
    back = normalize_partition_keys(run())  # landed again: replaced
    assert back.count() == land.count() and back.filter("amount = 1.0").count() == \
        land.filter(late).count()
    cols = ["txn_seq", "is_transfer", "hour_of_day", "part_dt", "part_hour"]
    silver = silver_df(spark, SF001).filter("part_dt < '20240104'").select(cols)
    assert back.select(cols).exceptAll(silver).isEmpty()


def test_a_batch_is_replaced_and_the_others_stay(spark):
    rows = [(i, f"2024010{1 + i % 2}", "05", str(i % 3), float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "txn_seq long, part_dt string, part_hour string, "
                                     "batch_id string, amount double")
    path = scratch_path(spark, "batches")
    for b in ("0", "1", "2"):
        K.landing_batch_replace(df.filter(F.col("batch_id") == b), path, b)
    again = df.filter("batch_id = '1' AND part_dt = '20240101'").withColumn("amount", F.lit(-1.0))
    for _ in range(2):
        K.landing_batch_replace(again.limit(1), path, "1")
    got = sorted((r.txn_seq, r.amount) for r in spark.read.parquet(path).collect())
    gone = {r[0] for r in rows if r[3] == "1" and r[1] == "20240101"}
    left = {s for s, a in got if a == -1.0}
    assert len(left) == 1 and left < gone and len(got) == 12 - len(gone) + 1
    assert [x for x in got if x[1] >= 0] == [(r[0], r[4]) for r in rows if r[0] not in gone]


def test_overwrite_of_the_warehouse_leaves_no_old_partition(spark):
    path = scratch_path(spark, "wh-static")
    silver = silver_df(spark, SF001).filter("part_dt < '20240104'")
    K.warehouse_table_write(silver, path)
    fewer = silver.filter("part_dt = '20240102'")
    K.warehouse_table_write(fewer, path)
    assert spark.read.parquet(path).count() == fewer.count()


def test_profile_shows_a_stable_sample(spark):
    df = spark.range(50).toDF("x")
    row = Q.dq_profile({"t": df}, sample=3).first()
    assert (row.database, row.table, row.row_count) == ("default", "t", 50)
    assert row.sample == sorted(row.sample) and len(row.sample) == 3
    assert not spark.catalog.tableExists("t")


def test_the_stream_drops_repeated_rows_like_the_hourly_batch(spark):
    land = _few_hours(spark).filter("part_hour < '03'")
    lpath, spath, ckpt = (scratch_path(spark, n) for n in ("l2", "s2", "c2"))
    K.landing_partitioned_write(land.unionByName(land), lpath, dynamic=False)
    run_hourly_stream(spark, lpath, spath, ckpt).awaitTermination()
    assert spark.read.parquet(spath).count() == land.count()
