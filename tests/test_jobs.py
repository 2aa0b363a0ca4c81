import json

import pytest
from pyspark.sql import functions as F

from txnlake.operators import quality as Q
from txnlake.operators.models import dim_users_full
from txnlake.plans import jobs as J
from txnlake.plans.base import landing_df
from txnlake.plans.registry import stable
from txnlake.session import scratch_path
from txnlake.sources import listing as L
from txnlake.sources import scans as S
from txnlake.sources import sinks as K

from .conftest import SF001


def test_partition_for_time():
    assert J.partition_for_time("2025-12-28 00:00:00") == (1, "20251228", "00")
    assert J.partition_for_time("2025-12-29 05:59:59") == (30, "20251229", "05")
    with pytest.raises(ValueError):
        J.partition_for_time("2025-12-27 23:30:00")


def _norm(df):
    return sorted(repr(tuple(r)) for r in stable(df).select(sorted(df.columns)).collect())


def _small_landing(spark, hours=6, rows_per_hour=8):
    """A few hours of the fixture's rows."""
    land = landing_df(spark, SF001)
    i = F.col("txn_seq")
    t = F.timestamp_seconds(F.lit(1704067200) + (i % hours) * 3600 + F.floor(i / hours) * 7)
    return (land.filter(i < hours * rows_per_hour).withColumn("transaction_time", t)
            .withColumn("part_dt", F.date_format("transaction_time", "yyyyMMdd"))
            .withColumn("part_hour", F.date_format("transaction_time", "HH")))


def test_late_and_rerun_hours_equal_the_full_rebuild(spark):
    root = scratch_path(spark, "late")
    landing, silver, wh, models = (f"{root}/{x}" for x in ("landing", "silver", "wh", "models"))
    land = _small_landing(spark)
    K.landing_partitioned_write(land, landing, dynamic=False)

    def etl(*hours):
        for h in hours:
            J.hourly_etl(spark, landing, silver, "20240101", h, warehouse_base=wh)

    def same_as_rebuild(out):
        fresh = J.refresh_models(spark, wh, f"{scratch_path(spark, 'rebuilt')}/models")
        for name in out:
            a, b = (spark.read.parquet(o[name]) for o in (out, fresh))
            drop = [c for c in ("processed_at",) if c in a.columns]
            assert _norm(a.drop(*drop)) == _norm(b.drop(*drop)), name
        return spark.read.parquet(out["fact_transactions"]).count()

    etl("01", "03")
    J.refresh_models(spark, wh, models)
    etl("02")  # late
    assert same_as_rebuild(J.refresh_models(spark, wh, models)) == 24
    etl("04")  # newer than all
    assert same_as_rebuild(J.refresh_models(spark, wh, models)) == 32
    changed = land.filter("part_hour = '02'").withColumn("amount", F.col("amount") + 1e6)
    K.partition_overwrite(changed.limit(5), landing)
    etl("02", "05")  # re-run with other rows, and a newer one
    out = J.refresh_models(spark, wh, models, replace_partitions=[("20240101", "02")])
    assert same_as_rebuild(out) == 37
    L.delete(spark, L.hour_path(spark, wh, "20240101", "03"))  # the warehouse lost an hour
    assert same_as_rebuild(J.refresh_models(spark, wh, models)) == 29
    assert len(L.key_values(spark, f"{models}/dim_users", "version")) == J.DIM_VERSIONS_KEPT


def test_initial_load_from_csv_to_marts_and_full_history(spark):
    root = scratch_path(spark, "init")
    land = _small_landing(spark)
    (land.drop("part_dt", "part_hour").write.option("header", True)
     .option("timestampFormat", S.CSV_TIMESTAMP_FORMAT).csv(f"{root}/csv"))
    bases = {f"{n}_base": f"{root}/{n}" for n in ("warehouse", "models", "features")}
    for _ in range(2):  # run again: truncated, not doubled
        out = J.bulk_init(spark, f"{root}/landing", f"{root}/silver", csv_path=f"{root}/csv",
                          features_date="2024-01-02", **bases)
    assert spark.read.parquet(out["warehouse"]).count() == 48
    assert spark.read.parquet(out["fact_transactions"]).count() == 48
    assert spark.read.parquet(out["mart_user_risk_score"]).count() == \
        land.select("nameOrig").distinct().count()
    assert S.feature_snapshot_scan(spark, f"{root}/features").count() == 48


def test_gates_act(spark):
    root = scratch_path(spark, "gates")
    land = _small_landing(spark)
    K.landing_partitioned_write(land, f"{root}/landing", dynamic=False)
    args = (f"{root}/landing", f"{root}/silver", "20240101", "01")
    with pytest.raises(Q.QualityError):  # the newest row is a year old
        J.hourly_etl(spark, *args, warehouse_base=f"{root}/wh", as_of="2024-12-01 00:00:00")
    with pytest.warns(UserWarning):
        J.hourly_etl(spark, *args, warehouse_base=f"{root}/wh", as_of="2024-12-01 00:00:00",
                     checks="warn")
    assert L.hour_partitions(spark, f"{root}/wh") == [("20240101", "01")]
    J.hourly_etl(spark, *args, warehouse_base=f"{root}/wh", as_of="2025-06-01 00:00:00",
                 checks="off")
    assert L.hour_partitions(spark, f"{root}/wh") == []  # beyond the retention
    bad = land.withColumn("amount", F.when(F.col("txn_seq") % 2 == 0, "x").otherwise(
        F.col("amount").cast("string"))).drop("part_dt", "part_hour")
    bad.write.option("header", True).csv(f"{root}/csv")
    with pytest.raises(Q.QualityError):
        J.bulk_init(spark, f"{root}/l2", f"{root}/s2", csv_path=f"{root}/csv")


def test_end_to_end_chain(spark):
    root = scratch_path(spark, "e2e")
    landing, silver, wh, models, feats = (f"{root}/{x}" for x in
                                          ("landing", "silver", "wh", "models", "features"))
    land = landing_df(spark, SF001)
    J.bulk_init(spark, landing, silver, landing=land)
    assert spark.read.parquet(silver).count() == land.count()

    # hourly ETL of two hours into the warehouse, the second one twice (idempotent)
    hours = [(r.part_dt, r.part_hour) for r in
             land.select("part_dt", "part_hour").distinct().orderBy("part_dt", "part_hour")
             .limit(2).collect()]
    for dt, hr in hours + hours[1:]:
        chk = J.hourly_etl(spark, landing, silver, dt, hr, warehouse_base=wh).first()
        assert chk.passed
    n_two = land.filter(F.concat("part_dt", "part_hour").isin([a + b for a, b in hours])).count()
    assert spark.read.parquet(wh).count() == n_two

    out = J.refresh_models(spark, wh, models)
    assert spark.read.parquet(out["fact_transactions"]).count() == n_two
    out2 = J.refresh_models(spark, wh, models)     # no new partitions: nothing added
    dim1 = spark.read.parquet(out["dim_users"]).agg(F.sum("total_txns")).first()[0]
    dim2 = spark.read.parquet(out2["dim_users"]).agg(F.sum("total_txns")).first()[0]
    assert dim1 == dim2 == n_two

    # two more hours arrive: the fact takes only them, the dimension merges them
    more = [(r.part_dt, r.part_hour) for r in
            land.select("part_dt", "part_hour").distinct().orderBy("part_dt", "part_hour")
            .limit(4).collect()][2:]
    for dt, hr in more:
        J.hourly_etl(spark, landing, silver, dt, hr, warehouse_base=wh)
    out3 = J.refresh_models(spark, wh, models)
    fact = spark.read.parquet(out3["fact_transactions"])
    n_four = land.filter(F.concat("part_dt", "part_hour").isin(
        [a + b for a, b in hours + more])).count()
    assert fact.count() == n_four
    assert _norm(spark.read.parquet(out3["dim_users"])) == _norm(dim_users_full(fact))
    risk = spark.read.parquet(out3["mart_user_risk_score"])
    assert risk.count() == fact.select("user_id").distinct().count()

    J.feature_job(spark, silver, feats, "2024-01-30")
    snap = S.feature_snapshot_scan(spark, feats)
    assert snap.count() == land.count()
    model, metrics = J.training_job(spark, feats, model_type="lr",
                                    runs_table=f"{root}/model_runs")
    assert 0.0 <= metrics["auc_roc"] <= 1.0 and 0.0 <= metrics["accuracy"] <= 1.0
    run = spark.read.parquet(f"{root}/model_runs").first()
    params = json.loads(run.params)
    assert params["data.train_rows"] + params["data.test_rows"] == params["data.total_rows"]
    assert params["data.run_date"] == "2024-01-30" and run.run_name.startswith("lr_2")
