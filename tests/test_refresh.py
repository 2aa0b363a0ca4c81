"""The models' refresh: failures anywhere, late, re-run and lost hours, one rule for hours."""

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from txnlake.operators import incremental as I
from txnlake.operators import models as M
from txnlake.operators import rollup as R
from txnlake.operators.cleaning import silver_transactions, stg_transactions
from txnlake.plans import commits as C
from txnlake.plans import jobs as J
from txnlake.session import scratch_path
from txnlake.sources import listing as L
from txnlake.sources import sinks as K

from .test_jobs import _norm, _small_landing


def _warehouse(spark, hours=7):
    """Rows with missing senders and amounts; some times lie hours ahead of their partition."""
    silver = silver_transactions(_small_landing(spark, hours=hours), run_ts="2024-02-01 00:00:00")
    i = F.col("txn_seq")
    return silver.withColumns({
        "user_id": F.when(i % 5 != 2, F.col("user_id")), "amount": F.when(i % 7 != 3, F.col("amount")),
        "transaction_time": F.col("transaction_time") + F.expr("INTERVAL 6 HOURS") * (i % 3 == 0).cast("int")})


def _same_as_rebuild(spark, wh, out):
    fresh = J.refresh_models(spark, wh, f"{scratch_path(spark, 'rebuilt')}/models", checks="off")
    assert set(fresh) == set(out)
    for name in out:
        a, b = (spark.read.parquet(o[name]) for o in (out, fresh))
        assert _norm(a) == _norm(b.select(a.columns)), name


class Crash(Exception):
    pass


def _crash_at(monkeypatch, k):
    """The k-th write fails: every second time before it began, else after it ended."""
    real, seen = DataFrameWriter.parquet, [0]

    def parquet(self, *args, **kw):
        seen[0] += 1
        if seen[0] == k and k % 2:
            raise Crash
        real(self, *args, **kw)
        if seen[0] == k:
            raise Crash
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


def test_a_run_that_fails_at_any_write_is_made_good_by_the_next(spark, monkeypatch):
    rows = _warehouse(spark)
    root = scratch_path(spark, "crash")
    wh, models = f"{root}/wh", f"{root}/models"

    def load(df):
        K.partition_overwrite(df, wh)

    load(rows.filter("part_hour IN ('01', '03', '04')"))
    J.refresh_models(spark, wh, models, checks="off")
    before = C.latest(spark, models)
    load(rows.filter("part_hour = '02'"))  # late
    load(rows.filter("part_hour = '03'").withColumn("amount", F.col("amount") + 3).limit(5))  # again
    L.delete(spark, L.hour_path(spark, wh, "20240101", "04"))  # lost
    k, failed = 0, 0
    while True:
        k += 1 if k < 3 else 3
        with monkeypatch.context() as m:
            seen = _crash_at(m, k)
            try:
                out = J.refresh_models(spark, wh, models, checks="off")
            except Crash:
                failed += 1
                now = C.latest(spark, models)  # the last commit is whole, and its tables are there
                if seen[0] < 16:
                    assert now.version == before.version
                assert spark.read.parquet(now.tables["dim_users"]).count() > 0
                if k == 6:  # and another hour comes in between
                    load(rows.filter("part_hour = '05'"))
                continue
        break
    assert failed > 5
    _same_as_rebuild(spark, wh, out)
    again = J.refresh_models(spark, wh, models, checks="off")
    assert again == out  # nothing to do: nothing is written
    dim = J.read_dim_users(spark, models)
    fact = spark.read.parquet(out["fact_transactions"])
    assert dim.agg(F.sum("total_txns")).first()[0] == fact.count()


def test_times_outside_their_hour_and_missing_users(spark):
    rows = _warehouse(spark)
    root = scratch_path(spark, "clock")
    wh, models = f"{root}/wh", f"{root}/models"
    for hours in ("'01', '03'", "'04'", "'02', '05'"):
        K.partition_overwrite(rows.filter(f"part_hour IN ({hours})"), wh)
        out = J.refresh_models(spark, wh, models, checks="off")
    _same_as_rebuild(spark, wh, out)
    fact = M.fact_transactions_full(stg_transactions(rows)).filter("part_hour IN ('01','02','03','04','05')")
    dim = J.read_dim_users(spark, models)
    assert _norm(dim) == _norm(M.dim_users_full(fact).select(dim.columns))
    assert dim.filter("user_id IS NULL").count() == 1


def test_only_the_changed_hours_are_read(spark):
    rows = _warehouse(spark)
    wh = scratch_path(spark, "wh-plan")
    K.partition_overwrite(rows, wh)
    one = K.in_hours(spark.read.parquet(wh), [("20240101", "02")])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "20240101" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert len(one.inputFiles()) > 1 and {r.part_hour for r in one.select("part_hour").collect()} == {2}


def test_dim_merge_with_missing_users_and_amounts(spark):
    rows = M.fact_transactions_full(stg_transactions(_warehouse(spark)))
    early = F.col("part_hour") < "03"
    merged = M.dim_users_merge(M.new_user_stats(rows.filter(early), True),
                               M.new_user_stats(rows.filter(~early), True))
    assert _norm(merged) == _norm(M.new_user_stats(rows, True).select(merged.columns))


@pytest.mark.parametrize("kind", ["user", "merchant"])
def test_moments_of_any_split_are_those_of_the_whole(spark, kind):
    state = R.STATES[kind]
    rows = M.fact_transactions_full(stg_transactions(_warehouse(spark)))
    rows = rows.withColumn("amount", F.when(F.col("amount").isNotNull(), F.lit(1e9) + F.col("txn_seq") % 3))
    states = state.of_hours(rows)
    whole = state.merged(state.of_hours(rows.withColumn("part_hour", F.lit("00"))))
    cols = [*state.keys, "amount_count", F.round("amount_mean", 3), F.round("amount_m2", 3)]
    assert _norm(state.merged(states).select(cols)) == _norm(whole.select(cols))


def test_a_whole_batch_is_replaced_hours_it_lost_are_emptied(spark):
    rows = [(i, "20240101", f"0{i % 4}", str(i % 2), float(i)) for i in range(16)]
    df = spark.createDataFrame(rows, "txn_seq long, part_dt string, part_hour string, "
                                     "batch_id string, amount double")
    path = scratch_path(spark, "whole-batch")
    for b in ("0", "1"):
        K.landing_batch_replace(df.filter(F.col("batch_id") == b), path, b)
    # batch 1 held hours 01 and 03; now only 01
    K.landing_batch_replace(df.filter("batch_id = '1' AND part_hour = '01'"), path, "1", whole=True)
    got = sorted(r.txn_seq for r in spark.read.parquet(path).collect())
    assert got == sorted(i for i, _, h, b, _ in rows if b == "0" or h == "01")
    assert ("20240101", "03") not in L.hour_partitions(spark, path)
    for _ in range(2):
        K.landing_batch_replace(df.limit(0), path, "1", whole=True)
    assert sorted(r.txn_seq for r in spark.read.parquet(path).collect()) == [
        i for i, _, _, b, _ in rows if b == "0"]


def test_an_emptied_hour_is_deleted(spark):
    rows = _warehouse(spark)
    path = scratch_path(spark, "emptied")
    K.partition_overwrite(rows, path)
    K.delete_insert_partition(rows.filter("part_hour <> '02'"), path, "20240101", "02")
    assert spark.read.parquet(path).filter("part_hour = 2").count() == 0
    assert spark.read.parquet(path).count() == rows.filter("part_hour <> '02'").count()


@pytest.mark.parametrize("as_of", ["2025-02-28 00:00:00", "2024-02-29 12:00:00", "2025-03-01 07:30:00",
                                   "2025-02-28 12:00:00"])
def test_expiry_deletes_nothing_that_the_filter_keeps(spark, as_of):
    hours = spark.sql("SELECT explode(sequence(TIMESTAMP '2023-02-26 00:00:00', "
                      "TIMESTAMP '2024-03-03 00:00:00', INTERVAL 30 MINUTES)) AS t")
    bound = I.retention_hour(as_of)
    kept = I.retention_filter(hours, "t", as_of)
    assert kept.filter(F.date_format("t", "yyyyMMddHH") < bound).isEmpty()
    gone = hours.filter(F.date_format("t", "yyyyMMddHH") >= bound).exceptAll(kept)
    assert gone.count() <= 2 * 25  # what is kept longer is the rest of an hour, or 29 February


def test_features_day_by_day(spark):
    """A run for each date, one of them twice, against runs over the window."""
    from txnlake.plans.base import silver_df
    from .conftest import SF001
    root = scratch_path(spark, "daily")
    silver = silver_df(spark, SF001, keep_processed_at=True).filter("part_dt < '20240106'")
    K.bulk_repartition_write(silver, f"{root}/silver")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "2024-01-03", "2024-01-04", "2024-01-05"):
        out = J.daily_feature_job(spark, f"{root}/silver", f"{root}/state", f"{root}/features", day, 3)
    whole = J.feature_job(spark, f"{root}/silver", f"{root}/whole", "2024-01-05", window_days=3)
    got, want = spark.read.parquet(out), spark.read.parquet(whole).filter("to_date(transaction_time) = '2024-01-05'")
    assert got.count() > 10 and _norm(got) == _norm(want.select(got.columns))
    assert J.daily_feature_job(spark, f"{root}/silver", f"{root}/state", f"{root}/features", "2024-02-01") is None
