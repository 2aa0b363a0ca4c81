"""Registered queries for scans, sinks, load semantics and data quality.

Each key that tests a sink or a file scan writes the events-derived table with
Spark to a fresh directory under the session's checkpoint root (the shared
folder named by ``spark.checkpoint.dir``), then reads it back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlake.operators import incremental as I
from txnlake.operators import models as M
from txnlake.operators import quality as Q
from txnlake.operators.cleaning import normalize_partition_keys, silver_transactions
from txnlake.plans.base import fact_df, landing_df, silver_df
from txnlake.plans.oracle_sql import with_base
from txnlake.plans.queries_core import (
    CLEAN_DOUBLES, CUTOFF_DT, DIM_DOUBLES, DIM_SQL, FACT_DOUBLES, SILVER_DOUBLES,
)
from txnlake.plans.registry import register
from txnlake.schemas import CSV_CASTS, SILVER_SCHEMA
from txnlake.session import scratch_path
from txnlake.sources import scans as S
from txnlake.sources import sinks as K
from txnlake.sources.fixture import landing as landing_src

LANDING_DOUBLES = CLEAN_DOUBLES
RUN_TS = "2024-02-01 00:00:00"  # fixed processing stamp of the load keys
LANDING_SQL = with_base("SELECT * FROM landing", "landing")


def _landing_written(spark, sf, name="landing"):
    path = scratch_path(spark, name)
    K.landing_partitioned_write(landing_df(spark, sf), path, dynamic=False)  # fresh directory
    return path


def _latest_partition(df):
    row = df.agg(F.max(F.concat("part_dt", "part_hour")).alias("m")).first()
    return row["m"][:8], row["m"][8:]


LATEST_HOUR_SQL = with_base("""
SELECT * FROM landing WHERE part_dt || part_hour = (SELECT max(part_dt || part_hour) FROM landing)""",
                            "landing")


# ------------------------------------------------------------------ scans (2.1)

@register("csv_step_ingest", LANDING_SQL, LANDING_DOUBLES)
def q_csv_ingest(spark, sf):
    path = scratch_path(spark, "csv")
    (landing_df(spark, sf).write.option("header", True)
     .option("timestampFormat", S.CSV_TIMESTAMP_FORMAT).csv(path))
    return S.csv_step_ingest(spark, path)


@register("landing_partition_scan", LATEST_HOUR_SQL, LANDING_DOUBLES)
def q_partition_scan(spark, sf):
    """The newest hour (what the hourly ETL reads), keys from the directory names."""
    path = _landing_written(spark, sf)
    dt, hr = _latest_partition(landing_df(spark, sf))
    return normalize_partition_keys(S.landing_partition_scan(spark, path, dt, hr))


@register("landing_bulk_scan", LANDING_SQL, LANDING_DOUBLES)
def q_bulk_scan(spark, sf):
    return S.normalized_landing_scan(spark, _landing_written(spark, sf))


@register("typed_scan", with_base(
    "SELECT * EXCLUDE (txn_seq), TIMESTAMP '2024-02-01 00:00:00' AS processed_at FROM silver",
    "silver"), SILVER_DOUBLES)
def q_typed_scan(spark, sf):
    path = scratch_path(spark, "silver")
    silver = silver_transactions(landing_src(spark, sf, with_seq=False), run_ts=RUN_TS)
    K.bulk_repartition_write(silver, path)
    return normalize_partition_keys(S.typed_scan(spark, path, SILVER_SCHEMA))


@register("rolling_window_scan", with_base(
    "SELECT * FROM silver WHERE part_dt BETWEEN '20240106' AND '20240205'", "silver"),
    SILVER_DOUBLES)
def q_rolling_window(spark, sf):
    """exec_date 2024-02-05, 30 days back inclusive (31 dates), pruned at the scan."""
    path = scratch_path(spark, "silver")
    K.bulk_repartition_write(silver_df(spark, sf), path)
    df = S.rolling_window_scan(S.landing_bulk_scan(spark, path), "2024-02-05", 30)
    return normalize_partition_keys(df)


@register("path_partition_columns", LANDING_SQL, LANDING_DOUBLES)
def q_path_keys(spark, sf):
    return S.path_partition_columns(spark, _landing_written(spark, sf))


@register("list_partitions", with_base(
    "SELECT DISTINCT part_dt, part_hour FROM landing", "landing"))
def q_list_partitions(spark, sf):
    return S.list_partitions(spark, _landing_written(spark, sf))


@register("empty_input_guard", LATEST_HOUR_SQL, LANDING_DOUBLES)
def q_empty_guard(spark, sf):
    path = _landing_written(spark, sf)
    dt, hr = _latest_partition(landing_df(spark, sf))
    df = S.empty_input_guard(S.landing_partition_scan(spark, path, dt, hr), f"{dt}/{hr}")
    return normalize_partition_keys(df)


# ------------------------------------------------------------------ sinks (2.2)

@register("landing_partitioned_write", LANDING_SQL, LANDING_DOUBLES)
def q_landing_write(spark, sf):
    return S.normalized_landing_scan(spark, _landing_written(spark, sf))


NEWEST = "part_dt || part_hour = (SELECT max(part_dt || part_hour) FROM landing)"


def _newest(df, spark, sf):
    dt, hr = _latest_partition(landing_df(spark, sf))
    return df.filter((F.col("part_dt") == dt) & (F.col("part_hour") == hr)), dt, hr


@register("landing_batch_replace", with_base("""
SELECT * REPLACE (CASE WHEN txn_seq % 3 = 1 AND part_dt >= '20240120' THEN amount + 1
                       ELSE amount END AS amount),
  CAST(txn_seq % 3 AS VARCHAR) AS batch_id FROM landing""", "landing"), LANDING_DOUBLES)
def q_landing_replace(spark, sf):
    """Three batches in every hour; one is landed again, twice, from one day on and with
    changed rows: its rows are replaced, the other batches' stay."""
    path = scratch_path(spark, "landing")
    land = landing_df(spark, sf).withColumn("batch_id", (F.col("txn_seq") % 3).cast("string"))
    K.landing_partitioned_write(land, path, dynamic=False)
    again = land.filter("batch_id = '1' AND part_dt >= '20240120'").withColumn(
        "amount", F.col("amount") + 1)
    for _ in range(2):
        K.landing_batch_replace(again, path, "1")
    return S.normalized_landing_scan(spark, path)


FLAGGED_SQL = f"CAST(CASE WHEN {NEWEST} THEN 1 ELSE isFlaggedFraud END AS TINYINT)"


@register("partition_overwrite", with_base(
    f"SELECT * REPLACE ({FLAGGED_SQL} AS isFlaggedFraud) FROM silver", "silver"), SILVER_DOUBLES)
def q_partition_overwrite(spark, sf):
    """Bulk silver load, then the newest hour again with changed rows."""
    path = scratch_path(spark, "silver")
    K.bulk_repartition_write(silver_df(spark, sf), path)
    one, dt, hr = _newest(landing_df(spark, sf), spark, sf)
    one = one.withColumn("isFlaggedFraud", F.lit(1).cast("byte"))
    K.partition_overwrite(silver_transactions(one, dt, hr).drop("processed_at"), path)
    return normalize_partition_keys(S.landing_bulk_scan(spark, path))


@register("bulk_repartition_write", with_base("SELECT * FROM silver", "silver"), SILVER_DOUBLES)
def q_bulk_write(spark, sf):
    path = scratch_path(spark, "silver")
    K.bulk_repartition_write(silver_df(spark, sf), path)
    return normalize_partition_keys(S.landing_bulk_scan(spark, path))


WAREHOUSE_SQL = with_base(
    "SELECT *, TIMESTAMP '2024-02-01 00:00:00' AS processed_at FROM silver", "silver")


def _warehouse(spark, sf):
    return silver_transactions(landing_df(spark, sf), run_ts=RUN_TS)


@register("warehouse_table_write", WAREHOUSE_SQL, SILVER_DOUBLES)
def q_warehouse_write(spark, sf):
    """Over a table with other dates: "overwrite" leaves none of its partitions."""
    path = scratch_path(spark, "warehouse")
    wh = _warehouse(spark, sf)
    K.warehouse_table_write(wh.withColumn("part_dt", F.concat(F.lit("2023"), F.substring(
        "part_dt", 5, 4))), path)
    K.warehouse_table_write(wh, path)
    return normalize_partition_keys(S.landing_bulk_scan(spark, path))


@register("delete_insert_partition", with_base(
    f"SELECT * REPLACE ({FLAGGED_SQL} AS isFlaggedFraud), "
    "TIMESTAMP '2024-02-01 00:00:00' AS processed_at FROM silver", "silver"), SILVER_DOUBLES)
def q_delete_insert(spark, sf):
    """Load all, then delete+insert the newest hour, changed, twice: one copy, the new one."""
    path = scratch_path(spark, "warehouse")
    wh = _warehouse(spark, sf)
    K.warehouse_table_write(wh, path)
    dt, hr = _latest_partition(landing_df(spark, sf))
    for _ in range(2):
        K.delete_insert_partition(wh.withColumn("isFlaggedFraud", F.lit(1).cast("byte")),
                                  path, dt, hr)
    return normalize_partition_keys(S.landing_bulk_scan(spark, path))


@register("truncate_reload", WAREHOUSE_SQL, SILVER_DOUBLES)
def q_truncate_reload(spark, sf):
    """A partial first load, then truncate and reload everything."""
    path = scratch_path(spark, "warehouse")
    wh = _warehouse(spark, sf)
    K.warehouse_table_write(wh.filter(F.col("part_dt") < CUTOFF_DT), path)
    K.truncate_reload(wh, path)
    return normalize_partition_keys(S.landing_bulk_scan(spark, path))


@register("upsert_by_key", with_base("""
, old AS (SELECT * FROM fact WHERE part_dt < '20240115'),
new AS (SELECT * FROM fact WHERE part_dt >= '20240114')
SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM new WHERE new.txn_id = old.txn_id)
UNION ALL SELECT * FROM new"""), FACT_DOUBLES)
def q_upsert(spark, sf):
    """An increment overlapping the target by one day: overlap replaced by key."""
    fact = fact_df(spark, sf)
    old = fact.filter(F.col("part_dt") < "20240115")
    new = fact.filter(F.col("part_dt") >= "20240114")
    return I.upsert_by_key(old, new, ["txn_id"])


SLICES = (("00000000", "20240111"), ("20240111", "20240121"), ("20240121", "99999999"))


@register("latest_version_per_key", with_base(
    ", snaps AS (" + " UNION ALL ".join(
        f"SELECT * FROM ({DIM_SQL.format(src=f'fact WHERE part_dt >= {lo!r} AND part_dt < {hi!r}')})"
        for lo, hi in SLICES) + ")\n"
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
    "ORDER BY updated_at DESC) AS rn FROM snaps) WHERE rn = 1"), DIM_DOUBLES)
def q_latest_version(spark, sf):
    """Per-slice user snapshots, newest `updated_at` per user kept."""
    fact = fact_df(spark, sf)
    snaps = None
    for lo, hi in SLICES:
        s = M.new_user_stats(fact.filter((F.col("part_dt") >= lo) & (F.col("part_dt") < hi)))
        snaps = s if snaps is None else snaps.unionByName(s)
    return I.latest_version_per_key(snaps, ["user_id"], "updated_at")


@register("retention_filter", with_base(
    "SELECT * FROM fact WHERE transaction_time + INTERVAL 1 YEAR > TIMESTAMP '2025-01-15 00:00:00'"),
    FACT_DOUBLES)
def q_retention(spark, sf):
    return I.retention_filter(fact_df(spark, sf), "transaction_time", "2025-01-15 00:00:00")


@register("default_now", WAREHOUSE_SQL, SILVER_DOUBLES)
def q_default_now(spark, sf):
    """A load whose files lack `processed_at`: filled with the run time."""
    return I.default_now(silver_df(spark, sf), "processed_at", RUN_TS)


@register("load_count_check", with_base(
    "SELECT part_dt, part_hour, count(*) AS row_count FROM silver GROUP BY part_dt, part_hour",
    "silver"))
def q_load_count(spark, sf):
    path = scratch_path(spark, "warehouse")
    K.warehouse_table_write(_warehouse(spark, sf), path)
    return M.load_count_check(normalize_partition_keys(S.landing_bulk_scan(spark, path)))


@register("bad_row_tolerance", with_base("""
, n AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE txn_seq % 25 = 0 OR txn_seq % 40 = 0)
          AS few, count(*) FILTER (WHERE txn_seq % 6 = 0) AS many FROM landing)
SELECT 'few' AS load, total_rows, few AS bad_rows, few::DOUBLE / total_rows AS bad_ratio,
  few::DOUBLE / total_rows <= 0.1 AS accepted FROM n
UNION ALL
SELECT 'many', total_rows, many, many::DOUBLE / total_rows, many::DOUBLE / total_rows <= 0.1
FROM n""", "landing"), ("bad_ratio",))
def q_bad_rows(spark, sf):
    """CSV text of the landing table, each numeric field checked by its cast: a load with
    few broken fields (two kinds, overlapping) and one with too many."""
    def load(name, **broken):
        path = scratch_path(spark, "csv")
        rows = landing_df(spark, sf)
        rows = rows.withColumns({c: F.when(F.expr(when), "oops").otherwise(
            F.col(c).cast("string")) for c, when in broken.items()})
        rows.write.option("header", True).csv(path)
        return Q.bad_row_tolerance(S.csv_text(spark, path), dict(CSV_CASTS, step="int")).select(
            F.lit(name).alias("load"), "*")

    return load("few", amount="txn_seq % 25 = 0", step="txn_seq % 40 = 0").unionByName(
        load("many", newbalanceDest="txn_seq % 6 = 0"))


@register("materialize_view", with_base("SELECT * FROM stg"), FACT_DOUBLES)
def q_materialize_view(spark, sf):
    from txnlake.plans.base import stg_df
    K.materialize_view(stg_df(spark, sf).drop("processed_at"), "stg_transactions_view")
    return spark.sql("SELECT * FROM stg_transactions_view")


@register("materialize_table", with_base("SELECT * FROM fact"), FACT_DOUBLES)
def q_materialize_table(spark, sf):
    return K.materialize_table(fact_df(spark, sf), scratch_path(spark, "fact"))


# ------------------------------------------------------------- quality (2.12)

@register("dq_unique", with_base("""
, d AS (SELECT txn_id, count(*) AS n FROM fact GROUP BY txn_id HAVING count(*) > 1),
u AS (SELECT user_id, count(*) AS n FROM (SELECT user_id FROM fact GROUP BY user_id) GROUP BY user_id HAVING count(*) > 1)
SELECT 'fact_transactions.txn_id' AS "check", count(*) AS duplicate_keys,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS duplicate_rows, count(*) = 0 AS passed FROM d
UNION ALL
SELECT 'dim_users.user_id', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), count(*) = 0 FROM u"""))
def q_dq_unique(spark, sf):
    fact = fact_df(spark, sf)
    return Q.dq_unique(fact, "txn_id", "fact_transactions.txn_id").unionByName(
        Q.dq_unique(M.dim_users_full(fact), "user_id", "dim_users.user_id"))


@register("dq_not_null", with_base("""
, holes AS (SELECT * REPLACE (CASE WHEN txn_seq % 9 <> 4 THEN txn_id END AS txn_id) FROM fact)
SELECT 'fact_transactions.txn_id' AS "check", count(*) FILTER (WHERE txn_id IS NULL) AS null_rows,
  count(*) FILTER (WHERE txn_id IS NULL) = 0 AS passed FROM holes
UNION ALL
SELECT 'dim_users.user_id', count(*) FILTER (WHERE user_id IS NULL),
  count(*) FILTER (WHERE user_id IS NULL) = 0 FROM (SELECT user_id FROM fact GROUP BY user_id)"""))
def q_dq_not_null(spark, sf):
    """A fact in which a ninth of the ids are missing, and a sound dimension."""
    fact = fact_df(spark, sf)
    holes = fact.withColumn("txn_id", F.when(F.col("txn_seq") % 9 != 4, F.col("txn_id")))
    return Q.dq_not_null(holes, "txn_id", "fact_transactions.txn_id").unionByName(
        Q.dq_not_null(M.dim_users_full(fact), "user_id", "dim_users.user_id"))


@register("dq_freshness", with_base("""
SELECT max(transaction_time) AS newest,
  (epoch_us(TIMESTAMP '2024-01-31 03:00:00') - epoch_us(max(transaction_time))) / 3600000000.0::DOUBLE AS age_hours,
  CASE WHEN (epoch_us(TIMESTAMP '2024-01-31 03:00:00') - epoch_us(max(transaction_time))) / 3600000000.0::DOUBLE > 6 THEN 'error'
       WHEN (epoch_us(TIMESTAMP '2024-01-31 03:00:00') - epoch_us(max(transaction_time))) / 3600000000.0::DOUBLE > 2 THEN 'warn'
       ELSE 'pass' END AS status
FROM silver""", "silver"), ("age_hours",))
def q_dq_freshness(spark, sf):
    return Q.dq_freshness(silver_df(spark, sf), "transaction_time", "2024-01-31 03:00:00")


@register("dq_output_files")
def q_dq_output_files(spark, sf):
    """File validation of a written silver table (byte sizes vary by writer)."""
    path = scratch_path(spark, "silver")
    K.bulk_repartition_write(silver_df(spark, sf), path)
    return Q.dq_output_files(spark, path, min_files=1)


@register("dq_profile", with_base("""
SELECT 'default' AS "database", 'transactions' AS "table", count(*) AS row_count,
  least(count(*), 20) AS n_shown FROM silver
UNION ALL SELECT 'default', 'fact_transactions', count(*), least(count(*), 20) FROM fact"""))
def q_dq_profile(spark, sf):
    profile = Q.dq_profile({"transactions": silver_df(spark, sf),
                            "fact_transactions": fact_df(spark, sf)})
    return profile.select("database", "table", "row_count",
                          F.size("sample").cast("long").alias("n_shown"))


# ------------------------------------------------------------------ streaming

@register("hourly_stream_clean", with_base("SELECT * FROM silver", "silver"), SILVER_DOUBLES)
def q_hourly_stream(spark, sf):
    """Landing files -> streaming cleaning -> silver, in three arrivals: all days but one,
    the missing day (late by weeks), and one hour landed again."""
    from txnlake.streaming.hourly import run_hourly_stream
    land = landing_df(spark, sf)
    landing_path, silver_path, state = (scratch_path(spark, n) for n in (
        "landing", "silver-stream", "stream-ckpt"))
    one, _, _ = _newest(land, spark, sf)
    late = F.col("part_dt") == "20240105"
    for part in (land.filter(~late), land.filter(late), one):
        K.partition_overwrite(part, landing_path)
        run_hourly_stream(spark, landing_path, silver_path, state).awaitTermination()
    return normalize_partition_keys(spark.read.parquet(silver_path)).drop("processed_at")
