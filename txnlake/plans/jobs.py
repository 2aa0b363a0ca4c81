"""End-to-end jobs: the reference's entry points as plain functions over paths.

* ``bulk_init``       CSV (or landing) -> landing -> silver, and optionally the whole warehouse,
                      models and full-history features
* ``hourly_etl``      one landing hour -> silver (dedupe, idempotent replace) -> warehouse
* ``refresh_models``  warehouse -> the hours that changed -> fact, states -> totals, user
                      dimension and five marts, published by one commit
* ``daily_feature_job`` two dates of silver and carried totals -> the features of one date
* ``feature_job``     silver rolling window or whole history -> features -> ``run_date=``
* ``training_job``    latest snapshot -> weights/split -> fit or CV -> metrics -> save, log

Every write is idempotent (partition replace, versioned paths), and the models have a commit
log, so a job run again after a failure anywhere gives what one run would have given.  Checks act: with severity
"error" a failed one stops the job, with "warn" it warns, "off" skips it.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.functions.columns import part_dt_of, part_hour_of, step_to_time
from txnlake.operators import incremental as I
from txnlake.operators import ml as ML
from txnlake.operators import models as M
from txnlake.operators import quality as Q
from txnlake.operators import rollup as R
from txnlake.operators.cleaning import normalize_partition_keys, silver_transactions, stg_transactions
from txnlake.operators.features import daily_totals, day_window_features, window_features
from txnlake.plans import commits as C
from txnlake.schemas import CSV_CASTS, PARTITION_KEYS, SEQ_COL, SILVER_SCHEMA, TRAIN_RATIO
from txnlake.session import ensure_utc, materialize
from txnlake.sources import listing as L
from txnlake.sources import scans as S
from txnlake.sources import sinks as K

# Fixed value: the start of the hourly step clock (step 1 = this hour, UTC).
SIMULATION_START = "2025-12-28 00:00:00"


def partition_for_time(logical_ts: str, start: str = SIMULATION_START) -> tuple[int, str, str]:
    """Scheduler time -> (step, part_dt, part_hour); steps before the start are rejected."""
    t = datetime.fromisoformat(logical_ts)
    s = datetime.fromisoformat(start)
    step = int((t - s).total_seconds() // 3600) + 1
    if step < 1:
        raise ValueError(f"invalid step {step}: time before simulation start")
    base = s + timedelta(hours=step - 1)
    return step, base.strftime("%Y%m%d"), base.strftime("%H")


# ------------------------------------------------------------------ ingestion

def bulk_init(spark: SparkSession, landing_base: str, silver_base: str,
              csv_path: str | None = None, landing: DataFrame | None = None,
              start: str = SIMULATION_START, warehouse_base: str | None = None,
              models_base: str | None = None, features_base: str | None = None,
              features_date: str | None = None, checks: str = "error") -> dict[str, str]:
    """Initial load: CSV (needs `step`) or a landing frame -> landing table -> silver.  With
    the other bases also: truncate and reload the warehouse, build all models, and write the
    features of the whole history as snapshot `features_date`."""
    ensure_utc(spark)
    if landing is None:
        Q.gate(Q.bad_row_tolerance(S.csv_text(spark, csv_path), dict(CSV_CASTS, step="int")),
               "bad rows in the CSV", checks)
        df = S.csv_step_ingest(spark, csv_path)
        if "transaction_time" not in df.columns:
            df = df.withColumn("transaction_time", F.lit(None).cast("timestamp"))
        df = df.withColumn("transaction_time", F.coalesce(
            F.col("transaction_time"), step_to_time(F.col("step"), start)))
        landing = df.withColumns({"part_dt": part_dt_of("transaction_time"),
                                  "part_hour": part_hour_of("transaction_time")})
    K.landing_partitioned_write(landing, landing_base, dynamic=False)
    bulk = S.empty_input_guard(S.normalized_landing_scan(spark, landing_base), "landing")
    K.bulk_repartition_write(silver_transactions(bulk), silver_base)
    Q.gate(Q.dq_output_files(spark, silver_base), "silver files", checks)
    out = {"landing": landing_base, "silver": silver_base}
    if warehouse_base:
        silver = normalize_partition_keys(S.typed_scan(spark, silver_base, _silver_schema(spark, silver_base)))
        K.truncate_reload(silver, warehouse_base)
        Q.gate(Q.load_counts_agree(silver, spark.read.parquet(warehouse_base)),
               "rows loaded", checks)
        out["warehouse"] = warehouse_base
        if models_base:
            out |= refresh_models(spark, warehouse_base, models_base, rebuild=True)
    if features_base:
        path = feature_job(spark, silver_base, features_base, features_date, window_days=None)
        out["features"] = path or ""
    return out


def _silver_schema(spark: SparkSession, base: str):
    """The silver contract; tables that carry the optional sequence column have it too."""
    has_seq = SEQ_COL in spark.read.parquet(base).columns
    return T.StructType([*SILVER_SCHEMA.fields,
                         *([T.StructField(SEQ_COL, T.LongType())] if has_seq else [])])


def hourly_etl(spark: SparkSession, landing_base: str, silver_base: str, part_dt: str,
               part_hour: str, warehouse_base: str | None = None,
               run_ts: str | None = None, checks: str = "error",
               as_of: str | None = None) -> DataFrame:
    """Clean one landing hour into silver (and the warehouse); returns the file check.

    The run fails if the hour has no files, if the warehouse then holds another number of
    rows, or, given `as_of`, if the newest row is too old; `as_of` also expires warehouse
    hours beyond the retention."""
    ensure_utc(spark)
    raw = S.empty_input_guard(S.landing_partition_scan(spark, landing_base, part_dt, part_hour),
                              f"partition {part_dt}/{part_hour}")
    silver = silver_transactions(raw, part_dt, part_hour, run_ts=run_ts)
    K.partition_overwrite(silver, silver_base)
    hour = f"part_dt={part_dt}/part_hour={part_hour}"
    files = Q.dq_output_files(spark, f"{silver_base}/{hour}")
    Q.gate(files, f"silver files of {hour}", checks)
    if warehouse_base:
        one = normalize_partition_keys(spark.read.option("basePath", silver_base).parquet(
            f"{silver_base}/{hour}"), part_dt, part_hour)
        K.delete_insert_partition(one, warehouse_base, part_dt, part_hour)
        there = spark.read.parquet(L.hour_path(spark, warehouse_base, part_dt, part_hour))
        Q.gate(Q.load_counts_agree(one, there), f"rows loaded for {hour}", checks)
        if as_of:
            Q.gate(Q.dq_freshness(there, "transaction_time", as_of), "freshness", checks)
            K.expire_partitions(spark, warehouse_base, I.retention_hour(as_of))
    return files


# ------------------------------------------------------------------ models

DIM_VERSIONS_KEPT = C.KEPT
STATES, TOTALS = "_states", "_totals"
MARTS = ["mart_user_risk_score", "mart_merchant_risk", "mart_hourly_patterns",
         "mart_transaction_type_analysis"]


def read_model(spark: SparkSession, models_base: str, name: str) -> DataFrame | None:
    """The published version of a model."""
    now = C.latest(spark, models_base)
    return spark.read.parquet(now.tables[name]) if now and name in now.tables else None


def read_dim_users(spark: SparkSession, models_base: str) -> DataFrame | None:
    return read_model(spark, models_base, "dim_users")


def _read_states(spark: SparkSession, base: str, kind: str, like: DataFrame,
                 runs: dict[C.Hour, int]) -> DataFrame:
    """The states of the hours, each from the run that the log names."""
    if not runs or not L.exists(spark, base):
        return like.filter(F.lit(False))
    df = normalize_partition_keys(spark.read.schema(like.schema).option("basePath", base).parquet(
        *[f"{base}/run={r}" for r in sorted(set(runs.values())) if L.exists(spark, f"{base}/run={r}")]))
    rows = [(r, d, h) for (d, h), r in runs.items()]  # one for each hour
    current = spark.createDataFrame(rows, "_run long, _d string, _h string")
    return df.join(F.broadcast(current), (F.col("run") == F.col("_run")) & (F.col("part_dt") == F.col("_d"))
                   & (F.col("part_hour") == F.col("_h")), "left_semi").select(like.columns)


def refresh_models(spark: SparkSession, warehouse_base: str, models_base: str,
                   replace_partitions: list[tuple[str, str]] = (), rebuild: bool = False,
                   checks: str = "warn") -> dict[str, str]:
    """One models run.

    To be done are the warehouse hours whose files are not those that the last commit applied
    (new, late or loaded again: nobody has to name them), those of `replace_partitions`, and
    the hours that the warehouse has lost.  Only these are read: their rows go into the fact
    and the anomaly mart, hour by hour, their aggregates into the states; totals, dimension
    and marts follow from states (`operators.rollup`).  Everything but the two row tables is
    written to a path of this run, and all of it is published by the commit, the last write.
    A run that fails anywhere leaves the last commit valid, and the next one does its hours
    again, from the states that the last commit names.  (The fact and the anomaly mart are replaced
    by the hour, so for the time of a run they may be ahead of the published marts.)
    A transaction id (user + second) never spans hours, so replacing hours is the
    delete+insert upsert.  `rebuild` builds everything from the whole warehouse.  Checks are
    made on the rows of the hours done."""
    ensure_utc(spark)
    stg = stg_transactions(normalize_partition_keys(
        S.typed_scan(spark, warehouse_base, _silver_schema(spark, warehouse_base))))
    fact_path = f"{models_base}/fact_transactions"
    anomaly_path = f"{models_base}/mart_anomaly_detection"
    fact_now = M.fact_transactions_full(stg)
    last = None if rebuild else C.latest(spark, models_base)
    before = last.hours if last else {}
    source = L.hour_versions(spark, warehouse_base)
    named = set(replace_partitions) & set(source)
    todo = sorted(named | {h for h, v in source.items() if h not in before or before[h][0] != v})
    gone = sorted((set(before) | set(L.hour_partitions(spark, fact_path))) - set(source))
    out = {"fact_transactions": fact_path, "mart_anomaly_detection": anomaly_path}
    if last and not todo and not gone:
        return out | {n: p for n, p in last.tables.items() if not n.startswith("_")}
    run = C.next_version(spark, models_base)

    if last:
        fact_new = K.in_hours(fact_now, todo)
        K.replace_hours(fact_new, fact_path, [*todo, *gone])
    else:
        K.bulk_repartition_write(fact_now, fact_path)
    fact = normalize_partition_keys(spark.read.schema(fact_now.schema).parquet(fact_path))
    done = K.in_hours(fact, todo) if last else fact
    if checks != "off":
        Q.gate(Q.dq_unique(done, "txn_id"), "unique txn_id", checks)
        Q.gate(Q.dq_not_null(done, "txn_id"), "not null txn_id", checks)
        Q.gate(Q.dq_not_null(done, "user_id"), "not null user_id", checks)
    anomalies = M.mart_anomaly_detection(done, PARTITION_KEYS)
    if last:
        K.replace_hours(anomalies, anomaly_path, [*todo, *gone])
    else:
        K.warehouse_table_write(anomalies, anomaly_path)

    # the old hours that are taken out, and those that stay
    runs = {h: r for h, (_, r) in before.items()}
    taken = {h: r for h, r in runs.items() if h in set(todo) | set(gone)}
    stay = {h: r for h, r in runs.items() if h not in taken}
    tables, marts, all_states = {}, {}, {}

    def totals_of(kind: str, like: DataFrame) -> DataFrame:
        if last:
            return spark.read.parquet(last.tables[f"{TOTALS}/{kind}"])
        return R.STATES[kind].merged(like.filter(F.lit(False)))

    def written(df: DataFrame, name: str) -> DataFrame:
        tables[name] = f"{models_base}/{name}/version={run}"
        df.write.mode("overwrite").parquet(tables[name])
        return spark.read.schema(df.schema).parquet(tables[name])

    for kind, state in R.STATES.items():
        base = f"{models_base}/{STATES}/{kind}"
        states = state.of_hours(done)
        (states.hint("rebalance", *PARTITION_KEYS).write.mode("overwrite")
         .partitionBy(*PARTITION_KEYS).parquet(f"{base}/run={run}"))
        new = _read_states(spark, base, kind, states, {h: run for h in todo})
        old_out = _read_states(spark, base, kind, states, taken) if taken else None
        kept = _read_states(spark, base, kind, states, stay)
        if kind not in R.KEPT_TOTALS:
            all_states[kind] = kept.unionByName(new)
        elif kind == "senders":
            marts[kind] = written(R.updated_senders(totals_of(kind, states), new, old_out),
                                  f"{TOTALS}/{kind}")
        else:
            marts[kind] = written(state.updated(totals_of(kind, states), new, old_out, kept),
                                  f"{TOTALS}/{kind}")

    dim = written(R.dim_users(marts["user"]), "dim_users")
    if checks != "off":
        Q.gate(Q.dq_unique(dim, "user_id"), "unique user_id", checks)
    written(R.mart_user_risk_score(marts["user"]), "mart_user_risk_score")
    written(R.mart_merchant_risk(marts["merchant"], marts["senders"]), "mart_merchant_risk")
    written(R.mart_hourly_patterns(all_states["clock"]), "mart_hourly_patterns")
    written(R.mart_transaction_type_analysis(all_states["type"]), "mart_transaction_type_analysis")

    hours = {h: before[h] for h in stay} | {h: (source[h], run) for h in todo}
    C.publish(spark, models_base, C.Commit(run, hours, tables))
    C.clear_old(spark, models_base, [n for n in tables if n != "dim_users"] + ["dim_users"], run)
    for kind in R.STATES:  # states that no commit names any more
        for (d, h), r in taken.items():
            L.delete(spark, f"{models_base}/{STATES}/{kind}/run={r}/part_dt={d}/part_hour={h}")
    return out | {n: p for n, p in tables.items() if not n.startswith("_")}


# ------------------------------------------------------------------ ML

def feature_job(spark: SparkSession, silver_base: str, features_base: str,
                exec_date: str, window_days: int | None = 30, files: int | None = None,
                least_coverage: float = 0.0) -> str | None:
    """Rolling `window_days` read (partition-pruned; None: the whole history) -> window
    features -> snapshot.  An empty window writes nothing and returns None (the cleaning
    job fails instead); dates covering less than `least_coverage` of the window warn."""
    ensure_utc(spark)
    silver = normalize_partition_keys(
        S.typed_scan(spark, silver_base, _silver_schema(spark, silver_base)))
    if window_days is not None:
        silver = S.rolling_window_scan(silver, exec_date, window_days)
    if silver.isEmpty():
        return None
    if window_days is not None and least_coverage > 0:
        Q.gate(M.distinct_partitions(silver, window_days).select(
            "*", (F.col("coverage") >= least_coverage).alias("passed")), "coverage", "warn")
    return K.feature_snapshot_write(window_features(silver), features_base, exec_date, files)


def daily_feature_job(spark: SparkSession, silver_base: str, state_base: str, features_base: str,
                      exec_date: str, window_days: int = 30) -> str | None:
    """The features of one date's rows, as `feature_job` gives them for that date, from two dates
    of silver and the daily totals that earlier runs left.  Leaves the date's totals behind (run
    again, they are replaced), and expects those of the window's dates: run the dates in order."""
    ensure_utc(spark)
    first, today = S.rolling_window_bounds(exec_date, window_days)
    yesterday = S.rolling_window_bounds(exec_date, 1)[0]
    silver = S.typed_scan(spark, silver_base, _silver_schema(spark, silver_base))
    two = normalize_partition_keys(silver.filter(F.col("part_dt").cast("string").isin(yesterday, today)))
    one = two.filter(F.col("part_dt") == today)
    totals = {}
    for name, key in (("dest", "merchant_id"), ("orig", "user_id")):
        day = daily_totals(one, key)
        day.drop("part_dt").write.mode("overwrite").parquet(f"{state_base}/{name}/part_dt={today}")
        totals[name] = spark.read.schema(day.schema).parquet(f"{state_base}/{name}")
    if one.isEmpty():
        return None
    return K.feature_snapshot_write(day_window_features(
        two, totals["dest"], totals["orig"], first, yesterday, today), features_base, exec_date)


def training_job(spark: SparkSession, features_base: str, run_date: str | None = None,
                 model_type: str = "lr", tune: bool = False, model_dir: str | None = None,
                 runs_table: str | None = None, relative_error: float = 0.0):
    """Latest (or given) snapshot -> eligible rows -> weights, nulls, time split ->
    fit or cross-validate -> AUC + classification report -> save model, log the run."""
    ensure_utc(spark)
    df = ML.fraud_eligible_filter(S.feature_snapshot_scan(spark, features_base, run_date))
    df = materialize(df)  # read by the weights, the split and every fit
    summary = ML.snapshot_summary(df).first().asDict()
    ratio = ML.class_weight_ratio(df)
    df = ML.null_fill(df.withColumn("weight", F.when(F.col("is_fraud") == 1, F.lit(float(ratio)))
                                    .otherwise(F.lit(1.0))))
    feats = ML.available_features(df)
    train, test, thr = ML.time_split(df, relative_error=relative_error)
    model = ML.tune_cv(train, feats, model_type) if tune else ML.train(train, feats, model_type)
    preds = materialize(ML.score_transactions(model, test))
    metrics = dict(ML.auc_metrics(preds))
    metrics.update({k: float(v) for k, v in
                    ML.classification_report(preds).first().asDict().items()})
    if model_dir:
        ML.model_save(model, model_dir)
    if runs_table:
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
        date = run_date or max(L.key_values(spark, features_base, "run_date"), default="none")
        sizes = preds.agg(F.count(F.lit(1)).alias("n")).first()["n"], train.count()
        ML.run_log(spark, runs_table, f"{model_type}_{stamp}",
                   {"model.type": model_type, "tuned": tune, "threshold": thr,
                    "data.run_date": date, "data.train_ratio": TRAIN_RATIO,
                    "data.test_rows": sizes[0], "data.train_rows": sizes[1],
                    "data.total_rows": summary["rows"], "model.num_features": len(feats),
                    "class_weight_ratio": round(ratio, 2), **summary},
                   metrics, {"model_family": "spark_ml", "spark_version": spark.version}, feats)
    return model, metrics
