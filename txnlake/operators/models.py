"""Core models (fact, user dimension) and the five risk marts, as DataFrame plans.

Every aggregation here is decomposable (count/sum/min/max/avg/stddev_pop), so
Spark's partial aggregation combines map-side before the shuffle: a hot sender or
merchant costs one pre-aggregated row per map task, not its raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnlake.functions.columns import (
    BALANCE_TOLERANCE, LARGE_TXN_AMOUNT, is_night_hour, round_half_up,
)
from txnlake.schemas import FACT_COLUMNS, SEQ_COL

# Fixed values of the risk model (weights and caps of each score component,
# category and priority thresholds).
FRAUD_WEIGHT, FRAUD_CAP = 40, 40
EMPTIED_WEIGHT, EMPTIED_CAP = 5, 20
NIGHT_CAP = 15.0
ERROR_WEIGHT, ERROR_CAP = 3, 15
NEW_ACCOUNT_WEIGHT, NEW_ACCOUNT_CAP = 2, 10
SCORE_CAP = 100.0
HIGH_RISK_ABOVE, MEDIUM_RISK_ABOVE = 50, 20
HOURLY_HIGH_ABOVE, HOURLY_MEDIUM_ABOVE = 1.0, 0.5


def _with_seq(df: DataFrame, cols: list[str]) -> list[str]:
    return cols + ([SEQ_COL] if SEQ_COL in df.columns else [])


def fact_transactions_full(stg: DataFrame) -> DataFrame:
    """27-column passthrough of staging."""
    return stg.select(*_with_seq(stg, FACT_COLUMNS))


def sum_long(c: Column) -> Column:
    return F.sum(c.cast("long"))


def new_user_stats(stg: DataFrame, amount_count: bool = False) -> DataFrame:
    """Per sender: first/last seen, count, volume, frauds, average, updated_at; on request the
    number of amounts, which an exact merge of averages needs."""
    return stg.groupBy("user_id").agg(
        F.min("transaction_time").alias("first_seen"),
        F.max("transaction_time").alias("last_seen"),
        F.count(F.lit(1)).alias("total_txns"),
        F.sum("amount").alias("total_volume"),
        sum_long(F.col("is_fraud")).alias("fraud_count"),
        F.avg("amount").alias("avg_txn_amount"),
        F.max("transaction_time").alias("updated_at"),
        *([F.count("amount").alias("amount_count")] if amount_count else []),
    )


dim_users_full = new_user_stats


def dim_users_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge new per-user stats into the existing dimension (full outer join on user_id).

    Counts/volume/frauds add up; the average is re-weighted by the number of amounts (the
    column `amount_count` where both sides have it, else of transactions; none without an
    average); first_seen is the earliest and last_seen/updated_at the latest of both sides
    (out-of-order safe).  A missing user is one user.  Both inputs are keyed by user_id, so
    the join is a co-partitioned equi-join.
    """
    o, n = old.alias("o"), new.alias("n")
    oc = lambda c: F.col(f"o.{c}")
    nc = lambda c: F.col(f"n.{c}")
    total = F.coalesce(oc("total_txns"), F.lit(0)) + F.coalesce(nc("total_txns"), F.lit(0))
    known = "amount_count" in old.columns and "amount_count" in new.columns
    n_of = "amount_count" if known else "total_txns"

    def weight(of) -> Column:
        return F.when(of("avg_txn_amount").isNotNull(), of(n_of)).otherwise(F.lit(0))

    amounts = F.coalesce(weight(oc), F.lit(0)) + F.coalesce(weight(nc), F.lit(0))
    weighted = (F.coalesce(oc("avg_txn_amount") * weight(oc), F.lit(0.0))
                + F.coalesce(nc("avg_txn_amount") * weight(nc), F.lit(0.0)))
    volume = F.coalesce(oc("total_volume") + nc("total_volume"), oc("total_volume"), nc("total_volume"))
    return n.join(o, F.col("n.user_id").eqNullSafe(F.col("o.user_id")), "full_outer").select(
        F.coalesce(nc("user_id"), oc("user_id")).alias("user_id"),
        F.least(oc("first_seen"), nc("first_seen")).alias("first_seen"),
        F.greatest(oc("last_seen"), nc("last_seen")).alias("last_seen"),
        total.alias("total_txns"),
        volume.alias("total_volume"),
        (F.coalesce(oc("fraud_count"), F.lit(0)) + F.coalesce(nc("fraud_count"), F.lit(0)))
        .alias("fraud_count"),
        F.when(amounts > 0, weighted / amounts).alias("avg_txn_amount"),
        F.greatest(oc("updated_at"), nc("updated_at")).alias("updated_at"),
        *([amounts.alias("amount_count")] if known else []),
    )


def _behavior_aggs() -> list[Column]:
    night = is_night_hour(F.col("hour_of_day"))
    return [
        F.count_if(F.col("is_all_orig_balance") == 1).alias("emptied_account_count"),
        F.count_if(F.col("is_dest_zero_init") == 1).alias("to_new_account_count"),
        F.count_if((F.col("is_error_balance_orig") == 1) | (F.col("is_error_balance_dest") == 1))
        .alias("balance_error_count"),
        sum_long(F.col("is_transfer")).alias("transfer_count"),
        sum_long(F.col("is_cash_out")).alias("cash_out_count"),
        F.count_if(night).alias("night_txns"),
        F.max("amount").alias("max_txn_amount"),
        F.stddev_pop("amount").alias("amount_volatility"),
    ]


def user_behavior(fact: DataFrame) -> DataFrame:
    """Per sender: conditional counts, type sums, night count, max and population stddev."""
    return fact.groupBy("user_id").agg(*_behavior_aggs())


def user_profile(fact: DataFrame) -> DataFrame:
    """Dimension stats and behaviour of every sender in ONE aggregation (one scan,
    one shuffle of partial aggregates) -- the full-rebuild path of the risk mart."""
    return fact.groupBy("user_id").agg(
        F.min("transaction_time").alias("first_seen"),
        F.max("transaction_time").alias("last_seen"),
        F.count(F.lit(1)).alias("total_txns"),
        F.sum("amount").alias("total_volume"),
        sum_long(F.col("is_fraud")).alias("fraud_count"),
        F.avg("amount").alias("avg_txn_amount"),
        F.max("transaction_time").alias("updated_at"),
        *_behavior_aggs(),
    )


def risk_components(fraud: Column, emptied: Column, night: Column, total: Column,
                    errors: Column, new_acc: Column) -> dict[str, Column]:
    """The five score components; the total uses the *uncapped* fraud term."""
    night_share = night * F.lit(100.0) / F.greatest(total, F.lit(1))
    comps = {
        "fraud_score": F.least(fraud * FRAUD_WEIGHT, F.lit(FRAUD_CAP)),
        "emptied_score": F.least(emptied * EMPTIED_WEIGHT, F.lit(EMPTIED_CAP)),
        "night_score": F.least(night_share, F.lit(NIGHT_CAP)),
        "error_score": F.least(errors * ERROR_WEIGHT, F.lit(ERROR_CAP)),
        "new_account_score": F.least(new_acc * NEW_ACCOUNT_WEIGHT, F.lit(NEW_ACCOUNT_CAP)),
    }
    raw = (fraud * FRAUD_WEIGHT + comps["emptied_score"] + comps["night_score"]
           + comps["error_score"] + comps["new_account_score"])
    comps["risk_score"] = F.least(raw.cast("double"), F.lit(SCORE_CAP))
    return comps


def risk_category(fraud: Column, score: Column) -> Column:
    return (F.when(fraud > 0, "BLOCKED")
            .when(score > HIGH_RISK_ABOVE, "HIGH_RISK")
            .when(score > MEDIUM_RISK_ABOVE, "MEDIUM_RISK")
            .otherwise("LOW_RISK"))


def user_risk_left_join(dim: DataFrame, behavior: DataFrame) -> DataFrame:
    """dim_users LEFT JOIN behaviour USING user_id, missing behaviour -> 0."""
    b_cols = [c for c in behavior.columns if c != "user_id"]
    joined = dim.join(behavior, "user_id", "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0.0) if c in ("max_txn_amount", "amount_volatility")
                          else F.lit(0)) for c in b_cols}
    return joined.withColumns(zero)


def risk_score_columns(u: DataFrame) -> DataFrame:
    comps = risk_components(F.col("fraud_count"), F.col("emptied_account_count"),
                            F.col("night_txns"), F.col("total_txns"),
                            F.col("balance_error_count"), F.col("to_new_account_count"))
    u = u.withColumns(comps)
    return u.select(
        "user_id", "first_seen", "last_seen", "total_txns", "total_volume", "fraud_count",
        "avg_txn_amount", "emptied_account_count", "to_new_account_count",
        "balance_error_count", "transfer_count", "cash_out_count", "night_txns",
        "max_txn_amount", "amount_volatility", "fraud_score", "emptied_score", "night_score",
        "error_score", "new_account_score", "risk_score",
        risk_category(F.col("fraud_count"), F.col("risk_score")).alias("risk_category"),
        "updated_at",
    )


def mart_user_risk_score(dim: DataFrame, fact: DataFrame | None = None) -> DataFrame:
    """Risk mart.  With a maintained (incremental) dimension: dim LEFT JOIN behaviour
    of the fact, both keyed by user_id (co-partitioned join).  With `dim` = the fact
    itself and no second argument, the fused single-aggregation rebuild."""
    if fact is None:
        return risk_score_columns(user_profile(dim))
    return risk_score_columns(user_risk_left_join(dim, user_behavior(fact)))


def merchant_only_filter(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("is_merchant_dest") == 1)


def mart_merchant_risk(fact: DataFrame) -> DataFrame:
    """Per merchant recipient: volume stats, exact distinct senders, fraud ratio (0-1)."""
    return merchant_only_filter(fact).groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("total_incoming_txns"),
        F.sum("amount").alias("total_received_volume"),
        F.avg("amount").alias("avg_received_amount"),
        F.max("amount").alias("max_received_amount"),
        F.stddev_pop("amount").alias("stddev_received_amount"),
        sum_long(F.col("is_fraud")).alias("fraud_received_count"),
        F.count_distinct("user_id").alias("unique_senders"),
        (F.sum("is_fraud").cast("double") / F.count(F.lit(1))).alias("fraud_risk_ratio"),
    )


def mart_hourly_patterns(fact: DataFrame) -> DataFrame:
    """Per (hour, weekday): counts, fraud rate %, amounts, fraud by type, risk level.

    The level is decided on the unrounded rate (standard SQL alias scoping).
    """
    is_f = F.col("is_fraud") == 1
    stats = fact.groupBy("hour_of_day", "day_of_week").agg(
        F.count(F.lit(1)).alias("total_txns"),
        sum_long(F.col("is_fraud")).alias("fraud_count"),
        F.sum("amount").alias("total_amount"),
        F.sum(F.when(is_f, F.col("amount")).otherwise(F.lit(0.0))).alias("fraud_amount"),
        F.avg("amount").alias("avg_txn_amount"),
        F.count_if(is_f & (F.col("is_transfer") == 1)).alias("fraud_transfers"),
        F.count_if(is_f & (F.col("is_cash_out") == 1)).alias("fraud_cash_outs"),
    )
    return hourly_pattern_columns(stats)


def hourly_pattern_columns(stats: DataFrame) -> DataFrame:
    """Rates, rounding and risk level over the aggregated (hour, weekday) rows."""
    rate = F.col("fraud_count") * F.lit(100.0) / F.col("total_txns")
    return stats.select(
        "hour_of_day", "day_of_week", "total_txns", "fraud_count",
        round_half_up(rate, 4).alias("fraud_rate_pct"),
        round_half_up(F.col("total_amount"), 2).alias("total_amount"),
        round_half_up(F.col("fraud_amount"), 2).alias("fraud_amount"),
        round_half_up(F.col("avg_txn_amount"), 2).alias("avg_txn_amount"),
        "fraud_transfers", "fraud_cash_outs",
        F.when(rate > HOURLY_HIGH_ABOVE, "HIGH").when(rate > HOURLY_MEDIUM_ABOVE, "MEDIUM")
        .otherwise("LOW").alias("risk_level"),
    )


def mart_transaction_type_analysis(fact: DataFrame) -> DataFrame:
    """Per type: counts, rates, amount stats, error/account patterns, share of totals.

    The shares use an unpartitioned window *after* the group-by, i.e. over at most
    five rows, so the single-partition window is bounded by the number of types.
    """
    is_f = F.col("is_fraud") == 1
    agg = fact.groupBy("type").agg(
        F.count(F.lit(1)).alias("total_txns"),
        sum_long(F.col("is_fraud")).alias("fraud_count"),
        F.sum("amount").alias("_sum"),
        F.avg("amount").alias("_avg"),
        F.min("amount").alias("_min"),
        F.max("amount").alias("_max"),
        F.sum(F.when(is_f, F.col("amount")).otherwise(F.lit(0.0))).alias("_fsum"),
        F.avg(F.when(is_f, F.col("amount"))).alias("_favg"),
        sum_long(F.col("is_error_balance_orig")).alias("balance_error_orig_count"),
        sum_long(F.col("is_error_balance_dest")).alias("balance_error_dest_count"),
        sum_long(F.col("is_all_orig_balance")).alias("emptied_account_count"),
        sum_long(F.col("is_dest_zero_init")).alias("new_dest_account_count"),
    )
    return type_analysis_columns(agg)


def type_analysis_columns(agg: DataFrame) -> DataFrame:
    """Rates, rounding and shares over the aggregated rows of the types."""
    everything = Window.partitionBy()
    return agg.select(
        "type", "total_txns", "fraud_count",
        round_half_up(F.col("fraud_count") * F.lit(100.0) / F.col("total_txns"), 4)
        .alias("fraud_rate_pct"),
        round_half_up(F.col("_sum"), 2).alias("total_volume"),
        round_half_up(F.col("_avg"), 2).alias("avg_amount"),
        round_half_up(F.col("_min"), 2).alias("min_amount"),
        round_half_up(F.col("_max"), 2).alias("max_amount"),
        round_half_up(F.col("_fsum"), 2).alias("fraud_volume"),
        round_half_up(F.col("_favg"), 2).alias("avg_fraud_amount"),
        "balance_error_orig_count", "balance_error_dest_count",
        "emptied_account_count", "new_dest_account_count",
        round_half_up(F.col("total_txns") * F.lit(100.0)
                      / F.sum("total_txns").over(everything), 2).alias("pct_of_total_txns"),
        round_half_up(F.col("_sum") * F.lit(100.0) / F.sum("_sum").over(everything), 2)
        .alias("pct_of_total_volume"),
    ).orderBy(F.desc("total_txns"))


ANOMALY_COLUMNS = [
    "txn_id", "transaction_time", "user_id", "merchant_id", "type", "amount",
    "old_balance_orig", "new_balance_orig", "old_balance_dest", "new_balance_dest",
    "error_balance_orig", "error_balance_dest", "is_fraud", "is_all_orig_balance",
    "is_dest_zero_init", "hour_of_day",
]


def anomaly_flags(fact: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    one = lambda cond: F.when(cond, F.lit(1)).otherwise(F.lit(0))
    df = fact.select(*_with_seq(fact, ANOMALY_COLUMNS), *keys).withColumns({
        "has_orig_balance_error": one(F.abs(F.col("error_balance_orig")) > BALANCE_TOLERANCE),
        "has_dest_balance_error": one(F.abs(F.col("error_balance_dest")) > BALANCE_TOLERANCE),
        "is_large_transaction": one(F.col("amount") > LARGE_TXN_AMOUNT),
        "is_night_transaction": one(is_night_hour(F.col("hour_of_day"))),
    })
    return df.withColumn("anomaly_score", (
        F.col("has_orig_balance_error") + F.col("has_dest_balance_error")
        + F.col("is_large_transaction") + F.col("is_night_transaction")
        + F.col("is_all_orig_balance").cast("int")))


ANOMALY_FLAGS = ["has_orig_balance_error", "has_dest_balance_error", "is_large_transaction",
                 "is_night_transaction", "is_all_orig_balance"]


def anomaly_filter(df: DataFrame) -> DataFrame:
    """`anomaly_score >= 1 OR is_fraud = 1`, written as "any 0/1 flag set" (the same
    rows: the score is a sum of 0/1 flags).  The OR short-circuits and stays small
    when Catalyst pushes it below the projections that define the flags."""
    cond = F.col("is_fraud") == 1
    for c in ANOMALY_FLAGS:
        cond = cond | (F.col(c) == 1)
    return df.filter(cond)


def investigation_priority(fraud: Column, score: Column) -> Column:
    return (F.when(fraud == 1, "CONFIRMED_FRAUD").when(score >= 4, "CRITICAL")
            .when(score >= 3, "HIGH").when(score >= 2, "MEDIUM").when(score >= 1, "LOW")
            .otherwise("NORMAL"))


def anomaly_reasons() -> Column:
    """Comma-terminated list of the flags that fired (the trailing comma is kept)."""
    part = lambda c, text: F.when(F.col(c) == 1, F.lit(text)).otherwise(F.lit(""))
    return F.concat(
        part("has_orig_balance_error", "ORIG_BALANCE_ERROR,"),
        part("has_dest_balance_error", "DEST_BALANCE_ERROR,"),
        part("is_large_transaction", "LARGE_TXN,"),
        part("is_night_transaction", "NIGHT_TXN,"),
        part("is_all_orig_balance", "EMPTIED_ACCOUNT,"),
    )


def mart_anomaly_detection(fact: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Four anomaly flags, a 0-5 score, priority and reasons; anomalies and frauds only.
    `keys`: further columns of the fact to keep."""
    df = anomaly_filter(anomaly_flags(fact, tuple(keys)))
    return df.withColumns({
        "investigation_priority": investigation_priority(F.col("is_fraud"), F.col("anomaly_score")),
        "anomaly_reasons": anomaly_reasons(),
    })


# ---------------------------------------------------------------- ad-hoc reports

def fraud_rate_report(df: DataFrame, fraud_col: str = "isFraud") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        sum_long(F.col(fraud_col)).alias("frauds"),
        (F.sum(fraud_col) * F.lit(100.0) / F.count(F.lit(1))).alias("fraud_rate_pct"),
    )


def load_count_check(df: DataFrame, per_partition: bool = True) -> DataFrame:
    if not per_partition:
        return df.agg(F.count(F.lit(1)).alias("row_count"))
    return df.groupBy("part_dt", "part_hour").agg(F.count(F.lit(1)).alias("row_count"))


def partition_row_counts(df: DataFrame, n: int = 10) -> DataFrame:
    """`part_dt, part_hour, count` ordered by partition, first n (a top-k report)."""
    return load_count_check(df).orderBy("part_dt", "part_hour").limit(n)


def top_partitions(df: DataFrame, n: int = 10) -> DataFrame:
    """First n distinct partitions in key order."""
    return df.select("part_dt", "part_hour").distinct().orderBy("part_dt", "part_hour").limit(n)


def distinct_partitions(df: DataFrame, expected_days: int = 30) -> DataFrame:
    """Coverage probe of a rolling read: number/min/max of dates, share of expected."""
    return df.agg(
        F.count_distinct("part_dt").alias("partition_count"),
        F.min("part_dt").alias("first_part_dt"),
        F.max("part_dt").alias("last_part_dt"),
        (F.count_distinct("part_dt") / F.lit(float(expected_days))).alias("coverage"),
    )


def distinct_steps(df: DataFrame) -> DataFrame:
    return df.select("step").distinct().orderBy("step")


def count_distinct_steps(df: DataFrame) -> DataFrame:
    return df.agg(F.count_distinct("step").alias("n_steps"))


def sample_rows(df: DataFrame, n: int = 20, order: list[str] | None = None) -> DataFrame:
    """`LIMIT n` made deterministic by an explicit order (a sampling report)."""
    order = order or [c for c in ("transaction_time", SEQ_COL) if c in df.columns]
    return df.orderBy(*order).limit(n)


def order_by_count(df: DataFrame, col: str = "total_txns") -> DataFrame:
    return df.orderBy(F.desc(col))


def exact_distinct_count(df: DataFrame, key: str = "merchant_id",
                         what: str = "user_id") -> DataFrame:
    return df.groupBy(key).agg(F.count_distinct(what).alias(f"distinct_{what}s"))


def conditional_aggregates(fact: DataFrame, key: str = "type") -> DataFrame:
    """`sum(case ...)`, `count(case ...)` and `avg(case ... else null)` in one pass."""
    is_f = F.col("is_fraud") == 1
    return fact.groupBy(key).agg(
        F.sum(F.when(is_f, F.col("amount")).otherwise(F.lit(0.0))).alias("fraud_amount"),
        F.count(F.when(F.col("is_all_orig_balance") == 1, F.lit(1))).alias("emptied_count"),
        F.count_if(is_night_hour(F.col("hour_of_day"))).alias("night_count"),
        F.avg(F.when(is_f, F.col("amount"))).alias("avg_fraud_amount"),
        F.count_if(is_f & (F.col("is_transfer") == 1)).alias("fraud_transfers"),
    )
