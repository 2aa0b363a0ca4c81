"""Registered queries: window features (section 2.6) and the feature projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnlake.operators import features as FT
from txnlake.plans.base import silver_df
from txnlake.plans.oracle_sql import with_base
from txnlake.plans.registry import register
from txnlake.session import scratch_path
from txnlake.sources import scans as S
from txnlake.sources import sinks as K

_W = {
    "wdr": "PARTITION BY merchant_id ORDER BY ts, transaction_time, txn_seq",
    "wor": "PARTITION BY user_id ORDER BY ts, transaction_time, txn_seq",
}


def _rng(key, secs):
    return f"(PARTITION BY {key} ORDER BY ts RANGE BETWEEN {secs} PRECEDING AND 1 PRECEDING)"


def _past(key):
    return (f"(PARTITION BY {key} ORDER BY ts, transaction_time, txn_seq "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")


FEATURE_EXPR = {
    "dest_delta_seconds": f"ts - epoch_us(lag(transaction_time) OVER ({_W['wdr']})) // 1000000",
    "orig_delta_seconds": f"ts - epoch_us(lag(transaction_time) OVER ({_W['wor']})) // 1000000",
    "orig_prev_amount": f"lag(amount) OVER ({_W['wor']})",
}
for _p, _k in (("dest", "merchant_id"), ("orig", "user_id")):
    for _lbl, _s in FT.RANGES.items():
        FEATURE_EXPR[f"{_p}_msg_count_{_lbl}"] = f"count(*) OVER {_rng(_k, _s)}"
        FEATURE_EXPR[f"{_p}_amount_sum_{_lbl}"] = f"sum(amount) OVER {_rng(_k, _s)}"
    FEATURE_EXPR[f"{_p}_count_past"] = f"count(*) OVER {_past(_k)}"
    FEATURE_EXPR[f"{_p}_sum_amount_past"] = f"sum(amount) OVER {_past(_k)}"
    FEATURE_EXPR[f"{_p}_history_fraud_count"] = f"CAST(sum(isFraud) OVER {_past(_k)} AS BIGINT)"
FEATURE_EXPR["orig_avg_amount_past"] = f"avg(amount) OVER {_past('user_id')}"
FEATURE_EXPR["is_night_txn"] = "CASE WHEN hour_of_day >= 22 OR hour_of_day <= 6 THEN 1 ELSE 0 END"
FEATURE_EXPR["is_round_amount"] = "CASE WHEN amount % 1000 = 0 THEN 1 ELSE 0 END"
FEATURE_EXPR["amount_log"] = "ln(1 + amount)"

FEATURE_DOUBLES = ("amount", "dest_amount_sum_1h", "dest_amount_sum_24h", "dest_sum_amount_past",
                   "orig_amount_sum_1h", "orig_amount_sum_24h", "orig_prev_amount",
                   "orig_sum_amount_past", "orig_avg_amount_past", "amount_log")
BASE_COLS = ("transaction_time", "user_id", "merchant_id", "amount", "type",
             "isFraud AS is_fraud", "hour_of_day", "day_of_week", "is_transfer", "is_cash_out")


def _feature_sql(cols: list[str], base: bool = True) -> str:
    sel = (list(BASE_COLS) if base else []) + [f"{FEATURE_EXPR[c]} AS {c}" for c in cols]
    return with_base(
        ", f AS (SELECT *, epoch_us(transaction_time) // 1000000 AS ts FROM silver)\n"
        f"SELECT {', '.join(sel)}, txn_seq FROM f", "silver")


ALL_FEATURES = [c for c in FT.FEATURE_ROW_COLUMNS if c in FEATURE_EXPR]


def _features(spark, sf):
    return FT.window_features(silver_df(spark, sf))


def _subset(name, cols):
    """A few of the features; columns of the others are pruned."""
    dbl = tuple(c for c in cols if c in FEATURE_DOUBLES)

    @register(name, _feature_sql(cols, base=False), dbl)
    def q(spark, sf):
        return FT.window_features(silver_df(spark, sf)).select(*cols, "txn_seq")
    return q


_subset("lag_time_delta", ["dest_delta_seconds", "orig_delta_seconds"])
_subset("lag_amount", ["orig_prev_amount"])
_subset("velocity_1h", ["dest_msg_count_1h", "dest_amount_sum_1h",
                        "orig_msg_count_1h", "orig_amount_sum_1h"])
_subset("velocity_24h", ["dest_msg_count_24h", "dest_amount_sum_24h",
                         "orig_msg_count_24h", "orig_amount_sum_24h"])
_subset("past_totals", ["dest_count_past", "dest_sum_amount_past", "orig_count_past",
                        "orig_sum_amount_past", "orig_avg_amount_past"])
_subset("past_fraud_count", ["dest_history_fraud_count", "orig_history_fraud_count"])


@register("window_features", _feature_sql(ALL_FEATURES), FEATURE_DOUBLES)
def q_window_features(spark, sf):
    """Whole feature job over every silver row."""
    return _features(spark, sf)


def _dense_sql() -> str:
    sel = ", ".join(f"{e} AS {c}" for c, e in FEATURE_EXPR.items() if c in ALL_FEATURES)
    sql = with_base(", d AS (SELECT * REPLACE ("
                    "CASE WHEN txn_seq % 50 = 7 THEN NULL ELSE TIMESTAMP '2024-01-01 00:00:00' + "
                    "to_milliseconds((txn_seq * 7919) % 172800 * 1000 + txn_seq % 3 * 100) END "
                    "AS transaction_time, "
                    "CASE WHEN txn_seq % 41 = 3 THEN NULL ELSE amount END AS amount, "
                    "CASE WHEN txn_seq % 3 = 0 THEN 'M0' ELSE merchant_id END AS merchant_id, "
                    "CASE WHEN txn_seq % 29 = 0 THEN NULL ELSE user_id END AS user_id) FROM silver),\n"
                    "f AS (SELECT *, epoch_us(transaction_time) // 1000000 AS ts FROM d)\n"
                    f"SELECT {sel}, txn_seq FROM f", "silver")
    return sql.replace("ORDER BY ts, transaction_time,", "ORDER BY ts NULLS FIRST, transaction_time "
                       "NULLS FIRST,").replace("ORDER BY ts RANGE", "ORDER BY ts NULLS FIRST RANGE")


@register("window_features_hot_keys", _dense_sql(), tuple(c for c in FEATURE_DOUBLES if c != "amount"))
def q_window_features_hot(spark, sf):
    """A third of all rows on one recipient, two days, many rows in a minute and some in one
    second, rows without a time, an amount or a sender; the recipient's history is split."""
    silver = silver_df(spark, sf)
    i = F.col("txn_seq")
    ms = (i * 7919) % 172800 * 1000 + i % 3 * 100
    silver = silver.withColumns({
        "transaction_time": F.when(i % 50 != 7, F.timestamp_millis(F.lit(1704067200000) + ms)),
        "amount": F.when(i % 41 != 3, F.col("amount")),
        "merchant_id": F.when(i % 3 == 0, "M0").otherwise(F.col("merchant_id")),
        "user_id": F.when(i % 29 != 0, F.col("user_id")),
    })
    return FT.window_features(silver, max_key_rows=200).select(*ALL_FEATURES, "txn_seq")


@register("window_features_daily", "SELECT * FROM (" + _feature_sql(ALL_FEATURES) + """) AS w
WHERE strftime(transaction_time, '%Y%m%d') = '20240120'""", FEATURE_DOUBLES)
def q_window_features_daily(spark, sf):
    """One date's features from two dates of rows and the daily totals of the whole table: as a run
    over all rows up to that date gives them."""
    silver = silver_df(spark, sf)
    first, yesterday, today = "00000000", "20240119", "20240120"
    return FT.day_window_features(
        silver.filter(F.col("part_dt").isin(yesterday, today)), FT.daily_totals(silver, "merchant_id"),
        FT.daily_totals(silver, "user_id"), first, yesterday, today)


@register("feature_projection", _feature_sql(ALL_FEATURES), FEATURE_DOUBLES)
def q_feature_projection(spark, sf):
    """The 31-column feature row as projected for the store."""
    return FT.feature_projection(FT.pattern_features(
        FT.orig_window_features(FT.dest_window_features(silver_df(spark, sf)))))


@register("share_of_total", with_base("""
SELECT type, round(CAST(count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS DECIMAL(38,12)), 2)::DOUBLE AS pct_of_total_txns,
  round(CAST(sum(amount) * 100.0::DOUBLE / sum(sum(amount)) OVER () AS DECIMAL(38,12)), 2)::DOUBLE AS pct_of_total_volume
FROM fact GROUP BY type"""), ("pct_of_total_txns", "pct_of_total_volume"))
def q_share_of_total(spark, sf):
    from txnlake.operators.models import mart_transaction_type_analysis
    from txnlake.plans.base import fact_df
    return mart_transaction_type_analysis(fact_df(spark, sf)).select(
        "type", "pct_of_total_txns", "pct_of_total_volume")




# ------------------------------------------------------------ feature store



@register("feature_snapshot_write", _feature_sql(ALL_FEATURES), FEATURE_DOUBLES)
def q_snapshot_write(spark, sf):
    """Snapshot `run_date=2024-01-30` of the features over every silver row, read back."""
    base = scratch_path(spark, "features")
    K.feature_snapshot_write(_features(spark, sf), base, "2024-01-30")
    return S.feature_snapshot_scan(spark, base, "2024-01-30")


@register("feature_snapshot_scan", _feature_sql(ALL_FEATURES), FEATURE_DOUBLES)
def q_snapshot_scan(spark, sf):
    """Two overlapping snapshots; the default read takes only the latest one."""
    base = scratch_path(spark, "features")
    silver = silver_df(spark, sf)
    older = FT.window_features(S.rolling_window_scan(silver, "2024-01-20", 30))
    K.feature_snapshot_write(older, base, "2024-01-20")
    K.feature_snapshot_write(FT.window_features(silver), base, "2024-01-30")
    return S.feature_snapshot_scan(spark, base)
