"""Table contracts of the lakehouse layers (landing, silver, fact, dim, features)."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference for right results, here and in all lists and
# schemas below: transaction types, fraud-eligible types, the columns (names, types, order)
# of each layer, the training columns, the model target and the search grid.
TXN_TYPES = ["PAYMENT", "CASH_OUT", "CASH_IN", "TRANSFER", "DEBIT"]
FRAUD_TYPES = ["CASH_OUT", "TRANSFER"]
TARGET_COL = "is_fraud"
TRAIN_RATIO = 0.8
RANDOM_SEED = 42
FEATURE_COLS = [
    "amount", "amount_log",
    "hour_of_day", "day_of_week", "is_night_txn",
    "is_transfer", "is_cash_out",
    "orig_delta_seconds", "dest_delta_seconds",
    "dest_msg_count_1h", "dest_amount_sum_1h", "dest_msg_count_24h", "dest_amount_sum_24h",
    "dest_count_past", "dest_sum_amount_past",
    "orig_msg_count_1h", "orig_amount_sum_1h", "orig_msg_count_24h", "orig_amount_sum_24h",
    "orig_prev_amount", "orig_count_past", "orig_sum_amount_past", "orig_avg_amount_past",
    "is_round_amount",
]
LR_GRID = {"regParam": [0.01, 0.1], "elasticNetParam": [0.0, 0.5, 1.0]}

PARTITION_KEYS = ["part_dt", "part_hour"]
# Optional unique tie-break carried through every layer when the source has one.
SEQ_COL = "txn_seq"

LANDING_SCHEMA = T.StructType([
    T.StructField("step", T.IntegerType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("nameOrig", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("nameDest", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.ByteType()),
    T.StructField("isFlaggedFraud", T.ByteType()),
    T.StructField("transaction_time", T.TimestampType()),
])

# CSV form: header-named text, `step` required, seven forced casts.
CSV_CASTS = {
    "isFraud": "tinyint", "isFlaggedFraud": "tinyint",
    "amount": "double", "oldbalanceOrg": "double", "newbalanceOrig": "double",
    "oldbalanceDest": "double", "newbalanceDest": "double",
}

SILVER_SCHEMA = T.StructType([
    T.StructField("transaction_time", T.TimestampType()),
    T.StructField("type", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("oldbalanceOrg", T.DoubleType()),
    T.StructField("newbalanceOrig", T.DoubleType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("oldbalanceDest", T.DoubleType()),
    T.StructField("newbalanceDest", T.DoubleType()),
    T.StructField("isFraud", T.ByteType()),
    T.StructField("isFlaggedFraud", T.ByteType()),
    T.StructField("errorBalanceOrig", T.DoubleType()),
    T.StructField("errorBalanceDest", T.DoubleType()),
    T.StructField("is_errorBalanceOrig", T.ByteType()),
    T.StructField("is_errorBalanceDest", T.ByteType()),
    T.StructField("is_transfer", T.ByteType()),
    T.StructField("is_cash_out", T.ByteType()),
    T.StructField("is_merchant_dest", T.ByteType()),
    T.StructField("hour_of_day", T.ByteType()),
    T.StructField("day_of_week", T.ByteType()),
    T.StructField("is_all_orig_balance", T.ByteType()),
    T.StructField("is_dest_zero_init", T.ByteType()),
    T.StructField("is_org_zero_init", T.ByteType()),
    T.StructField("processed_at", T.TimestampType()),
])
SILVER_COLUMNS = [f.name for f in SILVER_SCHEMA.fields]

# Staging/fact: snake_case silver plus the surrogate txn_id (27 columns).
STG_RENAMES = [
    ("transaction_time", "transaction_time"), ("type", "type"), ("amount", "amount"),
    ("user_id", "user_id"), ("merchant_id", "merchant_id"),
    ("oldbalanceOrg", "old_balance_orig"), ("newbalanceOrig", "new_balance_orig"),
    ("oldbalanceDest", "old_balance_dest"), ("newbalanceDest", "new_balance_dest"),
    ("isFraud", "is_fraud"), ("isFlaggedFraud", "is_flagged_fraud"),
    ("errorBalanceOrig", "error_balance_orig"), ("errorBalanceDest", "error_balance_dest"),
    ("is_transfer", "is_transfer"), ("is_cash_out", "is_cash_out"),
    ("is_merchant_dest", "is_merchant_dest"), ("hour_of_day", "hour_of_day"),
    ("day_of_week", "day_of_week"), ("is_all_orig_balance", "is_all_orig_balance"),
    ("is_dest_zero_init", "is_dest_zero_init"), ("is_org_zero_init", "is_org_zero_init"),
    ("is_errorBalanceOrig", "is_error_balance_orig"),
    ("is_errorBalanceDest", "is_error_balance_dest"),
    ("processed_at", "processed_at"), ("part_dt", "part_dt"), ("part_hour", "part_hour"),
]
FACT_COLUMNS = [
    "txn_id", "transaction_time", "type", "amount", "user_id", "merchant_id",
    "old_balance_orig", "new_balance_orig", "old_balance_dest", "new_balance_dest",
    "error_balance_orig", "error_balance_dest", "is_fraud", "is_flagged_fraud",
    "is_transfer", "is_cash_out", "is_merchant_dest", "hour_of_day", "day_of_week",
    "is_all_orig_balance", "is_dest_zero_init", "is_org_zero_init",
    "is_error_balance_orig", "is_error_balance_dest", "processed_at", "part_dt", "part_hour",
]

DIM_USERS_COLUMNS = ["user_id", "first_seen", "last_seen", "total_txns", "total_volume",
                     "fraud_count", "avg_txn_amount", "updated_at"]

FEATURE_ROW_COLUMNS = [
    "transaction_time", "user_id", "merchant_id", "amount", "type", "is_fraud",
    "hour_of_day", "day_of_week", "is_transfer", "is_cash_out",
    "orig_delta_seconds", "dest_delta_seconds",
    "dest_msg_count_1h", "dest_amount_sum_1h", "dest_msg_count_24h", "dest_amount_sum_24h",
    "dest_count_past", "dest_sum_amount_past", "dest_history_fraud_count",
    "orig_msg_count_1h", "orig_amount_sum_1h", "orig_msg_count_24h", "orig_amount_sum_24h",
    "orig_prev_amount", "orig_count_past", "orig_sum_amount_past",
    "orig_avg_amount_past", "orig_history_fraud_count",
    "is_night_txn", "is_round_amount", "amount_log",
]
