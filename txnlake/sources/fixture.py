"""Deterministic mapping of the driver's ``events`` table onto landing transactions.

The reference ships no inputs; this mapping gives every operator a real,
scalable source whose work grows with ``events``.  Pure per-row expressions:
the scan keeps column pruning and predicate pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.functions.columns import epoch_seconds, part_dt_of, part_hour_of
from txnlake.schemas import SEQ_COL

# Fixed values of the mapping (FIXTURES.md section 3).
FIXTURE_START = "2024-01-01 00:00:00"
FIXTURE_START_EPOCH = 1704067200
EVENT_TYPE_TO_TXN = {
    "purchase": "PAYMENT",
    "view": "CASH_OUT",
    "signup": "CASH_IN",
    "click": "TRANSFER",
    "error": "DEBIT",
}
USERS_PER_BLOCK = 150  # senders pay recipients of their block, so pools grow with the users
MERCHANTS_PER_BLOCK = 20
SEGMENT_BY_USER_MOD20 = [  # user_id % 20 -> segment
    (0, 0, "high_value"), (1, 2, "business"), (3, 14, "regular"),
    (15, 18, "low_income"), (19, 19, "dormant"),
]
OPENING_BALANCE = 1000.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _type_expr(c):
    expr = None
    for ev, tx in EVENT_TYPE_TO_TXN.items():
        expr = (F.when(c == ev, tx) if expr is None else expr.when(c == ev, tx))
    return expr


def landing_from_events(events: DataFrame, with_partition_keys: bool = True,
                        with_seq: bool = True) -> DataFrame:
    """events -> landing transaction rows (`step`, camelCase columns, time, keys)."""
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    typ = _type_expr(F.col("event_type"))
    # Cents rounding written with IEEE operations only (same bits in every engine);
    # the BigDecimal-based round() would be re-evaluated wherever Catalyst inlines it.
    amount = F.floor(F.col("value") * F.lit(1000.0) * F.lit(100.0) + F.lit(0.5)) / F.lit(100.0)
    old_orig = (F.when(eid % 10 == 0, F.lit(0.0))
                .when(eid % 10 == 1, amount)
                .otherwise(amount + (eid % 97).cast("double") * F.lit(100.0)))
    old_dest = F.when(eid % 3 == 0, F.lit(0.0)).otherwise((eid % 53).cast("double") * F.lit(250.0))
    df = events.select(
        eid.alias("_eid"),
        ts.alias("transaction_time"),
        typ.alias("type"),
        amount.alias("amount"),
        F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("nameOrig"),
        F.floor(F.col("user_id") / USERS_PER_BLOCK).alias("_block"),
        old_orig.alias("oldbalanceOrg"),
        old_dest.alias("oldbalanceDest"),
    )
    is_pay = F.col("type").isin("PAYMENT", "DEBIT")
    e = F.col("_eid")
    df = df.select(
        "*",
        (F.floor((epoch_seconds("transaction_time") - F.lit(FIXTURE_START_EPOCH)) / 3600) + 1)
        .cast("int").alias("step"),
        F.when(is_pay, F.concat(F.lit("M"), (
            F.col("_block") * MERCHANTS_PER_BLOCK + e % MERCHANTS_PER_BLOCK).cast("string")))
        .otherwise(F.concat(F.lit("C"), (
            F.col("_block") * USERS_PER_BLOCK + (e * 7 + 3) % USERS_PER_BLOCK).cast("string")))
        .alias("nameDest"),
        F.when(e % 4 == 0, F.col("oldbalanceOrg"))
        .otherwise(F.greatest(F.col("oldbalanceOrg") - F.col("amount"), F.lit(0.0)))
        .alias("newbalanceOrig"),
        F.when(e % 5 == 0, F.col("oldbalanceDest"))
        .otherwise(F.col("oldbalanceDest") + F.col("amount")).alias("newbalanceDest"),
        F.when(F.col("type").isin("TRANSFER", "CASH_OUT") & (e % 37 == 0), 1).otherwise(0)
        .cast("byte").alias("isFraud"),
        F.when((F.col("type") == "TRANSFER") & (F.col("amount") > 200000), 1).otherwise(0)
        .cast("byte").alias("isFlaggedFraud"),
    )
    cols = ["step", "type", "amount", "nameOrig", "oldbalanceOrg", "newbalanceOrig",
            "nameDest", "oldbalanceDest", "newbalanceDest", "isFraud", "isFlaggedFraud",
            "transaction_time"]
    out = [F.col(c) for c in cols]
    if with_partition_keys:
        out += [part_dt_of("transaction_time").alias("part_dt"),
                part_hour_of("transaction_time").alias("part_hour")]
    if with_seq:
        out.append(F.col("_eid").alias(SEQ_COL))
    return df.select(*out)


def landing(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return landing_from_events(read_table(spark, sf_dir, "events"), **kw)


def segment_of_user(user_num: str = "user_num"):
    """Customer segment by `user_id % 20` (the reference's 5/10/60/20/5 % shares)."""
    m = F.col(user_num) % 20
    expr = None
    for lo, hi, name in SEGMENT_BY_USER_MOD20:
        cond = m.between(lo, hi)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr
