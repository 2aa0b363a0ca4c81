"""Deterministic table logic of the transaction simulator, restated as Spark jobs
over existing transactions: account ledger with a zero floor, amount clipping by
customer segment, the large-transfer flag and the expected hourly fraud rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlake.functions.columns import LARGE_TXN_AMOUNT, clip, epoch_seconds, is_night_hour
from txnlake.operators.features import EXACT, MINUTE_SECONDS, NULL_KEY, bucket_of, hot_keys
from txnlake.schemas import SEQ_COL
from txnlake.session import materialize

# Expected fraud rate (x3 at night) and the per-segment amount
# bounds (min, max) for TRANSFER, CASH_OUT and every other type.
BASE_FRAUD_RATE = 0.0013
NIGHT_FRAUD_MULTIPLIER = 3.0
SEGMENT_AMOUNT_BOUNDS = [
    ("high_value", "TRANSFER", 50000.0, 50000000.0),
    ("high_value", "CASH_OUT", 10000.0, 5000000.0),
    ("high_value", "OTHER", 1000.0, 500000.0),
    ("business", "TRANSFER", 10000.0, 10000000.0),
    ("business", "CASH_OUT", 5000.0, 2000000.0),
    ("business", "OTHER", 500.0, 200000.0),
    ("low_income", "TRANSFER", 100.0, 50000.0),
    ("low_income", "CASH_OUT", 50.0, 20000.0),
    ("low_income", "OTHER", 20.0, 5000.0),
    ("regular", "TRANSFER", 100.0, 10000000.0),
    ("regular", "CASH_OUT", 50.0, 1000000.0),
    ("regular", "OTHER", 50.0, 50000.0),
]
SEGMENT_CLASS = {"dormant": "regular"}  # dormant accounts use the regular bounds


def flag_large_transfer(df: DataFrame) -> DataFrame:
    return df.withColumn("is_large_transfer", F.when(
        (F.col("type") == "TRANSFER") & (F.col("amount") > LARGE_TXN_AMOUNT), 1).otherwise(0)
        .cast("byte"))


def hourly_expected_fraud_rate(hour: str = "hour_of_day"):
    return F.when(is_night_hour(F.col(hour)), F.lit(BASE_FRAUD_RATE * NIGHT_FRAUD_MULTIPLIER)) \
        .otherwise(F.lit(BASE_FRAUD_RATE))


def bounds_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEGMENT_AMOUNT_BOUNDS,
                                 "segment_class string, type_class string, lo double, hi double")


def segment_amount_clip(df: DataFrame, segment: str = "segment") -> DataFrame:
    """Clip `amount` to the bounds of (segment class, type class).  The bounds
    table has a fixed 12 rows, so broadcasting it is size-safe."""
    seg = F.col(segment)
    for src, dst in SEGMENT_CLASS.items():
        seg = F.when(F.col(segment) == src, F.lit(dst)).otherwise(seg)
    tcls = F.when(F.col("type").isin("TRANSFER", "CASH_OUT"), F.col("type")).otherwise("OTHER")
    keyed = df.withColumns({"_sc": seg, "_tc": tcls})
    b = F.broadcast(bounds_table(df.sparkSession))
    j = keyed.join(b, (keyed["_sc"] == b["segment_class"]) & (keyed["_tc"] == b["type_class"]),
                   "left")
    return j.withColumn("clipped_amount", F.when(F.col("lo").isNull(), F.col("amount"))
                        .otherwise(clip(F.col("amount"), F.col("lo"), F.col("hi")))) \
        .drop("_sc", "_tc", "segment_class", "type_class", "lo", "hi")


def ledger_legs(df: DataFrame) -> DataFrame:
    """Each transaction as two balance movements.  Sender: debited, except CASH_IN
    (credited).  Recipient: credited for CASH_IN/TRANSFER, debited for CASH_OUT,
    unchanged for PAYMENT/DEBIT.  The sender leg comes first; a missing amount moves
    nothing.  Both legs come from one pass over the row, which numbers rows that are equal
    in every column, so a repeated transaction is booked sender, recipient, sender, ..."""
    seq = F.col(SEQ_COL) if SEQ_COL in df.columns else F.xxhash64(*df.columns)
    amt, typ = F.coalesce("amount", F.lit(0.0)), F.col("type")
    one = df.select("transaction_time", seq.alias("seq"),
                    F.monotonically_increasing_id().alias("copy"),
                    F.array(
                        F.struct(F.col("user_id").alias("account"), F.lit(0).alias("leg"),
                                 F.when(typ == "CASH_IN", amt).otherwise(-amt).alias("delta")),
                        F.struct(F.col("merchant_id").alias("account"), F.lit(1).alias("leg"),
                                 F.when(typ.isin("CASH_IN", "TRANSFER"), amt)
                                 .when(typ == "CASH_OUT", -amt).otherwise(F.lit(0.0))
                                 .alias("delta"))).alias("legs"))
    return one.select("transaction_time", "seq", "copy", F.inline("legs"))


# An account with more legs than this is split into time buckets.
MAX_ACCOUNT_LEGS = 1_000_000


def ledger_running_balance(df: DataFrame, opening: float = 1000.0,
                           bucket_seconds: int = MINUTE_SECONDS,
                           max_account_legs: int = MAX_ACCOUNT_LEGS) -> DataFrame:
    """Running balance per account with a floor at 0: `b_n = max(0, b_{n-1} + d_n)`.

    Closed form: with `S_n = b0 + sum(d_1..d_n)`, `b_n = S_n - min(0, min_k<=n S_k)`,
    i.e. a running sum and a running min -- both prefix scans.  One plan for every size:
    accounts with more than `max_account_legs` legs (counted in the plan) are split into
    time buckets, whose totals and minima are carried by a window over the small
    (account, bucket) table; every other account is one bucket.  Sums are DECIMAL, so
    neither the split nor the turnover shows in the last digits.  Legs without a time
    come first.  An amount that DECIMAL(28,6) cannot hold (NaN, infinite, 1e22 and more) moves
    nothing, like a missing one.
    """
    key = F.coalesce("account", F.lit(NULL_KEY))
    zero = F.lit(0).cast(EXACT)
    legs = ledger_legs(df).withColumns({"_k": key, "_d": F.coalesce(F.col("delta").try_cast(EXACT), zero)})
    hot = hot_keys(legs, F.col("_k"), max_account_legs)
    by, split = ["_k"], not hot.isEmpty()
    if split:
        hot = materialize(hot)  # at most rows / max_account_legs accounts
        legs = legs.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), "_k", "left").withColumn(
            "_b", bucket_of(F.coalesce("_hot", F.lit(False)), epoch_seconds("transaction_time"),
                            bucket_seconds))
        by = ["_k", "_b"]
    upto = Window.partitionBy(*by).orderBy("transaction_time", "seq", "copy", "leg") \
        .rowsBetween(Window.unboundedPreceding, 0)
    legs = legs.withColumn("_l", F.sum("_d").over(upto)).withColumn("_lm", F.min("_l").over(upto))
    if split:
        before = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        carried = (legs.filter("_hot").groupBy("_k", "_b")
                   .agg(F.sum("_d").alias("_t"), F.min("_l").alias("_m"))
                   .withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
                   .withColumn("_pm", F.min(F.col("_o") + F.col("_m")).over(before))
                   .select("_k", "_b", "_o", "_pm"))
        legs = legs.join(carried, ["_k", "_b"], "left")
    else:
        legs = legs.withColumns({"_o": zero, "_pm": F.lit(None).cast(EXACT)})
    j = legs
    b0 = F.lit(opening).cast(EXACT)
    earlier = F.coalesce("_o", zero)
    least = F.least(b0 + F.col("_pm"), b0 + earlier + F.col("_lm"), zero)
    return j.select("account", "transaction_time", "seq", "leg", "delta",
                    (b0 + earlier + F.col("_l") - least).cast("double").alias("balance"))
