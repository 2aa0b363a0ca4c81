"""Column -> Column building blocks.  All are built-in Catalyst expressions (codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "flag", "epoch_seconds", "to_utc_timestamp_col", "balance_error_orig", "balance_error_dest",
    "is_nonzero_flag", "night_flag", "round_amount_flag", "amount_log", "merchant_flag",
    "step_to_time", "time_to_step", "part_dt_of", "part_hour_of", "txn_id",
    "round_half_up", "stable_double", "clip", "is_night_hour",
]

# Fixed values that must equal the reference: night hours are >= 22 or <= 6,
# the large-transaction threshold is 200000, the mart balance tolerance is 0.01.
NIGHT_START_HOUR = 22
NIGHT_END_HOUR = 6
LARGE_TXN_AMOUNT = 200000.0
BALANCE_TOLERANCE = 0.01


def flag(cond: Column) -> Column:
    """0/1 tinyint flag; a NULL condition gives 0, like CASE WHEN ... ELSE 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0)).cast("byte")


def to_utc_timestamp_col(c: Column | str) -> Column:
    """Parquet test data loads as TIMESTAMP_NTZ; the session is UTC, so casting is exact."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def epoch_seconds(ts: Column | str) -> Column:
    """Whole epoch seconds of a timestamp (floor), as bigint."""
    return to_utc_timestamp_col(ts).cast("long")


def balance_error_orig(old: str = "oldbalanceOrg", amount: str = "amount",
                       new: str = "newbalanceOrig") -> Column:
    return (F.col(old) - F.col(amount)) - F.col(new)


def balance_error_dest(old: str = "oldbalanceDest", amount: str = "amount",
                       new: str = "newbalanceDest") -> Column:
    return (F.col(old) + F.col(amount)) - F.col(new)


def is_nonzero_flag(c: Column) -> Column:
    """Exact `!= 0` on doubles (silver layer: no tolerance)."""
    return flag(c != 0)


def is_night_hour(hour: Column) -> Column:
    return (hour >= NIGHT_START_HOUR) | (hour <= NIGHT_END_HOUR)


def night_flag(hour_col: str = "hour_of_day") -> Column:
    return F.when(is_night_hour(F.col(hour_col)), 1).otherwise(0)


def round_amount_flag(amount: str = "amount") -> Column:
    return F.when(F.col(amount) % 1000 == 0, 1).otherwise(0)


def amount_log(amount: str = "amount") -> Column:
    return F.log1p(F.col(amount))


def merchant_flag(dest: str = "merchant_id") -> Column:
    return flag(F.col(dest).startswith("M"))


def step_to_time(step: Column, start: str) -> Column:
    """`start + (step - 1) hours`; `start` is a UTC timestamp literal."""
    return F.timestamp_add("HOUR", (step - 1).cast("int"), F.lit(start).cast("timestamp"))


def time_to_step(ts: Column, start: str) -> Column:
    """`floor((ts - start) / 3600) + 1`; NULL (rejected) where that is < 1."""
    start_s = F.lit(start).cast("timestamp").cast("long")
    step = F.floor((epoch_seconds(ts) - start_s) / F.lit(3600)) + 1
    return F.when(step >= 1, step.cast("int"))


def part_dt_of(ts: Column | str) -> Column:
    return F.date_format(to_utc_timestamp_col(ts), "yyyyMMdd")


def part_hour_of(ts: Column | str) -> Column:
    return F.date_format(to_utc_timestamp_col(ts), "HH")


def txn_id(user: str = "user_id", ts: str = "transaction_time") -> Column:
    """Surrogate key `user || '-' || epoch seconds` (NULL if any part is NULL)."""
    return F.concat(F.col(user), F.lit("-"), epoch_seconds(ts).cast("string"))


def round_half_up(c: Column, digits: int) -> Column:
    """Half-up rounding of a double taken at its 12-decimal value.

    Going through DECIMAL makes the result independent of last-bit float noise
    (summation order), so engines agree on values that sit on a .5 boundary.
    """
    return F.round(c.cast("decimal(38,12)"), digits).cast("double")


def stable_double(c: Column, digits: int = 6) -> Column:
    return round_half_up(c, digits)


def clip(c: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(c, lo), hi)
