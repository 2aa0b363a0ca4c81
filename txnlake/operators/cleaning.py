"""Bronze -> silver cleaning, row-level flags and staging (all narrow, no shuffle
except the optional full-row dedupe)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.functions.columns import (
    balance_error_dest, balance_error_orig, flag, is_nonzero_flag, merchant_flag, txn_id,
)
from txnlake.schemas import PARTITION_KEYS, SEQ_COL, SILVER_COLUMNS, STG_RENAMES


def _extras(df: DataFrame, names) -> list[str]:
    return [c for c in names if c in df.columns]


def clean_transactions(df: DataFrame) -> DataFrame:
    """Cast time/money/flags, trim `type`, rename accounts, drop `step`.

    `try_cast` keeps the reference's non-ANSI behaviour: a bad value becomes NULL.
    """
    cols: list[Column] = [
        F.col("transaction_time").try_cast("timestamp").alias("transaction_time"),
        F.trim(F.col("type")).alias("type"),
        F.col("amount").try_cast("double").alias("amount"),
        F.col("nameOrig").alias("user_id"),
        F.col("oldbalanceOrg").try_cast("double").alias("oldbalanceOrg"),
        F.col("newbalanceOrig").try_cast("double").alias("newbalanceOrig"),
        F.col("nameDest").alias("merchant_id"),
        F.col("oldbalanceDest").try_cast("double").alias("oldbalanceDest"),
        F.col("newbalanceDest").try_cast("double").alias("newbalanceDest"),
        F.col("isFraud").try_cast("byte").alias("isFraud"),
        F.col("isFlaggedFraud").try_cast("byte").alias("isFlaggedFraud"),
    ]
    cols += [F.col(c) for c in _extras(df, PARTITION_KEYS + [SEQ_COL])]
    return df.select(*cols)


def dedup_transactions(df: DataFrame, enabled: bool = True) -> DataFrame:
    """Full-row duplicate removal (incremental mode only in the reference)."""
    return df.dropDuplicates() if enabled else df


def run_stamp(run_ts: str | None = None) -> Column:
    return F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp()


def add_processed_at(df: DataFrame, run_ts: str | None = None) -> DataFrame:
    """Stamp processing time; a fixed `run_ts` makes the stamp reproducible."""
    return df.withColumn("processed_at", run_stamp(run_ts))


def balance_errors() -> dict[str, Column]:
    return {"errorBalanceOrig": balance_error_orig(), "errorBalanceDest": balance_error_dest()}


def balance_error_flags() -> dict[str, Column]:
    return {f"is_{c}": is_nonzero_flag(F.col(c)) for c in ("errorBalanceOrig", "errorBalanceDest")}


def type_one_hot() -> dict[str, Column]:
    return {"is_transfer": flag(F.col("type") == "TRANSFER"),
            "is_cash_out": flag(F.col("type") == "CASH_OUT")}


def time_parts() -> dict[str, Column]:
    """hour_of_day 0-23, day_of_week 1=Sunday..7=Saturday."""
    return {"hour_of_day": F.hour("transaction_time").cast("byte"),
            "day_of_week": F.dayofweek("transaction_time").cast("byte")}


def account_flags() -> dict[str, Column]:
    """Merchant recipient, emptied sender, accounts that begin with nothing."""
    return {"is_merchant_dest": merchant_flag("merchant_id"),
            "is_all_orig_balance": flag(F.col("amount") == F.col("oldbalanceOrg")),
            "is_dest_zero_init": flag(F.col("oldbalanceDest") == 0),
            "is_org_zero_init": flag(F.col("oldbalanceOrg") == 0)}


def partition_keys(part_dt: str | None = None, part_hour: str | None = None) -> dict[str, Column]:
    """String keys `'YYYYMMDD'`, `'HH'`: literals for one partition, else cast + lpad
    (partition discovery infers them as integers)."""
    if part_dt is not None:
        return {"part_dt": F.lit(str(part_dt)), "part_hour": F.lit(str(part_hour))}
    return {"part_dt": F.col("part_dt").cast("string"),
            "part_hour": F.lpad(F.col("part_hour").cast("string"), 2, "0")}


def normalize_partition_keys(df: DataFrame, part_dt: str | None = None,
                             part_hour: str | None = None) -> DataFrame:
    return df.withColumns(partition_keys(part_dt, part_hour))


def add_row_features(df: DataFrame, more: dict[str, Column] | None = None) -> DataFrame:
    """All silver-layer row features: the errors, then what is read from them."""
    return df.withColumns(balance_errors()).withColumns(
        balance_error_flags() | type_one_hot() | time_parts() | account_flags() | (more or {}))


def silver_transactions(landing: DataFrame, part_dt: str | None = None,
                        part_hour: str | None = None, dedup: bool | None = None,
                        run_ts: str | None = None) -> DataFrame:
    """The whole cleaning job: landing rows -> 24 silver columns + partition keys.

    `part_dt=None` is bulk mode (keys normalised from the data, no dedupe by
    default); a given partition is incremental mode (literal keys, dedupe).
    """
    incremental = part_dt is not None
    df = clean_transactions(landing)
    df = dedup_transactions(df, incremental if dedup is None else dedup)
    keyed = incremental or "part_dt" in landing.columns
    keys = partition_keys(part_dt, part_hour) if keyed else {}
    df = add_row_features(df, {"processed_at": run_stamp(run_ts)} | keys)
    return df.select(*SILVER_COLUMNS, *(PARTITION_KEYS if keyed else []),
                     *_extras(landing, [SEQ_COL]))


def stg_transactions(silver: DataFrame) -> DataFrame:
    """Staging view: snake_case names plus the surrogate `txn_id` (27 columns)."""
    cols = [F.col(src).alias(dst) for src, dst in STG_RENAMES if src in silver.columns]
    cols.append(txn_id("user_id", "transaction_time").alias("txn_id"))
    cols += [F.col(c) for c in _extras(silver, [SEQ_COL])]
    return silver.select(*cols)
