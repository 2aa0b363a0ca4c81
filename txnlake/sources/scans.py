"""Scans: CSV ingest, Hive-style partition scans, typed reads, rolling windows,
path-derived keys, partition listing and feature-store reads.

Partition keys live in directory names; filters on them prune whole directories
before any file is opened, and typed reads skip schema inference.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnlake.operators.cleaning import normalize_partition_keys
from txnlake.schemas import CSV_CASTS, SEQ_COL
from txnlake.sources import listing as L

CSV_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
PART_DT_RE = r"part_dt=([0-9]+)"
PART_HOUR_RE = r"part_hour=([0-9]+)"


class EmptyInputError(ValueError):
    pass


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """The CSV as header-named text; `step` is required."""
    df = (spark.read.option("header", True).option("timestampFormat", CSV_TIMESTAMP_FORMAT)
          .csv(path))
    if "step" not in df.columns:
        raise ValueError("CSV must contain a 'step' column")
    return df


def csv_step_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Read transaction CSV (header-named text), require `step`, force the casts.

    Text is read without inference (no extra pass over the data); the known
    columns are `try_cast`, the rest pass through as text.
    """
    df = csv_text(spark, path)
    casts = dict(CSV_CASTS, step="int", transaction_time="timestamp")
    casts[SEQ_COL] = "long"
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items() if c in df.columns})


def landing_partition_scan(spark: SparkSession, base: str, part_dt: str,
                           part_hour: str) -> DataFrame:
    """One `part_dt/part_hour` directory; keys are recovered from the path."""
    return (spark.read.option("basePath", base)
            .parquet(f"{base}/part_dt={part_dt}/part_hour={part_hour}"))


def landing_bulk_scan(spark: SparkSession, base: str) -> DataFrame:
    """All partitions (partition discovery infers the keys, as integers)."""
    return spark.read.parquet(base)


def typed_scan(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """Fixed data schema (no footer sampling), partition columns discovered."""
    return spark.read.schema(schema).option("basePath", base).parquet(base)


def rolling_window_bounds(exec_date: str, window_days: int = 30) -> tuple[str, str]:
    d = datetime.strptime(exec_date, "%Y-%m-%d")
    return ((d - timedelta(days=window_days)).strftime("%Y%m%d"), d.strftime("%Y%m%d"))


def rolling_window_scan(df: DataFrame, exec_date: str, window_days: int = 30) -> DataFrame:
    """Keep `exec_date - window_days <= part_dt <= exec_date` (both ends inclusive:
    window_days + 1 dates).  Works on string or inferred-integer keys; on a
    partitioned scan it becomes a partition filter."""
    lo, hi = rolling_window_bounds(exec_date, window_days)
    dtype = dict(df.dtypes).get("part_dt")
    if dtype in ("int", "bigint"):
        return df.filter(F.col("part_dt").between(int(lo), int(hi)))
    return df.filter(F.col("part_dt").between(lo, hi))


def path_partition_columns(spark: SparkSession, base: str) -> DataFrame:
    """Read files without partition discovery and derive the keys from each file's
    path (hidden `_metadata.file_path` column)."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(base)
    path = F.col("_metadata.file_path")
    return df.withColumns({
        "part_dt": F.regexp_extract(path, PART_DT_RE, 1),
        "part_hour": F.regexp_extract(path, PART_HOUR_RE, 1),
    })


def list_partitions(spark: SparkSession, base: str) -> DataFrame:
    """(part_dt, part_hour) of a table's hour directories; no file is opened."""
    return spark.createDataFrame(L.hour_partitions(spark, base), "part_dt string, part_hour string")


def feature_snapshot_scan(spark: SparkSession, base: str, run_date: str | None = None,
                          all_dates: bool = False) -> DataFrame:
    """Feature store rows of one `run_date` (default: the latest snapshot, so
    overlapping snapshots are never read together).  `all_dates=True` reads every
    snapshot with its `run_date` column (rolling snapshots overlap: rows repeat)."""
    if all_dates:
        return spark.read.parquet(base)
    if run_date is not None:
        return spark.read.parquet(f"{base}/run_date={run_date}")
    dates = L.key_values(spark, base, "run_date")
    if not dates:
        raise EmptyInputError(f"no snapshots under {base}")
    return spark.read.parquet(f"{base}/run_date={dates[-1]}")


def empty_input_guard(df: DataFrame, what: str = "input") -> DataFrame:
    """Fail on an empty input.  `isEmpty` stops at the first row (a limit-1 job)."""
    if df.isEmpty():
        raise EmptyInputError(f"empty {what}")
    return df


def normalized_landing_scan(spark: SparkSession, base: str) -> DataFrame:
    return normalize_partition_keys(landing_bulk_scan(spark, base))
