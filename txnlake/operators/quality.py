"""Data-quality checks as aggregations (no collect of data-sized frames)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.sources import listing as L

# Fixed thresholds of the source freshness check (hours) and bad-row tolerance.
FRESHNESS_WARN_HOURS = 2
FRESHNESS_ERROR_HOURS = 6
BAD_ROW_TOLERANCE = 0.1


def dq_unique(df: DataFrame, col: str, check: str | None = None) -> DataFrame:
    """One row: keys that occur more than once and the rows they cover."""
    dup = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    return dup.agg(
        F.count(F.lit(1)).alias("duplicate_keys"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_rows"),
    ).select(F.lit(check or col).alias("check"), "*",
             (F.col("duplicate_keys") == 0).alias("passed"))


def dq_not_null(df: DataFrame, col: str, check: str | None = None) -> DataFrame:
    return df.agg(F.count_if(F.col(col).isNull()).alias("null_rows")).select(
        F.lit(check or col).alias("check"), "null_rows", (F.col("null_rows") == 0).alias("passed"))


def dq_freshness(df: DataFrame, ts: str, as_of: str, warn_h: float = FRESHNESS_WARN_HOURS,
                 error_h: float = FRESHNESS_ERROR_HOURS) -> DataFrame:
    """Newest `ts` against `as_of`: pass / warn (> warn_h hours) / error (> error_h)."""
    newest = F.max(F.col(ts).cast("timestamp"))
    age = (F.lit(as_of).cast("timestamp").cast("double") - newest.cast("double")) / 3600.0
    return df.agg(newest.alias("newest"), age.alias("age_hours")).select(
        "newest", "age_hours",
        F.when(F.col("age_hours") > error_h, "error").when(F.col("age_hours") > warn_h, "warn")
        .otherwise("pass").alias("status"))


def dq_output_files(spark: SparkSession, path: str, min_files: int = 1,
                    min_kb: float = 0.0) -> DataFrame:
    """Data files under `path` (markers ignored): count, bytes, verdict.  From the file
    system's listing; no file is opened."""
    sizes = [size for _, size in L.data_files(spark, path)]
    total = sum(sizes)
    ok = len(sizes) >= min_files and total / 1024.0 >= min_kb and total > 0
    return spark.createDataFrame([(len(sizes), total, ok)],
                                 "n_files long, total_bytes long, passed boolean")


def dq_profile(tables: dict[str, DataFrame], database: str = "default",
               sample: int = 20) -> DataFrame:
    """One row per table: database, table, rows, and `sample` rows as JSON (the smallest by
    their text, so the report is the same on every run)."""
    rows = None
    for name, df in tables.items():
        json = F.to_json(F.struct(*df.columns))
        shown = df.select(json.alias("j")).orderBy("j").limit(sample).agg(
            F.sort_array(F.collect_list("j")).alias("sample"))
        one = df.agg(F.count(F.lit(1)).alias("row_count")).unionByName(
            shown, allowMissingColumns=True).agg(  # two rows, one of each
            F.max("row_count").alias("row_count"), F.first("sample", ignorenulls=True)
            .alias("sample")).select(F.lit(database).alias("database"),
                                     F.lit(name).alias("table"), "row_count", "sample")
        rows = one if rows is None else rows.unionByName(one)
    return rows


class QualityError(ValueError):
    pass


def gate(check: DataFrame, what: str, severity: str = "error") -> list[dict]:
    """Read a check's verdict rows and act: raise ("error") or warn ("warn") if one has not
    passed.  Checks are one row each, so nothing of the data's size is collected."""
    if severity == "off":
        return []
    rows = [r.asDict() for r in check.collect()]
    verdicts = ("passed", "accepted")
    for r in rows:
        bad = r.get("status") == "error" or any(r.get(v) is False for v in verdicts)
        if bad and severity == "error":
            raise QualityError(f"{what}: {r}")
        if bad or r.get("status") == "warn":
            warnings.warn(f"{what}: {r}", stacklevel=2)
    return rows


def load_counts_agree(expected: DataFrame, loaded: DataFrame) -> DataFrame:
    """Rows meant to be loaded against rows that are there."""
    n = F.count(F.lit(1))
    both = expected.agg(n.alias("expected_rows")).unionByName(
        loaded.agg(n.alias("loaded_rows")), allowMissingColumns=True)
    return both.agg(F.max("expected_rows").alias("expected_rows"),
                    F.max("loaded_rows").alias("loaded_rows")).select(
        "*", (F.col("expected_rows") == F.col("loaded_rows")).alias("passed"))


def bad_row_tolerance(text: DataFrame, numeric_cols: dict[str, str],
                      tolerance: float = BAD_ROW_TOLERANCE) -> DataFrame:
    """Share of rows with a value that fails its cast; accepted if <= tolerance."""
    bad = None
    for c, t in numeric_cols.items():
        cond = F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()
        bad = cond if bad is None else (bad | cond)
    return text.agg(F.count(F.lit(1)).alias("total_rows"),
                    F.count_if(bad).alias("bad_rows")).select(
        "total_rows", "bad_rows",
        (F.col("bad_rows") / F.greatest(F.col("total_rows"), F.lit(1))).alias("bad_ratio"),
    ).withColumn("accepted", F.col("bad_ratio") <= tolerance)
