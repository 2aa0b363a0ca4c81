"""Sinks and load semantics: Hive-style partitioned writes, idempotent partition
replacement (dynamic overwrite), truncate-and-reload, snapshots, materialization.

Writes go through a `REBALANCE` hint on the partition keys: AQE sizes the output
tasks and splits a hot partition over several files instead of one straggler.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlake.operators.cleaning import normalize_partition_keys
from txnlake.schemas import PARTITION_KEYS
from txnlake.session import scratch_path
from txnlake.sources import listing as L

BATCH_COL = "batch_id"


def _rebalanced(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.hint("rebalance", *keys)


def landing_partitioned_write(df: DataFrame, path: str, mode: str = "overwrite",
                              dynamic: bool = True) -> None:
    """Split by (part_dt, part_hour), keys only in the path (one job, no Python loop)."""
    (_rebalanced(df, PARTITION_KEYS).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
     .partitionBy(*PARTITION_KEYS).parquet(path))


def partition_overwrite(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Replace only the partitions present in `df`; every other partition is kept."""
    keys = keys or PARTITION_KEYS
    (_rebalanced(df, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*keys).parquet(path))


def in_hours(df: DataFrame, hours) -> DataFrame:
    """Rows of the hours (pairs).  Literals on the partition columns, so that only the
    directories of these hours are listed and read."""
    hours = sorted({(str(d), str(h).zfill(2)) for d, h in hours})
    if not hours:
        return df.filter(F.lit(False))
    dates = sorted({d for d, _ in hours})
    return df.filter(F.col("part_dt").cast("string").isin(dates) & F.concat(
        F.col("part_dt").cast("string"), F.lpad(F.col("part_hour").cast("string"), 2, "0")).isin(
        [d + h for d, h in hours]))


def hours_of(df: DataFrame) -> list[tuple[str, str]]:
    """The hours that have rows: a handful, or as many as the load has."""
    return sorted((r[0], r[1]) for r in df.select(*PARTITION_KEYS).distinct().collect())


def replace_hours(df: DataFrame, path: str, hours) -> None:
    """Replace the given hours by the rows of `df`, which has no others; hours without rows
    there are emptied."""
    spark, there = df.sparkSession, hours_of(df)
    if there:
        partition_overwrite(df, path)
    for d, h in set(hours) - set(there):
        if old := L.hour_path(spark, path, d, h):
            L.delete(spark, old)


#: Beside a landing table: the hours that each batch covers (readers skip the folder).
MANIFEST = "_batches"


def _batch_hours(spark: SparkSession, path: str, batch_id: str) -> list[tuple[str, str]]:
    """The hours that hold the batch, from the manifest; a batch that it lacks is looked for
    in the table, by its one column."""
    manifest = f"{path}/{MANIFEST}/batch={batch_id}"
    done = [v for v in L.key_values(spark, manifest, "version")
            if L.exists(spark, f"{manifest}/version={v}/_SUCCESS")]
    if done:
        newest = max(done, key=int)
        return hours_of(spark.read.schema("part_dt string, part_hour string").parquet(
            f"{manifest}/version={newest}"))
    if not L.hour_partitions(spark, path):
        return []
    there = normalize_partition_keys(spark.read.option("mergeSchema", True).parquet(path))
    return hours_of(there.filter(F.col(BATCH_COL) == batch_id)) if BATCH_COL in there.columns else []


def _write_batch_hours(spark: SparkSession, path: str, batch_id: str, hours) -> None:
    manifest = f"{path}/{MANIFEST}/batch={batch_id}"
    old = [int(v) for v in L.key_values(spark, manifest, "version")]
    spark.createDataFrame(sorted(hours), "part_dt string, part_hour string").coalesce(1).write.parquet(
        f"{manifest}/version={max(old, default=-1) + 1}")
    for v in old:
        L.delete(spark, f"{manifest}/version={v}")


def landing_batch_replace(df: DataFrame, path: str, batch_id: str, whole: bool = False) -> None:
    """Land one batch again: in the hours that it covers, its earlier rows go and the other
    batches' rows stay.  `whole`: in all hours that held it, so hours that it no longer covers
    lose its rows, and an empty batch goes altogether.  Only the hours touched are read and
    written (copy on write): a manifest tells those of the batch.  Rows carry their `batch_id`;
    re-running is idempotent, also after a failure between the rows and the manifest."""
    spark, batch_id = df.sparkSession, str(batch_id)
    batch = stored(normalize_partition_keys(df.withColumn(BATCH_COL, F.lit(batch_id))), "batch")
    now, before = hours_of(batch), _batch_hours(spark, path, batch_id)
    touched = sorted(set(now) | (set(before) if whole else set()))
    if not touched:
        return
    # said before the rows are written: a failed run leaves too many hours there, never too few
    _write_batch_hours(spark, path, batch_id, set(now) | set(before))
    if set(L.hour_partitions(spark, path)) & set(touched):
        there = in_hours(spark.read.option("mergeSchema", True).parquet(path), touched)
        kept = normalize_partition_keys(there)
        if BATCH_COL in there.columns:
            kept = kept.filter(F.col(BATCH_COL).isNull() | (F.col(BATCH_COL) != batch_id))
        batch = stored(batch.unionByName(kept, allowMissingColumns=True), "landing")
    replace_hours(batch, path, touched)
    _write_batch_hours(spark, path, batch_id, set(now) | (set() if whole else set(before)))


def delete_insert_partition(df: DataFrame, path: str, part_dt: str, part_hour: str) -> None:
    """Delete one (part_dt, part_hour) and insert it again: re-runs never duplicate, and an
    hour without rows is emptied."""
    one = df.filter((F.col("part_dt") == part_dt) & (F.col("part_hour") == part_hour))
    replace_hours(one, path, [(part_dt, part_hour)])


def bulk_repartition_write(df: DataFrame, path: str) -> None:
    """Bulk (init) write: cluster rows by partition keys, replace the whole table."""
    (_rebalanced(df, PARTITION_KEYS).write.mode("overwrite")
     .option("partitionOverwriteMode", "static").partitionBy(*PARTITION_KEYS).parquet(path))


def truncate_reload(df: DataFrame, path: str) -> None:
    """Clear the table and load every partition (static overwrite)."""
    bulk_repartition_write(df, path)


def warehouse_table_write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Warehouse table: partitioned by date/hour, rows sorted by (transaction_time,
    user_id) inside each file, so min/max statistics prune time-range reads.
    "overwrite" replaces the table, with every partition that it had."""
    (_rebalanced(df, PARTITION_KEYS).sortWithinPartitions("transaction_time", "user_id")
     .write.mode(mode).option("partitionOverwriteMode", "static")
     .partitionBy(*PARTITION_KEYS).parquet(path))


def expire_partitions(spark: SparkSession, path: str, before: str) -> list[tuple[str, str]]:
    """Drop the hours that lie wholly before `before` (`yyyyMMddHH`); directories only."""
    gone = [(d, h) for d, h in L.hour_partitions(spark, path) if d + h < before]
    for d, h in gone:
        L.delete(spark, L.hour_path(spark, path, d, h))
    return gone


def feature_snapshot_write(df: DataFrame, base: str, run_date: str,
                           files: int | None = None) -> str:
    """Overwrite `run_date=<d>`; a file count may be fixed, else AQE sizes the files."""
    out = f"{base}/run_date={run_date}"
    df = df.repartition(files) if files else df.hint("rebalance")
    df.write.mode("overwrite").parquet(out)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written once under the checkpoint root, read back (lineage ends there)."""
    return materialize_table(df, scratch_path(df.sparkSession, name))


def materialize_view(df: DataFrame, name: str) -> DataFrame:
    """View materialization: a named, lazily evaluated temp view."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def materialize_table(df: DataFrame, path: str) -> DataFrame:
    """Table materialization: computed once, stored as Parquet, read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)

