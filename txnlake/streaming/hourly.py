"""The hourly landing -> silver job as a Structured Streaming query.

The landing directory is a file stream; each trigger finds the hours in which files
arrived (tracked in the checkpoint), reads those hours whole and runs the batch cleaning
on them, replacing their silver partitions.  So there is no watermark: a late hour is
kept however late it is, an hour that is landed again is replaced and not doubled, and a
trigger that is run again after a failure writes the same partitions again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from txnlake.operators.cleaning import normalize_partition_keys, silver_transactions
from txnlake.schemas import LANDING_SCHEMA, PARTITION_KEYS, SEQ_COL
from txnlake.sources import sinks as K


def landing_stream_schema(with_seq: bool = True) -> T.StructType:
    fields = list(LANDING_SCHEMA.fields) + [T.StructField(k, T.StringType()) for k in PARTITION_KEYS]
    if with_seq:
        fields.append(T.StructField(SEQ_COL, T.LongType()))
    return T.StructType(fields)


def clean_hours(spark: SparkSession, landing_base: str, silver_base: str,
                hours: DataFrame) -> None:
    """Clean the landing hours (part_dt, part_hour) whole and replace them in silver, without
    repeated rows, like the hourly batch.  The hours of a trigger become literals on the
    partition columns, so only their directories are read."""
    which = K.hours_of(normalize_partition_keys(hours.select(*PARTITION_KEYS).distinct()))
    landing = spark.read.schema(landing_stream_schema()).option("basePath", landing_base).parquet(
        landing_base)
    one = normalize_partition_keys(K.in_hours(landing, which))
    K.partition_overwrite(silver_transactions(one, dedup=True), silver_base)


def run_hourly_stream(spark: SparkSession, landing_base: str, silver_base: str,
                      checkpoint: str, available_now: bool = True,
                      max_files_per_trigger: int | None = None):
    """Start the stream; with `available_now` it processes what has landed and stops."""
    reader = spark.readStream.schema(landing_stream_schema())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def each(batch: DataFrame, _: int) -> None:
        clean_hours(batch.sparkSession, landing_base, silver_base, batch)

    q = (reader.parquet(landing_base).select(*PARTITION_KEYS).writeStream.foreachBatch(each)
         .option("checkpointLocation", checkpoint))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="1 hour")
    return q.start()
