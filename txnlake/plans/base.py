"""Shared inputs of registered queries: events -> landing -> silver -> stg/fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from txnlake.operators.cleaning import silver_transactions, stg_transactions
from txnlake.operators.models import fact_transactions_full
from txnlake.sources.fixture import landing


def landing_df(spark: SparkSession, sf: str) -> DataFrame:
    return landing(spark, sf)


def silver_df(spark: SparkSession, sf: str, keep_processed_at: bool = False) -> DataFrame:
    df = silver_transactions(landing(spark, sf))
    return df if keep_processed_at else df.drop("processed_at")


def stg_df(spark: SparkSession, sf: str) -> DataFrame:
    return stg_transactions(silver_transactions(landing(spark, sf)))


def fact_df(spark: SparkSession, sf: str, keep_processed_at: bool = False) -> DataFrame:
    df = fact_transactions_full(stg_df(spark, sf))
    return df if keep_processed_at else df.drop("processed_at")
