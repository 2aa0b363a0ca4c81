"""Registered queries: one Spark plan per operator key, each with its DuckDB oracle.

Every query reads the driver's tables (``events`` mapped to transactions) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from txnlake.functions.columns import stable_double
from txnlake.session import ensure_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORACLE_DOUBLES: dict[str, list[str]] = {}
# The plans without the output rounding used for the oracle comparison (bench.py).
RAW: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SOURCE_FUNCS: dict[str, Callable] = {}


def stable(df: DataFrame) -> DataFrame:
    """Round every DOUBLE output at 6 decimals through DECIMAL (see oracle_sql)."""
    dbl = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    if not dbl:
        return df
    return df.withColumns({c: stable_double(df[c]) for c in dbl})


def register(name: str, oracle: str | None = None, doubles: tuple[str, ...] = ()):
    from txnlake.plans.oracle_sql import stable_select

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return stable(fn(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run

        def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_utc(spark)
            return fn(spark, sf_dir)
        RAW[name] = raw
        SOURCE_FUNCS[name] = fn
        if oracle is not None:
            ORACLES[name] = stable_select(oracle, list(doubles))
            ORACLE_DOUBLES[name] = list(doubles)
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from txnlake.plans import (  # noqa: F401
        queries_core,
        queries_features,
        queries_incremental,
        queries_io,
        queries_ml,
    )
