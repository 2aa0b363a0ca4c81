"""Load semantics: high-water selection, key upserts, latest version per key,
retention and defaults.  Idempotent by construction: a re-run selects nothing new
or replaces rows by key, never appends duplicates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnlake.operators.models import dim_users_merge, new_user_stats
from txnlake.schemas import PARTITION_KEYS

EPOCH_HIGH_WATER = "1970010100"


def _scalar(df: DataFrame, expr: Column) -> object:
    """One aggregated value (a single row) brought to the driver as a literal, so the
    following filter is static and prunes partitions/row groups at the scan."""
    return df.agg(expr.alias("v")).first()["v"]


def partition_high_water(target: DataFrame) -> str:
    v = _scalar(target, F.max(F.concat(F.col("part_dt"), F.col("part_hour"))))
    return v if v is not None else EPOCH_HIGH_WATER


def newer_than(src: DataFrame, hw: str) -> DataFrame:
    """`part_dt || part_hour > hw`, led by `part_dt >= hw[:8]` on the bare column so
    the bound prunes partitions / row groups at the scan."""
    return src.filter((F.col("part_dt") >= F.lit(hw[:8]))
                      & (F.concat(F.col("part_dt"), F.col("part_hour")) > F.lit(hw)))


def incremental_high_water(src: DataFrame, target: DataFrame) -> DataFrame:
    """Source rows in partitions strictly newer than the target's newest partition."""
    return newer_than(src, partition_high_water(target))


def user_dim_high_water(src: DataFrame, dim: DataFrame) -> DataFrame:
    """Rows newer than the dimension's newest `last_seen`, compared in one format
    (`yyyyMMddHH`) so the boundary hour is never read twice."""
    v = _scalar(dim, F.date_format(F.max("last_seen"), "yyyyMMddHH"))
    return newer_than(src, v if v is not None else EPOCH_HIGH_WATER)


def dim_users_incremental(dim: DataFrame, batch: DataFrame) -> DataFrame:
    """One incremental run of the user dimension: select new rows, aggregate, merge."""
    return dim_users_merge(dim, new_user_stats(user_dim_high_water(batch, dim),
                                               "amount_count" in dim.columns))


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """delete+insert on a key: old rows whose key re-appears are replaced by the new rows.
    A NULL key is a key like any other, so loading a batch again adds nothing.  How the
    keys meet (broadcast or shuffle) is left to the optimizer, which knows their size."""
    again = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys]).distinct()
    same = [old[k].eqNullSafe(again[f"_new_{k}"]) for k in keys]
    return old.join(again, same, "left_anti").unionByName(new)


def fact_transactions_incremental(src: DataFrame, target: DataFrame) -> DataFrame:
    """The target and the source's newer hours.  A transaction id never spans two hours, so
    strictly newer hours hold no key of the target: nothing is to be replaced or joined."""
    return target.unionByName(incremental_high_water(src, target))


def replace_hours(target: DataFrame, src: DataFrame, hours: DataFrame) -> DataFrame:
    """The target with the given (part_dt, part_hour) taken from the source instead: late
    hours come in, re-run hours are replaced, hours that the source has lost go."""
    hours = hours.select(*PARTITION_KEYS).distinct()
    return target.join(hours, PARTITION_KEYS, "left_anti").unionByName(
        src.join(hours, PARTITION_KEYS, "left_semi"))


def dim_users_replace(dim: DataFrame, fact: DataFrame, touched: DataFrame) -> DataFrame:
    """The dimension after hours were replaced: the touched users (column user_id) are
    aggregated anew from the whole fact, all others stay as they are."""
    users = touched.select(F.col("user_id").alias("_touched")).distinct()

    def of(df: DataFrame, how: str) -> DataFrame:
        return df.join(users, df["user_id"].eqNullSafe(users["_touched"]), how)

    return of(dim, "left_anti").unionByName(new_user_stats(of(fact, "left_semi")))


def latest_version_per_key(df: DataFrame, keys: list[str], version: str,
                           tiebreak: list[str] | None = None) -> DataFrame:
    """Newest row per key (a replacing-by-version table).

    A `max_by` aggregate instead of a row_number window: it combines map-side, so
    a key with millions of versions never lands whole in one task.
    """
    order = F.struct(F.col(version), *[F.col(c) for c in (tiebreak or [])])
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_row"))
            .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]))


def retention_filter(df: DataFrame, ts: str, as_of: str, interval: str = "1 YEAR") -> DataFrame:
    """TTL: keep rows with `ts + interval > as_of`.

    A looser bound on the bare column (`ts > as_of - interval - 1 day`, folded to a
    literal) goes first so the scan can push it down and skip row groups; the exact
    month-arithmetic predicate then decides the boundary rows.
    """
    as_of_ts = F.lit(as_of).cast("timestamp")
    bound = as_of_ts - F.expr(f"INTERVAL {interval}") - F.expr("INTERVAL 1 DAY")
    return df.filter((F.col(ts) > bound)
                     & (F.col(ts) + F.expr(f"INTERVAL {interval}") > as_of_ts))


def retention_hour(as_of: str, years: int = 1) -> str:
    """The first hour (`yyyyMMddHH`) of which `retention_filter` may keep a row: `years` calendar
    years before `as_of`, as there (what would be 29 February is 1 March)."""
    at = datetime.fromisoformat(as_of)
    try:
        at = at.replace(year=at.year - years)
    except ValueError:
        at = at.replace(year=at.year - years, month=3, day=1, hour=0)
    return at.strftime("%Y%m%d%H")


def default_now(df: DataFrame, col: str, run_ts: str | None = None) -> DataFrame:
    """`DEFAULT now()`: fill a missing stamp with the run time (fixed when given)."""
    now = F.lit(run_ts).cast("timestamp") if run_ts else F.current_timestamp()
    if col not in df.columns:
        return df.withColumn(col, now)
    return df.withColumn(col, F.coalesce(F.col(col), now))
