"""The commit log of the models: what is applied, and which paths are current.

A commit is one small table, `_commits/version=N`, written after everything that it names; it
counts once Spark has marked it complete.  It holds, for every hour applied, the version of the
source files it came from and the run that aggregated it, and the path of every published table.
A run reads the last complete commit first: hours whose source differs from it are to be
done, whatever a failed run has left behind, and nothing that is not named is ever read.  One writer
at a time is assumed.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import SparkSession

from txnlake.sources import listing as L

Hour = tuple[str, str]
LOG = "_commits"
FIELDS = "kind string, name string, part_dt string, part_hour string, source string, run long, path string"
KEPT = 3


@dataclasses.dataclass
class Commit:
    version: int
    hours: dict[Hour, tuple[str, int]]  # source version, run of the states
    tables: dict[str, str]


def versions(spark: SparkSession, base: str) -> list[int]:
    """Complete commits, oldest first."""
    log = f"{base}/{LOG}"
    return sorted(int(v) for v in L.key_values(spark, log, "version")
                  if L.exists(spark, f"{log}/version={v}/_SUCCESS"))


def latest(spark: SparkSession, base: str) -> Commit | None:
    got = versions(spark, base)
    if not got:
        return None
    # one row for each hour and table: the log is read whole
    rows = spark.read.schema(FIELDS).parquet(f"{base}/{LOG}/version={got[-1]}").collect()
    return Commit(got[-1], {(r.part_dt, r.part_hour): (r.source, r.run) for r in rows if r.kind == "hour"},
                  {r.name: r.path for r in rows if r.kind == "table"})


def next_version(spark: SparkSession, base: str) -> int:
    """A number that no run has used, complete or not, in the log or in its states."""
    used = [int(v) for v in L.key_values(spark, f"{base}/{LOG}", "version")]
    return max(used, default=-1) + 1


def publish(spark: SparkSession, base: str, commit: Commit) -> None:
    rows = [("hour", None, d, h, source, run, None) for (d, h), (source, run) in sorted(commit.hours.items())]
    rows += [("table", name, None, None, None, commit.version, path)
             for name, path in sorted(commit.tables.items())]
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("overwrite").parquet(
        f"{base}/{LOG}/version={commit.version}")


def clear_old(spark: SparkSession, base: str, names: list[str], now: int, kept: int = KEPT) -> None:
    """Remove versions of the tables and of the log that are older than the last few."""
    for name in [LOG, *names]:
        old = sorted(int(v) for v in L.key_values(spark, f"{base}/{name}", "version"))
        for v in [v for v in old if v < now][:-(kept - 1) or None]:
            L.delete(spark, f"{base}/{name}/version={v}")
