"""Directory-level metadata of Hive-style tables, through the file system's own listing.

Only directory entries are read (one call per directory), never files, so listing
costs the number of partitions.  The one place that reaches for Hadoop's FileSystem.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a partition or version directory (nothing happens if it is not there)."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def key_values(spark: SparkSession, base: str, key: str) -> list[str]:
    """Values of the `key=value` directories directly under `base`, sorted."""
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{key}="))


def hour_partitions(spark: SparkSession, base: str) -> list[tuple[str, str]]:
    """(part_dt, part_hour as two digits) of every hour directory, sorted."""
    return sorted((d, h.zfill(2)) for d in key_values(spark, base, "part_dt")
                  for h in key_values(spark, f"{base}/part_dt={d}", "part_hour"))


def hour_versions(spark: SparkSession, base: str) -> dict[tuple[str, str], str]:
    """A mark of each hour's files (number, bytes, newest change): another one means that the hour
    was written again.  Spark lists the directories, in parallel; no file is opened and one row
    for each hour comes back."""
    if not hour_partitions(spark, base):
        return {}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option(
        "pathGlobFilter", "*.parquet").load(base)
    rows = files.selectExpr(
        "regexp_extract(path, 'part_dt=([0-9]+)', 1) AS d",
        "lpad(regexp_extract(path, 'part_hour=([0-9]+)', 1), 2, '0') AS h", "length",
        "modificationTime").groupBy("d", "h").agg(
        F.concat_ws(":", F.count(F.lit(1)), F.sum("length"), F.max(F.unix_micros("modificationTime"))
                    ).alias("v")).collect()
    return {(r.d, r.h): r.v for r in rows if r.d}


def hour_path(spark: SparkSession, base: str, part_dt: str, part_hour: str) -> str | None:
    """The directory of an hour, whether its name is padded or not."""
    for h in dict.fromkeys((part_hour, part_hour.zfill(2), str(int(part_hour)))):
        path = f"{base}/part_dt={part_dt}/part_hour={h}"
        if exists(spark, path):
            return path
    return None


def data_files(spark: SparkSession, path: str) -> Iterator[tuple[str, int]]:
    """(path, bytes) of the data files under one directory; markers and hidden files are
    left out."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return
    found = fs.listFiles(p, True)
    while found.hasNext():
        s = found.next()
        name = s.getPath().getName()
        if not name.startswith(("_", ".")) and not name.endswith(".crc"):
            yield s.getPath().toString(), s.getLen()
