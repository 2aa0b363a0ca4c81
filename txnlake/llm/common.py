"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import shutil
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import txnlake
from txnlake.session import scratch_path

_shipped: set[str] = set()
#: Broadcasts made for a stage of a pipeline, while one is built; None: not in a stage.
_lent: list | None = None
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written under spark.checkpoint.dir and read back: lineage ends here and
    a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, value):
    """A broadcast; one made in a stage lives until the next ``stage`` begins."""
    shared = spark.sparkContext.broadcast(value)
    if _lent is not None:
        _lent.append(shared)
    return shared


#: Rows of a batch between Spark and a worker, at most, in a pipeline's stages: whole texts are long.
STAGE_BATCH = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def stage(spark: SparkSession):
    """Around the building of a stage, whose result is written before the next one is built: what
    the stage before has broadcast is given back, on executors and driver.  Batches are made
    small, so that two tasks' batches of whole texts fit beside the heap."""
    global _lent
    if not 0 < int(spark.conf.get(_BATCH_CONF, "10000")) <= STAGE_BATCH:
        spark.conf.set(_BATCH_CONF, str(STAGE_BATCH))
    for old in _held_over:
        old.destroy()
    _held_over.clear()
    _lent = []
    try:
        yield
    finally:
        _held_over.extend(_lent)
        _lent = None


_held_over: list = []


#: In a Python worker: what it keeps for later tasks, of one operator at a time.
_kept: dict = {}


def turn_to(operator: str) -> None:
    """A worker that turns from one operator to another lets go of what it kept for the first;
    memory that is free goes back to the system, as workers live on from stage to stage."""
    if _kept.get("operator") != operator:
        _kept.clear()
        _kept["operator"] = operator
        gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def kept(operator: str, key, make):
    """``make()``, kept by this worker for later tasks of the operator."""
    turn_to(operator)
    if _kept.get("key") != key:
        _kept["key"], _kept["value"] = key, make()
    return _kept["value"]


def each(cells: pa.Array):
    """The values of an Arrow array, one at a time: no list of all texts of a batch."""
    return (x.as_py() for x in cells)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (any case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Nothing is done where the cluster's PYTHONPATH has it (or it was submitted as a zip);
    otherwise Spark's own file server hands the package to each executor, once a context.
    """
    root = os.path.dirname(os.path.abspath(txnlake.__file__))
    home, sc = os.path.dirname(root), spark.sparkContext
    on_path = map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    if home in on_path or not os.path.isdir(root) or sc.applicationId in _shipped:
        return
    held = os.path.realpath(tempfile.mkdtemp(prefix="txnlake-"))
    atexit.register(shutil.rmtree, held, ignore_errors=True)
    with zipfile.ZipFile(f"{held}/txnlake.zip", "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, home))
    sc.addPyFile(f"{held}/txnlake.zip")
    _shipped.add(sc.applicationId)


def lower_ascii(col):
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, ASCII_UPPER, ASCII_UPPER.lower())


def order_statistics(df: DataFrame, key: str, value: str, places) -> dict:
    """Key -> of its values in ascending order, those at ``places(n)`` (from 0; n: how many it has).
    One sort by (key, value), dealt by ranges; only the values asked for come to the driver."""
    pairs = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    wanted, start = {}, 0
    for r in pairs.groupBy("k").count().orderBy("k").collect():
        wanted[r.k] = [start + i for i in places(r["count"])]
        start += r["count"]
    at = {i for found in wanted.values() for i in found}
    got = dict(pairs.orderBy("k", "v").rdd.zipWithIndex().filter(lambda x: x[1] in at).map(
        lambda x: (x[1], x[0][1])).collect())
    return {k: [got[i] for i in found] for k, found in wanted.items()}


def sample_share(df: DataFrame, rows: int, *cols) -> DataFrame:
    """About ``rows`` rows (all, if fewer), chosen by a hash of ``cols``: the same rows on
    every run and on every partitioning.  Used for model fitting only."""
    n = df.count()
    if n <= rows:
        return df
    cut = int((1 << 31) * rows / n)
    return df.where(F.pmod(F.xxhash64(F.lit("fit"), *cols), F.lit(1 << 31)) < cut)
