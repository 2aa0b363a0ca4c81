"""SparkSession helpers: UTC pinning, AQE defaults and a shared scratch root."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

UTC = "UTC"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "txnlake", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster the submitter owns these settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": UTC,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        # JIT-compile large generated methods (wide whole-stage-codegen stages)
        "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
        "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    }
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Timestamps in the data are wall-clock UTC; hour/day/epoch math needs a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone", None) != UTC:
        spark.conf.set("spark.sql.session.timeZone", UTC)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session does not name one (local tests) do we make our own.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="txnlake-ckpt-")  # one machine, for tests only
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint root for one job's outputs."""
    return f"{checkpoint_root(spark)}/txnlake-scratch/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Cut lineage before a frame is read by several actions: a reliable checkpoint
    in the shared checkpoint root (re-readable after an executor is lost, unlike a
    local checkpoint or an executor-memory cache)."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
