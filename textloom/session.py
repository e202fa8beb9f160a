"""A session with the settings the library expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; other settings as given."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of
    this machine for a local session without that setting."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if not found and current.isDefined():
        return current.get()
    if not found and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = (found or "file://" + tempfile.mkdtemp(prefix="textloom-")).rstrip("/")
    if not current.isDefined():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
