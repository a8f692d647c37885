"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Functions that run in workers import it; with this they can wherever the driver was started from."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quernstone-"), "quernstone.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    own = os.path.join(folder, name)
                    out.write(own, os.path.relpath(own, os.path.dirname(root)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def _local_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder of this machine, which is shared by all executors only in a local session."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return tempfile.mkdtemp(prefix=prefix)


def shared_folder(spark: SparkSession) -> str:
    """A new folder all executors share: below spark.checkpoint.dir, or a local one only where that is not set (a local session, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{base.rstrip('/')}/{uuid.uuid4()}" if base else _local_folder(spark, "shared-")


def written(df: DataFrame) -> DataFrame:
    """``df`` checkpointed into spark.checkpoint.dir, the folder all executors share, so that it is computed once, its
    lineage is cut and the loss of executors does no harm. Only where no folder is set (a local session, as in tests) one is made."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _local_folder(df.sparkSession, "checkpoint-"))
    return df.checkpoint(eager=True)


def written_by(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` checkpointed in partitions by ``keys`` that later joins and aggregates on these know of, so that it is not shuffled again.

    A plan that may change while it runs does not tell its partitioning, so it is held still for this write."""
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return written(df.repartition(*keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def spread(table: DataFrame) -> DataFrame:
    """A table just read, over all cores if its files make fewer than half as many tasks.

    For work that is heavy per row (tokenizing, models): one small file would otherwise keep one core busy. Large tables have
    more tasks than cores and stay as they are; what moves is at most what that few tasks read."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() * 2 <= cores else table
