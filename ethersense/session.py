"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on (hours and ISO times are UTC) and ship the package
    to the Python workers once per application."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if getattr(context, "_ethersense_shipped", None) is None:
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(
            os.path.join(tempfile.mkdtemp(prefix="ethersense-"), "ethersense"), "zip",
            os.path.dirname(package), os.path.basename(package),
        )
        context.addPyFile(archive)
        context._ethersense_shipped = archive
    return spark


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ethersense")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: dict[str, str] = {}  # of local applications without a configured folder


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Where it is unset, the folder given to ``setCheckpointDir`` counts. A local application without
    either gets a temporary folder; on a cluster that is an error, as each machine would have its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _FOLDERS.get(context.applicationId)
    if not named:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="ethersense-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is ever overwritten there."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting that removes a query's shuffle files as soon as the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Queries that run inside leave no shuffle files; outside they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts lineage and survives executor loss, and unlike a row checkpoint stays columnar, so later
    readers still prune columns and partitions. Its shuffles' files go with the query.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with passing_shuffles(spark):
        writer.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._work_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` whose every reader has been stored itself; others are left alone."""
    for table in tables:
        path = getattr(table, "_work_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def local_frame(spark: SparkSession, rows: list, schema) -> DataFrame:
    """A small driver-side table in one partition, however many cores the cluster has."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def bounded(df: DataFrame, limit: int = 10_000) -> tuple[DataFrame, bool]:
    """Return ``(frame, is_small)``; a small one is fetched and safe to broadcast.

    At most ``limit + 1`` rows reach the driver. A larger frame comes back untouched and without
    a hint, so that the planner picks a shuffled join for it.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, False
    return F.broadcast(local_frame(df.sparkSession, rows, df.schema)), True
