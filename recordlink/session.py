"""Cluster settings the operators rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# A lookup table up to this many rows is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 200_000


# Spark's batches for Python have 10,000 rows, which for texts are tens of megabytes, held
# several times over by the JVM and each worker.
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Have Spark send Python small batches from here on, unless the session says how large."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_ROWS)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, taken from the session.

    Only a local session (tests) gets a folder of its own; on a cluster every
    executor must see the folder, so the setting has to be there.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    context = spark.sparkContext
    if root is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        root = context.getCheckpointDir() or tempfile.mkdtemp(prefix="recordlink-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``; its rows no longer change when tasks are rerun."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Has Spark drop the shuffle files of a query when it ends, not when the driver collects garbage.
SHUFFLE_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Any value of the types whose columns are known to hold no null.
NO_NULLS = {"string": "", "long": 0, "integer": 0, "double": 0.0, "boolean": False}
# What Parquet has no type for.
NOT_IN_PARQUET = ("void", "interval", "variant")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str | None]:
    """``df`` as a compressed table in the shared folder, and its path, see ``removed``.

    Cuts the lineage like ``checkpoint``, in a fraction of the bytes; the shuffle files that
    making it took go at once. Values that Parquet cannot hold are checkpointed: no path.
    """
    spark = df.sparkSession
    if any(kind in df.schema.simpleString() for kind in NOT_IN_PARQUET):
        return checkpoint(df), None
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    spark.conf.set(SHUFFLE_CLEANUP_CONF, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP_CONF)
        else:
            spark.conf.set(SHUFFLE_CLEANUP_CONF, before)
    # files say nothing of columns without nulls, and joins compare those several times faster
    known = [
        F.coalesce(F.col(f"`{f.name}`"), F.lit(NO_NULLS[f.dataType.typeName()]).cast(f.dataType)).alias(f.name)
        if not f.nullable and f.dataType.typeName() in NO_NULLS
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    return spark.read.schema(df.schema).parquet(path).select(*known), path


def removed(spark: SparkSession, path: str | None) -> None:
    """Remove what ``stored`` wrote, once nothing will read it again."""
    if path is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    """Whether ``df`` has few enough rows to be broadcast."""
    limit = BROADCAST_ROWS if limit is None else limit
    return df.limit(limit + 1).count() <= limit


def spread(df: DataFrame) -> DataFrame:
    """A checkpointed ``df`` in at least as many partitions as there are cores.

    Partitions are sized by bytes, which leaves cores idle where little data takes
    much computing. Large tables have more partitions than that already.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
