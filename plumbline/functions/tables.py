"""Tables on the way: written intermediates, and small tables whose size is checked."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes the shuffle files of a query when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a parameter table (weights, bands, temperatures, markers, a registry) at most.
SMALL = 10_000


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables below ``spark.checkpoint.dir``; it is deleted when the driver ends.

    Where that is unset, a local session makes a folder of its own; on a cluster it is an error, as executors share no local folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if base is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    folder = f"{base.rstrip('/')}/plumbline-{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, gives true size statistics, survives lost executors.

    The shuffles behind it go once it is written, so that a chain of tables holds the disk of one step at a time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes ``written`` tables, once all that reads them is written itself."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` for broadcast, or an error if it has more than ``most`` rows. Counts it, so give it a written or literal table."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a parameter table has more than {most} rows")
    return F.broadcast(df)
