"""Where intermediate tables may be written.

A cluster names a shared folder in ``spark.checkpoint.dir``. Only a session
that runs in local mode and names none gets a temporary folder of its own.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder every executor can reach."""
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/seqframe-{uuid.uuid4().hex}"


def materialize(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a table that several later steps use: it is computed once, the plan
    behind it is cut, and it outlives lost executors.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and that no later step reads, and let go of finished shuffles.

    Spark removes the files of a shuffle once the driver has collected the plan that made it.
    """
    spark = None
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    release(spark or SparkSession.getActiveSession())


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that the shuffle files of finished steps are removed now and not at some later time."""
    for _ in range(2):  # what Python lets go of in the first pass, the JVM collects in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
