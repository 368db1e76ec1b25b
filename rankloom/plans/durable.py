"""Cutting lineage in a way that survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if configured:
        sc.setCheckpointDir(configured)
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def place(spark: SparkSession) -> str:
    """A new folder in the shared one; it is deleted when the driver ends, or by ``release``."""
    where = f"{shared_dir(spark)}/rankloom-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read back, so that later stages don't repeat it.

    Later stages read only the columns they need.
    """
    where = place(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def release(spark: SparkSession) -> int:
    """Deletes the tables written so far and returns their number; no DataFrame made from them may be used afterwards."""
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    own = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("rankloom-")]
    for path in own:
        fs.delete(path, True)
    return len(own)
