"""The folder that the driver and all executors share, and what is written there for a while."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is not set, a local session gets a temporary folder, and a cluster
    an error, as its executors share no such folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if folder is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back; lineage ends here."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_once(rows: DataFrame, *paths: str) -> DataFrame:
    """rows, read now; the paths that they come from are deleted."""
    out = checkpointed(rows)
    for path in paths:
        remove(rows.sparkSession, path)
    return out
