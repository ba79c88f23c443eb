"""The folder that a cluster's machines share, and the planned size of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions in one process.
LOCAL_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A session in one process may go without; on a cluster there is no folder to fall back to."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_FOLDER


def shared_checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the shared folder, unless the session has a folder for that already."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def planned_bytes(df: DataFrame) -> int:
    """Spark's estimate of a table's size: of the files, for one that is stored."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
