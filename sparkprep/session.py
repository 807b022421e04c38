"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a folder of its own below the temporary one, in local mode only.

    On a cluster without the setting an error is raised, as executors share no machine's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sparkprep.workDir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sparkprep-")
        spark.conf.set("spark.sparkprep.workDir", base)
    return base.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Gives the session a checkpoint folder if it has none."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared folder: its plan is one scan for all that follows."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def local_path(folder: str) -> str:
    """The path of a shared folder for file access from Python."""
    return folder.removeprefix("file://") if folder.startswith("file://") else folder.removeprefix("file:")


def run_to_end(stream, folder: str, mode: str = "append") -> None:
    """Writes all that a stream has now as Parquet into ``folder`` and stops."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").outputMode(mode).trigger(availableNow=True).start(folder)
    query.awaitTermination()
