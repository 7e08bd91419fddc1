"""Session settings the engine relies on, and the shared folder for its files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options that results depend on.

    Days and buckets are UTC, and a repeated JSON key keeps its last value. Adaptive
    execution splits a day that holds most rows of a write.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session may go without the setting; its warehouse folder is
    then used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tallylog"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The frame written to the shared checkpoint folder, with its lineage cut."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def fresh_name(prefix: str) -> str:
    """Name that no earlier run used."""
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this session made in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
