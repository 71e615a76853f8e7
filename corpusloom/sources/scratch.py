"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Folders of local applications whose setting is missing.
_OWN: dict[str, str] = {}

#: Parent of every table made here.
MARK = "corpusloom-scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Without the setting a local session (tests) gets a folder of its own; on a cluster,
    where each executor would write to its own disk, it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        found = _OWN[app]
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_dir(spark)}/{MARK}/{name}-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def clear(spark: SparkSession) -> None:
    """Remove every scratch table in the shared folder.

    Call it only when no DataFrame made from a scratch table is still to run.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{MARK}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
