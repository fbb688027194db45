"""Intermediate tables in the shared folder that `spark.checkpoint.dir` names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder of this application under the folder that `spark.checkpoint.dir` names.

    Only a session without executors of its own, as in tests, may do without the setting: it
    gets a temporary folder. The session's settings are read, never changed.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        base = _fallback.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="fleetspc-")
        _fallback[context.applicationId] = base
    return f"{base.rstrip('/')}/fleetspc-{context.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def tidy_session(spark: SparkSession) -> SparkSession:
    """A session beside `spark` whose actions delete their shuffle files as they end, not whenever the driver collects garbage.

    Settings of `spark` itself stay as they are, and so do shuffle files of its actions.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return session


def materialize(
    df: DataFrame, label: str, *, compression: str = "snappy", session: SparkSession | None = None
) -> DataFrame:
    """Write `df` as parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive a lost executor, computes the frame once however
    often it is used, and gives the planner its true size: a join with it is broadcast when it
    is under spark.sql.autoBroadcastJoinThreshold and shuffled when it is not. `session` reads it
    in place of the frame's own.
    """
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return (session or df.sparkSession).read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = file_system(spark, path)
    return files.exists(where)


def drop(df: DataFrame) -> None:
    """Delete the table that `materialize` made; only files in this application's folder go."""
    spark = df.sparkSession
    own = shared_folder(spark)
    own = own.removeprefix("file:").replace("///", "/")
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        if folder.removeprefix("file:").replace("///", "/").startswith(own + "/"):
            files, where = file_system(spark, folder)
            files.delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application."""
    files, where = file_system(spark, shared_folder(spark))
    files.delete(where, True)
