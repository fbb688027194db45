"""Tables whose folder holds several versions, of which readers see finished ones only.

A version is written to a folder of its own, `data/<number>`, and counts once its marker, an empty
file `versions/<number>`, is there. Creating the marker is the only switch: a reader that opened an
older version keeps its files, and a job that fails leaves a folder without a marker, which
nobody reads. One writer at a time; a second one meets the other's folder and fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetspc.sources.workspace import file_system


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    files, where = file_system(spark, folder)
    if not files.exists(where):
        return []
    names = [status.getPath().getName() for status in files.listStatus(where)]
    return sorted(int(n) for n in names if n.isdigit())


def finished_versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the versions that can be read, in order."""
    return _numbers(spark, f"{table}/versions")


def version_path(table: str, number: int) -> str:
    return f"{table}/data/{number:012d}"


def new_version(spark: SparkSession, table: str) -> int:
    """A number that neither a finished nor a failed version has."""
    return max([-1, *_numbers(spark, f"{table}/data"), *finished_versions(spark, table)]) + 1


def finish_version(spark: SparkSession, table: str, number: int) -> None:
    """From here on readers see the version."""
    files, where = file_system(spark, f"{table}/versions/{number:012d}")
    files.create(where, False).close()


def replace_table(spark: SparkSession, table: str, write: Callable[[str], None]) -> str:
    """Write a new version with `write(path)`, switch readers to it, and return its path."""
    number = new_version(spark, table)
    write(version_path(table, number))
    finish_version(spark, table, number)
    return version_path(table, number)


def current_path(spark: SparkSession, table: str) -> str:
    """Path of the newest finished version."""
    finished = finished_versions(spark, table)
    if not finished:
        raise FileNotFoundError(f"no finished version of {table}")
    return version_path(table, finished[-1])


def drop_versions(spark: SparkSession, table: str, keep: int = 2) -> None:
    """Delete all but the newest `keep` finished versions, and what failed versions left before those.

    Markers go first, so that no reader opens a version whose files are going.
    """
    finished = finished_versions(spark, table)
    kept = set(finished[-keep:]) if keep else set()
    oldest = min(kept, default=finished[-1] + 1 if finished else 0)
    for number in finished:
        if number not in kept:
            files, where = file_system(spark, f"{table}/versions/{number:012d}")
            files.delete(where, False)
    for number in _numbers(spark, f"{table}/data"):
        if number < oldest:
            files, where = file_system(spark, version_path(table, number))
            files.delete(where, True)


def replace_frame(df: DataFrame, table: str) -> DataFrame:
    """Replace a table by a frame, which may have been read from it, and return it as read back."""
    path = replace_table(df.sparkSession, table, lambda to: df.write.parquet(to))
    return df.sparkSession.read.schema(df.schema).parquet(path)
