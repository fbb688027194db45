"""Machine logs of many CSV files, each with a header of its own.

A file's columns are taken by the names in its header, in whatever order it has them; columns it
lacks are NULL and others are ignored. The driver reads the first line of every file, several at a
time, and nothing else; files with the same header are read together by Spark, so the readings of
a log take one pass, and a file may be read in many splits.

Rows that do not fit are set aside with their file and the reason, and never change a reading: `torn`
rows have more or fewer cells than the header, rows named after a column have a cell there that is
not of the column's type. Empty cells are NULL. A file without a header, that is an empty one, has
no rows.
"""

from __future__ import annotations

import csv
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspc.schemas import RAW, require_columns
from fleetspc.sources.workspace import file_system

# First lines that are read at a time.
AT_ONCE = 16
REJECTED = "file string, reason string, line string"


def csv_files(spark: SparkSession, path: str) -> list[str]:
    """The files at a path, which is a file, a folder or a pattern; hidden ones are left out."""
    files, where = file_system(spark, path)
    found = []
    for status in files.globStatus(where) or []:
        inside = files.listStatus(status.getPath()) if status.isDirectory() else [status]
        found += [s.getPath() for s in inside if not s.isDirectory()]
    return sorted(p.toString() for p in found if not p.getName().startswith(("_", ".")))


def first_line(spark: SparkSession, path: str) -> str | None:
    files, where = file_system(spark, path)
    reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(files.open(where), "UTF-8"))
    try:
        return reader.readLine()
    finally:
        reader.close()


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Files by header."""
    paths = csv_files(spark, path)
    if not paths:
        raise FileNotFoundError(f"no CSV files at {path}")
    with ThreadPoolExecutor(AT_ONCE) as readers:
        lines = list(readers.map(lambda p: first_line(spark, p), paths))
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, line in zip(paths, lines):
        if line and line.strip():
            names = tuple(name.strip() for name in next(csv.reader([line.removeprefix("﻿")])))
            by_header.setdefault(names, []).append(file)
    return by_header


def _cell(place: int, field: T.StructField) -> Column:
    cell = F.col(f"_{place}").try_cast(field.dataType)
    return F.nanvl(cell, F.lit(None).cast("double")) if isinstance(field.dataType, T.DoubleType) else cell


def _wrong(place: int, field: T.StructField) -> Column:
    """The column's name where a cell is not of its type."""
    cell = F.col(f"_{place}")
    return F.when(cell.isNotNull() & cell.try_cast(field.dataType).isNull(), F.lit(field.name))


def read_csv_logs(spark: SparkSession, path: str, schema: T.StructType = RAW) -> tuple[DataFrame, DataFrame]:
    """(rows of `schema`, rejected rows as (file, reason, line)) of all CSV files at a path.

    Neither frame starts a job. Every header needs the first two columns of the schema, the time and
    the machine; a name must not stand in it twice.
    """
    good, bad = [], []
    for names, files in sorted(headers(spark, path).items()):
        if len(set(names)) < len(names):
            raise ValueError(f"a column's name stands twice in the header {list(names)} of {files[0]}")
        cells = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(names))])
        reader = spark.read.schema(T.StructType([*cells, T.StructField("_torn", T.StringType())])).option("header", True)
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_torn").option("enforceSchema", True)
        # Blanks around a cell are not part of it.
        reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
        rows = reader.csv(files).select("*", F.col("_metadata.file_path").alias("_file"))
        require_columns(rows.toDF(*names, "_torn", "_file"), schema.fieldNames()[:2], files[0])
        place = {name: i for i, name in enumerate(names)}
        known = [(place[f.name], f) for f in schema.fields if f.name in place]
        reason = F.coalesce(F.when(F.col("_torn").isNotNull(), "torn"), *[_wrong(i, f) for i, f in known])
        judged = rows.withColumn("_reason", reason)
        whole = [
            (_cell(place[f.name], f) if f.name in place else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields
        ]
        good.append(judged.where(F.col("_reason").isNull()).select(whole))
        line = F.coalesce("_torn", F.concat_ws(",", *[F.coalesce(F.col(f"_{i}"), F.lit("")) for i in range(len(names))]))
        bad.append(judged.where(F.col("_reason").isNotNull()).select(F.col("_file").alias("file"), F.col("_reason").alias("reason"), line.alias("line")))
    if not good:
        return spark.createDataFrame([], schema), spark.createDataFrame([], REJECTED)
    return reduce(DataFrame.unionByName, good), reduce(DataFrame.unionByName, bad)
