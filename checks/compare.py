"""Run queries next to their SQL: python -m checks.compare <folder> [query ...]"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "M":
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(result: DataFrame, con: duckdb.DuckDBPyConnection, name: str) -> str | None:
    """None when a query's result holds the rows of its SQL, else what differs first."""
    ours = result.toPandas()
    theirs = con.execute(ORACLE[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    ours, theirs = ordered(ours), ordered(theirs)
    for c in ours.columns:
        unequal = ~((ours[c] == theirs[c]) | (ours[c].isna() & theirs[c].isna()))
        if unequal.any():
            at = unequal.idxmax()
            return f"{int(unequal.sum())} of {len(ours)} in {c}, first {ours[c][at]!r} and {theirs[c][at]!r}"
    return None


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(ORACLE)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            found = difference(QUERIES[name](spark, sf_dir), con, name)
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:300]}"
        failed += found is not None
        print(f"{'FAIL' if found else 'ok':5s}{name:28s}{time.time() - start:6.1f}s  {found or ''}", flush=True)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
