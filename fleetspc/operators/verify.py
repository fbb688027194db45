"""Fingerprints of result tables and their comparison."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetspc.functions.predicates import micros_of
from fleetspc.sources.workspace import materialize

FINGERPRINT = ["row_count", "digest_high", "digest_low"]


def _canonical(field: T.StructField, digits: int | None) -> Column:
    """A cell as text with its length in front, so that neighbouring cells cannot run together.

    Doubles count as they are, with every digit that tells them apart; with `digits`, up to that
    many decimals.
    """
    cell = F.col(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)) and digits is not None:
        fixed = F.round(cell, digits).try_cast(T.DecimalType(38, digits)).cast("string")
        text = F.coalesce(fixed, cell.cast("string"))
    elif isinstance(field.dataType, T.TimestampNTZType):
        text = micros_of(cell).cast("string")
    elif isinstance(field.dataType, T.TimestampType):
        text = F.unix_micros(cell).cast("string")
    else:
        text = cell.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def table_fingerprint(df: DataFrame, by: Sequence[str] = (), *, digits: int | None = None) -> DataFrame:
    """Row count and two order-free sums of row digests (120 bits of each), per value of `by`.

    Tables are compared exactly. Where two runs may differ in the last bits of a sum, `digits` gives
    the decimals that count.

    Rows are digested over their columns in name order and folded by partial sums, so neither
    row order nor partitioning matters and no group is brought together. A table without `by`
    gives one row.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    digest = F.sha2(F.concat(*[_canonical(f, digits) for f in fields]), 256)

    def part(start: int) -> Column:
        # 15 hex digits: sums of 28-digit decimals keep room for 10**19 rows.
        return F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(28,0)")

    parts = df.select(*by, part(1).alias("_high"), part(16).alias("_low"))
    folded = parts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("_high").cast("string").alias("digest_high"),
        F.sum("_low").cast("string").alias("digest_low"),
    )
    return folded


def manifest_compare(expected: DataFrame, actual: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Keys of two fingerprint frames with `status`: ok, missing, extra or mismatched.

    `missing` is expected only, `extra` is actual only. NULL keys match each other. Without `by`
    the two whole tables are compared, which gives one row.
    """
    if not by:
        whole = F.lit(True).alias("_whole")
        both = (df.select(whole, *FINGERPRINT) for df in (expected, actual))
        return manifest_compare(*both, ["_whole"]).select("status")
    left = expected.select(*[F.col(c).alias(f"_e_{c}") for c in (*by, *FINGERPRINT)])
    right = actual.select(*[F.col(c).alias(f"_a_{c}") for c in (*by, *FINGERPRINT)])
    same_key = [F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}")) for c in by]
    same = F.lit(True)
    for c in FINGERPRINT:
        same = same & F.col(f"_e_{c}").eqNullSafe(F.col(f"_a_{c}"))
    status = (
        F.when(F.col("_a_row_count").isNull(), "missing")
        .when(F.col("_e_row_count").isNull(), "extra")
        .when(same, "ok")
        .otherwise("mismatched")
    )
    keys = [F.coalesce(f"_e_{c}", f"_a_{c}").alias(c) for c in by]
    return left.join(right, same_key, "full").select(*keys, status.alias("status"))


def verify_scopes(expected: DataFrame, actual: DataFrame, by: Sequence[str]) -> DataFrame:
    """Result per `scope`: keys missing, extra and mismatched, and whether the scope is ok.

    Scopes are compared on their own, so slices added later do not disturb the base. A scope
    that has results and no manifest fails, with all its keys extra, rather than raising.
    """
    compared = manifest_compare(expected, actual, ["scope", *by])

    def number(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    return compared.groupBy("scope").agg(
        number("missing"),
        number("extra"),
        number("mismatched"),
        F.bool_and(F.col("status") == "ok").alias("ok"),
    )


def all_ok(scopes: DataFrame) -> DataFrame:
    """One row: whether every scope is ok."""
    return scopes.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("ok"))


def compare_runs(original: DataFrame, repeated: DataFrame, by: Sequence[str] = (), *, digits: int | None = None) -> DataFrame:
    """manifest_compare of two runs of the same output, keys that are ok left out."""
    both = (table_fingerprint(df, by, digits=digits) for df in (original, repeated))
    return manifest_compare(*both, by).where(F.col("status") != "ok")


def differing_rows(original: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two frames of the same columns.

    Copies are counted, not repeated: a row stands once with its count on either side.
    """
    columns = original.columns
    left = original.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    right = repeated.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    return (
        left.unionByName(right)
        .groupBy(*columns)
        .agg(F.sum("_l").alias("copies_original"), F.sum("_r").alias("copies_repeated"))
        .where(F.col("copies_original") != F.col("copies_repeated"))
    )


def difference_tree(original: DataFrame, repeated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Where two fingerprint frames differ, from the whole tables down to the values of `by`.

    Fingerprints are sums, so those of a node are the sums of its children's: (level, by...,
    rows_original, rows_repeated, status) for every node that differs, level being the number of
    leading columns of `by` that are fixed, the others NULL; a NULL key is told from these by its
    level. `missing` has no rows in the repeated table, `extra` none in the original. Only
    fingerprints are read, and a repeated key counts with all its fingerprints.
    """
    signed = None
    for df, other in ((original, False), (repeated, True)):
        ours, theirs = ("_r", "_o") if other else ("_o", "_r")
        sums = [F.col(c).cast("decimal(28,0)" if c != "row_count" else "long") for c in FINGERPRINT]
        side = df.select(
            *by, *[v.alias(f"{ours}_{c}") for c, v in zip(FINGERPRINT, sums)],
            *[F.lit(0).cast("decimal(28,0)" if c != "row_count" else "long").alias(f"{theirs}_{c}") for c in FINGERPRINT],
        )
        signed = side if signed is None else signed.unionByName(side)
    totals = [F.sum(f"{side}_{c}").alias(f"{side}_{c}") for side in ("_o", "_r") for c in FINGERPRINT]
    level = (len(by) - F.bit_count(F.grouping_id())).cast("int").alias("level")
    nodes = signed.rollup(*by).agg(level, *totals)
    same = F.lit(True)
    for c in FINGERPRINT:
        same = same & F.col(f"_o_{c}").eqNullSafe(F.col(f"_r_{c}"))
    status = F.when(F.col("_r_row_count") == 0, "missing").when(F.col("_o_row_count") == 0, "extra").otherwise("mismatched")
    return nodes.where(~same).select(
        "level", *by, F.col("_o_row_count").alias("rows_original"), F.col("_r_row_count").alias("rows_repeated"),
        status.alias("status"),
    )


def located_differences(
    original: DataFrame,
    repeated: DataFrame,
    by: Sequence[str],
    fingerprints: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """differing_rows, reading again only the values of `by` whose fingerprints differ.

    `fingerprints` are table_fingerprint(..., by) of both tables, exact and stored when the tables
    were; without them both tables are read once for it. If `by` names the folders of a stored
    table, the folders of equal values are not opened. NULL keys match each other.
    """
    known = fingerprints or tuple(table_fingerprint(df, by) for df in (original, repeated))
    compared = materialize(manifest_compare(*known, by), "compared-keys")
    unequal = compared.where(F.col("status") != "ok").select(*[F.col(c).alias(f"_{c}") for c in by])
    # Structs are equal where both hold NULL, and unlike <=> their equality prunes folders at run time.
    same = reduce(and_, [F.struct(F.col(c).alias("key")) == F.struct(F.col(f"_{c}").alias("key")) for c in by])
    return differing_rows(*(df.join(unequal, same, "left_semi") for df in (original, repeated)))
