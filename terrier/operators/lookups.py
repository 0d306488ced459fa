"""Lookups by code, boundary tables, and the reports on what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.functions.columns import first_known, not_in_or_null
from terrier.operators.skew import attach


def region_mapping(departments: DataFrame, regions: DataFrame, region: str) -> DataFrame:
    """Departments with their region's columns; a region without an entry gives null."""
    return departments.join(regions, region, "left")


def add_lookup(df: DataFrame, mapping: DataFrame, key: str, salt_by: Sequence[str]) -> DataFrame:
    """Left join of a one-row-per-key mapping; an unknown key gives null."""
    added = [c for c in mapping.columns if c != key]
    return attach(df, mapping, [key], salt_by).select(*df.columns, *added)


def missing_report(df: DataFrame, found: str, key: str) -> DataFrame:
    """Per key without a match: how many rows. Its total is the number of unmatched rows."""
    return (df.where(F.col(found).isNull()).groupBy(key)
            .agg(F.count(F.lit(1)).alias("n_missing")))


def missing_totals(df: DataFrame, found: str, key: str) -> DataFrame:
    """One row: ``n_rows``, ``n_missing`` and the distinct ``missing_keys`` (null key included)."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(found).isNull()).alias("gone"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.coalesce(F.sum("gone"), F.lit(0)).cast("long").alias("n_missing"),
        F.count_if(F.col("gone") > 0).cast("long").alias("missing_keys"))


def join_stats(shapes: DataFrame, stats: DataFrame, key: str,
               drop: Sequence[str] = ()) -> DataFrame:
    """Every shape with its statistics, null where there are none.

    ``drop`` names statistics columns the shapes already have; absent ones are
    ignored. A code with two names in the statistics gives two rows.
    """
    return shapes.join(stats.drop(*drop), key, "left")


def replace_parents(areas: DataFrame, parts: DataFrame, code: str,
                    parents: Sequence[str], prefix: dict[str, int] | None = None) -> DataFrame:
    """Areas without the replaced ``parents``, plus the ``parts`` that stand for them.

    ``prefix`` adds columns to ``parts`` that hold the first letters of the code.
    """
    for name, width in (prefix or {}).items():
        parts = parts.withColumn(name, F.substring(code, 1, width))
    return areas.where(not_in_or_null(code, parents)).unionByName(parts)


def name_areas(areas: DataFrame, names: DataFrame, code: str, chain: Sequence[str],
               name: str) -> DataFrame:
    """Join reference names by code and take the first known name of ``chain``."""
    joined = areas.join(names.withColumn(code, F.col(code).cast("string")), code, "left")
    return joined.withColumn(name, first_known(*chain))


def with_constants(shapes: DataFrame, one_row: DataFrame) -> DataFrame:
    """Copy the columns of a one-row table onto every row; null where it is empty.

    A table of several rows is an error when the result is computed.
    """
    tag, several = "__one", F.lit("with_constants needs a table of one row")
    checked = one_row.agg(F.count(F.lit(1)).alias("n"), F.first(F.struct(*one_row.columns)).alias("r")).select(
        F.lit(1).alias(tag), F.when(F.col("n") > 1, F.raise_error(several)).otherwise(F.col("r")).alias("r"))
    return (shapes.withColumn(tag, F.lit(1)).join(F.broadcast(checked), tag, "left")
            .select(*shapes.columns, "r.*"))

