"""Deed lines, code tables, the processed table and saved statistics."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrier.functions.columns import parse_day
from terrier.schema import DEED_LINE, NULL_TOKENS


def scan_deeds(spark: SparkSession, path: str | list[str], strict_dates: bool = True) -> DataFrame:
    """Deed lines from CSV, with parsed dates and ``seq``, their place in file order.

    A number that does not parse is null; the rest of its row stays. ``seq`` is
    file, block and row number: Spark keeps no row order across a shuffle.
    """
    raw = (spark.read.schema(DEED_LINE).option("header", True).option("mode", "PERMISSIVE")
           .option("escape", '"').csv(path))
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    cells = [
        F.when(~F.col(f.name).isin(*NULL_TOKENS), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in raw.schema.fields]
    return raw.select(*cells, place.alias("seq")).withColumn(
        "date_mutation", parse_day("date_mutation", strict_dates))


def scan_departments(spark: SparkSession, path: str) -> DataFrame:
    """Department and region codes; codes are text, so leading zeros survive."""
    return spark.read.option("header", True).csv(path).select(
        F.col("DEP").alias("code_departement"), F.col("REG").alias("code_region"))


def scan_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path).select(
        F.col("REG").alias("code_region"), F.col("LIBELLE").alias("nom_region"))


def scan_zone_names(spark: SparkSession, path: str) -> DataFrame:
    """Zone codes and names, from CSV or Parquet."""
    table = (spark.read.parquet(path) if path.rstrip("/").endswith(".parquet")
             else spark.read.option("header", True).csv(path))
    return table.select(F.col("CODE_IRIS").cast("string").alias("code_iris"),
                        F.col("LIB_IRIS").alias("nom_iris_ref"))


def scan_processed(spark: SparkSession, path: str, start: date | None = None) -> DataFrame:
    """The processed table, from ``start`` on; the test reaches the Parquet scan."""
    table = spark.read.parquet(path)
    return table if start is None else table.where(F.col("date_mutation") >= F.lit(start))


def load_aggregate(spark: SparkSession, base: str, level: str, span: str = "all") -> DataFrame:
    """Saved statistics of one level and span; other spans are not read."""
    return spark.read.parquet(f"{base}/{level}").where(F.col("span") == span).drop("span")
