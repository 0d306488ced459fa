"""Statistics of every level and span, the city list and the reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from terrier import schema as S
from terrier.functions.columns import map_or_keep
from terrier.operators.level_histogram import all_levels
from terrier.operators.lookups import with_constants
from terrier.operators.price_stats import top_by, top_groups
from terrier.sinks import save_aggregate, save_list, write_table
from terrier.sources.deeds import load_aggregate


def save_levels(processed: DataFrame, base: str,
                spans: Mapping[str, date | None] = S.SPANS) -> None:
    """One dataset per level, partitioned by span. Country, regions and departments share their passes."""
    found = all_levels(processed, S.LEVELS, S.ROLES, spans, ["cle_principale"])
    for name, level in S.LEVELS.items():
        save_aggregate(found[name], base, name, level.keys or tuple(level.constants))


def top_cities(processed: DataFrame) -> DataFrame:
    """The cities with most sales; numbered districts count for their city."""
    named = processed.withColumn(
        "city", map_or_keep("code_commune", S.DISTRICT_CITY, "nom_commune"))
    return top_groups(named, "city", S.TOP_CITIES, S.ROLES)


def aggregate(processed: DataFrame, base: str) -> None:
    save_levels(processed, base)
    save_list(top_cities(processed), f"{base}/top_cities", S.TOP_CITIES)


def observed(processed: DataFrame) -> tuple[DataFrame, Observation]:
    """The table with figures that are counted while it is written, in place of another pass."""
    figures = Observation("processed")
    price = [f(c).alias(f"{n}_{tag}") for n, c in (("prix_m2", S.ROLES.price), ("prix_m2_ajuste", S.ROLES.adjusted))
             for tag, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return processed.observe(
        figures, F.count(F.lit(1)).alias("n_rows"), F.min("date_mutation").alias("date_min"),
        F.max("date_mutation").alias("date_max"), *price,
        F.count_if(F.col("code_region").isNull()).alias("missing_regions"),
        F.count_if(F.col("code_iris").isNull()).alias("missing_zones")), figures


def save_figures(spark: SparkSession, figures: Observation, base: str) -> None:
    """The counted figures as a table of one row; call after the write that counts them."""
    row = {k: v for k, v in figures.get.items()}
    schema = ("n_rows long, date_min date, date_max date, prix_m2_mean double, prix_m2_min double, prix_m2_max double, "
              "prix_m2_ajuste_mean double, prix_m2_ajuste_min double, prix_m2_ajuste_max double, "
              "missing_regions long, missing_zones long")
    spark.createDataFrame([row], schema).write.mode("overwrite").parquet(f"{base}/processed")


def reports(spark: SparkSession, stats: str, figures: str) -> dict[str, DataFrame]:
    """The summaries after a run, from saved statistics and counted figures; no pass over the sales.

    The medians of all sales are those of the country.
    """
    def saved(level: str) -> DataFrame:
        return load_aggregate(spark, stats, level)

    medians = saved("country").select("prix_m2_median", "prix_m2_ajuste_median")
    return {
        "summary": with_constants(spark.read.parquet(f"{figures}/processed"), medians),
        "country": saved("country"),
        "regions_by_price": top_by(saved("region"), "prix_m2_median", 5, "code_region"),
        "departments_by_sales": top_by(saved("department"), "nb_transactions", 10,
                                       "code_departement"),
        "communes_by_price": top_by(saved("commune"), "prix_m2_median", 10, "code_commune", 50),
    }


def save_reports(spark: SparkSession, stats: str, base: str) -> None:
    for name, report in reports(spark, stats, base).items():
        write_table(report, f"{base}/{name}")
