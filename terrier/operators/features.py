"""Export rules, GeoJSON features, and parcels joined to their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions import geometry as G
from terrier.functions.columns import round_doubles
from terrier.operators.simplify import simplify
from terrier.operators.skew import LIGHT_ROWS, attach


def exportable(df: DataFrame, geom: str, count: str = "nb_transactions", keep_empty: bool = False,
               tolerance: float | None = None) -> DataFrame:
    """Rows as they are published.

    Shapes without a geometry go. Shapes without statistics stay with a count of
    0 (their other statistics stay null) or go, by ``keep_empty``. Doubles are
    rounded to two digits; ``tolerance`` simplifies first.
    """
    rows = df.where(F.col(geom).isNotNull())
    rows = rows.fillna({count: 0}) if keep_empty else rows.where(F.col(count).isNotNull())
    if tolerance is not None:
        rows = simplify(rows, geom, tolerance)
    return round_doubles(rows)


def feature_text(df: DataFrame, geom: str, properties: Sequence[str] | None = None) -> Column:
    """One GeoJSON Feature per row; null properties are written as null."""
    names = list(properties) if properties is not None else [c for c in df.columns if c != geom]
    props = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'),
                    F.coalesce(G.geojson_geometry(F.col(geom)), F.lit("null")), F.lit("}"))


FEATURE = ("struct<id:string,properties:map<string,string>,"
           "geometry:struct<type:string,coordinates:string>>")
COLLECTION = f"struct<type:string,features:array<{FEATURE}>>"


def explode_collections(df: DataFrame, text: str) -> DataFrame:
    """One row per feature of GeoJSON documents: ``id``, ``properties``, ``geom``.

    A document that does not parse, or has no features, gives no rows.
    """
    doc = F.from_json(F.col(text), COLLECTION)
    return (df.withColumn("__f", F.explode(doc["features"])).drop(text)
            .select(*[c for c in df.columns if c != text],
                    F.coalesce("__f.properties.id", "__f.id").alias("id"),
                    F.col("__f.properties").alias("properties"),
                    G.parse_geojson_geometry(F.col("__f.geometry.type"),
                                             F.col("__f.geometry.coordinates")).alias("geom")))


def join_parcels(parcels: DataFrame, stats: DataFrame, department: str, parcel: str,
                 light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Parcels that have statistics under the same department; a null department has none."""
    return attach(parcels, stats, [department, parcel], [parcel], "inner",
                  light_rows=light_rows)


def file_status(files: DataFrame, parcels: DataFrame, stats: DataFrame, file: str,
                department: str, parcel: str, readable: str) -> DataFrame:
    """Per file: how many of its parcels have statistics, and its outcome.

    ``files`` lists the files; ``parcels`` has one row per parcel, and for a file
    without parcels a row without an id. Parcels are counted per id before the
    statistics are joined, so repeated ids do not grow the join.
    """
    ids = parcels.groupBy(file, department, parcel).agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(readable).alias(readable))
    known = stats.where(F.col(department).isNotNull()).select(
        department, parcel, F.lit(1).alias("hit")).distinct()
    per_file = (
        ids.join(known, [department, parcel], "left").groupBy(file)
        .agg(F.bool_or(readable).alias(readable),
             F.sum(F.when(F.col(parcel).isNotNull(), F.col("n")).otherwise(0)).alias("n_ids"),
             F.sum(F.col("n") * F.coalesce("hit", F.lit(0))).alias("n_parcels")))
    departments = known.select(department).distinct().withColumn("known", F.lit(True))
    joined = (files.join(departments, department, "left").join(per_file, file, "left")
              .fillna(0, ["n_ids", "n_parcels"]).fillna(False, [readable]))
    status = (F.when(F.col("known").isNull(), "no_transactions")
              .when(~F.col(readable), "error")
              .when(F.col("n_ids") == 0, "no_cadastre")
              .when(F.col("n_parcels") == 0, "no_transactions")
              .otherwise("success"))
    return joined.withColumn("status", status).drop("known", "n_ids", readable)


def status_totals(statuses: DataFrame) -> DataFrame:
    """Files and parcels per outcome."""
    return statuses.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(F.when(F.col("status") == "success", F.col("n_parcels")).otherwise(0))
        .cast("long").alias("n_parcels"))
