"""Boundary layers and cadastre files."""

from __future__ import annotations

import gzip
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import geometry as G
from terrier.operators.features import COLLECTION, FEATURE
from terrier.operators.lookups import name_areas, replace_parents
from terrier.schema import CITY_CODES
from terrier.sources.geopackage import GeoPackageSource

# executors get the file reader with the query and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Published columns of each layer and what they are called here.
LAYER_COLUMNS = {
    "region": {"code_insee": "code_region", "nom_officiel": "nom_region_geo"},
    "departement": {"code_insee": "code_departement", "code_insee_de_la_region": "code_region",
                    "nom_officiel": "nom_departement"},
    "commune": {"code_insee": "code_commune", "code_insee_du_departement": "code_departement",
                "nom_officiel": "nom_commune_geo"},
    "arrondissement_municipal": {"code_insee": "code_commune", "nom_officiel": "nom_commune_geo"},
    "iris": {"code_iris": "code_iris", "nom_iris": "nom_iris_gpkg",
             "code_insee": "code_commune_iris", "nom_commune": "nom_commune_iris"},
}


#: One line of a file: a feature, or a whole collection.
LINE = f"struct<type:string,{FEATURE[len('struct<'):-1]},features:array<{FEATURE}>>"
#: Lines that only hold a collection together where each feature has a line of its own.
WRAPPER = (r'^(\{|\[|\]|\}|\]\s*\}|\{?\s*"(type|name)"\s*:\s*"[^"]*"|'
           r'"(crs|bbox)"\s*:\s*[\{\[].*[\}\]]|\{?.*"features"\s*:\s*\[)$')


def scan_features(spark: SparkSession, path: str, srid: int = G.WGS84) -> DataFrame:
    """GeoJSON of any layout, as ``file``, ``properties``, ``geom`` and ``error``.

    Files with one feature or one collection per line are read line by line, so a
    layer may be one large file; keys may come in any order. Files of any other
    layout are read whole. A document or line that cannot be read is a row with an
    ``error`` and nothing else, never left out.
    """
    text = F.regexp_replace(F.trim("value"), ",$", "")
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), text.alias("line"))
             .where("line <> ''").withColumn("f", F.from_json("line", LINE)))
    feature, collection = F.col("f.type") == "Feature", F.col("f.features").isNotNull()
    good = F.coalesce(feature | collection, F.lit(False))
    bad = ~good & ~F.col("line").rlike(WRAPPER)
    # a job over the text alone: the files, seldom any, none of whose lines is a document
    odd = [r.file for r in lines.groupBy("file").agg(F.count_if(good).alias("good"), F.count_if(bad).alias("bad"))
           .where("good = 0 and bad > 0").toLocalIterator()]
    single = F.struct(*[F.col(f"f.{c}").alias(c) for c in ("id", "properties", "geometry")])
    features = F.when(collection, F.col("f.features")).when(feature, F.array(single))
    unreadable = F.lit("not a GeoJSON feature or collection")

    def exploded(rows: DataFrame, failed: Column) -> DataFrame:
        return rows.select("file", F.explode_outer(features).alias("f"), F.when(failed, unreadable).alias("error"))
    found = exploded(lines.where((good | bad) & ~F.col("file").isin(odd)), bad)
    if odd:
        whole = (spark.read.text(odd, wholetext=True)
                 .select(F.col("_metadata.file_path").alias("file"), F.from_json("value", LINE).alias("f")))
        found = found.unionByName(exploded(whole, features.isNull()))
    found = found.where("f IS NOT NULL OR error IS NOT NULL")  # a collection may be empty
    return found.select("file", F.col("f.properties").alias("properties"),
                        G.parse_geojson_geometry(F.col("f.geometry.type"),
                                                 F.col("f.geometry.coordinates"), srid).alias("geom"), "error")


def scan_layer(spark: SparkSession, path: str, layer: str, srid: int = G.WGS84,
               table: str | None = None) -> DataFrame:
    """A boundary layer with its columns projected and renamed, and ``geom``.

    The format follows the file name: GeoPackage, Parquet (flat columns and
    ``geom``) or GeoJSON. ``table`` is the GeoPackage table if not the layer's name.
    Text that is not GeoJSON fails the query that reads it.
    """
    columns = LAYER_COLUMNS[layer]
    if path.endswith(".parquet"):
        rows = spark.read.parquet(path)
        return rows.select(*[F.col(a).cast("string").alias(b) for a, b in columns.items()], "geom")
    if path.endswith(".gpkg"):
        spark.dataSource.register(GeoPackageSource)
        rows = spark.read.format("geopackage").option("table", table or layer).load(path)
    else:
        rows = scan_features(spark, path, srid)
        failed = F.raise_error(F.concat("file", F.lit(": "), "error")).cast("boolean")
        rows = rows.where(F.when(F.col("error").isNotNull(), failed).otherwise(True))
    return rows.select(*[F.col("properties")[a].alias(b) for a, b in columns.items()], "geom")


def communes_with_districts(communes: DataFrame, districts: DataFrame) -> DataFrame:
    """Communes in which the districts of a city take the city's place."""
    return replace_parents(communes, districts, "code_commune", CITY_CODES,
                           {"code_departement": 2})


def named_zones(zones: DataFrame, names: DataFrame) -> DataFrame:
    """Zones with the reference name, else the layer's, else the commune's."""
    return name_areas(zones, names, "code_iris",
                      ["nom_iris_ref", "nom_iris_gpkg", "nom_commune_iris"],
                      "nom_iris").drop("nom_iris_ref", "nom_iris_gpkg")


def _with_codes(df: DataFrame, path: Column) -> DataFrame:
    return df.withColumns({
        "file": path,
        "code_commune_file": F.regexp_extract(path, r"cadastre-([^/]+?)-parcelles\.json", 1),
        "code_departement": F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1)})


def list_cadastre(spark: SparkSession, glob: str) -> DataFrame:
    """One row per cadastre file, listed without opening any."""
    files = spark.read.format("binaryFile").load(glob).select("path")
    return _with_codes(files, F.col("path")).drop("path")


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of each file, or why it has none; plain files are taken as they are."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            text, error, raw = None, None, content.as_py()
            try:
                text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode("utf-8")
            except (OSError, EOFError, zlib.error, UnicodeDecodeError) as problem:
                error = f"{type(problem).__name__}: {problem}"
            yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([text], pa.string()), pa.array([error], pa.string())],
                                             ["path", "text", "error"])


def scan_cadastre(spark: SparkSession, glob: str) -> DataFrame:
    """One row per parcel of the gzipped cadastre files, and one per file without any.

    A file that cannot be decompressed, is cut short or is not GeoJSON has one row with
    its ``error`` and is not ``readable``; one without features has one readable row
    without a parcel. Files are opened inside tasks, one at a time. Spark lists no files
    of zero bytes, here and in ``list_cadastre``.
    """
    files = spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(
        _opened, "path string, text string, error string")
    doc = F.from_json("text", COLLECTION)
    keep = ["file", "code_commune_file", "code_departement"]
    unread = F.when(doc["features"].isNull(), F.coalesce("error", F.when(F.col("text") == "", "empty file"), F.lit("no feature collection")))
    opened = _with_codes(files, F.col("path")).select(*keep, unread.alias("error"), doc["features"].alias("features"))
    return (
        opened.select(*keep, "error", F.explode_outer("features").alias("f"))
        .select(*keep, F.col("error").isNull().alias("readable"), "error",
                F.coalesce("f.properties.id", "f.id").alias("id_parcelle_unique"),
                G.parse_geojson_geometry(F.col("f.geometry.type"),
                                         F.col("f.geometry.coordinates")).alias("geom")))
