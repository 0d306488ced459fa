"""Map layers: statistics on boundaries and parcels, as GeoJSON and tile rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier import schema as S
from terrier.functions import geometry as G
from terrier.functions.columns import display_class, round_doubles, scale_position
from terrier.operators import features as X
from terrier.operators.dissolve import dissolve
from terrier.operators.lookups import join_stats, with_constants
from terrier.operators.simplify import simplify
from terrier.operators.tiles import LAYERS, rank_in_tile, tile_parts
from terrier.sinks import save_geojson, save_parcels, save_tiles
from terrier.session import staged


def join_layers(stats: dict[str, DataFrame], regions: DataFrame, departments: DataFrame,
                communes: DataFrame, zones: DataFrame, grid: float = 50_000.0) -> dict[str, DataFrame]:
    """Every layer with its statistics, in degrees.

    The country is the union of the regions in metres. Region codes are not carried onto it.
    """
    srid = G.LAMBERT93
    country = with_constants(dissolve(
        regions.withColumn("geom", G.to_lambert93(F.col("geom"))), [], "geom", srid, grid),
        stats["country"])
    layers = {
        "country": country,
        "regions": join_stats(regions, stats["region"], "code_region"),
        "departments": join_stats(departments, stats["department"], "code_departement",
                                  ["code_region", "nom_region"]),
        "communes": join_stats(communes, stats["commune"], "code_commune"),
        "iris": join_stats(zones, stats["iris"], "code_iris", ["nom_iris"]),
    }
    return {n: df.withColumn("geom", G.to_wgs84(F.col("geom"))) for n, df in layers.items()}


def save_layers(layers: dict[str, DataFrame], base: str) -> None:
    """GeoJSON per layer. Communes and zones stay on the map without statistics."""
    for name, df in layers.items():
        fine = name in ("communes", "iris")
        save_geojson(df, f"{base}/{name}", tolerance=S.TOLERANCE[name], keep_empty=fine)


def with_display(df: DataFrame, parcels: bool = False) -> DataFrame:
    """How the map draws each shape; parcels are never held back for few sales."""
    few = 0 if parcels else S.SCALE_MIN_SALES
    return df.withColumns({
        "display": display_class("nb_transactions", few),
        "shade": scale_position("prix_m2_median", S.SCALE_LOW, S.SCALE_HIGH)})


def save_layer_tiles(df: DataFrame, name: str, path: str, key: str) -> None:
    """The part of each feature in every tile it meets, over the layer's zooms; parcels with their rank in the tile."""
    layer = LAYERS[name]
    sized = df.withColumn("area", G.area(F.col("geom")))
    rows = tile_parts(sized, "geom", layer.min_zoom, layer.max_zoom)
    if layer.ranked:
        rows = rank_in_tile(rows, "area", [key])
    save_tiles(rows, path)


def export_parcels(files: DataFrame, parcels: DataFrame, stats: DataFrame, base: str,
                   tiles: str | None = None) -> DataFrame:
    """Parcels with statistics, by commune; returns files and parcels per outcome.

    The parsed parcels are written once: the count per file then reads ids only,
    and only matched parcels reach simplification.
    """
    parcels = staged(parcels)
    joined = X.join_parcels(parcels.drop("file", "readable", "error"), stats, "code_departement",
                            "id_parcelle_unique")
    thin = round_doubles(simplify(joined.withColumn("geom", G.to_wgs84(F.col("geom"))), "geom",
                                  S.TOLERANCE["parcels"]))
    save_parcels(thin, base, "code_commune_file")
    if tiles is not None:
        save_layer_tiles(thin, "parcels", tiles, "id_parcelle_unique")
    return staged(X.status_totals(X.file_status(
        files, parcels, stats, "file", "code_departement", "id_parcelle_unique", "readable")))
