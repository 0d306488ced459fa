"""``python -m terrier.plans.cli --process --aggregate ...``: run chosen steps in order."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from terrier import schema as S
from terrier.plans import aggregate, maps, process
from terrier.sinks import write_table
from terrier.sources import boundaries as B
from terrier.sources import deeds

STEPS = ("process", "aggregate", "geometries", "parcels", "convert")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Price statistics from deed lines to map layers.")
    p.add_argument("--input", required=True, help="folder with the landed inputs")
    p.add_argument("--output", required=True, help="folder for results")
    p.add_argument("--all", action="store_true", help="run every step")
    for step in STEPS:
        p.add_argument(f"--{step}", action="store_true")
    p.add_argument("--span", default="all", choices=list(S.SPANS), help="span shown on the map")
    p.add_argument("--layers", default="geojson", choices=["geojson", "gpkg", "parquet"],
                   help="format of the boundary layers")
    return p


def layer(spark: SparkSession, args: argparse.Namespace, name: str):
    return B.scan_layer(spark, f"{args.input}/layers/{name}.{args.layers}", name)


def run(spark: SparkSession, args: argparse.Namespace) -> list[str]:
    """Run the chosen steps; returns their names."""
    chosen = [s for s in STEPS if args.all or getattr(args, s)]
    out, src = args.output, args.input
    stats = f"{out}/aggregates"

    def saved(level: str):
        return deeds.load_aggregate(spark, stats, level, args.span)

    if "process" in chosen:
        zones = layer(spark, args, "iris").withColumnRenamed("nom_iris_gpkg", "nom_iris")
        zones = zones.withColumn("geom", maps.G.to_lambert93(zones.geom))
        sales, lists = process.process(
            deeds.scan_deeds(spark, f"{src}/deeds"),
            deeds.scan_departments(spark, f"{src}/departments.csv"),
            deeds.scan_regions(spark, f"{src}/regions.csv"), zones)
        counted, figures = aggregate.observed(sales)
        write_table(counted, f"{out}/processed")
        aggregate.save_figures(spark, figures, f"{out}/reports")
        write_table(process.missing_regions(sales), f"{out}/reports/missing_regions")
        write_table(lists, f"{out}/processed_lists")
    if "aggregate" in chosen:
        aggregate.aggregate(deeds.scan_processed(spark, f"{out}/processed"), stats)
        aggregate.save_reports(spark, stats, f"{out}/reports")
    if "geometries" in chosen or "convert" in chosen:
        communes = B.communes_with_districts(layer(spark, args, "commune"),
                                             layer(spark, args, "arrondissement_municipal"))
        zones = B.named_zones(layer(spark, args, "iris"),
                              deeds.scan_zone_names(spark, f"{src}/zone_names.csv"))
        layers = maps.join_layers(
            {level: saved(level) for level in S.LEVELS}, layer(spark, args, "region"),
            layer(spark, args, "departement"), communes, zones)
        if "geometries" in chosen:
            maps.save_layers(layers, f"{out}/map")
        if "convert" in chosen:
            for name, key in (("communes", "code_commune"), ("iris", "code_iris")):
                maps.save_layer_tiles(maps.with_display(layers[name]), name,
                                      f"{out}/tiles/{name}", key)
    if "parcels" in chosen:
        glob = f"{src}/cadastre/*/*/cadastre-*-parcelles.json.gz"
        maps.export_parcels(
            B.list_cadastre(spark, glob), B.scan_cadastre(spark, glob), saved("parcel"),
            f"{out}/map/parcels", f"{out}/tiles/parcels").show()
    return chosen


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("terrier").getOrCreate()
    steps = run(spark, args)
    print("steps run:", ", ".join(steps) or "none")


if __name__ == "__main__":
    main()
