"""Which web-map tiles each feature falls in: the data side of tiling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.functions import geometry as G
from terrier.operators.skew import dealt_out
from terrier.session import staged

# Fixed value: the latitude at which the square Web-Mercator world ends.
MAX_LAT = 85.0511287798066


@dataclass(frozen=True)
class TileLayer:
    """Zoom range of a layer; the features of ``ranked`` layers know their rank in a tile."""

    min_zoom: int
    max_zoom: int
    ranked: bool = False


# The zoom ranges of the published layers.
LAYERS = {
    "communes": TileLayer(9, 14),
    "iris": TileLayer(11, 16),
    "parcels": TileLayer(13, 16, ranked=True),
}


def tile_x(lon: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0)),
                   n.cast("long") - 1)


def tile_y(lat: Column, zoom: Column) -> Column:
    n = F.pow(F.lit(2.0), zoom)
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT)))
    up = F.ln(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / math.pi
    return F.least(F.greatest(F.floor((F.lit(1.0) - up) / 2.0 * n), F.lit(0)),
                   n.cast("long") - 1)


def tile_features(df: DataFrame, box: str, min_zoom: int, max_zoom: int) -> DataFrame:
    """One row per (feature, tile its bounding box meets), with ``z``, ``x``, ``y``."""
    b = F.col(box)
    zoomed = df.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    z = F.col("z")
    return (
        zoomed
        .withColumn("x", F.explode(F.sequence(tile_x(b["minx"], z), tile_x(b["maxx"], z))))
        .withColumn("y", F.explode(F.sequence(tile_y(b["maxy"], z), tile_y(b["miny"], z)))))


def tile_box(x: Column, y: Column, zoom: Column) -> Column:
    """Borders of a tile in degrees: west, south, east, north."""
    n = F.pow(F.lit(2.0), zoom)

    def north(y: Column) -> Column:
        return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (F.lit(1.0) - y * 2.0 / n))))
    return F.struct((x / n * 360.0 - 180.0).alias("west"), north(y + 1).alias("south"),
                    ((x + 1) / n * 360.0 - 180.0).alias("east"), north(y).alias("north"))


def _cut(ring: Column, along: str, border: Column, above: bool) -> Column:
    """What of a closed ring lies on one side of a border, closed again; fewer than four vertices are nothing."""
    across = "y" if along == "x" else "x"

    def inside(v: Column) -> Column:
        return v[along] >= border if above else v[along] <= border

    def crossing(a: Column, b: Column) -> Column:
        place = a[across] + (border - a[along]) / (b[along] - a[along]) * (b[across] - a[across])
        x, y = (border, place) if along == "x" else (place, border)
        return F.struct(x.alias("x"), y.alias("y"))

    def kept(a: Column, b: Column) -> Column:
        return (F.when(inside(a), F.when(inside(b), F.array(b)).otherwise(F.array(crossing(a, b))))
                .otherwise(F.when(inside(b), F.array(crossing(a, b), b)).otherwise(F.array().cast(G.RING))))
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    open_ = F.flatten(F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), kept))
    # named by a step of its own, so that it is made once though it is read twice
    return F.get(F.transform(F.array(open_), lambda o: F.concat(o, F.slice(o, 1, 1))), F.lit(0))


def clipped(df: DataFrame, geom: str, box: str) -> DataFrame:
    """The part of each geometry inside its box; see ``has_area`` for those that miss or only touch it.

    Rings are cut at the four borders in turn. Where a ring leaves the box and comes
    back, its parts stay one ring that runs along the border.
    """
    for along, side, above in (("x", "west", True), ("x", "east", False), ("y", "south", True), ("y", "north", False)):
        border = F.col(f"{box}.{side}")
        parts = F.transform(F.col(f"{geom}.parts"), lambda p: F.filter(
            F.transform(p, lambda r: _cut(r, along, border, above)), lambda r: F.size(r) > 3))
        # a part whose shell is gone has no holes left either
        df = df.withColumn(geom, F.struct(F.col(f"{geom}.srid").alias("srid"), F.filter(parts, lambda p: F.size(p) > 0).alias("parts")))
    return df


def has_area(geom: str) -> Column:
    """Whether anything is left of a clipped geometry but points and lines."""
    own = G.bbox(F.col(geom))
    return ((F.size(f"{geom}.parts") > 0) & (own["minx"] < own["maxx"]) & (own["miny"] < own["maxy"])
            & (G.area(F.col(geom)) > 0))


def tile_parts(df: DataFrame, geom: str, min_zoom: int, max_zoom: int) -> DataFrame:
    """One row per (feature, tile that it really meets), with ``z``, ``x``, ``y`` and its part there.

    Geometries are in degrees; null ones meet no tile. Zoom by zoom each part is dealt to
    the four tiles below its own, so empty tiles of a large or winding shape are left
    with the first tile that misses it, and no vertex is cut again where it is not.
    Each zoom is written once, since both the result and the next zoom read it; the
    features are dealt to all tasks first, as cutting is far more work than reading.
    """
    box = G.bbox(F.col(geom))
    top = F.lit(min_zoom)
    level = dealt_out(df).where(F.col(geom).isNotNull()).withColumn("__b", box).withColumns({
        "z": top, "x": F.explode(F.sequence(tile_x(F.col("__b.minx"), top), tile_x(F.col("__b.maxx"), top)))}).withColumn(
        "y", F.explode(F.sequence(tile_y(F.col("__b.maxy"), top), tile_y(F.col("__b.miny"), top)))).drop("__b")
    out = None
    for zoom in range(min_zoom, max_zoom + 1):
        if zoom > min_zoom:
            level = (level.withColumn("__child", F.explode(F.sequence(F.lit(0), F.lit(3))))
                     .withColumns({"z": F.lit(zoom), "x": F.col("x") * 2 + F.col("__child") % 2,
                                   "y": F.col("y") * 2 + F.floor(F.col("__child") / 2)}).drop("__child"))
            near, tile = G.bbox(F.col(geom)), tile_box(F.col("x"), F.col("y"), F.col("z"))
            level = level.where((near["minx"] < tile["east"]) & (near["maxx"] > tile["west"])
                                & (near["miny"] < tile["north"]) & (near["maxy"] > tile["south"]))
        cut = clipped(level.withColumn("__tile", tile_box(F.col("x"), F.col("y"), F.col("z"))), geom, "__tile").drop("__tile")
        level = staged(cut).where(has_area(geom))  # asked of the written parts, which are not cut again for it
        out = level if out is None else out.unionByName(level)
    return out


def rank_in_tile(tiles: DataFrame, size: str, id_by: Sequence[str]) -> DataFrame:
    """Add ``rank``: a feature's place in its tile, the largest first. Every row stays.

    A reader that wants the largest few of each tile filters on it; Spark then cuts
    each group within its map task, before the shuffle.
    """
    w = Window.partitionBy("z", "x", "y").orderBy(F.desc(size), *id_by)
    return tiles.withColumn("rank", F.row_number().over(w))
