"""Polygons as nested arrays, and the column expressions on them.

A geometry is ``struct<srid, parts>``: parts -> rings -> vertices. The first ring
of a part is its shell, the others are holes; every ring repeats its first vertex
at the end. A polygon has one part. Points stay two plain columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrier.functions.projection import from_lambert, to_lambert

VERTEX = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(VERTEX)
GEOMETRY = T.StructType([
    T.StructField("srid", T.IntegerType()),
    T.StructField("parts", T.ArrayType(T.ArrayType(RING))),
])
WGS84, LAMBERT93 = 4326, 2154


def polygon(rings: Column, srid: int) -> Column:
    """A one-part geometry from an array of rings."""
    return F.struct(F.lit(srid).alias("srid"), F.array(rings).alias("parts"))


def vertex(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A counter-clockwise rectangle."""
    return F.array(vertex(minx, miny), vertex(maxx, miny), vertex(maxx, maxy),
                   vertex(minx, maxy), vertex(minx, miny))


def rings(geom: Column) -> Column:
    return F.flatten(geom["parts"])


def vertices(geom: Column) -> Column:
    return F.flatten(rings(geom))


def ring_edges(ring: Column) -> Column:
    """Directed edges ``(ax, ay, bx, by)`` of a closed ring."""
    tail = F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0)))
    head = F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def edges(geom: Column) -> Column:
    return F.flatten(F.transform(rings(geom), ring_edges))


def ring_area(ring: Column) -> Column:
    """Signed area by the shoelace sum; positive for counter-clockwise rings."""
    return F.aggregate(
        ring_edges(ring), F.lit(0.0),
        lambda acc, e: acc + (e["ax"] * e["by"] - e["bx"] * e["ay"])) / 2


def area(geom: Column) -> Column:
    """Shells minus holes, whichever way the rings run."""
    def part(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda r, i: F.when(i == 0, F.abs(ring_area(r)))
                                       .otherwise(-F.abs(ring_area(r)))),
                           F.lit(0.0), lambda acc, a: acc + a)
    return F.aggregate(F.transform(geom["parts"], part), F.lit(0.0), lambda acc, a: acc + a)


def corners(ring: Column) -> Column:
    """The vertices of a closed ring at which it turns, each once."""
    n = F.size(ring) - 1

    def turns(v: Column, i: Column) -> Column:
        a, b = F.get(ring, F.pmod(i + n - 1, n)), F.get(ring, i + 1)
        return (v["x"] - a["x"]) * (b["y"] - v["y"]) != (v["y"] - a["y"]) * (b["x"] - v["x"])
    return F.filter(F.slice(ring, F.lit(1), n), turns)


def vertex_count(geom: Column) -> Column:
    return F.size(vertices(geom))


def bbox(geom: Column) -> Column:
    vs = vertices(geom)
    xs, ys = F.transform(vs, lambda v: v["x"]), F.transform(vs, lambda v: v["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def map_vertices(geom: Column, move: Callable[[Column, Column], tuple[Column, Column]],
                 srid: int) -> Column:
    """Move every vertex; the new geometry carries ``srid``."""
    def moved(v: Column) -> Column:
        x, y = move(v["x"], v["y"])
        return F.struct(x.alias("x"), y.alias("y"))
    parts = F.transform(geom["parts"],
                        lambda p: F.transform(p, lambda r: F.transform(r, moved)))
    return F.when(geom.isNotNull(), F.struct(F.lit(srid).alias("srid"), parts.alias("parts")))


def to_wgs84(geom: Column) -> Column:
    """Degrees; a geometry already in degrees is left alone."""
    return F.when(geom["srid"] == WGS84, geom).otherwise(map_vertices(geom, from_lambert, WGS84))


def to_lambert93(geom: Column) -> Column:
    return F.when(geom["srid"] == LAMBERT93, geom).otherwise(
        map_vertices(geom, to_lambert, LAMBERT93))


def geometry_type(geom: Column) -> Column:
    return F.when(geom.isNull(), F.lit(None)).when(
        F.size(geom["parts"]) == 1, F.lit("Polygon")).otherwise(F.lit("MultiPolygon"))


def geojson_geometry(geom: Column) -> Column:
    """GeoJSON text of a geometry, null for a null one."""
    pairs = F.transform(geom["parts"], lambda p: F.transform(
        p, lambda r: F.transform(r, lambda v: F.array(v["x"], v["y"]))))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"),
                             F.get(pairs, F.lit(0)).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates")))
    return F.when(geom.isNotNull(), F.when(F.size(geom["parts"]) == 1, one).otherwise(many))


def parse_geojson_geometry(kind: Column, coordinates: Column, srid: int = WGS84) -> Column:
    """Geometry from the type and the raw coordinate text; null for other types."""
    def ring(r: Column) -> Column:
        return F.transform(r, lambda c: F.struct(
            F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y")))
    one = F.transform(F.from_json(coordinates, "array<array<array<double>>>"), ring)
    many = F.transform(F.from_json(coordinates, "array<array<array<array<double>>>>"),
                       lambda p: F.transform(p, ring))
    parts = F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many)
    return F.when(parts.isNotNull(), F.struct(F.lit(srid).alias("srid"), parts.alias("parts")))


def crossings(es: Column, x: Column, y: Column) -> Column:
    """How many edges a ray from (x, y) to the right crosses; half-open in y."""
    def crosses(e: Column) -> Column:
        straddles = (e["ay"] > y) != (e["by"] > y)
        at = F.try_divide((e["bx"] - e["ax"]) * (y - e["ay"]), e["by"] - e["ay"]) + e["ax"]
        return straddles & (x < at)
    return F.size(F.filter(es, crosses))


def touches(es: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) lies on one of the edges."""
    def on(e: Column) -> Column:
        cross = (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
        return ((cross == 0) & (x >= F.least(e["ax"], e["bx"])) & (x <= F.greatest(e["ax"], e["bx"]))
                & (y >= F.least(e["ay"], e["by"])) & (y <= F.greatest(e["ay"], e["by"])))
    return F.exists(es, on)
