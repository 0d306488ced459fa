"""Point in zone: a grid-cell equi-join followed by an exact test."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions import geometry as G
from terrier.functions.projection import to_lambert
from terrier.operators.skew import BROADCAST_ROWS, LIGHT_ROWS, attach
from terrier.session import staged


def project_points(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                   x: str = "x", y: str = "y") -> DataFrame:
    """Add Lambert-93 metres to points in degrees."""
    easting, northing = to_lambert(F.col(lon), F.col(lat))
    return df.withColumns({x: easting, y: northing})


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def candidates(zones: DataFrame, geom: str, order: str, columns: Sequence[str], size: float,
               by: Sequence[str] = ()) -> DataFrame:
    """One row per (grid cell, zone that meets it): ``cx``, ``cy``, ``seq``, ``zone``, ``es``.

    A cell that no edge enters lies inside or outside as a whole, so it carries
    no edges. Other cells carry the edges of their row of cells that reach them
    or lie to the right, all that a ray to the right can meet. Exact copies of a
    zone are folded into the first one, which is the one a point would get.
    """
    seq, payload = F.col(order).alias("seq"), F.struct(*columns).alias("zone")
    zones = (
        zones.where(F.col(geom).isNotNull()).select(*by, F.col(geom).alias("__g"), seq, payload)
        .groupBy(*by, "__g").agg(F.min(F.struct("seq", "zone")).alias("first"))
        .select(*by, F.col("first.*"), G.edges(F.col("__g")).alias("es"),
                G.bbox(F.col("__g")).alias("box"))
    )
    ids = [*by, "seq", "zone", "box"]
    # edges by row of cells: a row holds few of a zone's edges
    bands = (
        zones.select(*ids, F.explode("es").alias("e"))
        .withColumn("cy", F.explode(F.sequence(
            _cell(F.least("e.ay", "e.by"), size), _cell(F.greatest("e.ay", "e.by"), size))))
        .groupBy(*ids, "cy").agg(F.collect_list("e").alias("es"))
        .withColumn("cx", F.explode(F.sequence(
            _cell(F.col("box.minx"), size), _cell(F.col("box.maxx"), size))))
    )
    left, right = F.col("cx") * F.lit(size), (F.col("cx") + 1) * F.lit(size)
    entered = F.exists("es", lambda e: (F.greatest(e["ax"], e["bx"]) >= left)
                       & (F.least(e["ax"], e["bx"]) <= right))
    middle = F.pmod(G.crossings(F.col("es"), left + size / 2, (F.col("cy") + 0.5) * F.lit(size)), 2)
    nothing = F.filter("es", lambda e: F.lit(False))
    ahead = F.filter("es", lambda e: F.greatest(e["ax"], e["bx"]) >= left)
    return (
        bands.withColumn("entered", entered)
        .withColumn("inside", ~F.col("entered") & (middle == 1))
        .where(F.col("entered") | F.col("inside"))
        .select(*by, "cx", "cy", "seq", "inside", "zone",
                F.when(F.col("entered"), ahead).otherwise(nothing).alias("es")))


def point_in_zone(points: DataFrame, zones: DataFrame, x: str, y: str, geom: str, order: str,
                  columns: Sequence[str], salt_by: Sequence[str], size: float,
                  by: Sequence[str] = (), max_rows: int = BROADCAST_ROWS,
                  light_rows: int = LIGHT_ROWS, crowd: int = 256) -> DataFrame:
    """Add the ``columns`` of the first zone, in ``order``, that holds each point.

    A point on a border is in no zone. Every point stays one row; one without a
    zone gets nulls. ``by`` restricts a point to zones with the same values there.
    A cell with more than ``crowd`` candidates is dealt out over several lookups,
    so no lookup row grows with the number of zones that overlap.
    """
    cell = [*by, "cx", "cy"]
    found = staged(candidates(zones, geom, order, columns, size, by))
    sizes = found.groupBy(*cell).agg(F.count(F.lit(1)).alias("size"))
    rounds = max(1, math.ceil((sizes.agg(F.max("size")).first()[0] or 0) / crowd))
    if rounds > 1:
        crowded = sizes.where(F.col("size") > crowd).select(
            *cell, F.ceil(F.col("size") / crowd).alias("deals"))
        found = attach(found, crowded, cell, ["seq"], max_rows=max_rows, light_rows=light_rows)
        deal = F.pmod(F.xxhash64("seq"), F.coalesce("deals", F.lit(1))).alias("deal")
        found = found.select(*cell, "seq", "inside", "zone", "es", deal)
    weight = F.aggregate(F.transform("zones", lambda z: F.size(z["es"]) * 32 + 64),
                         F.lit(0), lambda acc, n: acc + n)
    px, py = F.col(x), F.col(y)

    def holds(z: Column) -> Column:
        odd = F.pmod(G.crossings(z["es"], px, py), 2) == 1
        return (z["inside"] | odd) & ~G.touches(z["es"], px, py)

    placed = points.withColumns({"cx": _cell(px, size), "cy": _cell(py, size)})
    best = None
    for i in range(rounds):
        dealt = found if rounds == 1 else found.where(F.col("deal") == i)
        cells = dealt.groupBy(*cell).agg(F.sort_array(F.collect_list(
            F.struct("seq", "inside", "zone", "es"))).alias("zones"))
        placed = attach(placed, cells, cell, salt_by, row_bytes=weight, max_rows=max_rows,
                        light_rows=light_rows)
        hit = F.get(F.filter("zones", holds), F.lit(0))
        hit = F.when(hit.isNotNull(), F.struct(hit["seq"].alias("seq"), hit["zone"].alias("zone")))
        # least() passes over nulls and compares by order first
        placed = placed.withColumn("__hit", hit if best is None else F.least("__hit", hit)).drop("zones")
        best = "__hit"
    return placed.select(*points.columns, *[F.col(f"__hit.zone.{c}").alias(c) for c in columns])
