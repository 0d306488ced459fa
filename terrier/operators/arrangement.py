"""Noding of border segments and the winding numbers beside them.

Segments ``(k, ax, ay, bx, by, net)`` run from their lesser end to the greater; ``net``
counts the polygons on their left less those on their right, so segments that cancel
are gone before any work is done. All steps are joins on grid cells, grouped by ``k``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.session import staged

#: The grid is shifted by this part of a cell, so that round coordinates lie on none of its lines.
SHIFT = 0.3819660112501051
#: Shares of a cell within which a node falls on a segment, and by which covers are widened.
SNAP, PAD = 1e-9, 1e-8
#: Splitting is repeated until no segment has a node inside; moved by ``SNAP`` at most, few do after once.
ROUNDS = 8


def _index(v: Column, size: float) -> Column:
    """Grid coordinate of a value, in cells."""
    return (v - F.lit(SHIFT * size)) / F.lit(size)


def _line(cell: Column, size: float) -> Column:
    """The lower border of a row or column of cells."""
    return cell * F.lit(size) + F.lit(SHIFT * size)


def directed(border: DataFrame) -> DataFrame:
    """Segments from oriented edges ``(k, ax, ay, bx, by, times)``, polygon on the left."""
    ahead = F.struct("ax", "ay") < F.struct("bx", "by")
    return border.select("k", *[F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in
                                (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))],
                         F.when(ahead, F.col("times")).otherwise(-F.col("times")).cast("long").alias("net"))


def covered(segments: DataFrame, size: float) -> DataFrame:
    """Segments with every cell they meet, ``cx`` and ``cy``; a cell's right border belongs to it too."""
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = segments.withColumn("cy", F.explode(F.sequence(
        F.floor(_index(low, size) - PAD), F.floor(_index(high, size) + PAD))))

    def at(y: Column) -> Column:
        """x of the segment where it enters or leaves the row."""
        t = F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay"))
        return F.col("ax") + F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)) * (F.col("bx") - F.col("ax"))
    flat = F.col("ay") == F.col("by")
    one = F.when(flat, F.col("ax")).otherwise(at(_line(F.col("cy") - PAD, size)))
    two = F.when(flat, F.col("bx")).otherwise(at(_line(F.col("cy") + (1 + PAD), size)))
    return rows.withColumn("cx", F.explode(F.sequence(
        F.ceil(_index(F.least(one, two), size) - PAD) - 1, F.floor(_index(F.greatest(one, two), size) + PAD))))


def _nodes(cover: DataFrame, snap: float) -> DataFrame:
    """Points (id, x, y) inside segments where others end on them, cross them or run along them."""
    one = cover.select("k", "cx", "cy", *[F.col(c).alias(f"p_{c}") for c in ("id", "ax", "ay", "bx", "by")])
    two = cover.select("k", "cx", "cy", *[F.col(c).alias(f"q_{c}") for c in ("id", "ax", "ay", "bx", "by")])

    def overlap(a: str, b: str) -> Column:
        return ((F.least(f"p_{a}", f"p_{b}") <= F.greatest(f"q_{a}", f"q_{b}") + snap)
                & (F.least(f"q_{a}", f"q_{b}") <= F.greatest(f"p_{a}", f"p_{b}") + snap))
    pairs = one.join(two, ["k", "cx", "cy"]).where(
        (F.col("p_id") < F.col("q_id")) & overlap("ax", "bx") & overlap("ay", "by"))

    def on(s: str, e: str, end: str) -> Column:
        """The point where an end of ``e`` lies inside ``s``."""
        ax, ay, bx, by = (F.col(f"{s}_{c}") for c in ("ax", "ay", "bx", "by"))
        x, y = F.col(f"{e}_{end}x"), F.col(f"{e}_{end}y")
        dx, dy = bx - ax, by - ay
        length2 = dx * dx + dy * dy
        cross, along = dx * (y - ay) - dy * (x - ax), (x - ax) * dx + (y - ay) * dy
        inside = ((cross * cross <= F.lit(snap * snap) * length2) & (along > 0) & (along < length2)
                  & ~((x == ax) & (y == ay)) & ~((x == bx) & (y == by)))
        return F.when(inside, F.struct(F.col(f"{s}_id").alias("id"), x.alias("x"), y.alias("y")))

    px, py = F.col("p_bx") - F.col("p_ax"), F.col("p_by") - F.col("p_ay")
    qx, qy = F.col("q_bx") - F.col("q_ax"), F.col("q_by") - F.col("q_ay")
    ox, oy = F.col("q_ax") - F.col("p_ax"), F.col("q_ay") - F.col("p_ay")
    area = px * qy - py * qx
    t, u = F.try_divide(ox * qy - oy * qx, area), F.try_divide(ox * py - oy * px, area)
    x, y = F.col("p_ax") + t * px, F.col("p_ay") + t * py
    if snap:
        x, y = F.round(x / snap) * snap, F.round(y / snap) * snap
    crossing = (t > 0) & (t < 1) & (u > 0) & (u < 1)
    ends = [on(s, e, end) for s, e in (("p", "q"), ("q", "p")) for end in "ab"]
    for s in "pq":  # a crossing at an end is that end
        for end in "ab":
            dx, dy = x - F.col(f"{s}_{end}x"), y - F.col(f"{s}_{end}y")
            crossing = crossing & (dx * dx + dy * dy > 4 * snap * snap)
    met = [F.when(crossing, F.struct(F.col(f"{s}_id").alias("id"), x.alias("x"), y.alias("y"))) for s in "pq"]
    return pairs.select(F.explode(F.array_compact(F.array(*ends, *met))).alias("n")).select("n.*").distinct()


def _split(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """Segments cut at their nodes; equal pieces are added up and those that cancel are gone."""
    at = nodes.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("x", "y")).alias("nodes"))
    along = F.transform("nodes", lambda n: F.struct(
        ((n["x"] - F.col("ax")) * (F.col("bx") - F.col("ax")) + (n["y"] - F.col("ay")) * (F.col("by") - F.col("ay"))).alias("t"),
        n["x"].alias("x"), n["y"].alias("y")))
    # the nodes of one segment, which its own pieces make up
    points = F.concat(F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y"))),
                      F.transform(F.array_sort(along), lambda n: F.struct(n["x"].alias("x"), n["y"].alias("y"))),
                      F.array(F.struct(F.col("bx").alias("x"), F.col("by").alias("y"))))
    steps = F.zip_with(F.slice("points", F.lit(1), F.size("points") - 1), F.slice("points", F.lit(2), F.size("points") - 1),
                       lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    cut = segments.join(at, segments["id"] == at["of"], "left").withColumn("nodes", F.coalesce(
        "nodes", F.array().cast("array<struct<x:double,y:double>>")))
    pieces = (cut.withColumn("points", points).select("k", "net", F.explode(steps).alias("e")).select("k", "e.*", "net")
              .where("ax <> bx OR ay <> by"))
    ahead = F.struct("ax", "ay") < F.struct("bx", "by")
    turned = pieces.select("k", *[F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in
                                  (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))],
                           F.when(ahead, F.col("net")).otherwise(-F.col("net")).alias("net"))
    return turned.groupBy("k", "ax", "ay", "bx", "by").agg(F.sum("net").alias("net")).where("net <> 0")


def noded(segments: DataFrame, size: float, snap: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments (with ``id``) that meet at their ends only, and the same by the cells they meet.

    A vertex within ``snap`` of a segment becomes a node of it; crossings are rounded to it.
    Cells should hold few segments: those of one cell are compared with each other.
    """
    snap = size * SNAP if snap is None else snap
    snap = 2.0 ** math.floor(math.log2(snap)) if snap else 0.0  # multiples of it are exact
    for _ in range(ROUNDS):
        segments = staged(segments.withColumn("id", F.monotonically_increasing_id()))
        cover = staged(covered(segments, size))
        nodes = staged(_nodes(cover, snap))
        if nodes.isEmpty():
            return segments, cover
        segments = _split(segments, nodes)
    raise ValueError(f"segments still meet inside after {ROUNDS} rounds: raise snap above {snap}")


def wound(segments: DataFrame, cover: DataFrame, size: float) -> DataFrame:
    """Noded segments with ``left`` and ``right``, the number of polygons over either side.

    From far right to the middle of a segment: along the lower border of its row of cells
    to its own cell, by running totals of what crosses that border; up the cell's right
    border; and left to the middle. The last two look at the segments of one cell only.
    """
    up = F.col("by") > F.col("ay")
    lines = segments.select("*", F.explode(F.sequence(
        F.floor(_index(F.least("ay", "by"), size)), F.floor(_index(F.greatest("ay", "by"), size)) + 1)).alias("cy"))
    y = _line(F.col("cy"), size)
    x = F.col("ax") + F.try_divide(y - F.col("ay"), F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossed = lines.where((F.col("ay") > y) != (F.col("by") > y)).select(
        "k", "cy", (F.ceil(_index(x, size)) - 1).alias("cx"), F.when(up, F.col("net")).otherwise(-F.col("net")).alias("net"))
    crossed = crossed.groupBy("k", "cy", "cx").agg(F.sum("net").alias("net"))
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    middles = segments.withColumns({"mx": mx, "my": my}).withColumns({
        "cx": F.floor(_index(F.col("mx"), size)), "cy": F.floor(_index(F.col("my"), size))})
    # totals over the cells to the right: one row for each cell of a row that has any
    asked = middles.select("k", "cy", "cx").distinct().withColumn("net", F.lit(None).cast("long"))
    places = crossed.select("k", "cy", "cx", "net", (-2 * F.col("cx")).alias("place")).unionByName(
        asked.withColumn("place", -2 * F.col("cx") - 1))
    before = Window.partitionBy("k", "cy").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    corners = places.withColumn("corner", F.coalesce(F.sum("net").over(before), F.lit(0))).where(
        F.pmod(F.col("place"), F.lit(2)) == 1).select("k", "cy", "cx", "corner")

    c = {n: F.col(f"c_{n}") for n in ("id", "ax", "ay", "bx", "by", "net")}
    near = cover.select("k", "cx", "cy", *[F.col(n).alias(f"c_{n}") for n in c])
    right, floor = _line(F.col("cx") + 1, size), _line(F.col("cy"), size)
    at_y = c["ay"] + F.try_divide(right - c["ax"], c["bx"] - c["ax"]) * (c["by"] - c["ay"])
    at_x = c["ax"] + F.try_divide(F.col("my") - c["ay"], c["by"] - c["ay"]) * (c["bx"] - c["ax"])
    rising = c["by"] > c["ay"]
    # a point on a line counts as just above it and just right of it
    upwards = (((c["ax"] > right) != (c["bx"] > right))
               & ((at_y > floor) | ((at_y == floor) & rising)) & ((at_y < F.col("my")) | ((at_y == F.col("my")) & ~rising)))
    leftwards = (((c["ay"] > F.col("my")) != (c["by"] > F.col("my"))) & (at_x > F.col("mx")) & (at_x <= right)
                 & (c["id"] != F.col("id")))
    step = F.when(upwards, c["net"]).otherwise(0) + F.when(leftwards, F.when(rising, c["net"]).otherwise(-c["net"])).otherwise(0)
    passed = middles.join(near, ["k", "cx", "cy"]).groupBy("id").agg(F.sum(step).alias("passed"))
    met = (middles.join(corners, ["k", "cy", "cx"]).join(passed, "id", "left")
           .withColumn("east", F.col("corner") + F.coalesce("passed", F.lit(0))))
    left = F.when(up, F.col("east") + F.col("net")).otherwise(F.col("east"))
    return met.select("k", "ax", "ay", "bx", "by", left.alias("left"), (left - F.col("net")).alias("right"))


def union_border(border: DataFrame, size: float, snap: float | None = None) -> DataFrame:
    """Edges ``(k, ax, ay, bx, by)`` of the union, union on the left, from oriented edges with ``times``."""
    sides = wound(*noded(directed(border), size, snap), size)
    ahead = F.col("left") != 0
    return sides.where((F.col("left") != 0) != (F.col("right") != 0)).select(
        "k", *[F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in
               (("ax", "bx"), ("ay", "by"), ("bx", "ax"), ("by", "ay"))])
