"""Dissolving polygons: cancel shared edges, find the union's border, stitch it into rings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrier.functions import geometry as G
from terrier.operators.arrangement import union_border
from terrier.operators.spatial import point_in_zone
from terrier.session import staged

_EDGE = ("ax", "ay", "bx", "by")


def _oriented(geom: Column) -> Column:
    """All edges with the polygon on their left: shells counter-clockwise, holes clockwise."""
    def part(p: Column) -> Column:
        return F.flatten(F.transform(p, lambda r, i: G.ring_edges(
            F.when((G.ring_area(r) > 0) == (i == 0), r).otherwise(F.reverse(r)))))
    return F.flatten(F.transform(geom["parts"], part))


def outline(df: DataFrame, keys: Sequence[str], geom: str) -> DataFrame:
    """Edges on the border of each group's union, polygon on the left.

    Neighbours run along a shared edge in opposite directions, so an undirected
    edge seen twice is interior. The edge is part of the grouping key: a large
    group is spread over all tasks. ``times`` above 1 marks overlapping input.
    """
    es = df.select(*keys, F.explode(_oriented(F.col(geom))).alias("e")).select(*keys, "e.*")
    forward = F.struct("ax", "ay") < F.struct("bx", "by")
    es = es.where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by")))
    tally = es.select(
        *keys,
        *[F.when(forward, F.col(a)).otherwise(F.col(b)).alias(f"u{a}")
          for a, b in zip(_EDGE, ("bx", "by", "ax", "ay"))],
        F.when(forward, 1).otherwise(-1).alias("way"),
    ).groupBy(*keys, *[f"u{c}" for c in _EDGE]).agg(
        F.sum("way").alias("net"), F.count(F.lit(1)).alias("seen"))
    ahead = F.col("net") > 0
    return tally.where(F.col("net") != 0).select(
        *keys,
        *[F.when(ahead, F.col(f"u{a}")).otherwise(F.col(f"u{b}")).alias(a)
          for a, b in zip(_EDGE, ("bx", "by", "ax", "ay"))],
        F.abs("net").cast("int").alias("times"))


def open_ends(border: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Vertices where the border does not close: the input shares borders without vertices."""
    a = border.select(*keys, F.col("ax").alias("x"), F.col("ay").alias("y"), F.lit(1).alias("d"))
    b = border.select(*keys, F.col("bx").alias("x"), F.col("by").alias("y"), F.lit(-1).alias("d"))
    return (a.unionByName(b).groupBy(*keys, "x", "y").agg(F.sum("d").alias("d"))
            .where(F.col("d") != 0))


def _group(keys: Sequence[str]) -> Column:
    return F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))


def stitch(border: DataFrame, keys: Sequence[str], max_steps: int = 64) -> DataFrame:
    """Closed rings ``(keys, ring, vertices)`` from border edges, by pointer doubling.

    Each edge points to the next one round its ring. In every step an edge learns
    the smallest edge number within twice as many edges, and how far off it is, so
    a ring of n edges takes log2(n) joins on evenly spread numbers.
    """
    # written with the edges, so the numbers stay the same from here on
    es = staged(border.select(_group(keys).alias("k"), *_EDGE,
                              F.monotonically_increasing_id().alias("id")))
    # Where borders meet in one vertex, turn left as sharply as possible: seen from
    # the way back, the next way out clockwise. One window finds it, without pairs.
    ends = es.selectExpr("struct(k, bx as x, by as y) as at", "atan2(ay - by, ax - bx) as angle",
                         "id", "cast(null as bigint) as out")
    starts = es.selectExpr("struct(k, ax as x, ay as y) as at", "atan2(by - ay, bx - ax) as angle",
                           "cast(null as bigint) as id", "id as out")
    clockwise = Window.partitionBy("at").orderBy(F.desc("angle"), F.desc_nulls_last("out"))
    after = clockwise.rowsBetween(1, Window.unboundedFollowing)
    around = clockwise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    state = (
        ends.unionByName(starts)
        .withColumn("jump", F.coalesce(F.first("out", ignorenulls=True).over(after),
                                       F.first("out", ignorenulls=True).over(around)))
        .where(F.col("id").isNotNull())
        .selectExpr("id", "jump", "id as low", "0L as off"))

    def doubled(state: DataFrame, step: int) -> DataFrame:
        ahead = state.selectExpr("id as jump", "jump as jump2", "low as low2", "off as off2")
        return state.join(ahead, "jump").selectExpr(
            "id", "jump2 as jump", "least(low, low2) as low",
            f"if(low2 < low, off2 + {1 << step}L, off) as off", "low2 < low as moved")

    state = staged(doubled(state, 0))
    for step in range(1, max_steps, 2):
        state = staged(doubled(doubled(state, step), step + 1))
        if state.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"border not closed after {max_steps} steps")
    # an edge lies `off` edges before the first one of its ring; that one leads
    ring = F.expr("sort_array(collect_list(struct("
                  "if(off = 0, -4611686018427387904, -off) as place, ax as x, ay as y)))")
    closed = state.join(es, "id").groupBy("k", F.col("low").alias("ring")).agg(ring.alias("r"))
    return closed.select(
        *[F.col(f"k.{c}").alias(c) for c in keys], "ring",
        F.transform(F.concat("r", F.slice("r", 1, 1)),
                    lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("vertices"))


def union_outline(df: DataFrame, keys: Sequence[str], geom: str, size: float,
                  snap: float | None = None) -> DataFrame:
    """Edges on the border of each group's union, whether its polygons share vertices, overlap or not.

    Segments that cancel are gone before the rest is noded, so polygons that share
    all vertices cost no more than their outline. A vertex within ``snap`` of another
    polygon's edge (a billionth of ``size`` by default) becomes a vertex of it.
    """
    border = outline(df, keys, geom).select(_group(keys).alias("k"), *_EDGE, "times")
    return union_border(border, size, snap).select(*[F.col(f"k.{c}").alias(c) for c in keys], *_EDGE)


def dissolve(df: DataFrame, keys: Sequence[str], geom: str, srid: int,
             size: float, snap: float | None = None) -> DataFrame:
    """One geometry per group: the union of its polygons.

    They may share borders with or without sharing vertices, overlap, cross or hold one
    another. Only the keys are kept; attributes of an arbitrary member would be stale.
    ``size`` is the grid cell in which segments are compared and holes placed in their
    shells. Groups without a polygon give no row.
    """
    rings = staged(stitch(union_outline(df, keys, geom, size, snap), keys)
                   .withColumn("signed", G.ring_area(F.col("vertices")))
                   .withColumn("__k", _group(keys)))
    shells = rings.where("signed > 0")
    holes = rings.where("signed < 0").select(
        "__k", "ring", "vertices",
        # the middle of a hole's first edge is strictly inside its shell
        ((F.col("vertices")[0]["x"] + F.col("vertices")[1]["x"]) / 2).alias("hx"),
        ((F.col("vertices")[0]["y"] + F.col("vertices")[1]["y"]) / 2).alias("hy"))
    zones = shells.select("__k", F.col("ring").alias("shell"), "signed",
                          G.polygon(F.array("vertices"), srid).alias("g"))
    # zones in order of area: the smallest shell around a hole is its own
    placed = point_in_zone(holes, zones, "hx", "hy", "g", "signed", ["shell"], ["ring"], size,
                           by=["__k"])
    inner = placed.groupBy(F.col("shell").alias("ring")).agg(
        F.sort_array(F.collect_list("vertices")).alias("inner"))
    parts = shells.join(inner, "ring", "left").select(
        *keys, F.concat(F.array("vertices"), F.coalesce(
            "inner", F.array().cast(T.ArrayType(G.RING)))).alias("part"))
    # one output cell holds the whole shape, so gathering its rings here is its size
    return parts.groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("parts")).select(
        *keys, F.struct(F.lit(srid).alias("srid"), "parts").alias(geom))
