"""Unions of polygons that overlap, and simplification that keeps the topology, against plain versions."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrier.functions import geometry as G
from terrier.operators import arrangement as A
from terrier.operators import dissolve as D
from terrier.operators import simplify as S

SHAPE = "struct<srid:int,parts:array<array<array<struct<x:double,y:double>>>>>"


def geom(*parts):
    return {"srid": 2154, "parts": [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]}


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                odd = not odd
    return odd


def star(rng, snap):
    x, y, n, turn = rng.uniform(0, 14), rng.uniform(0, 14), rng.randrange(3, 8), rng.random()
    ring = [(x + rng.uniform(.4, 3) * math.cos(2 * math.pi * k / n + turn),
             y + rng.uniform(.4, 3) * math.sin(2 * math.pi * k / n + turn)) for k in range(n)]
    if snap:
        ring = list(dict.fromkeys((round(a / snap) * snap, round(b / snap) * snap) for a, b in ring))
    return [*ring, ring[0]]


def rings_of(shape):
    return [[(v.x, v.y) for v in ring] for part in shape.parts for ring in part]


@pytest.mark.parametrize("size", [0.7, 5.0])
def test_union_covers_what_any_polygon_covers(spark, size):
    rng = random.Random(11)
    shapes = {"free": [[star(rng, 0)] for _ in range(30)], "quarters": [[star(rng, .25)] for _ in range(30)],
              "boxes": [[box(rng.randrange(9), rng.randrange(9), rng.randrange(1, 5), rng.randrange(1, 4))] for _ in range(30)],
              "holes": [[box(x, y, 6, 6), box(x + 1, y + 1, 4, 4)[::-1 if x % 2 else 1]] for x in range(0, 9, 3) for y in (0, 2, 7)],
              "nested": [[box(0, 0, 9, 9)], [box(2, 2, 3, 3)], [box(2, 2, 3, 3)], [box(8, 8, 3, 1)]]}
    shapes = {k: [s for s in v if len({*s[0]}) > 2] for k, v in shapes.items()}
    rows = [(k, geom(s)) for k, each in shapes.items() for s in each] + [("free", None), ("none", None)]
    df = spark.createDataFrame(rows, f"k string, geom {SHAPE}").repartition(3)
    out = {r.k: r for r in D.dissolve(df, ["k"], "geom", 2154, size).select("k", "geom", G.area(F.col("geom")).alias("area")).collect()}
    assert set(out) == set(shapes)
    for k, each in shapes.items():
        found = rings_of(out[k].geom)
        assert all(r[0] == r[-1] for r in found)
        for _ in range(4000):
            x, y = rng.uniform(-3, 18), rng.uniform(-3, 18)
            assert inside(found, x, y) == any(inside(s, x, y) for s in each), (k, x, y)
    cells = {(x + i, y + j) for s in shapes["boxes"] for (x, y), _, (x2, y2), *_ in [s[0]] for i in range(x2 - x) for j in range(y2 - y)}
    assert out["boxes"].area == len(cells)


def corner_points(shape):
    return Counter((x, y) for ring in rings_of(shape) for i, (x, y) in enumerate(ring[:-1])
                   if (x - ring[i - 1 if i else -2][0]) * (ring[i + 1][1] - y) != (y - ring[i - 1 if i else -2][1]) * (ring[i + 1][0] - x))


def test_shared_borders_without_shared_vertices(spark):
    df = spark.createDataFrame([(geom([box(0, 0, 2, 2)]),), (geom([box(2, 0, 1, 1)]),), (geom([box(2, 1, 1, 1)]),),
                                (geom([box(0, 2, 3, 1)]),)], f"geom {SHAPE}")
    shape = D.dissolve(df, [], "geom", 2154, 2.0).first().geom
    assert len(shape.parts) == 1 and len(shape.parts[0]) == 1
    assert corner_points(shape) == Counter([(0, 0), (3, 0), (3, 3), (0, 3)])
    # on a slanted border a vertex is on it up to rounding only
    slanted = [[(0, 0), (9, 7), (0, 7), (0, 0)], [(0, 0), (9 / 3, 7 / 3), (9, 0), (0, 0)],
               [(9 / 3, 7 / 3), (9, 7), (9, 0), (9 / 3, 7 / 3)]]
    df = spark.createDataFrame([(geom([r]),) for r in slanted], f"geom {SHAPE}")
    shape = D.dissolve(df, [], "geom", 2154, 3.0).first().geom
    assert len(rings_of(shape)) == 1 and set(rings_of(shape)[0]) == {(0, 0), (9, 0), (9, 7), (0, 7)}


def test_union_of_nothing_and_groups_by_several_keys(spark):
    none = spark.createDataFrame([], f"a int, b string, geom {SHAPE}")
    assert D.dissolve(none, ["a", "b"], "geom", 2154, 2.0).count() == 0
    df = spark.createDataFrame([(1, None, geom([box(0, 0, 2, 2)])), (1, None, geom([box(1, 1, 2, 2)])), (1, "x", geom([box(0, 0, 1, 1)]))],
                               f"a int, b string, geom {SHAPE}")
    out = {(r.a, r.b): r.area for r in D.dissolve(df, ["a", "b"], "geom", 2154, 2.0).select("a", "b", G.area(F.col("geom")).alias("area")).collect()}
    assert out == {(1, None): 7.0, (1, "x"): 1.0}


def test_winding_counts_polygons_on_both_sides(spark):
    rng = random.Random(5)
    ends = [[(rng.randrange(24) / 2, rng.randrange(24) / 2) for _ in range(3)] for _ in range(25)]
    shapes = [[*t, t[0]] for t in ends if len({*t}) > 2]
    df = spark.createDataFrame([(geom([s]),) for s in shapes], f"geom {SHAPE}")
    border = D.outline(df, [], "geom").withColumn("k", F.struct(F.lit(0)))
    for r in A.wound(*A.noded(A.directed(border), 1.5), 1.5).collect():
        mx, my, dx, dy = (r.ax + r.bx) / 2, (r.ay + r.by) / 2, r.bx - r.ax, r.by - r.ay
        step = 1e-6 / math.hypot(dx, dy)
        assert r.left == sum(inside([s], mx - dy * step, my + dx * step) for s in shapes)
        assert r.right == sum(inside([s], mx + dy * step, my - dx * step) for s in shapes)


# --- simplification

def jagged(rng, radius, n, depth, x=0.0, y=0.0, turn=0.0):
    ring = [(x + (radius + rng.uniform(-depth, depth)) * math.cos(2 * math.pi * k / n + turn),
             y + (radius + rng.uniform(-depth, depth)) * math.sin(2 * math.pi * k / n + turn)) for k in range(n)]
    return np.array([*ring, ring[0]])


def crossings(rings):
    ends = np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings])
    return sum(S.meets(e, np.delete(ends, i, axis=0)) for i, e in enumerate(ends))


@pytest.mark.parametrize("seed", range(6))
def test_simplified_rings_do_not_meet(seed):
    rng = random.Random(seed)
    rings = [jagged(rng, 10, 300, .12), jagged(rng, 9.6, 260, .12, turn=.5), jagged(rng, 9.2, 240, .12, turn=1.1), jagged(rng, .05, 12, .01, 9.8, 0)]
    if seed % 2:  # a ring that comes back close to itself
        spiral = [(t * math.cos(t), t * math.sin(t)) for t in np.linspace(6, 30, 700)]
        back = [((t + .4) * math.cos(t), (t + .4) * math.sin(t)) for t in np.linspace(30, 6, 700)]
        rings.append(np.array([*spiral, *back, spiral[0]]) + [100, 0])
    assert crossings(rings) == 0
    for tolerance in (.05, .3, 2.0):
        kept = [r[k] for r, k in zip(rings, S.thin_shape(rings, tolerance))]
        assert crossings(kept) == 0
        for ring, k in zip(rings, S.thin_shape(rings, tolerance)):
            assert k[0] == 0 and k[-1] == len(ring) - 1 and len(k) >= 4 and (np.diff(k) > 0).all()
            for lo, hi in zip(k[:-1], k[1:]):
                assert hi - lo < 2 or S._offsets(ring, lo, hi).max() <= tolerance
        nested = [[tuple(v) for v in r] for r in kept[:3]]
        assert all(inside([nested[i]], *v) for i in (0, 1) for v in nested[i + 1])
        island = [tuple(v) for v in kept[3]]
        assert [inside([r], *island[0]) for r in nested] == [inside([[tuple(v) for v in r]], *rings[3][0]) for r in rings[:3]]
    # each ring for itself would not do
    assert sum(crossings([r[S.thin_ring(r, tolerance)] for r in rings[:3]]) for tolerance in (.3, .6, 1.0, 2.0)) > 0
    assert sum(map(len, S.thin_shape(rings, .3))) < sum(map(len, rings)) / 2


def test_simplify_keeps_small_and_null_shapes(spark):
    small = [[(0, 0), (1, 0), (0, 1), (0, 0)]]
    line = [[(0, 0), (1, 0), (2, 0), (3, 0), (0, 0)]]
    df = spark.createDataFrame([(1, geom(small)), (2, None), (3, geom()), (4, geom(line, small))], f"id int, geom {SHAPE}")
    out = {r.id: r.geom for r in S.simplify(df, "geom", .1).collect()}
    assert rings_of(out[1]) == small and out[2] is None and out[3].parts == []
    assert rings_of(out[4])[1] == small[0] and rings_of(out[4])[0][0] == (0, 0)
