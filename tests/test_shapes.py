import gzip
import json
import math
import random
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from terrier.functions import geometry as G
from terrier.functions import projection as P
from terrier.operators import dissolve as D
from terrier.operators import features as X
from terrier.operators import tiles
from terrier.operators.simplify import simplify, thin_ring
from terrier.operators.spatial import point_in_zone
from terrier.queries.shapes import QUERIES, _boxes, _squares
from terrier.sinks import as_collections
from terrier.sources import boundaries as B

SCHEMA = "struct<srid:int,parts:array<array<array<struct<x:double,y:double>>>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def shapes(spark, data, extra="", srid=2154):
    """``data``: (id, *extra values, parts)."""
    return spark.createDataFrame(
        [(*r[:-1], None if r[-1] is None else (srid, [[[(float(x), float(y)) for x, y in ring]
                                                       for ring in part] for part in r[-1]]))
         for r in data], f"id int, {extra}geom {SCHEMA}")


def test_projection_at_known_points(spark):
    df = spark.createDataFrame([(3.0, 46.5), (2.3522, 48.8566), (9.2, 41.4), (-4.8, 48.4)],
                               "lon double, lat double")
    x, y = P.to_lambert(F.col("lon"), F.col("lat"))
    flat = df.withColumns({"x": x, "y": y})
    lon, lat = P.from_lambert(F.col("x"), F.col("y"))
    got = flat.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert (got[0].x, got[0].y) == pytest.approx((700000, 6600000), abs=1e-6)
    assert (got[1].x, got[1].y) == pytest.approx((652469.0227, 6862035.2594), abs=1e-3)
    for r in got:
        assert (r.lon2, r.lat2) == pytest.approx((r.lon, r.lat), abs=1e-9)


def test_points_in_zones(spark):
    zones = shapes(spark, [
        (1, [[box(0, 0, 10, 10), box(2, 2, 4, 4)]]),                 # with a hole
        (2, [[box(10, 0, 20, 10)], [box(30, 0, 35, 5)]]),            # two parts
        (3, [[box(5, 5, 15, 15)]]),                                  # overlaps 1 and 2
        (4, [[box(5, 5, 15, 15)]]),                                  # a copy of 3
        (5, [[[(40, 0), (60, 30), (40, 60), (20, 30), (40, 0)]]]),   # slanted, over many cells
        (6, None)])
    pts = [(0, 1, 1, 1), (1, 3, 3, None), (2, 2, 3, None), (3, 12, 1, 2), (4, 32, 1, 2),
           (5, 10, 1, None), (6, 10, 12, 3), (7, 12, 12, 3), (8, 7, 7, 1), (9, 12, 7, 2),
           (10, 0, 0, None), (11, 40, 30, 5), (12, 22, 29, 5), (13, 22, 20, None),
           (14, 40, 0, None), (15, 50, 15, None), (16, 500, 500, None), (17, 10, 7, 3)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, x, y, _ in pts],
                                   "pid int, x double, y double")
    want = [(i, z) for i, _, _, z in pts]
    for size, kw in ((1.0, {}), (3.0, {"max_rows": 0, "light_rows": 3}), (100.0, {"crowd": 2})):
        out = point_in_zone(points, zones, "x", "y", "geom", "id", ["id"], ["pid"], size, **kw)
        assert rows(out, "pid", "id") == want, (size, kw)


def test_points_against_brute_force(spark):
    rng = random.Random(5)
    polys = []
    for i in range(25):
        cx, cy = rng.uniform(0, 50), rng.uniform(0, 50)
        ring = [(cx + rng.uniform(2, 9) * math.cos(a), cy + rng.uniform(2, 9) * math.sin(a))
                for a in np.linspace(0, 2 * math.pi, 9)[:-1]]
        polys.append((i, [[ring + ring[:1]]]))
    pts = [(i, rng.uniform(-5, 55), rng.uniform(-5, 55)) for i in range(800)]

    def inside(ring, x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    want = [(i, next((z for z, ((ring,),) in polys if inside(ring, x, y)), None)) for i, x, y in pts]
    points = spark.createDataFrame(pts, "pid int, x double, y double")
    out = point_in_zone(points, shapes(spark, polys), "x", "y", "geom", "id", ["id"], ["pid"], 2.0)
    assert rows(out, "pid", "id") == want


def test_points_only_match_their_own_group(spark):
    zones = shapes(spark, [(1, "a", [[box(0, 0, 9, 9)]]), (2, "b", [[box(0, 0, 9, 9)]])], "k string, ")
    points = spark.createDataFrame([(1, "b", 5.0, 5.0), (2, "c", 5.0, 5.0)],
                                   "pid int, k string, x double, y double")
    out = point_in_zone(points, zones, "x", "y", "geom", "id", ["id"], ["pid"], 4.0, by=["k"])
    assert rows(out, "pid", "id") == [(1, 2), (2, None)]


def test_dissolve_cancels_shared_edges(spark):
    df = shapes(spark, [(1, "a", [[box(0, 0, 1, 1)]]), (2, "a", [[box(1, 0, 2, 1)[::-1]]]),
                        (3, "b", [[box(5, 5, 6, 6)]]), (4, None, [[box(8, 8, 9, 9)]])], "k string, ")
    out = {r.k: r for r in D.dissolve(df, ["k"], "geom", 2154, 4.0).select(
        "k", G.area(F.col("geom")).alias("area"), F.size("geom.parts").alias("parts"),
        G.vertex_count(F.col("geom")).alias("n")).collect()}
    assert (out["a"].area, out["a"].parts, out["a"].n) == (2.0, 1, 7)
    assert out["b"].area == 1.0 and out[None].area == 1.0
    assert D.open_ends(D.outline(df, ["k"], "geom"), ["k"]).count() == 0


def test_dissolve_places_holes_islands_and_corner_contacts(spark):
    ring = [(x, y) for x in range(5) for y in range(5) if x in (0, 4) or y in (0, 4)]
    cells = [*ring, (2, 2), (6, 0), (7, 1)]   # a frame, an island in its hole, two corner neighbours
    df = shapes(spark, [(i, [[box(x, y, x + 1, y + 1)]]) for i, (x, y) in enumerate(cells)])
    shape = D.dissolve(df, [], "geom", 2154, 2.0)
    parts = shape.first().geom.parts
    assert sorted(len(p) for p in parts) == [1, 1, 1, 2]
    frame = next(p for p in parts if len(p) == 2)
    assert len(frame[0]) == 21 and len(frame[1]) == 13
    assert shape.select(G.area(F.col("geom"))).first()[0] == len(cells)


def test_unmatched_vertices_are_reported(spark):
    df = shapes(spark, [(1, [[box(0, 0, 2, 1)]]), (2, [[box(0, 1, 1, 2)]]), (3, [[box(0, 0, 2, 1)]])])
    border = D.outline(df, [], "geom")
    assert border.where("times > 1").count() > 0      # shape 1 is there twice


@pytest.mark.parametrize("name", ["simplify_checks", "simplify"])
def test_shapes_of_one_file_are_dealt_to_many_tasks(spark, tmp_path, name):
    """A small file of keys is one task to Spark; the shapes made of them are not."""
    spark.range(64).selectExpr("id as s_suppkey", "cast(id as string) as s_name", "0 as s_nationkey", "0D as s_acctbal").coalesce(
        1).write.parquet(f"{tmp_path}/supplier.parquet")
    tasks = QUERIES[name].run(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 64 and len(tasks) >= 8


@pytest.mark.parametrize("made", [_squares, _boxes])
def test_polygons_of_one_part_file_are_dealt_to_many_tasks(spark, tmp_path, made):
    spark.range(64).selectExpr("id as p_partkey", "'' as p_name", "'b' as p_brand", "'' as p_type", "1 as p_size",
                               "0D as p_retailprice").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    tasks = made(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 64 and len(tasks) >= 8


def test_area_of_a_union_is_not_asked_for_every_corner(spark, tmp_path):
    spark.range(200).selectExpr("id as p_partkey", "'' as p_name", "'b' as p_brand", "'' as p_type", "1 as p_size",
                                "0D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["dissolve_union"].run(spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    corners = next(i for i, line in enumerate(plan) if "Generate explode(" in line)
    # the shoelace sum stands below the step that makes rows of corners
    assert not any("aggregate(" in line for line in plan[:corners])
    assert any("aggregate(" in line for line in plan[corners:])


def test_tile_parts_deals_one_file_to_many_tasks(spark):
    # small shapes inside one tile of every zoom
    df = shapes(spark, [(i, [[box(2 + i / 1e4, 48, 2.001 + i / 1e4, 48.001)]]) for i in range(64)], srid=4326).coalesce(1)
    parts = tiles.tile_parts(df, "geom", 8, 9)
    assert parts.groupBy("z").count().count() == 2
    assert len(parts.inputFiles()) >= 8  # one task would write one file a zoom


def test_simplify_keeps_rings_closed(spark):
    rng = np.random.default_rng(1)
    a = np.linspace(0, 2 * math.pi, 200)[:-1]
    ring = np.c_[np.cos(a), np.sin(a)] * 10 + rng.normal(0, 0.01, (199, 2))
    ring = [tuple(v) for v in ring] + [tuple(ring[0])]
    df = shapes(spark, [(1, [[ring]]), (2, [[box(0, 0, 1e-9, 1e-9)]]), (3, None)])
    out = {r.id: r.geom for r in simplify(df, "geom", 0.1).collect()}
    kept = out[1].parts[0][0]
    assert 8 < len(kept) < 60 and kept[0] == kept[-1]
    assert abs(float(np.max(thin_ring(np.array(ring), 0.1)))) == 199
    assert len(out[2].parts[0][0]) == 5 or len(out[2].parts[0][0]) == 4
    assert out[3] is None


def test_geojson_round_trip(spark):
    df = shapes(spark, [(1, "é\"x", [[box(0, 0, 1.5, 1), box(.2, .2, .4, .4)]]),
                        (2, None, [[box(0, 0, 1, 1)], [box(3, 3, 4, 4)]])], "name string, ", 4326)
    text = df.select("id", "geom", X.feature_text(df, "geom", ["name"]).alias("f"))
    first, second = [json.loads(r.f) for r in text.orderBy("id").collect()]
    assert first["geometry"]["type"] == "Polygon" and first["properties"] == {"name": "é\"x"}
    assert second["geometry"]["type"] == "MultiPolygon" and second["properties"] == {"name": None}
    docs = text.groupBy().agg(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                                       F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("t"))
    back = X.explode_collections(docs, "t").select("geom")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select("geom").collect()))


def test_cadastre_statuses(spark, tmp_path):
    def write(dept, commune, ids):
        folder = tmp_path / dept / commune
        folder.mkdir(parents=True)
        feats = [{"type": "Feature", "properties": {"id": i},
                  "geometry": {"type": "Polygon", "coordinates": [box(0, 0, 1, 1)]}} for i in ids]
        with gzip.open(folder / f"cadastre-{commune}-parcelles.json.gz", "wt") as f:
            json.dump({"type": "FeatureCollection", "features": feats}, f)
    write("75", "75101", ["p1", "p2", "p3", "p1"])
    write("75", "75102", ["q1"])
    write("75", "75103", [])
    write("69", "69001", ["p1"])                     # no statistics in this department
    bad = tmp_path / "75" / "75104"
    bad.mkdir()
    (bad / "cadastre-75104-parcelles.json.gz").write_bytes(b"not gzip")
    other = tmp_path / "75" / "75105"
    other.mkdir()
    (other / "cadastre-75105-parcelles.json.gz").write_bytes(gzip.compress(b'{"a": 1}'))
    whole = gzip.compress(b'{"type": "FeatureCollection", "features": []}' * 50)
    for name, content in (("75106", whole[:40]), ("75107", whole[:-6] + b"000000"), ("75108", gzip.compress(b""))):  # cut, corrupt, empty
        (tmp_path / "75" / name).mkdir()
        (tmp_path / "75" / name / f"cadastre-{name}-parcelles.json.gz").write_bytes(content)
    stats = spark.createDataFrame([("p1", "75", 3), ("p2", "75", 1), ("q1", "99", 1), ("x", None, 1)],
                                  "id_parcelle_unique string, code_departement string, "
                                  "nb_transactions int")
    glob = f"{tmp_path}/*/*/cadastre-*-parcelles.json.gz"
    files, parcels = B.list_cadastre(spark, glob), B.scan_cadastre(spark, glob)
    joined = X.join_parcels(parcels, stats, "code_departement", "id_parcelle_unique")
    assert rows(joined, "code_commune_file", "id_parcelle_unique", "nb_transactions") == [
        ("75101", "p1", 3), ("75101", "p1", 3), ("75101", "p2", 1)]
    st = X.file_status(files, parcels, stats, "file", "code_departement",
                       "id_parcelle_unique", "readable")
    assert rows(st, "code_commune_file", "status", "n_parcels") == [
        ("69001", "no_transactions", 0), ("75101", "success", 3), ("75102", "no_transactions", 0),
        ("75103", "no_cadastre", 0), *[(f"7510{i}", "error", 0) for i in range(4, 9)]]
    assert rows(X.status_totals(st), "status", "n_files", "n_parcels") == [
        ("error", 5, 0), ("no_cadastre", 1, 0), ("no_transactions", 2, 0), ("success", 1, 3)]
    errors = {r.code_commune_file: r.error for r in parcels.where("error is not null").collect()}
    assert set(errors) == {f"7510{i}" for i in range(4, 9)} and errors["75105"] == "no feature collection"
    assert "EOFError" in errors["75106"] and "BadGzipFile" in errors["75107"] and errors["75108"] == "empty file"


@pytest.mark.parametrize("features, characters, documents", [(1000, 10 ** 6, 2), (7, 10 ** 6, 12), (1000, 200, None)])
def test_every_document_parses(spark, features, characters, documents):
    lines = spark.createDataFrame([("a" if i % 3 else "b", f'{{"id":{i}}}') for i in range(100)], "k string, value string")
    out = as_collections(lines, ["k"], features, characters).collect()
    found = [(r.k, f["id"]) for r in out for f in json.loads(r.value)["features"]]
    assert sorted(found) == sorted(("a" if i % 3 else "b", i) for i in range(100))
    assert len(out) > 2 if documents is None else 2 <= len(out) <= 3 * documents
    empty = as_collections(lines.where("false").drop("k"))
    assert [json.loads(r.value) for r in empty.collect()] == [{"type": "FeatureCollection", "features": []}]
    assert as_collections(lines.where("false"), ["k"]).count() == 0


def test_export_rules(spark):
    df = shapes(spark, [(1, 5, 1.005, [[box(0, 0, 1, 1)]]), (2, None, None, [[box(0, 0, 1, 1)]]),
                        (3, 7, 2.0, None)], "nb_transactions int, m double, ")
    assert rows(X.exportable(df, "geom"), "id", "nb_transactions") == [(1, 5)]
    kept = X.exportable(df, "geom", keep_empty=True)
    assert rows(kept, "id", "nb_transactions", "m") == [(1, 5, 1.0), (2, 0, None)]


def test_tiles_cover_boxes_and_drop_the_smallest(spark):
    df = spark.createDataFrame([(1, 5.0, (2.29, 48.85, 2.30, 48.86)), (2, 9.0, (2.29, 48.85, 2.29, 48.85)),
                                (3, 1.0, (-180.0, -90.0, 180.0, 90.0))],
                               "id int, area double, box struct<minx:double,miny:double,maxx:double,maxy:double>")
    t = tiles.tile_features(df, "box", 0, 1)
    assert rows(t.where("id = 1"), "z", "x", "y") == [(0, 0, 0), (1, 1, 0)]
    assert t.where("id = 3").count() == 5
    ranked = tiles.rank_in_tile(t, "area", ["id"])
    assert rows(ranked.where("z = 0"), "rank", "id") == [(1, 2), (2, 1), (3, 3)]
    assert rows(tiles.tile_features(df.where("id = 1"), "box", 14, 14).select("x", "y").limit(1)) \
        == [(8296, 5636)]


def test_tile_parts_make_up_the_shape(spark):
    a = np.linspace(0, 4 * math.pi, 160)
    spiral = [(float(2 + r * math.cos(t)), float(47 + r * math.sin(t))) for t, r in zip(a, np.linspace(.2, 1.5, 160))]
    spiral += [(float(2 + (r + .08) * math.cos(t)), float(47 + (r + .08) * math.sin(t))) for t, r in zip(a[::-1], np.linspace(1.5, .2, 160))]
    df = shapes(spark, [(1, [[box(1, 46, 3, 48), box(1.5, 46.5, 2.9, 47.9)], [box(4, 46, 4.1, 46.1)]]),
                        (2, [[[*spiral, spiral[0]]]]), (3, None), (4, [[box(0, 45, 45 / 64, 45.5)]])], srid=4326)
    parts = tiles.tile_parts(df, "geom", 7, 10).cache()
    whole = {r.id: r.a for r in df.where("geom is not null").select("id", G.area(F.col("geom")).alias("a")).collect()}
    for r in parts.groupBy("id", "z").agg(F.sum(G.area(F.col("geom"))).alias("a")).collect():
        assert r.a == pytest.approx(whole[r.id], rel=1e-9), (r.id, r.z)
    seen = {(r.id, r.z, r.x, r.y): r for r in parts.select("id", "z", "x", "y", G.bbox(F.col("geom")).alias("b"), tiles.tile_box(
        F.col("x"), F.col("y"), F.col("z")).alias("t")).collect()}
    assert len(seen) == parts.count() and {k[0] for k in seen} == {1, 2, 4}
    for r in seen.values():
        assert r.t.west <= r.b.minx <= r.b.maxx <= r.t.east and r.t.south - 1e-9 <= r.b.miny <= r.b.maxy <= r.t.north + 1e-9
    assert all((i, z - 1, x // 2, y // 2) in seen for i, z, x, y in seen if z > 7)
    boxed = tiles.tile_features(df.withColumn("box", G.bbox(F.col("geom"))), "box", 10, 10)
    assert sum(k[1] == 10 and k[0] == 2 for k in seen) < boxed.where("id = 2").count()  # inside of the spiral is empty
    assert max(k[2] for k in seen if k[0] == 4 and k[1] == 9) == 256  # a border on a tile's border enters no further tile


def write_geopackage(path, table, rows_):
    def wkb(parts):
        def poly(rings):
            out = struct.pack("<BII", 1, 3, len(rings))
            for ring in rings:
                out += struct.pack("<I", len(ring)) + b"".join(struct.pack("<dd", *v) for v in ring)
            return out
        return struct.pack("<BII", 1, 6, len(parts)) + b"".join(poly(p) for p in parts)
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom')", (table,))
    con.execute(f"CREATE TABLE {table} (fid INTEGER PRIMARY KEY, code_insee TEXT, "
                "nom_officiel TEXT, geom BLOB)")
    for code, name, parts in rows_:
        blob = None if parts is None else (
            b"GP\x00\x03" + struct.pack("<i", 2154) + struct.pack("<dddd", 0, 1, 0, 1) + wkb(parts))
        con.execute(f"INSERT INTO {table} (code_insee, nom_officiel, geom) VALUES (?, ?, ?)",
                    (code, name, blob))
    con.commit()
    con.close()


def test_geopackage_layer(spark, tmp_path):
    path = str(tmp_path / "layers.gpkg")
    write_geopackage(path, "region", [
        ("11", "Île", [[box(0, 0, 2, 2), box(1, 1, 1.5, 1.5)], [box(5, 5, 6, 6)]]), ("84", None, None)])
    out = B.scan_layer(spark, path, "region")
    assert rows(out, "code_region", "nom_region_geo", G.area(F.col("geom")).alias("a")) == [
        ("11", "Île", 4.75), ("84", None, None)]
    assert out.first().geom.srid == 2154
    assert B.scan_layer(spark, path, "arrondissement_municipal").count() == 2   # the only layer


def test_layers_from_feature_lines_and_parquet(spark, tmp_path):
    feats = [{"type": "Feature", "properties": {"code_insee": c, "nom_officiel": c.lower()},
              "geometry": {"type": "Polygon", "coordinates": [box(0, 0, 1, 1)]}} for c in ("75101", "A")]
    text = ('{\n"type": "FeatureCollection",\n"features": [\n'
            + ",\n".join(json.dumps(f) for f in feats) + "\n]\n}\n")
    (tmp_path / "arr.geojson").write_text(text)
    arr = B.scan_layer(spark, str(tmp_path / "arr.geojson"), "arrondissement_municipal")
    assert rows(arr, "code_commune", "nom_commune_geo") == [("75101", "75101"), ("A", "a")]
    communes = spark.createDataFrame([("75056", "Paris"), (None, "?"), ("01001", "x")],
                                     "code_commune string, nom_commune_geo string").withColumns(
        {"code_departement": F.lit("d"), "geom": F.lit(None).cast(G.GEOMETRY)})
    both = B.communes_with_districts(communes, arr)
    assert rows(both, "code_commune", "code_departement") == [
        ("01001", "d"), ("75101", "75"), ("A", "A"), (None, "d")]


def test_features_of_any_layout(spark, tmp_path):
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}
    feats = [{"properties": {"id": str(i)}, "geometry": shape, "type": "Feature"} for i in range(3)]
    whole = {"features": feats, "type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}}
    texts = {"one_line": json.dumps(whole), "pretty": json.dumps(whole, indent=1), "lines": "\n".join(map(json.dumps, feats)),
             "single": json.dumps(feats[0], indent=2), "broken": json.dumps(whole)[:150],
             "cut": "\n".join(map(json.dumps, feats))[:-20], "prose": "no\njson", "empty": json.dumps({**whole, "features": []}),
             "wrapped": '{"type":"FeatureCollection","name":"a","features":[\n' + ",\n".join(map(json.dumps, feats)) + "\n]}"}
    for name, text in texts.items():
        (tmp_path / f"{name}.geojson").write_text(text)
    found = B.scan_features(spark, str(tmp_path)).select(
        F.regexp_extract("file", r"(\w+)\.geojson", 1).alias("name"), F.col("properties")["id"].alias("id"),
        F.col("geom").isNotNull().alias("shape"), F.col("error").isNotNull().alias("bad")).collect()
    by_name = {n: sorted((r.id or "", r.shape, r.bad) for r in found if r.name == n) for n in texts}
    good, failed = [(str(i), True, False) for i in range(3)], ("", False, True)
    assert by_name["one_line"] == by_name["pretty"] == by_name["lines"] == by_name["wrapped"] == good
    assert by_name["single"] == good[:1] and by_name["empty"] == []
    assert by_name["broken"] == [failed] and by_name["prose"] == [failed]
    assert by_name["cut"] == [failed, *good[:2]]
    with pytest.raises(Exception, match="not a GeoJSON"):
        B.scan_layer(spark, str(tmp_path / "broken.geojson"), "region").collect()
