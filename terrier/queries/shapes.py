"""Geometry, export, parcel and tile queries on shapes derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions import geometry as G
from terrier.functions import projection as P
from terrier.functions.columns import round_half_even
from terrier.operators import dissolve as D
from terrier.operators import features as X
from terrier.operators import lookups, tiles
from terrier.operators.simplify import simplify
from terrier.operators.skew import dealt_out
from terrier.operators.spatial import point_in_zone, project_points
from terrier.queries.tables import TRANSACTIONS, Query, coarse, coarse_sql, table, transactions
from terrier.session import scratch_file
from terrier.sinks import collection_text, save_geojson, save_parcels
from terrier.sources import boundaries as B

# Outline of a supplier's zone, from the corner of its 10 x 10 square. It reaches
# into the square above, and every third zone has a hole.
SHELL = ((0, 0), (9, 1), (10, 8), (5, 13), (1, 9))
HOLE = ((3, 3), (6, 3), (6, 6), (3, 6))
# A customer's lot, in thousandths of a degree around its point.
LOT = ((0, 0), (8, 1), (9, 7), (3, 9))


def _ring(points: tuple, x: Column, y: Column, scale: float = 1.0) -> Column:
    closed = [*points, points[0]]
    return F.array(*[G.vertex(x + F.lit(px * scale), y + F.lit(py * scale)) for px, py in closed])


def _edges_sql(points: tuple, scale: float = 1.0) -> str:
    closed = [*points, points[0]]
    return ", ".join(f"({ax * scale}::DOUBLE, {ay * scale}::DOUBLE, {bx * scale}::DOUBLE, "
                     f"{by * scale}::DOUBLE)"
                     for (ax, ay), (bx, by) in zip(closed, closed[1:]))


# --- points in zones ------------------------------------------------------------------------

def _zones(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = (k % 40 * 10).cast("double"), (F.floor(k / 40) * 10).cast("double")
    shell, hole = _ring(SHELL, x, y), _ring(HOLE, x, y)
    rings = F.when(k % 3 == 0, F.array(shell, hole)).otherwise(F.array(shell))
    return table(spark, folder, "supplier").select(
        k.alias("zone"), F.col("s_name").alias("zone_name"),
        G.polygon(rings, G.LAMBERT93).alias("geom"))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    # quarter steps put many points exactly on edges and corners
    return table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") * 37 % 1600 / F.lit(4.0)).alias("x"),
        (F.col("o_custkey") * 11 % 1000 / F.lit(4.0)).alias("y"))


ZONES_SQL = f"""
shell AS (SELECT * FROM (VALUES {_edges_sql(SHELL)}) AS t(ax, ay, bx, bv)),
hole AS (SELECT * FROM (VALUES {_edges_sql(HOLE)}) AS t(ax, ay, bx, bv)),
base AS (SELECT s_suppkey AS zone, s_name AS zone_name, (s_suppkey % 40 * 10)::DOUBLE AS x0,
                (s_suppkey // 40 * 10)::DOUBLE AS y0 FROM supplier),
edge AS (SELECT zone, zone_name, x0 + ax AS ax, y0 + ay AS ay, x0 + bx AS bx, y0 + bv AS bv
         FROM base CROSS JOIN shell
         UNION ALL SELECT zone, zone_name, x0 + ax, y0 + ay, x0 + bx, y0 + bv
         FROM base CROSS JOIN hole WHERE zone % 3 = 0),
pt AS (SELECT o_orderkey, (o_orderkey * 37 % 1600) / 4.0::DOUBLE AS x,
              (o_custkey * 11 % 1000) / 4.0::DOUBLE AS y FROM orders),
hit AS (SELECT o_orderkey, zone, zone_name,
               sum(CASE WHEN (ay > y) <> (bv > y) AND x < (bx - ax) * (y - ay) / (bv - ay) + ax
                        THEN 1 ELSE 0 END) % 2 = 1 AS odd,
               bool_or((bx - ax) * (y - ay) - (bv - ay) * (x - ax) = 0
                       AND x BETWEEN least(ax, bx) AND greatest(ax, bx)
                       AND y BETWEEN least(ay, bv) AND greatest(ay, bv)) AS edge
        FROM pt CROSS JOIN edge GROUP BY ALL),
first AS (SELECT o_orderkey, min(zone) AS zone, arg_min(zone_name, zone) AS zone_name FROM hit
          WHERE odd AND NOT edge GROUP BY o_orderkey),
placed AS (SELECT o_orderkey, x, y, zone, zone_name FROM pt LEFT JOIN first USING (o_orderkey))
"""


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    return point_in_zone(_points(spark, folder), _zones(spark, folder), "x", "y", "geom", "zone",
                         ["zone", "zone_name"], ["o_orderkey"], size=5.0)


def _zone_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder).groupBy("zone").agg(F.count(F.lit(1)).alias("n_points"))


# --- projection -----------------------------------------------------------------------------

def _lonlat(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", (F.lit(-4.5) + k * 17 % 1301 / F.lit(100.0)).alias("longitude"),
        (F.lit(41.5) + k * 29 % 951 / F.lit(100.0)).alias("latitude"))


LONLAT_SQL = f"""
ll AS (SELECT c_custkey, -4.5::DOUBLE + (c_custkey * 17 % 1301) / 100.0::DOUBLE AS longitude,
              41.5::DOUBLE + (c_custkey * 29 % 951) / 100.0::DOUBLE AS latitude FROM customer),
a AS (SELECT *, sin(radians(latitude)) * {P.ECC!r} AS s FROM ll),
b AS (SELECT *, {P.SCALE!r} * pow(tan(pi() / 4 - radians(latitude) / 2)
                / pow((1 - s) / (1 + s), {P.ECC / 2!r}), {P.CONE!r}) AS rho,
             radians(longitude - 3) * {P.CONE!r} AS theta FROM a),
m AS (SELECT c_custkey, longitude, latitude, rho * sin(theta) + 700000 AS x,
             6600000 + {P.RHO_0!r} - rho * cos(theta) AS y FROM b)
"""


def _project(spark: SparkSession, folder: str) -> DataFrame:
    p = project_points(_lonlat(spark, folder))
    return p.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _project_back(spark: SparkSession, folder: str) -> DataFrame:
    p = project_points(_lonlat(spark, folder))
    lon, lat = P.from_lambert(F.col("x"), F.col("y"))
    return p.select("c_custkey", F.round(lon, 7).alias("longitude"),
                    F.round(lat, 7).alias("latitude"))


# --- shapes ---------------------------------------------------------------------------------

def _squares(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k % 50).cast("double"), F.floor(k / 50).cast("double")
    return dealt_out(table(spark, folder, "part").select("p_partkey", "p_brand")).select(
        "p_partkey", "p_brand",
        G.polygon(F.array(G.box_ring(x, y, x + 1, y + 1)), G.LAMBERT93).alias("geom"))


def _cells_sql(by: str) -> str:
    return f"""
sq AS (SELECT {by} AS k, p_partkey % 50 AS x, p_partkey // 50 AS y FROM part),
e AS (SELECT k, x, y, 0 AS d FROM sq UNION ALL SELECT k, x, y + 1, 0 FROM sq
      UNION ALL SELECT k, x, y, 1 FROM sq UNION ALL SELECT k, x + 1, y, 1 FROM sq),
rim AS (SELECT k, x, y, d FROM e GROUP BY ALL HAVING count(*) = 1)
"""


def _dissolve_edges(spark: SparkSession, folder: str) -> DataFrame:
    rim = D.outline(_squares(spark, folder), ["p_brand"], "geom")
    return rim.select("p_brand", F.least("ax", "bx").cast("long").alias("x"),
                      F.least("ay", "by").cast("long").alias("y"),
                      F.when(F.col("ay") == F.col("by"), 0).otherwise(1).alias("d"))


def _dissolve_shapes(spark: SparkSession, folder: str) -> DataFrame:
    shapes = D.dissolve(_squares(spark, folder), ["p_brand"], "geom", G.LAMBERT93, 4.0)
    return shapes.select("p_brand", G.area(F.col("geom")).alias("area"),
                         F.aggregate(G.rings(F.col("geom")), F.lit(0),
                                     lambda n, r: n + F.size(r) - 1).alias("n_edges"))


def _dissolve_country(spark: SparkSession, folder: str) -> DataFrame:
    country = D.dissolve(_squares(spark, folder), [], "geom", G.LAMBERT93, 16.0)
    stats = table(spark, folder, "part").agg(F.count(F.lit(1)).alias("n_parts"))
    joined = lookups.with_constants(country, stats)
    return joined.select("n_parts", G.area(F.col("geom")).alias("area"),
                         (G.vertex_count(F.col("geom")) - F.size(G.rings(F.col("geom"))))
                         .alias("n_edges"))


def _boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of a few units that overlap, hold one another and meet without shared vertices."""
    k = F.col("p_partkey")
    x, y = (k * 13 % 17).cast("double"), F.floor(k / 150).cast("double")
    return dealt_out(table(spark, folder, "part").select("p_partkey", "p_brand")).select("p_brand", G.polygon(F.array(
        G.box_ring(x, y, x + 1 + k % 3, y + 1 + k % 2)), G.LAMBERT93).alias("geom"))


def _dissolve_union(spark: SparkSession, folder: str) -> DataFrame:
    """The corners of each brand's union, how often its rings turn there, and its area."""
    shapes = D.dissolve(_boxes(spark, folder), ["p_brand"], "geom", G.LAMBERT93, 4.0)
    turns = F.flatten(F.transform(G.rings(F.col("geom")), G.corners))
    # the area is asked of each shape before its corners become rows, or every corner would add it up again
    sized = shapes.select("p_brand", G.area(F.col("geom")).alias("area"), turns.alias("turns"))
    return sized.select("p_brand", "area", F.explode("turns").alias("v")).groupBy(
        "p_brand", "area", F.col("v.x").cast("long").alias("x"), F.col("v.y").cast("long").alias("y")).agg(
        F.count(F.lit(1)).alias("turns"))


def _lots(spark: SparkSession, folder: str) -> DataFrame:
    p = _lonlat(spark, folder).join(table(spark, folder, "customer"), "c_custkey")
    ring = _ring(LOT, F.col("longitude"), F.col("latitude"), 0.001)
    return p.select("c_custkey", "c_nationkey", "c_name", "c_mktsegment",
                    G.polygon(F.array(ring), G.WGS84).alias("geom"))


LOTS_SQL = f"""
{LONLAT_SQL},
lot AS (SELECT * FROM (VALUES {_edges_sql(LOT, 0.001)}) AS t(ax, ay, bx, bv)),
lots AS (SELECT c_custkey, sum((longitude + ax) * (latitude + bv)
                               - (longitude + bx) * (latitude + ay)) / 2 AS area,
                count(*) + 1 AS n_vertices, min(longitude + ax) AS minx, max(longitude + ax) AS maxx,
                min(latitude + ay) AS miny, max(latitude + ay) AS maxy
         FROM ll CROSS JOIN lot GROUP BY c_custkey)
"""


def _polygon_area(spark: SparkSession, folder: str) -> DataFrame:
    z = _zones(spark, folder)
    box = G.bbox(F.col("geom"))
    return z.select("zone", G.area(F.col("geom")).alias("area"),
                    G.vertex_count(F.col("geom")).alias("n_vertices"),
                    box["minx"].alias("minx"), box["miny"].alias("miny"),
                    box["maxx"].alias("maxx"), box["maxy"].alias("maxy"))


def _jagged(k: Column, radius: float, count: int, waves: int) -> Column:
    """A closed ring around (k, k) that wavers by 0.05."""
    turn = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.radians(i * F.lit(360.0 / count)))
    rim = F.transform(turn, lambda a: F.struct(
        (k + F.cos(a) * (F.lit(radius) + F.sin(a * waves + k) * 0.05)).alias("x"),
        (k + F.sin(a) * (F.lit(radius) + F.sin(a * waves + k) * 0.05)).alias("y")))
    return F.concat(rim, F.slice(rim, 1, 1))


def _simplify(spark: SparkSession, folder: str) -> DataFrame:
    # a jagged rim of 60 vertices around each supplier's point
    k = F.col("s_suppkey")
    shapes = dealt_out(table(spark, folder, "supplier").select("s_suppkey")).select(
        k.alias("zone"), G.polygon(F.array(_jagged(k, 3.0, 60, 7)), G.WGS84).alias("geom"))
    return simplify(shapes, "geom", 0.1).select(
        "zone", G.vertex_count(F.col("geom")).alias("n_vertices"),
        F.round(G.area(F.col("geom")), 6).alias("area"))


def _simplify_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What simplification promises, of shapes with a hole and an island close to their rim."""
    k, tolerance = F.col("s_suppkey"), 0.2
    rings = F.array(_jagged(k, 3.0, 90, 11), _jagged(k, 2.88, 80, 7))
    given = dealt_out(table(spark, folder, "supplier").select("s_suppkey")).select(k.alias("zone"), F.struct(
        F.lit(G.WGS84).alias("srid"), F.array(rings, F.array(_jagged(k, 2.76, 70, 9))).alias("parts")).alias("geom"))
    both = simplify(given.withColumn("before", F.col("geom")), "geom", tolerance)
    pairs = both.select("zone", "geom", F.arrays_zip(
        G.rings(F.col("before")).alias("old"), G.rings(F.col("geom")).alias("new")).alias("rings"))

    def places(r: Column) -> Column:
        """Where the vertices left stood, with the end of the closed ring last."""
        kept = F.slice(r["new"], F.lit(1), F.size(r["new"]) - 1)
        return F.concat(F.transform(kept, lambda v: F.array_position(r["old"], v).cast("int")), F.array(F.size(r["old"])))

    def close(r: Column) -> Column:
        """Whether every old vertex lies near the segment that runs past it."""
        def near(p: Column, i: Column) -> Column:
            a, b = F.get(r["old"], p - 1), F.get(r["old"], F.get(r["places"], i + 1) - 1)
            dx, dy = b["x"] - a["x"], b["y"] - a["y"]

            def off(v: Column) -> Column:
                t = F.least(F.greatest(((v["x"] - a["x"]) * dx + (v["y"] - a["y"]) * dy) / (dx * dx + dy * dy), F.lit(0.0)), F.lit(1.0))
                return F.hypot(v["x"] - a["x"] - t * dx, v["y"] - a["y"] - t * dy) > tolerance + 1e-9
            between = F.slice(r["old"], p, F.greatest(F.get(r["places"], i + 1) - p, F.lit(1)))
            return F.when(i + 1 < F.size(r["places"]), F.exists(between, off)).otherwise(F.lit(False))
        return ~F.exists(F.transform(r["places"], near), lambda far: far)

    def turn(a: Column, b: Column, c: Column, d: Column, x: Column, y: Column) -> Column:
        return F.signum((c - a) * (y - b) - (d - b) * (x - a))

    def cross(e: Column, f: Column) -> Column:
        one = turn(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]) * turn(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
        two = turn(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]) * turn(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
        return (one < 0) & (two < 0)

    def inside(inner: Column, outer: Column) -> Column:
        es = G.ring_edges(outer)
        return F.forall(inner, lambda v: F.pmod(G.crossings(es, v["x"], v["y"]), F.lit(2)) == 1)
    located = pairs.select("zone", "geom", F.transform("rings", lambda r: r.withField("places", places(r))).alias("rings"))
    es = G.edges(F.col("geom"))
    shell, hole, island = (F.get(G.rings(F.col("geom")), F.lit(i)) for i in range(3))
    return located.select(
        "zone", F.forall("rings", lambda r: r["places"] == F.array_sort(r["places"])).alias("in_order"),
        F.forall("rings", close).alias("within_tolerance"),
        (~F.exists(es, lambda e: F.exists(es, lambda f: cross(e, f)))).alias("no_crossing"),
        (inside(hole, shell) & inside(island, hole)).alias("nested"),
        F.forall("rings", lambda r: (F.size(r["new"]) < F.size(r["old"])) & (F.size(r["new"]) > 3)).alias("fewer"))


# --- tiles ----------------------------------------------------------------------------------

def _tiles(spark: SparkSession, folder: str) -> DataFrame:
    lots = _lots(spark, folder).select(
        "c_custkey", G.bbox(F.col("geom")).alias("box"), G.area(F.col("geom")).alias("area"))
    layer = tiles.LAYERS["communes"]
    return tiles.tile_features(lots, "box", layer.min_zoom, layer.max_zoom)


def _tile_assign(spark: SparkSession, folder: str) -> DataFrame:
    return _tiles(spark, folder).select("c_custkey", "z", "x", "y")


def _tile_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Corner-shaped lots by the tiles they meet, with the size of their part there."""
    x, y = F.col("longitude"), F.col("latitude")
    corner = ((0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (0, 6))
    shapes = _lonlat(spark, folder).select("c_custkey", G.polygon(F.array(_ring(corner, x, y, 0.1)), G.WGS84).alias("geom"))
    return tiles.tile_parts(shapes, "geom", 8, 10).select("c_custkey", "z", "x", "y", F.round(G.area(F.col("geom")), 8).alias("area"))


def _tile_cap(spark: SparkSession, folder: str) -> DataFrame:
    sized = _tiles(spark, folder).withColumn("balance", F.col("c_custkey") % 97)
    ranked = tiles.rank_in_tile(sized, "balance", ["c_custkey"])
    return ranked.where("rank <= 2").select("c_custkey", "z", "x", "y")


TILES_SQL = f"""
WITH {LOTS_SQL},
zz AS (SELECT *, unnest(range(9, 15)) AS z FROM lots),
n AS (SELECT *, pow(2.0, z) AS n FROM zz),
r AS (SELECT c_custkey, CAST(z AS INTEGER) AS z,
      CAST(floor((minx + 180.0) / 360.0 * n) AS BIGINT) AS x1,
      CAST(floor((maxx + 180.0) / 360.0 * n) AS BIGINT) AS x2,
      CAST(floor((1.0 - ln(tan(radians(maxy)) + 1.0 / cos(radians(maxy))) / pi()) / 2.0 * n) AS BIGINT) AS y1,
      CAST(floor((1.0 - ln(tan(radians(miny)) + 1.0 / cos(radians(miny))) / pi()) / 2.0 * n) AS BIGINT) AS y2
      FROM n),
xs AS (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM r),
ts AS (SELECT c_custkey, z, x, unnest(range(y1, y2 + 1)) AS y FROM xs)
"""


# --- GeoJSON, export and parcels ------------------------------------------------------------

def _documents(spark: SparkSession, folder: str) -> DataFrame:
    """GeoJSON documents of at most 50 lots each."""
    lots = _lots(spark, folder).withColumn("id", F.col("c_name"))
    one = lots.select(F.floor(F.col("c_custkey") / 50).alias("doc"),
                      X.feature_text(lots, "geom", ["id", "c_mktsegment"]).alias("f"))
    return one.groupBy("doc").agg(F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("text"))


def _geojson(spark: SparkSession, folder: str) -> DataFrame:
    return coarse(X.explode_collections(_documents(spark, folder), "text").select(
        "doc", "id", F.col("properties")["c_mktsegment"].alias("segment"),
        G.vertex_count(F.col("geom")).alias("n_vertices"),
        G.bbox(F.col("geom"))["maxx"].alias("maxx"), G.bbox(F.col("geom"))["miny"].alias("miny")),
        "maxx", "miny")


def _scan_geojson(spark: SparkSession, folder: str) -> DataFrame:
    """The lots as files of three layouts, some cut short, read back by the layer source."""
    lots = _lots(spark, folder).withColumn("id", F.col("c_name"))
    text = X.feature_text(lots, "geom", ["id", "c_mktsegment"])
    turned = F.concat(F.lit("{"), F.substr(text, F.lit(len('{"type":"Feature",') + 1),
                                           F.length(text) - len('{"type":"Feature",') - 1), F.lit(',"type":"Feature"}'))
    doc = F.floor(F.col("c_custkey") / 50)
    layout = F.col("doc") % 3
    joined = F.concat(F.lit('{"features":['), F.array_join("f", ","), F.lit('],"type":"FeatureCollection"}'))
    written = (F.when(layout == 0, joined).when(layout == 1, F.regexp_replace(joined, r"([,{\[])", "$1\n"))
               .otherwise(F.array_join("f", "\n")))
    short = (F.col("doc") % 7 == 3) & (layout < 2)
    files = (lots.select(doc.alias("doc"), F.when(doc % 3 == 2, turned).otherwise(text).alias("f"))
             .groupBy("doc").agg(F.collect_list("f").alias("f"))
             .select("doc", F.when(short, F.substr(written, F.lit(1), (F.length(written) / 2).cast("int")))
                     .otherwise(written).alias("value")))
    path = scratch_file(spark)
    files.write.partitionBy("doc").text(path)
    return B.scan_features(spark, path).select(
        F.regexp_extract("file", r"doc=(\d+)", 1).cast("long").alias("doc"), F.col("properties")["id"].alias("id"),
        F.col("properties")["c_mktsegment"].alias("segment"), G.vertex_count(F.col("geom")).alias("n_vertices"),
        F.col("error").isNotNull().alias("unreadable"))


def _sale_stats(spark: SparkSession, folder: str) -> DataFrame:
    # the sales of some customers name none
    named = F.when(F.col("o_custkey") % 4 > 0, F.col("o_custkey"))
    return (transactions(spark, folder).groupBy(named.alias("c_custkey"))
            .agg(F.count(F.lit(1)).alias("nb_transactions"), F.max("price").alias("top_price")))


SALES_SQL = """
st AS (SELECT CASE WHEN o_custkey % 4 > 0 THEN o_custkey END AS c_custkey, count(*) AS nb_transactions, max(price) AS top_price
       FROM tx GROUP BY ALL)
"""


def _export(keep_empty: bool) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        # segment MACHINERY stands for shapes that have no geometry
        lots = _lots(spark, folder).withColumn(
            "geom", F.when(F.col("c_mktsegment") != "MACHINERY", F.col("geom")))
        joined = lookups.join_stats(lots, _sale_stats(spark, folder), "c_custkey")
        return X.exportable(joined, "geom", keep_empty=keep_empty).select(
            "c_custkey", "nb_transactions", "top_price",
            G.geometry_type(F.col("geom")).alias("kind"))
    count = "coalesce(nb_transactions, 0) AS nb_transactions" if keep_empty else "nb_transactions"
    where = "" if keep_empty else "AND nb_transactions IS NOT NULL"
    return Query(run, f"""
WITH {TRANSACTIONS}, {SALES_SQL}
SELECT c_custkey, {count}, round_even(top_price * 100, 0) / 100 AS top_price, 'Polygon' AS kind
FROM customer LEFT JOIN st USING (c_custkey) WHERE c_mktsegment <> 'MACHINERY' {where}""")


def _left_join(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").withColumnRenamed("n_nationkey", "department")
    stats = transactions(spark, folder).withColumn(
        "department", F.when(F.col("department") % 4 > 0, F.col("department"))).groupBy(
        "department", "commune_name").agg(F.count(F.lit(1)).alias("nb_transactions"))
    return lookups.join_stats(nation, stats.withColumn("n_name", F.lit("stale")), "department",
                              drop=["n_name", "no_such_column"])


def _names(spark: SparkSession, folder: str) -> DataFrame:
    areas = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("string").alias("code"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("layer_name"), "c_name")
    names = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("code"), F.col("s_name").alias("ref_name"))
    return lookups.name_areas(areas, names, "code", ["ref_name", "layer_name", "c_name"],
                              "name").select("code", "name")


def _union_replace(spark: SparkSession, folder: str) -> DataFrame:
    areas = table(spark, folder, "nation").select(
        F.nullif("n_name", F.lit("NATION_7")).alias("code"),
        F.col("n_regionkey").cast("string").alias("department"))
    parts = table(spark, folder, "supplier").select(F.col("s_name").alias("code"))
    return lookups.replace_parents(areas, parts, "code", ["NATION_1", "NATION_2", "NATION_3"],
                                   {"department": 2})


def _cadastre(spark: SparkSession, folder: str) -> DataFrame:
    """Each lot is a parcel in the file of its nation and segment."""
    return _lots(spark, folder).select(
        F.concat(F.lit("P"), "c_custkey").alias("parcel"),
        F.col("c_nationkey").alias("department"),
        F.concat("c_nationkey", F.lit("-"), "c_mktsegment").alias("file"), "geom")


def _parcel_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics by parcel; some name no department, or one that is not the file's."""
    sales = transactions(spark, folder)
    odd = (F.when(F.col("o_custkey") % 10 == 0, F.lit(99)).when(
        (F.col("o_custkey") % 11 == 0) | (F.col("department") == 5), F.lit(None)).otherwise(F.col("department")))
    return sales.groupBy(F.concat(F.lit("P"), "o_custkey").alias("parcel"),
                         odd.alias("department")).agg(
        F.count(F.lit(1)).alias("nb_transactions"), F.max("price").alias("top_price"))


PARCELS_SQL = """
ps AS (SELECT 'P' || o_custkey AS parcel, CASE WHEN o_custkey % 10 = 0 THEN 99
              WHEN o_custkey % 11 = 0 OR department = 5 THEN NULL ELSE department END AS department,
              count(*) AS nb_transactions, max(price) AS top_price
       FROM tx GROUP BY ALL),
cad AS (SELECT 'P' || c_custkey AS parcel, c_nationkey AS department,
               c_nationkey || '-' || c_mktsegment AS file FROM customer)
"""


def _parcel_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = X.join_parcels(_cadastre(spark, folder), _parcel_stats(spark, folder),
                            "department", "parcel")
    return joined.select("parcel", "department", "file", "nb_transactions",
                         round_half_even("top_price").alias("top_price"))


def _statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Files of HOUSEHOLD cannot be read, those of BUILDING are empty."""
    lots = _cadastre(spark, folder)
    unread, empty = (F.col("file").endswith(s) for s in ("HOUSEHOLD", "BUILDING"))
    parcels = lots.where(~unread).withColumns({
        "readable": F.lit(True), "parcel": F.when(~empty, F.col("parcel"))})
    return X.status_totals(X.file_status(
        lots.select("file", "department").distinct(), parcels, _parcel_stats(spark, folder),
        "file", "department", "parcel", "readable"))


def _read_documents(spark: SparkSession, path: str, *keys: Column) -> DataFrame:
    """Files as single documents: how many there are, and the features and customers in them."""
    doc = F.from_json("value", X.COLLECTION)
    texts = spark.read.text(path, wholetext=True).select(*keys, doc.alias("d"))
    ids = F.transform(F.col("d.features"), lambda f: f["properties"]["c_custkey"].cast("long"))
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda a, x: a + x)
    return texts.groupBy(*texts.columns[:-1]).agg(
        F.bool_and(F.col("d.type") == "FeatureCollection").alias("valid"), F.sum(F.size(ids)).alias("n_features"),
        F.sum(total).alias("keys"))


def _saved_parcels(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of every commune is one document, and together they hold its lots."""
    path = scratch_file(spark)
    save_parcels(_lots(spark, folder).withColumn("commune", F.concat("c_nationkey", F.lit("-"), "c_mktsegment")), path, "commune")
    commune = F.regexp_extract(F.col("_metadata.file_path"), r"commune=([^/]+)/", 1).alias("commune")
    return _read_documents(spark, path, commune)


def _saved_layer(spark: SparkSession, folder: str) -> DataFrame:
    """A layer saved with its empty shapes, and without."""
    lots = _lots(spark, folder).withColumn("nb_transactions", F.nullif(F.col("c_custkey") % 5, F.lit(0)))

    def saved(name: str) -> DataFrame:
        path = scratch_file(spark)
        save_geojson(lots, path, tolerance=None, keep_empty=name == "all")
        return _read_documents(spark, path).withColumn("kept", F.lit(name))
    return saved("all").unionByName(saved("some"))


def _scan_cadastre(spark: SparkSession, folder: str) -> DataFrame:
    """Lots as compressed cadastre files, some cut short, some empty, read back with their outcome."""
    lots = _lots(spark, folder).withColumn("id", F.concat(F.lit("P"), "c_custkey"))
    texts = lots.select(F.floor(F.col("c_custkey") / 20).alias("doc"), X.feature_text(lots, "geom", ["id"]).alias("f")).groupBy(
        "doc").agg(collection_text(F.collect_list("f")).alias("value"))
    odd = F.col("doc") % 7
    written = (F.when(odd == 3, F.substr("value", F.lit(1), (F.length("value") / 2).cast("int")))
               .when(odd == 4, F.lit('{"type":"FeatureCollection","features":[]}')).when(odd == 5, F.lit('{"a":1}')).otherwise(F.col("value")))
    path = scratch_file(spark)
    texts.select("doc", written.alias("value")).write.partitionBy("doc").option("compression", "gzip").text(path)
    found = B.scan_cadastre(spark, f"{path}/*/*.gz")
    return found.select(F.regexp_extract("file", r"doc=(\d+)", 1).cast("long").alias("doc"), "id_parcelle_unique", "readable",
                        F.col("error").isNotNull().alias("failed"), G.vertex_count(F.col("geom")).alias("n_vertices"))


QUERIES: dict[str, Query] = {
    "point_in_zone": Query(_placed, f"WITH {ZONES_SQL} SELECT * FROM placed"),
    "zone_counts": Query(_zone_counts, f"WITH {ZONES_SQL} SELECT zone, count(*) AS n_points "
                                       "FROM placed GROUP BY zone"),
    "project_points": Query(_project, f"WITH {LONLAT_SQL} SELECT c_custkey, round(x, 3) AS x, "
                                      "round(y, 3) AS y FROM m"),
    "project_inverse": Query(_project_back, f"WITH {LONLAT_SQL} SELECT c_custkey, "
                             "round(longitude, 7) AS longitude, round(latitude, 7) AS latitude FROM m"),
    "dissolve_edges": Query(_dissolve_edges, f"WITH {_cells_sql('p_brand')} SELECT k AS p_brand, "
                            "x, y, d FROM rim"),
    "dissolve_shapes": Query(_dissolve_shapes, f"""
WITH {_cells_sql('p_brand')}
SELECT k AS p_brand, CAST(n AS DOUBLE) AS area, CAST(n_edges AS INTEGER) AS n_edges
FROM (SELECT k, count(*) AS n FROM sq GROUP BY k)
JOIN (SELECT k, count(*) AS n_edges FROM rim GROUP BY k) USING (k)"""),
    "dissolve_country": Query(_dissolve_country, f"""
WITH {_cells_sql("0")}
SELECT (SELECT count(*) FROM part) AS n_parts, (SELECT count(*)::DOUBLE FROM sq) AS area,
       (SELECT count(*)::INTEGER FROM rim) AS n_edges"""),
    "polygon_area": Query(_polygon_area, f"""
WITH {ZONES_SQL}
SELECT zone, (SELECT abs(sum(ax * bv - bx * ay)) / 2 FROM shell)
       - CASE WHEN zone % 3 = 0 THEN 9 ELSE 0 END AS area,
       CASE WHEN zone % 3 = 0 THEN 11 ELSE 6 END::INTEGER AS n_vertices,
       min(ax) AS minx, min(ay) AS miny, max(ax) AS maxx, max(ay) AS maxy FROM edge GROUP BY zone"""),
    "dissolve_union": Query(_dissolve_union, """
WITH boxes AS (SELECT p_brand, p_partkey * 13 % 17 AS x, p_partkey // 150 AS y, 1 + p_partkey % 3 AS w,
                      1 + p_partkey % 2 AS h FROM part),
wide AS (SELECT p_brand, unnest(range(x, x + w)) AS x, y, h FROM boxes),
cells AS (SELECT DISTINCT p_brand, x, unnest(range(y, y + h)) AS y FROM wide),
-- which of the four cells around a point are covered: a corner has one, three, or two that face each other
around AS (SELECT p_brand, x + dx AS x, y + dy AS y, dx, dy
           FROM cells CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS d(dx, dy)),
points AS (SELECT p_brand, x, y, count(*) AS n, count(*) FILTER (dx = dy) AS straight FROM around GROUP BY ALL)
SELECT p_brand, area, x, y, CASE n WHEN 2 THEN 2 ELSE 1 END::BIGINT AS turns FROM points
JOIN (SELECT p_brand, count(*)::DOUBLE AS area FROM cells GROUP BY p_brand) USING (p_brand)
WHERE n IN (1, 3) OR n = 2 AND straight IN (0, 2)"""),
    "simplify": Query(_simplify),
    "simplify_checks": Query(_simplify_checks, """
SELECT s_suppkey AS zone, true AS in_order, true AS within_tolerance, true AS no_crossing, true AS nested,
       true AS fewer FROM supplier"""),
    "tile_assign": Query(_tile_assign, TILES_SQL + "SELECT * FROM ts"),
    "tile_parts": Query(_tile_parts, f"""
WITH {LONLAT_SQL},
boxes AS (SELECT c_custkey, longitude + bx * 0.1::DOUBLE AS minx, longitude + cx * 0.1::DOUBLE AS maxx,
                 latitude + bb * 0.1::DOUBLE AS miny, latitude + cb * 0.1::DOUBLE AS maxy
          FROM ll CROSS JOIN (VALUES (0, 0, 6, 2), (0, 2, 2, 6)) AS b(bx, bb, cx, cb)),
zz AS (SELECT *, unnest(range(8, 11)) AS z FROM boxes),
n AS (SELECT *, pow(2.0, z) AS n FROM zz),
r AS (SELECT *, CAST(floor((minx + 180.0) / 360.0 * n) AS BIGINT) AS x1, CAST(floor((maxx + 180.0) / 360.0 * n) AS BIGINT) AS x2,
      CAST(floor((1.0 - ln(tan(radians(maxy)) + 1.0 / cos(radians(maxy))) / pi()) / 2.0 * n) AS BIGINT) AS y1,
      CAST(floor((1.0 - ln(tan(radians(miny)) + 1.0 / cos(radians(miny))) / pi()) / 2.0 * n) AS BIGINT) AS y2 FROM n),
xs AS (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM r),
ts AS (SELECT *, unnest(range(y1, y2 + 1)) AS y FROM xs),
cut AS (SELECT c_custkey, z, x, y,
        least(maxx, (x + 1) / n * 360.0 - 180.0) - greatest(minx, x / n * 360.0 - 180.0) AS w,
        least(maxy, degrees(atan(sinh(pi() * (1.0 - y * 2.0 / n))))) - greatest(miny, degrees(atan(sinh(pi() * (1.0 - (y + 1) * 2.0 / n))))) AS h
        FROM ts)
SELECT c_custkey, CAST(z AS INTEGER) AS z, x, y, round(sum(w * h), 8) AS area FROM cut WHERE w > 0 AND h > 0 GROUP BY ALL"""),
    "tile_density_cap": Query(_tile_cap, TILES_SQL + """
SELECT c_custkey, z, x, y FROM ts QUALIFY row_number() OVER (
  PARTITION BY z, x, y ORDER BY c_custkey % 97 DESC, c_custkey) <= 2"""),
    "geojson_explode": Query(_geojson, f"""
WITH {LOTS_SQL}
SELECT c_custkey // 50 AS doc, c_name AS id, c_mktsegment AS segment,
       CAST(n_vertices AS INTEGER) AS n_vertices, {coarse_sql('maxx')} AS maxx,
       {coarse_sql('miny')} AS miny FROM lots JOIN customer USING (c_custkey)"""),
    "scan_geojson": Query(_scan_geojson, f"""
WITH {LOTS_SQL}, f AS (
  SELECT c_custkey // 50 AS doc, c_name AS id, c_mktsegment AS segment, CAST(n_vertices AS INTEGER) AS n_vertices
  FROM lots JOIN customer USING (c_custkey))
SELECT *, false AS unreadable FROM f WHERE NOT (doc % 7 = 3 AND doc % 3 < 2)
UNION ALL
SELECT DISTINCT doc, NULL, NULL, CAST(NULL AS INTEGER), true FROM f WHERE doc % 7 = 3 AND doc % 3 < 2"""),
    "saved_parcels": Query(_saved_parcels, """
SELECT c_nationkey || '-' || c_mktsegment AS commune, true AS valid, count(*) AS n_features, CAST(sum(c_custkey) AS BIGINT) AS keys
FROM customer GROUP BY 1"""),
    "saved_layer": Query(_saved_layer, """
SELECT kept, true AS valid, count(*) AS n_features, CAST(sum(c_custkey) AS BIGINT) AS keys
FROM customer CROSS JOIN (VALUES ('all'), ('some')) AS k(kept) WHERE kept = 'all' OR c_custkey % 5 > 0 GROUP BY kept"""),
    "scan_cadastre": Query(_scan_cadastre, f"""
WITH {LOTS_SQL}, docs AS (SELECT DISTINCT c_custkey // 20 AS doc FROM customer)
SELECT c_custkey // 20 AS doc, 'P' || c_custkey AS id_parcelle_unique, true AS readable, false AS failed, CAST(n_vertices AS INTEGER) AS n_vertices
FROM lots WHERE c_custkey // 20 % 7 NOT IN (3, 4, 5)
UNION ALL SELECT doc, NULL, doc % 7 = 4, doc % 7 <> 4, CAST(NULL AS INTEGER) FROM docs WHERE doc % 7 IN (3, 4, 5)"""),
    "export_keep_empty": _export(True),
    "export_drop_empty": _export(False),
    "left_join_stats": Query(_left_join, f"""
WITH {TRANSACTIONS}, s AS (
  SELECT CASE WHEN department % 4 > 0 THEN department END AS department, commune_name,
         count(*) AS nb_transactions FROM tx GROUP BY ALL)
SELECT n_nationkey AS department, n_name, n_regionkey, commune_name, nb_transactions
FROM nation LEFT JOIN s ON n_nationkey = department"""),
    "name_fallback": Query(_names, """
SELECT CAST(c_custkey AS VARCHAR) AS code,
       coalesce(s_name, nullif(c_mktsegment, 'BUILDING'), c_name) AS name
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey"""),
    "union_replace": Query(_union_replace, """
SELECT code, department FROM (SELECT nullif(n_name, 'NATION_7') AS code,
       CAST(n_regionkey AS VARCHAR) AS department FROM nation)
WHERE code IS NULL OR code NOT IN ('NATION_1', 'NATION_2', 'NATION_3')
UNION ALL SELECT s_name, substring(s_name, 1, 2) FROM supplier"""),
    "parcel_inner_join": Query(_parcel_join, f"""
WITH {TRANSACTIONS}, {PARCELS_SQL}
SELECT parcel, department, file, nb_transactions, round_even(top_price * 100, 0) / 100 AS top_price
FROM cad JOIN ps USING (parcel, department)"""),
    "status_counts": Query(_statuses, f"""
WITH {TRANSACTIONS}, {PARCELS_SQL},
per AS (SELECT file, department, count(*) AS n, count(nb_transactions) AS hits
        FROM cad LEFT JOIN ps USING (parcel, department) GROUP BY ALL),
s AS (SELECT hits, CASE WHEN department NOT IN (SELECT department FROM ps WHERE department IS NOT NULL) THEN 'no_transactions'
             WHEN file LIKE '%HOUSEHOLD' THEN 'error' WHEN file LIKE '%BUILDING' THEN 'no_cadastre'
             WHEN hits = 0 THEN 'no_transactions' ELSE 'success' END AS status FROM per)
SELECT status, count(*) AS n_files,
       CAST(sum(CASE WHEN status = 'success' THEN hits ELSE 0 END) AS BIGINT) AS n_parcels
FROM s GROUP BY status"""),
}
