"""Cleaning and derivation queries, mostly on ``lineitem`` as deed lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier import schema as S
from terrier.functions import columns as C
from terrier.functions import geometry as G
from terrier.functions import projection as P
from terrier.operators import groups
from terrier.plans import process
from terrier.queries.tables import TRANSACTIONS, Query, coarse, coarse_sql, mid, near, table, transactions
from terrier.session import scratch_file
from terrier.sources.deeds import scan_deeds

#: Tells the lines of an order apart; line numbers alone repeat.
LINE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY = "(l_shipdate, l_linenumber, l_partkey, l_suppkey)"
LINE_ORDER_SQL = "struct_pack(a := l_shipdate, b := l_linenumber, c := l_partkey, d := l_suppkey)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def _with_nulls(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose flag ``N`` and whose discount 0 are unknown, like gaps in deeds."""
    return _lines(spark, folder).withColumns({
        "use": F.nullif("l_returnflag", F.lit("N")),
        "status": F.nullif("l_linestatus", F.lit("O")),
        "rooms": F.nullif(F.col("l_linenumber"), F.lit(4)).cast("long")})


LINES_SQL = """
lines AS (SELECT *, nullif(l_returnflag, 'N') AS use, nullif(l_linestatus, 'O') AS status,
                 CAST(nullif(l_linenumber, 4) AS BIGINT) AS rooms FROM lineitem)
"""


def _fill_nulls(spark: SparkSession, folder: str) -> DataFrame:
    return C.fill_unknown(_with_nulls(spark, folder), ["use", "status"]).select(
        "l_orderkey", "l_linenumber", "use", "status")


def _residential(spark: SparkSession, folder: str) -> DataFrame:
    test = C.relevant("use", ["A", "R"], "l_linestatus", ["F"], "l_extendedprice", 1000.0,
                      "l_discount", ["rooms"])
    return _with_nulls(spark, folder).where(test).select(
        "l_orderkey", "l_partkey", "use", "l_extendedprice", "rooms")


def _unit_price(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    return lines.withColumn("spread", F.col("l_quantity") - 10).select(
        "l_orderkey", "l_linenumber", C.unit_price("l_extendedprice", "l_quantity").alias("unit"),
        C.unit_price("l_extendedprice", "spread").alias("guarded"))


def _composite_key(spark: SparkSession, folder: str) -> DataFrame:
    return _with_nulls(spark, folder).select(
        "l_orderkey", "l_linenumber", C.composite_key("l_orderkey", "l_linenumber").alias("key"),
        C.composite_key("l_orderkey", "use").alias("key_with_gap"))


def _dates(spark: SparkSession, folder: str) -> DataFrame:
    text = table(spark, folder, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"))
    day = text.withColumn("day", C.parse_day("text"))
    return day.select("o_orderkey", "day", F.year("day").alias("year"))


def _round_floats(spark: SparkSession, folder: str) -> DataFrame:
    part = transactions(spark, folder).select(
        "sale", "price", "adjusted", F.col("value").alias("longitude"))
    return C.round_doubles(part)


def _display(spark: SparkSession, folder: str) -> DataFrame:
    tx = transactions(spark, folder)
    sold = tx.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), F.max("price").alias("top"))
    # every customer is a zone; some have no sale
    zones = table(spark, folder, "customer").select(F.col("c_custkey").alias("zone"))
    stats = zones.join(sold, "zone", "left")
    return stats.select("zone", C.display_class("n", 5).alias("class"),
                        C.display_class("n", 0).alias("parcel_class"),
                        C.scale_position("top", 1500.0, 8000.0).alias("position"))


def _keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return groups.keep_first_category(
        _with_nulls(spark, folder), ["l_orderkey", "status"], "use", LINE_ORDER).select(
        "l_orderkey", "status", "use", *LINE_ORDER)


def _flag(spark: SparkSession, folder: str) -> DataFrame:
    return groups.flag_group(
        _with_nulls(spark, folder), ["l_orderkey", "status"], F.col("use") == "R", "has_return",
        LINE_ORDER).select("l_orderkey", "status", *LINE_ORDER, "has_return")


def _allocate(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["l_orderkey", "l_linestatus"]
    totals = groups.group_totals(_lines(spark, folder), keys, {"total_quantity": "l_quantity"},
                                 {"mean_price": "l_extendedprice"}, LINE_ORDER)
    out = groups.allocate(totals, "mean_price", "total_quantity", "l_quantity", "share")
    return coarse(out.select(*keys, *LINE_ORDER, "total_quantity", "mean_price", "share"),
                  "mean_price", "share")


def _reduced(spark: SparkSession, folder: str) -> DataFrame:
    lines = _with_nulls(spark, folder).withColumn("rooms_sum", F.col("rooms"))
    return groups.reduce_groups(lines, ["l_orderkey"], LINE_ORDER, ["use", "l_shipdate"],
                                ["l_partkey", "rooms"], ["rooms_sum"])


def _as_text(column: str) -> Column:
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",", "?")


def _reduce(spark: SparkSession, folder: str) -> DataFrame:
    r = _reduced(spark, folder)
    return r.select("l_orderkey", "use", "l_shipdate", "rooms_sum",
                    _as_text("l_partkey").alias("parts"), _as_text("rooms").alias("rooms"))


def _reduce_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Three groups hold all rows: their lists come in pieces."""
    lines = _with_nulls(spark, folder).withColumns({
        "month": F.trunc("l_shipdate", "month"), "rooms_sum": F.col("rooms")})
    keys, order = ["l_returnflag"], ["month", "l_orderkey", *LINE_ORDER]
    whole = groups.reduce_groups(lines, keys, order, ["use", "l_partkey"], sums=["rooms_sum"])
    pieces = groups.list_pieces(lines, keys, order, ["l_suppkey", "rooms"], ["month"])
    return pieces.join(whole, keys).select("l_returnflag", "part", "use", F.col("l_partkey").alias("first_part"),
                    "rooms_sum", F.size("rooms").alias("n"),
                    F.md5(_as_text("l_suppkey")).alias("suppliers"),
                    F.md5(_as_text("rooms")).alias("rooms"))


def _items(keys: list[str], order: list[str], light_rows: int) -> Query:
    """Lists as rows: every line with its place in its group, and the group's sum."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return groups.number_items(_with_nulls(spark, folder), keys, order, {"rooms_sum": "rooms"}, light_rows=light_rows).select(
            *keys, "position", *[c for c in order if c not in keys], "rooms", "rooms_sum")
    by, along = ", ".join(keys), ", ".join(order)
    kept = ", ".join([*keys, *[c for c in order if c not in keys]])
    return Query(run, f"""
WITH {LINES_SQL}
SELECT {kept}, row_number() OVER (PARTITION BY {by} ORDER BY {along}, rooms) - 1 AS position, rooms,
       CAST(coalesce(sum(rooms) OVER (PARTITION BY {by}), 0) AS BIGINT) AS rooms_sum FROM lines""")


def _first_of_list(spark: SparkSession, folder: str) -> DataFrame:
    return _reduced(spark, folder).select(
        "l_orderkey", C.first_of_list("l_partkey").alias("first_part"))


def _deeds(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as deed lines: an order is a deed of two dispositions, its suppliers' parity the parcels."""
    kind = (F.when(F.col("l_partkey") % 4 == 0, "Maison").when(F.col("l_partkey") % 4 == 1, "Appartement")
            .when(F.col("l_partkey") % 4 == 2, S.OUTBUILDING))
    told = {
        "id_mutation": F.col("l_orderkey").cast("string"), "numero_disposition": (F.col("l_linenumber") % 2).cast("long"),
        "date_mutation": F.to_date("l_shipdate"), "valeur_fonciere": F.col("l_extendedprice"),
        "nature_mutation": F.when(F.col("l_suppkey") % 9 == 0, "Echange").otherwise("Vente"),
        "id_parcelle": F.concat(F.lit("P"), (F.col("l_suppkey") % 2).cast("string")),
        "nature_culture": F.nullif("l_returnflag", F.lit("N")), "type_local": kind,
        "surface_reelle_bati": F.col("l_quantity") - 5,
        "longitude": F.lit(2.0) + F.col("l_partkey") % 97 / F.lit(50.0), "latitude": F.lit(48.0) + F.col("l_suppkey") % 49 / F.lit(50.0),
        "code_commune": F.concat(F.lit("C"), (F.col("l_suppkey") % 40).cast("string")),
        "code_departement": (F.col("l_suppkey") % 25).cast("string"),
        "nombre_pieces_principales": F.nullif(F.col("l_linenumber"), F.lit(4)).cast("long"),
        "nature_culture_speciale": F.nullif("l_linestatus", F.lit("O"))}
    unknown = {c: F.lit(None).cast("string") for c in process.LINE_COLUMNS if c not in (*told, "surface_terrain", "seq")}
    return _lines(spark, folder).select(*[v.alias(c) for c, v in (told | unknown).items()],
                                        F.lit(None).cast("double").alias("surface_terrain"), F.struct(*LINE_ORDER).alias("seq"))


def _scanned(spark: SparkSession, folder: str) -> DataFrame:
    """Lines written as deed files, with words for unknown cells, and read back."""
    lines, path = _deeds(spark, folder), scratch_file(spark)
    names = spark.createDataFrame([], S.DEED_LINE).columns
    cells = {"nature_culture": F.coalesce("nature_culture", F.lit("NA")), "type_local": F.coalesce("type_local", F.lit("null")),
             "adresse_nom_voie": F.concat(F.lit('RUE "A", '), "id_mutation")}
    cells = {c: cells.get(c, F.col(c) if c in lines.columns else F.lit(None).cast("string")) for c in names}
    lines.select(*[v.cast("string").alias(c) for c, v in cells.items()]).write.option("header", True).option("escape", '"').csv(path)
    read = scan_deeds(spark, path)
    return read.select("id_mutation", "numero_disposition", "date_mutation", "valeur_fonciere", "nature_mutation", "nature_culture",
                       "type_local", "surface_reelle_bati", "nombre_pieces_principales", "longitude", "code_departement", "adresse_nom_voie",
                       F.col("seq.file").isNotNull().alias("placed"))


DEEDS_SQL = f"""
deeds AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS id_mutation, l_linenumber::BIGINT % 2 AS numero_disposition, CAST(l_shipdate AS DATE) AS date_mutation,
         l_extendedprice AS value, CASE WHEN l_suppkey % 9 = 0 THEN 'Echange' ELSE 'Vente' END AS nature, 'P' || (l_suppkey % 2) AS parcel,
         coalesce(nullif(l_returnflag, 'N'), 'unknown') AS use, coalesce(nullif(l_linestatus, 'O'), 'unknown') AS special,
         CASE l_partkey % 4 WHEN 0 THEN 'Maison' WHEN 1 THEN 'Appartement' WHEN 2 THEN 'Dépendance' END AS kind,
         l_quantity - 5 AS surface, CAST(nullif(l_linenumber, 4) AS BIGINT) AS rooms,
         2.0::DOUBLE + l_partkey % 97 / 50.0::DOUBLE AS longitude, 48.0::DOUBLE + l_suppkey % 49 / 50.0::DOUBLE AS latitude,
         'C' || (l_suppkey % 40) AS commune, CAST(l_suppkey % 25 AS VARCHAR) AS department, {LINE_ORDER_SQL} AS seq FROM lineitem),
uses AS (SELECT id_mutation, numero_disposition, parcel, nature, arg_min(use, seq) AS use FROM deeds GROUP BY ALL),
flagged AS (
  SELECT *, coalesce(bool_or(kind = 'Dépendance') OVER (PARTITION BY id_mutation, numero_disposition, parcel, use, special, nature), false)
         AS has_dependency FROM deeds JOIN uses USING (id_mutation, numero_disposition, parcel, nature, use)),
homes AS (SELECT * FROM flagged WHERE nature = 'Vente' AND kind IN ('Maison', 'Appartement') AND value > 100 AND surface > 0),
items AS (
  SELECT *, sum(surface) OVER d AS total, avg(value) OVER d AS mean, CAST(coalesce(sum(rooms) OVER d, 0) AS BIGINT) AS total_rooms,
         row_number() OVER (PARTITION BY id_mutation, numero_disposition ORDER BY seq) - 1 AS position
  FROM homes WINDOW d AS (PARTITION BY id_mutation, numero_disposition))
"""


def _deed_reduction(spark: SparkSession, folder: str) -> DataFrame:
    """The whole reduction of deed lines to one row per sale."""
    sales = process.reduce_deeds(_deeds(spark, folder))
    return sales.select("id_mutation", "numero_disposition", "date_mutation", "valeur_fonciere", "nature_mutation", "type_local",
                        "has_dependency", "surface_batie_totale", "nombre_pieces_principales", "id_parcelle_unique")


def _deed_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The lists of every sale, one row per place."""
    lists = process.lists_of(process.deed_items(_deeds(spark, folder)))
    return coarse(lists.select("id_mutation", "numero_disposition", "position", "id_parcelle", "surface_reelle_bati",
                               "nature_culture", "nature_culture_speciale", "prix_de_vente"), "prix_de_vente")


def _processed(spark: SparkSession, folder: str) -> DataFrame:
    """The whole first step: reduction, prices, regions, outliers, time index and zones."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    k = F.col("n_nationkey")
    x, y = (F.lit(625000.0) + k % 5 * 30000), (F.lit(6770000.0) + F.floor(k / 5) * 22000)
    zones = nation.select(F.col("n_name").alias("code_iris"), F.lower("n_name").alias("nom_iris"),
                          G.polygon(F.array(G.box_ring(x, y, x + 24000, y + 18000)), G.LAMBERT93).alias("geom"))
    departments = nation.select(k.cast("string").alias("code_departement"), F.col("n_regionkey").cast("string").alias("code_region"))
    regions = region.select(F.col("r_regionkey").cast("string").alias("code_region"), F.col("r_name").alias("nom_region"))
    sales, _ = process.process(_deeds(spark, folder), departments, regions, zones)
    return sales.select("cle_principale", "date_mutation", "valeur_fonciere", "type_local", "has_dependency", "surface_batie_totale",
                        "nombre_pieces_principales", "id_parcelle_unique", "code_commune", "prix_m2", "prix_m2_ajuste",
                        "annee_mutation", "code_region", "nom_region", "code_iris", "nom_iris")


def _processed_sql() -> str:
    bounds = dict(zip(("total", "value", "prix_m2", "total_rooms"), S.BOUNDS.values()))
    within = " AND ".join(f"{c} > {lo} AND {c} < {hi}" for c, (lo, hi) in bounds.items())
    quart = ", ".join(f"{near(c, 0.25)} AS {c}_q1, {near(c, 0.75)} AS {c}_q3" for c in bounds)
    inside = " AND ".join(f"{c} > {c}_q1 - 1.5::DOUBLE * ({c}_q3 - {c}_q1) AND {c} < {c}_q3 + 1.5::DOUBLE * ({c}_q3 - {c}_q1)" for c in bounds)
    return f"""
WITH {DEEDS_SQL},
sales AS (SELECT *, id_mutation || '_' || numero_disposition AS cle, value / nullif(total, 0) AS prix_m2,
                 CAST(year(date_mutation) AS INTEGER) AS year FROM items WHERE position = 0),
sound AS (SELECT * FROM sales WHERE {within}),
fence AS (SELECT commune, count(*) AS group_rows, {quart} FROM sound GROUP BY commune),
clean AS (SELECT sound.* FROM sound JOIN fence USING (commune) WHERE group_rows < 10 OR ({inside})),
yearly AS (SELECT department, kind, year, {mid('prix_m2')} AS m FROM clean GROUP BY ALL),
last AS (SELECT department, kind, coalesce(max(m) FILTER (WHERE year = {S.REFERENCE_YEAR}), arg_max(m, year)) AS target FROM yearly GROUP BY ALL),
a AS (SELECT *, sin(radians(latitude)) * {P.ECC!r} AS s FROM clean),
b AS (SELECT *, {P.SCALE!r} * pow(tan(pi() / 4 - radians(latitude) / 2) / pow((1 - s) / (1 + s), {P.ECC / 2!r}), {P.CONE!r}) AS rho,
             radians(longitude - 3) * {P.CONE!r} AS theta FROM a),
placed AS (SELECT *, rho * sin(theta) + 700000 AS x, 6600000 + {P.RHO_0!r} - rho * cos(theta) AS y FROM b),
zones AS (SELECT n_name, 625000 + n_nationkey % 5 * 30000 AS x0, 6770000 + n_nationkey // 5 * 22000 AS y0 FROM nation)
SELECT cle AS cle_principale, date_mutation, value AS valeur_fonciere, kind AS type_local, has_dependency,
       total AS surface_batie_totale, total_rooms AS nombre_pieces_principales, parcel AS id_parcelle_unique, commune AS code_commune,
       prix_m2, prix_m2 * CASE WHEN m > 0 AND target IS NOT NULL THEN target / m ELSE 1.0::DOUBLE END AS prix_m2_ajuste,
       year AS annee_mutation, CAST(n.n_regionkey AS VARCHAR) AS code_region, r_name AS nom_region,
       z.n_name AS code_iris, lower(z.n_name) AS nom_iris
FROM placed JOIN yearly USING (department, kind, year) JOIN last USING (department, kind)
LEFT JOIN nation n ON department = CAST(n.n_nationkey AS VARCHAR) LEFT JOIN region ON n.n_regionkey = r_regionkey
LEFT JOIN zones z ON x > x0 AND x < x0 + 24000 AND y > y0 AND y < y0 + 18000"""


def _uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    return groups.duplicate_keys(_lines(spark, folder),
                                 C.composite_key("l_orderkey", "l_linenumber"))


QUERIES: dict[str, Query] = {
    "fill_nulls": Query(_fill_nulls, f"""
WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, coalesce(use, 'unknown') AS use,
       coalesce(status, 'unknown') AS status FROM lines"""),
    "residential_filter": Query(_residential, f"""
WITH {LINES_SQL} SELECT l_orderkey, l_partkey, use, l_extendedprice, rooms FROM lines
WHERE use IN ('A', 'R') AND l_linestatus = 'F' AND l_extendedprice > 1000 AND l_discount > 0
  AND rooms IS NOT NULL"""),
    "unit_price": Query(_unit_price, """
SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit,
       l_extendedprice / nullif(l_quantity - 10, 0) AS guarded FROM lineitem"""),
    "composite_key": Query(_composite_key, f"""
WITH {LINES_SQL} SELECT l_orderkey, l_linenumber, l_orderkey || '_' || l_linenumber AS key,
       l_orderkey || '_' || use AS key_with_gap FROM lines"""),
    "date_parse_year": Query(_dates, """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders"""),
    "round_floats": Query(_round_floats, f"""
WITH {TRANSACTIONS} SELECT sale, round_even(price * 100, 0) / 100 AS price,
       round_even(adjusted * 100, 0) / 100 AS adjusted, value AS longitude FROM tx"""),
    "display_class": Query(_display, f"""
WITH {TRANSACTIONS}, s AS (SELECT zone, count(*) AS n, max(price) AS top FROM tx GROUP BY zone),
z AS (SELECT c_custkey AS zone, coalesce(n, 0) AS n, top FROM customer LEFT JOIN s ON c_custkey = zone)
SELECT zone, CASE WHEN n = 0 THEN 'none' WHEN n < 5 THEN 'few' ELSE 'scaled' END AS class,
       CASE WHEN n = 0 THEN 'none' ELSE 'scaled' END AS parcel_class,
       CASE WHEN top IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (top - 1500.0::DOUBLE) / 6500.0::DOUBLE)) END
       AS position FROM z"""),
    "keep_first_category": Query(_keep_first, f"""
WITH {LINES_SQL},
f AS (SELECT l_orderkey, status, arg_min_null(use, {LINE_ORDER_SQL}) AS first FROM lines
      WHERE status IS NOT NULL GROUP BY ALL)
SELECT l_orderkey, status, use, l_shipdate, l_linenumber, l_partkey, l_suppkey
FROM lines JOIN f USING (l_orderkey, status) WHERE use = first"""),
    "flag_group": Query(_flag, f"""
WITH {LINES_SQL}
SELECT l_orderkey, status, l_shipdate, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_orderkey IS NOT NULL AND status IS NOT NULL THEN
            coalesce(bool_or(use = 'R') OVER (PARTITION BY l_orderkey, status), false) END
       AS has_return FROM lines"""),
    "proportional_allocation": Query(_allocate, f"""
WITH t AS (SELECT *, sum(l_quantity) OVER w AS tq, avg(l_extendedprice) OVER w AS mp FROM lineitem
           WINDOW w AS (PARTITION BY l_orderkey, l_linestatus))
SELECT l_orderkey, l_linestatus, l_shipdate, l_linenumber, l_partkey, l_suppkey,
       tq AS total_quantity, {coarse_sql("mp")} AS mean_price,
       {coarse_sql("mp / nullif(tq, 0) * l_quantity")} AS share FROM t"""),
    "reduce_first_list_sum": Query(_reduce, f"""
WITH {LINES_SQL}
SELECT l_orderkey, arg_min_null(use, {LINE_ORDER_SQL}) AS use, min(l_shipdate) AS l_shipdate,
       CAST(coalesce(sum(rooms), 0) AS BIGINT) AS rooms_sum,
       string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY {LINE_KEY}) AS parts,
       string_agg(coalesce(CAST(rooms AS VARCHAR), '?'), ',' ORDER BY {LINE_KEY}) AS rooms
FROM lines GROUP BY l_orderkey"""),
    "reduce_list_parts": Query(_reduce_parts, f"""
WITH {LINES_SQL},
n AS (SELECT *, date_trunc('month', l_shipdate) AS month FROM lines),
g AS (SELECT l_returnflag, arg_min_null(use, (month, l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS use,
             arg_min(l_partkey, (month, l_orderkey, l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS first_part,
             CAST(coalesce(sum(rooms), 0) AS BIGINT) AS rooms_sum FROM n GROUP BY l_returnflag),
p AS (SELECT l_returnflag, month, CAST(count(*) AS INTEGER) AS n,
             md5(string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_orderkey, {LINE_KEY})) AS suppliers,
             md5(string_agg(coalesce(CAST(rooms AS VARCHAR), '?'), ',' ORDER BY l_orderkey, {LINE_KEY})) AS rooms
      FROM n GROUP BY l_returnflag, month)
SELECT l_returnflag, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY month) - 1 AS INTEGER) AS part,
       use, first_part, rooms_sum, n, suppliers, rooms FROM p JOIN g USING (l_returnflag)"""),
    "list_items": _items(["l_orderkey"], LINE_ORDER, groups.LIGHT_ROWS),
    # three groups hold all rows, far beyond what one task is given here
    "list_items_large": _items(["l_returnflag"], ["l_orderkey", *LINE_ORDER], 1000),
    "first_of_list": Query(_first_of_list, f"""
SELECT l_orderkey, arg_min(l_partkey, {LINE_ORDER_SQL}) AS first_part
FROM lineitem GROUP BY l_orderkey"""),
    "deed_reduction": Query(_deed_reduction, f"""
WITH {DEEDS_SQL}
SELECT id_mutation, numero_disposition, date_mutation, value AS valeur_fonciere, nature AS nature_mutation, kind AS type_local,
       has_dependency, total AS surface_batie_totale, total_rooms AS nombre_pieces_principales, parcel AS id_parcelle_unique
FROM items WHERE position = 0"""),
    "scan_deeds": Query(_scanned, f"""
WITH {DEEDS_SQL}
SELECT id_mutation, numero_disposition, date_mutation, value AS valeur_fonciere, nature AS nature_mutation,
       nullif(use, 'unknown') AS nature_culture, kind AS type_local, surface AS surface_reelle_bati, rooms AS nombre_pieces_principales,
       longitude, department AS code_departement, 'RUE "A", ' || id_mutation AS adresse_nom_voie, true AS placed FROM deeds"""),
    "processed_sales": Query(_processed, _processed_sql()),
    "deed_lists": Query(_deed_lists, f"""
WITH {DEEDS_SQL}
SELECT id_mutation, numero_disposition, position, parcel AS id_parcelle, surface AS surface_reelle_bati, use AS nature_culture,
       special AS nature_culture_speciale, {coarse_sql("mean / nullif(total, 0) * surface")} AS prix_de_vente FROM items"""),
    "key_uniqueness": Query(_uniqueness, """
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey || '_' || l_linenumber) AS n_keys,
       count(*) = count(DISTINCT l_orderkey || '_' || l_linenumber) AS is_unique FROM lineitem"""),
}
