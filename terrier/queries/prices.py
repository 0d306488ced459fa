"""Statistics, levels, outliers, the time index and the reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.functions.columns import map_or_keep, within_bounds
from terrier.operators import lookups
from terrier.operators.level_histogram import all_levels, sliced_level
from terrier.operators.order_stats import median, nearest, order_stats
from terrier.operators.outliers import remove_iqr_outliers, remove_outliers
from terrier.operators.price_stats import (
    Level, level_stats, price_stats, span_counts, summary, top_by, top_groups)
from terrier.operators.time_index import adjust_prices, latest_per_group
from terrier.queries.tables import (
    REFERENCE_YEAR, ROLES, TRANSACTIONS, Query, coarse, coarse_sql, mid, near, table, transactions)
from terrier.session import scratch_file, staged
from terrier.sinks import save_aggregate
from terrier.sources.deeds import load_aggregate

MEANS = ("prix_m2_mean", "prix_m2_maison_mean", "prix_m2_appart_mean")
SPANS = {"2001": date(2001, 1, 1), "2000": date(2000, 1, 1), "1999": date(1999, 1, 1), "all": None}
LEVELS = {
    "country": Level((), big=True, constants={"country": "France"}),
    "region": Level(("region", "region_name"), big=True),
    "department": Level(("department", "region", "region_name"), big=True),
    "commune": Level(("commune", "commune_name")),
    "zone": Level(("zone",), not_null="zone"),
    "parcel": Level(("parcel",), firsts=("department", "commune")),
}
BOUNDS = {"surface": (25.0, 195.0), "value": (10_000.0, 450_000.0), "price": (100.0, 9_000.0),
          "rooms": (0, 7)}
CITIES = {"NATION_0/BUILDING": "City A", "NATION_0/MACHINERY": "City A",
          "NATION_1/BUILDING": "City B", "NATION_2/BUILDING": "City B"}


def _stats_sql() -> str:
    parts = ["count(*) AS nb_transactions",
             "count(*) FILTER (WHERE kind = 'Maison') AS nb_maisons",
             "count(*) FILTER (WHERE kind = 'Appartement') AS nb_appartements"]
    for tag, where in (("", "true"), ("_maison", "kind = 'Maison'"),
                       ("_appart", "kind = 'Appartement'")):
        parts += [coarse_sql(f"(avg(price) FILTER (WHERE {where}))") + f" AS prix_m2{tag}_mean",
                  f"{near('price', 0.25, where)} AS prix_m2{tag}_q25",
                  f"{mid('price', where)} AS prix_m2{tag}_median",
                  f"{near('price', 0.75, where)} AS prix_m2{tag}_q75",
                  f"{mid('adjusted', where)} AS prix_m2_ajuste{tag}_median"]
    return ", ".join(parts)


STATS_SQL = _stats_sql()


def _level(name: str) -> Query:
    level = LEVELS[name]
    keys = ", ".join(level.keys)

    def run(spark: SparkSession, folder: str) -> DataFrame:
        tx = transactions(spark, folder)
        return coarse(level_stats(tx, level, ROLES, order_by=["sale"]), *MEANS)

    heads = [f"'{v}' AS {n}" for n, v in level.constants.items()] + list(level.keys)
    heads += [f"arg_min({c}, sale) AS {c}" for c in level.firsts]
    where = f"WHERE {level.not_null} IS NOT NULL" if level.not_null else ""
    group = f"GROUP BY {keys}" if keys else ""
    return Query(run, f"WITH {TRANSACTIONS} SELECT {', '.join(heads)}, {STATS_SQL} "
                      f"FROM tx {where} {group}")


def _levels_by_span(spark: SparkSession, folder: str) -> DataFrame:
    # written once, joined and narrow, because every level reads it
    tx = staged(transactions(spark, folder).select(
        "sale", "price", "adjusted", "kind", "day",
        *dict.fromkeys(c for lv in LEVELS.values() for c in (*lv.keys, *lv.firsts))))
    out, found = None, all_levels(tx, LEVELS, ROLES, SPANS, ["sale"])
    for name, level in LEVELS.items():
        stats = coarse(found[name], *MEANS)
        code = F.concat_ws("|", *[F.col(k).cast("string") for k in level.keys])
        rows = stats.withColumns({"level": F.lit(name), "code": code}).drop(
            *level.keys, *level.firsts, *level.constants)
        out = rows if out is None else out.unionByName(rows)
    return out


def _levels_sql() -> str:
    spans = [f"SELECT '{s}' AS span, * FROM tx" + (f" WHERE day >= DATE '{d}'" if d else "")
             for s, d in SPANS.items()]
    parts = []
    for name, level in LEVELS.items():
        code = ("concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in level.keys) + ")"
                if level.keys else "''")
        where = f"WHERE {level.not_null} IS NOT NULL" if level.not_null else ""
        parts.append(f"SELECT '{name}' AS level, span, {code} AS code, {STATS_SQL} FROM spanned "
                     f"{where} GROUP BY " + ", ".join(["span", *level.keys]))
    return (f"WITH {TRANSACTIONS}, spanned AS ({' UNION ALL '.join(spans)}) "
            + " UNION ALL ".join(parts))


def _saved_aggregate(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics of the communes saved by span, and those of one span read back."""
    level, base = LEVELS["commune"], scratch_file(spark)
    stats = sliced_level(transactions(spark, folder), level, ROLES, SPANS, ["sale"])
    save_aggregate(stats, base, "commune", level.keys)
    return coarse(load_aggregate(spark, base, "commune", "2000"), *MEANS)


def _group_median(spark: SparkSession, folder: str) -> DataFrame:
    return order_stats(table(spark, folder, "customer"), ["c_nationkey"],
                       [median("median_balance", "c_acctbal")])


def _quantile_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return order_stats(table(spark, folder, "lineitem"), ["l_returnflag"],
                       [nearest(f"q{int(q * 100)}", "l_extendedprice", q)
                        for q in (0.25, 0.5, 0.75, 0.9)], strategy="rank")


def _price_stats(spark: SparkSession, folder: str) -> DataFrame:
    tx = transactions(spark, folder)
    return coarse(price_stats(tx, ["department", "year"], ROLES), *MEANS)


def _span_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"))
    return span_counts(orders, SPANS, "day")


def _top_groups(spark: SparkSession, folder: str) -> DataFrame:
    tx = transactions(spark, folder)
    return top_groups(tx.withColumn("city", map_or_keep("commune", CITIES, "commune")),
                      "city", 50, ROLES)


def _region_report(spark: SparkSession, folder: str) -> DataFrame:
    tx = transactions(spark, folder)
    stats = price_stats(tx, ["department"], ROLES, strategy="rank")
    return top_by(stats, "prix_m2_median", 5, "department").select(
        "department", "nb_transactions", "nb_maisons", "nb_appartements", "prix_m2_median",
        "prix_m2_ajuste_median")


def _filled_report(spark: SparkSession, folder: str) -> DataFrame:
    tx = transactions(spark, folder)
    stats = price_stats(tx, ["commune"], ROLES)
    return top_by(stats, "prix_m2_median", 10, "commune", min_rows=50).select(
        "commune", "nb_transactions", "prix_m2_median")


def _map_or_keep(spark: SparkSession, folder: str) -> DataFrame:
    tx = transactions(spark, folder)
    return tx.groupBy(map_or_keep("commune", CITIES, "commune").alias("city")).agg(
        F.count(F.lit(1)).alias("n"))


CASE_CITY = ("CASE " + " ".join(f"WHEN commune = '{k}' THEN '{v}'" for k, v in CITIES.items())
             + " ELSE commune END")
_BOUNDS_SQL = " AND ".join(f"{c} > {lo} AND {c} < {hi}" for c, (lo, hi) in BOUNDS.items())


def _fences_sql(source: str, key: str, columns: list[str]) -> str:
    quart = ", ".join(f"{near(c, 0.25)} AS {c}_q1, {near(c, 0.75)} AS {c}_q3" for c in columns)
    inside = " AND ".join(
        f"{c} > {c}_q1 - 1.5::DOUBLE * ({c}_q3 - {c}_q1) AND "
        f"{c} < {c}_q3 + 1.5::DOUBLE * ({c}_q3 - {c}_q1)" for c in columns)
    return (f"fence AS (SELECT {key} AS fkey, count(*) AS group_rows, {quart} FROM {source} "
            f"GROUP BY {key}) SELECT sale, {key}, value, price FROM {source} "
            f"JOIN fence ON {key} = fkey WHERE group_rows < 10 OR ({inside})")


def _iqr_filter(spark: SparkSession, folder: str) -> DataFrame:
    return remove_iqr_outliers(transactions(spark, folder), "zone", list(BOUNDS), ["sale"]).select(
        "sale", "zone", "value", "price")


def _hard_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    return transactions(spark, folder).where(within_bounds(BOUNDS)).select(
        "sale", "value", "surface", "price", "rooms")


def _outlier_chain(spark: SparkSession, folder: str) -> DataFrame:
    return remove_outliers(transactions(spark, folder), BOUNDS, "commune", ["sale"]).select(
        "sale", "commune", "value", "price")


def _adjusted(year: int) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        tx = transactions(spark, folder)
        return adjust_prices(tx, ["department", "kind"], "year", "price", year,
                             "price_adjusted", ["sale"]).select(
            "sale", "year", "price", "price_adjusted")
    return Query(run, f"""
WITH {TRANSACTIONS},
m AS (SELECT department, kind, year, {mid('price')} AS m FROM tx GROUP BY ALL),
t AS (SELECT department, kind,
             coalesce(max(m) FILTER (WHERE year = {year}), arg_max(m, year)) AS target
      FROM m GROUP BY ALL)
SELECT sale, year, price,
       price * CASE WHEN m > 0 AND target IS NOT NULL THEN target / m ELSE 1.0::DOUBLE END
       AS price_adjusted
FROM tx JOIN m USING (department, kind, year) JOIN t USING (department, kind)""")


def _latest(spark: SparkSession, folder: str) -> DataFrame:
    yearly = transactions(spark, folder).groupBy("department", "kind", "year").agg(
        F.max("price").alias("top"))
    return latest_per_group(yearly, ["department", "kind"], "top", "year", "latest_top")


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return coarse(summary(transactions(spark, folder), ROLES), "prix_m2_mean",
                   "prix_m2_ajuste_mean")


def _lookup_mapping(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    # one region and one department are known by no code
    known = region.select(F.when(F.col("r_name") != "ASIA", F.col("r_regionkey")).alias("n_regionkey"), "r_name")
    return lookups.region_mapping(
        nation.select(F.when(F.col("n_name") != "NATION_3", F.col("n_nationkey")).alias("n_nationkey"), "n_regionkey"),
        known, "n_regionkey").select(
        F.col("n_nationkey").alias("department"), F.col("n_regionkey").alias("code_region"),
        F.col("r_name").alias("nom_region"))


def _with_region(spark: SparkSession, folder: str) -> DataFrame:
    sales = transactions(spark, folder).select("sale", "department")
    return lookups.add_lookup(sales, _lookup_mapping(spark, folder), "department", ["sale"])


def _missing(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.missing_report(_with_region(spark, folder), "code_region", "department")


LOOKUP_SQL = f"""
WITH {TRANSACTIONS},
map AS (SELECT CASE WHEN n_name <> 'NATION_3' THEN n_nationkey END AS n_nationkey, n_regionkey, r_name FROM nation
        LEFT JOIN region ON n_regionkey = CASE WHEN r_name <> 'ASIA' THEN r_regionkey END),
looked AS (SELECT sale, department, n_regionkey AS code_region, r_name AS nom_region
           FROM tx LEFT JOIN map ON department = n_nationkey)
"""

QUERIES: dict[str, Query] = {
    "group_median": Query(_group_median, f"SELECT c_nationkey, {mid('c_acctbal')} AS median_balance "
                                         "FROM customer GROUP BY c_nationkey"),
    "quantile_nearest": Query(_quantile_nearest, "SELECT l_returnflag, " + ", ".join(
        f"{near('l_extendedprice', q)} AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75, 0.9))
        + " FROM lineitem GROUP BY l_returnflag"),
    "price_stats": Query(_price_stats, f"WITH {TRANSACTIONS} SELECT department, year, {STATS_SQL} "
                                       "FROM tx GROUP BY department, year"),
    **{f"level_{name}": _level(name) for name in LEVELS},
    "levels_by_span": Query(_levels_by_span, _levels_sql()),
    "saved_aggregate": Query(_saved_aggregate, f"""
WITH {TRANSACTIONS} SELECT commune, commune_name, {STATS_SQL} FROM tx WHERE day >= DATE '{SPANS["2000"]}'
GROUP BY commune, commune_name"""),
    "span_filter_counts": Query(_span_counts, " UNION ALL ".join(
        f"SELECT '{s}' AS span, count(*) AS n_rows FROM orders"
        + (f" WHERE o_orderdate >= DATE '{d}'" if d else "") for s, d in SPANS.items())),
    "top_groups": Query(_top_groups, f"""
WITH {TRANSACTIONS}
SELECT {CASE_CITY} AS name, count(*) AS nb_transactions,
       count(*) FILTER (WHERE kind = 'Maison') AS nb_maisons,
       count(*) FILTER (WHERE kind = 'Appartement') AS nb_appartements,
       {mid('price')} AS prix_m2_median,
       {mid('price', "kind = 'Maison'")} AS prix_m2_maison_median,
       {mid('price', "kind = 'Appartement'")} AS prix_m2_appart_median
FROM tx WHERE kind IN ('Maison', 'Appartement') AND price > 0
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50"""),
    "top_by_median": Query(_region_report, f"""
WITH {TRANSACTIONS}
SELECT department, count(*) AS nb_transactions,
       count(*) FILTER (WHERE kind = 'Maison') AS nb_maisons,
       count(*) FILTER (WHERE kind = 'Appartement') AS nb_appartements,
       {mid('price')} AS prix_m2_median, {mid('adjusted')} AS prix_m2_ajuste_median
FROM tx GROUP BY department ORDER BY prix_m2_median DESC, department LIMIT 5"""),
    "top_having": Query(_filled_report, f"""
WITH {TRANSACTIONS}
SELECT commune, count(*) AS nb_transactions, {mid('price')} AS prix_m2_median
FROM tx GROUP BY commune HAVING count(*) >= 50 ORDER BY prix_m2_median DESC, commune LIMIT 10"""),
    "map_or_keep": Query(_map_or_keep, f"WITH {TRANSACTIONS} SELECT {CASE_CITY} AS city, "
                                       "count(*) AS n FROM tx GROUP BY 1"),
    "hard_threshold_filter": Query(_hard_thresholds, f"WITH {TRANSACTIONS} SELECT sale, value, "
                                   f"surface, price, rooms FROM tx WHERE {_BOUNDS_SQL}"),
    "iqr_filter": Query(_iqr_filter, f"WITH {TRANSACTIONS}, "
                        + _fences_sql("tx", "zone", list(BOUNDS))),
    "outlier_chain": Query(_outlier_chain, f"WITH {TRANSACTIONS}, ok AS (SELECT * FROM tx WHERE "
                           f"{_BOUNDS_SQL}), " + _fences_sql("ok", "commune", list(BOUNDS))),
    "time_adjusted_price": _adjusted(REFERENCE_YEAR),
    "time_adjusted_fallback": _adjusted(2002),
    "latest_per_group": Query(_latest, f"""
WITH {TRANSACTIONS}, y AS (SELECT department, kind, year, max(price) AS top FROM tx GROUP BY ALL)
SELECT department, kind, arg_max(top, year) AS latest_top FROM y GROUP BY ALL"""),
    "dataset_summary": Query(_summary, f"""
WITH {TRANSACTIONS}
SELECT count(*) AS n_rows, min(day) AS date_min, max(day) AS date_max,
       {coarse_sql('avg(price)')} AS prix_m2_mean, {mid('price')} AS prix_m2_median,
       min(price) AS prix_m2_min, max(price) AS prix_m2_max,
       {coarse_sql('avg(adjusted)')} AS prix_m2_ajuste_mean, {mid('adjusted')} AS prix_m2_ajuste_median,
       min(adjusted) AS prix_m2_ajuste_min, max(adjusted) AS prix_m2_ajuste_max
FROM tx"""),
    "region_lookup": Query(_with_region, LOOKUP_SQL + "SELECT * FROM looked"),
    "missing_report": Query(_missing, LOOKUP_SQL + "SELECT department, count(*) AS n_missing "
                            "FROM looked WHERE code_region IS NULL GROUP BY department"),
}
