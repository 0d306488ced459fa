"""The given tables in the roles of the deed domain, for Spark and as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.operators.price_stats import PriceRoles


@dataclass(frozen=True)
class Query:
    """A registered query and, where SQL can say it, the same query for the check."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


#: Stated so that no job has to read footers for them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


ROLES = PriceRoles(price="price", adjusted="adjusted", kind="kind", day="day")
REFERENCE_YEAR = 2001


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sales: a price per size, a kind, a day, and areas of every level."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    priority = F.col("o_orderpriority")
    kind = (F.when(priority.isin("1-URGENT", "2-HIGH"), "Maison")
            .when(priority.isin("3-MEDIUM", "4-NOT SPECIFIED"), "Appartement").otherwise("Local"))
    sales = orders.select(
        F.col("o_orderkey").alias("sale"), "o_custkey", F.col("o_totalprice").alias("value"),
        (F.lit(20.0) + (F.col("o_orderkey") * 7 + F.col("o_custkey")) % 180).alias("surface"),
        (1 + F.floor(F.col("o_orderkey") / 4) % 7).alias("rooms"),
        kind.alias("kind"), F.to_date("o_orderdate").alias("day"),
        F.year("o_orderdate").alias("year"),
        F.when(F.col("o_custkey") % 9 != 0, F.col("o_custkey")).alias("zone"),
        F.floor(F.col("o_orderkey") / 3).alias("parcel"))
    areas = (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("c_nationkey").alias("department"),
                F.col("r_regionkey").alias("region"), F.col("r_name").alias("region_name"),
                F.concat("n_name", F.lit("/"), "c_mktsegment").alias("commune"),
                F.col("c_mktsegment").alias("commune_name")))
    price = F.col("value") / F.col("surface")
    return sales.join(areas, sales.o_custkey == areas.c_custkey).drop("c_custkey").withColumns({
        "price": price,
        "adjusted": price * (F.lit(1.0) + (F.lit(2001) - F.col("year")) * F.lit(0.03))})


TRANSACTIONS = """
tx AS (
  SELECT *, value / surface AS price,
         value / surface * (1.0::DOUBLE + (2001 - year) * 0.03::DOUBLE) AS adjusted
  FROM (
    SELECT o_orderkey AS sale, o_custkey, o_totalprice AS value,
           (20 + (o_orderkey * 7 + o_custkey) % 180)::DOUBLE AS surface, 1 + o_orderkey // 4 % 7 AS rooms,
           CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Maison'
                WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Appartement'
                ELSE 'Local' END AS kind,
           CAST(o_orderdate AS DATE) AS day, CAST(year(o_orderdate) AS INTEGER) AS year,
           CASE WHEN o_custkey % 9 <> 0 THEN o_custkey END AS zone, o_orderkey // 3 AS parcel,
           c_nationkey AS department, r_regionkey AS region, r_name AS region_name,
           n_name || '/' || c_mktsegment AS commune, c_mktsegment AS commune_name
    FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey))
"""


def near(value: str, q: float, where: str = "true") -> str:
    """SQL for the nearest-rank quantile."""
    cond = f"({where}) AND {value} IS NOT NULL"
    return (f"list_sort(list({value}) FILTER (WHERE {cond}))"
            f"[CAST(round({q} * (count(*) FILTER (WHERE {cond}) - 1)) AS BIGINT) + 1]")


def mid(value: str, where: str = "true") -> str:
    """SQL for the median."""
    cond = f"({where}) AND {value} IS NOT NULL"
    values = f"list_sort(list({value}) FILTER (WHERE {cond}))"
    n = f"count(*) FILTER (WHERE {cond})"
    return f"(({values}[({n} - 1) // 2 + 1] + {values}[{n} // 2 + 1]) / 2)"


def coarse(df: DataFrame, *columns: str) -> DataFrame:
    """Single precision for means, whose last bits depend on the order of adding."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def coarse_sql(value: str) -> str:
    return f"CAST(CAST({value} AS FLOAT) AS DOUBLE)"
