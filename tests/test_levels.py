"""Levels and spans from shared passes, against one level at a time."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from terrier.operators.level_histogram import all_levels, nested_levels, sliced_level
from terrier.operators.price_stats import STAT_COLUMNS, Level, PriceRoles, level_stats

ROLES = PriceRoles(price="price", adjusted="adjusted", kind="kind", day="day")
SPANS = {"2024": date(2024, 1, 1), "all": None, "2025": date(2025, 1, 1), "never": date(2090, 1, 1)}
LEVELS = {"country": Level((), big=True, constants={"country": "X"}), "region": Level(("region",), big=True),
          "department": Level(("department", "region"), big=True),
          "commune": Level(("commune",)), "zone": Level(("zone",), not_null="zone", firsts=("department", "commune"))}


def sales(spark, n=3000, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        department = rng.choice([None, "01", "02", "03", "04", "05"])
        price = rng.choice([None, 0.0, -5.0, 1000.0, rng.lognormvariate(7, 1), rng.lognormvariate(7, .01), float(rng.randrange(20))])
        day = rng.choice([None, date(2023, 5, 1) + timedelta(rng.randrange(900))])
        out.append((i, price, None if price is None or rng.random() < .1 else price * 1.1, rng.choice([None, "Maison", "Appartement", "Local"]),
                    day, None if department == "05" else "R" + str(int(department or 7) % 2), department,
                    rng.choice([None, *range(40)]), rng.choice([None, *range(500)])))
    return spark.createDataFrame(out, "id long, price double, adjusted double, kind string, day date, region string, "
                                      "department string, commune long, zone long").repartition(4)


def same(got, want, level):
    columns = ["span", *level.constants, *level.keys, *STAT_COLUMNS, *level.firsts]
    assert got.columns == columns
    a, b = ([tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows(df, *columns)] for df in (got, want))
    assert a == b


@pytest.mark.parametrize("bucket_rows, broadcast_rows", [(1_000_000, 200_000), (20, 200_000), (60, 0)])
def test_nested_levels_as_one_by_one(spark, bucket_rows, broadcast_rows):
    df = sales(spark).cache()
    big = {n: level for n, level in LEVELS.items() if level.big}
    found = nested_levels(df, big, ROLES, SPANS, bucket_rows=bucket_rows, broadcast_rows=broadcast_rows, resolution=2)
    for name, level in big.items():
        same(found[name], level_stats(df, level, ROLES, SPANS), level)


@pytest.mark.parametrize("array_rows", [100_000, 60])
def test_sliced_levels_as_one_by_one(spark, array_rows):
    df = sales(spark).cache()
    for name in ("commune", "zone"):
        same(sliced_level(df, LEVELS[name], ROLES, SPANS, ["id"], array_rows), level_stats(df, LEVELS[name], ROLES, SPANS, ["id"]), LEVELS[name])


def test_levels_of_nothing(spark):
    for name, out in all_levels(sales(spark, 0), LEVELS, ROLES, SPANS, ["id"]).items():
        assert out.count() == (len(SPANS) if name == "country" else 0)


def test_big_levels_read_the_sales_twice(spark):
    """However many levels and spans there are."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    df = sales(spark, 2000)
    df = df.mapInArrow(counted, df.schema)
    big = {n: level for n, level in LEVELS.items() if level.big}
    for out in nested_levels(df, big, ROLES, SPANS).values():
        out.collect()
    assert read.value == 2 * 2000
