import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import rows
from terrier.operators.order_stats import median, nearest, order_stats
from terrier.operators.outliers import iqr_fences, remove_iqr_outliers, remove_outliers
from terrier.operators.price_stats import (
    STAT_COLUMNS, Level, PriceRoles, level_stats, span_counts, top_by, top_groups)
from terrier.operators.time_index import adjust_prices, median_index

ROLES = PriceRoles("p", "a", "t", "H", "F", "d")


def test_nearest_rank_on_one_to_twelve(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(1, 13)], "k string, v double")
    for strategy in ("arrays", "rank"):
        r = order_stats(df, ["k"], [nearest("q25", "v", .25), median("q50", "v"),
                                    nearest("q75", "v", .75)], strategy=strategy).first()
        assert (r.q25, r.q50, r.q75) == (4.0, 6.5, 9.0)


@pytest.mark.parametrize("resolution", [64, 1])
def test_strategies_agree_with_brute_force(spark, resolution):
    rng = random.Random(3)
    data = []
    for i in range(4000):
        key = None if i % 5 == 0 else "hot" if i % 3 else f"k{rng.randrange(60)}"
        v = rng.choice([None, -0.0, 0.0, 7.0, rng.gauss(0, 500), rng.expovariate(1e-4), -3.25])
        data.append((key, v, rng.choice(["H", "F", None])))
    df = spark.createDataFrame(data, "k string, v double, t string")
    stats = [nearest("lo", "v", .25), median("mid", "v"), nearest("hi", "v", .75, "h"),
             median("midh", "v", "h")]
    subsets = {"h": F.col("t") == "H"}
    want = []
    for key in {k for k, _, _ in data}:
        row = [key]
        for s in stats:
            vs = sorted(v + 0.0 for k, v, t in data
                        if k == key and v is not None and (s.subset is None or t == "H"))
            n = len(vs)
            if not n:
                row.append(None)
            elif s.median:
                row.append((vs[(n - 1) // 2] + vs[n // 2]) / 2)
            else:
                row.append(vs[int(s.q * (n - 1) + 0.5)])
        want.append(tuple(row))
    want = sorted(want, key=lambda r: (r[0] is None, r[0] or ""))

    def got(**kw):
        out = order_stats(df, ["k"], stats, subsets, resolution=resolution, **kw)
        return sorted((tuple(r) for r in out.collect()), key=lambda r: (r[0] is None, r[0] or ""))

    assert got(strategy="arrays") == want
    assert got(strategy="rank") == want
    assert got(strategy="rank", broadcast_rows=0) == want
    assert got(strategy="rank", bucket_rows=5) == want      # wanted buckets are cut again
    assert got(strategy="auto", array_rows=100) == want


def test_price_stats_of_empty_subsets_are_null(spark):
    df = spark.createDataFrame([("r", 10.0, 11.0, "H", date(2024, 5, 1))],
                               "k string, p double, a double, t string, d date")
    r = level_stats(df, Level(("k",)), ROLES).first()
    assert (r.nb_transactions, r.nb_maisons, r.nb_appartements) == (1, 1, 0)
    assert r.prix_m2_maison_median == 10.0 and r.prix_m2_ajuste_median == 11.0
    assert r.prix_m2_appart_mean is None and r.prix_m2_appart_q25 is None


def test_country_has_one_row_per_span_even_when_empty(spark):
    df = spark.createDataFrame([("r", 10.0, 11.0, "H", date(2024, 5, 1))],
                               "k string, p double, a double, t string, d date")
    level = Level((), big=True, constants={"country": "France"})
    spans = {"2025": date(2025, 1, 1), "all": None}
    out = {r.span: r for r in level_stats(df, level, ROLES, spans).collect()}
    assert out["2025"].nb_transactions == 0 and out["2025"].prix_m2_median is None
    assert out["all"].nb_transactions == 1 and out["all"].country == "France"
    assert level_stats(df.limit(0), level, ROLES).first().nb_transactions == 0
    assert level_stats(df, level, ROLES).columns == ["country", *STAT_COLUMNS]
    assert rows(span_counts(df, spans, "d")) == [("2025", 0), ("all", 1)]


def test_level_keeps_null_groups_and_first_values(spark):
    df = spark.createDataFrame(
        [(None, 1.0, "c2", 2), (None, 3.0, "c1", 1), ("x", 5.0, None, 3), ("x", 6.0, "c9", 4)],
        "k string, p double, c string, seq int").selectExpr(
        "*", "p as a", "'H' as t", "date'2024-01-01' as d")
    out = level_stats(df, Level(("k",), firsts=("c",)), ROLES, order_by=["seq"])
    assert rows(out, "k", "prix_m2_median", "c") == [("x", 5.5, None), (None, 2.0, "c1")]


def test_fences_of_small_flat_and_unknown_areas(spark):
    data = [("nine", float(i % 3) * 1000) for i in range(9)]           # too few: all stay
    data += [("ten", 100.0 + i) for i in range(9)] + [("ten", 9999.0)]  # one outlier goes
    data += [("flat", 50.0) for _ in range(12)]                        # quartiles coincide: all go
    data += [(None, 5.0)]                                              # no area: goes
    df = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(data)],
                               "c string, v double, id int")
    for max_rows in (200_000, 0):
        out = remove_iqr_outliers(df, "c", ["v"], ["id"], max_rows=max_rows)
        assert out.columns == df.columns
        assert {r.c: r["count"] for r in out.groupBy("c").count().collect()} == {"nine": 9, "ten": 9}
    loose = remove_iqr_outliers(df, "c", ["v"], ["id"], strict=False)
    assert loose.where("c = 'flat'").count() == 12
    assert iqr_fences(df, "c", ["v"]).where("c = 'ten'").first().group_rows == 10


def test_bounds_are_open_and_come_first(spark):
    df = spark.createDataFrame([(1, 5.0, "c"), (2, 6.0, "c"), (3, 999.0, "c"), (4, 1000.0, "c"),
                                (5, None, "c")], "id int, s double, c string")
    out = remove_outliers(df, {"s": (5, 1000)}, "c", ["id"])
    assert rows(out, "id") == [(2,), (3,)]


def test_time_index_targets(spark):
    data = [("A", 2024, 100.0), ("A", 2024, 300.0), ("A", 2025, 400.0),   # to 2025: x2, x1
            ("B", 2022, 50.0), ("B", 2023, 100.0),                        # no 2025: to 2023
            ("C", 2025, 10.0), ("C", 2024, 0.0),                          # median 0: factor 1
            (None, 2024, 7.0)]                                            # null key: factor 1
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(data)],
                               "k string, y int, p double, id int")
    for max_rows in (200_000, 0):
        out = adjust_prices(df, ["k"], "y", "p", 2025, "adj", ["id"], max_rows=max_rows)
        assert [r.adj for r in out.orderBy("id").collect()] == [
            200.0, 600.0, 400.0, 100.0, 100.0, 10.0, 0.0, 7.0]
    assert {r.factor for r in median_index(df, ["k"], "y", "p", 2025).where("k='A'").collect()} \
        == {2.0, 1.0}


def test_top_groups_breaks_ties_by_name(spark):
    df = spark.createDataFrame(
        [("b", "H", 1.0), ("a", "F", 2.0), ("c", "H", 3.0), ("c", "F", 5.0), ("d", "X", 9.0),
         ("e", "H", 0.0), ("e", "H", None)], "city string, t string, p double")
    roles = PriceRoles("p", "a", "t", "H", "F", "d")
    out = top_groups(df, "city", 2, roles).collect()
    assert [(r.name, r.nb_transactions, r.prix_m2_median, r.prix_m2_maison_median) for r in out] \
        == [("c", 2, 4.0, 3.0), ("a", 1, 2.0, None)]


def test_top_by_needs_enough_rows(spark):
    df = spark.createDataFrame([("a", 60, 1.0), ("b", 40, 9.0), ("c", 50, 2.0), ("d", 70, None)],
                               "k string, nb_transactions int, m double")
    assert [r.k for r in top_by(df, "m", 10, "k", 50).collect()] == ["c", "a", "d"]
