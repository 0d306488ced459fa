import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from terrier.operators import groups, skew

KEYS = ["m", "p"]
MODES = [("light", 10), ("heavy", 10), ("auto", 5)]


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("mode,light_rows", MODES)
def test_all_rows_of_the_first_category_stay(spark, mode, light_rows):
    df = frame(spark, [
        ("A", "1", "sol", 1), ("A", "1", "pre", 2), ("A", "1", "sol", 3),   # sol wins, twice
        ("A", "2", None, 1), ("A", "2", "sol", 2),                          # a null comes first
        ("B", None, "sol", 1),                                              # a null key
        ("C", "9", "bois", 5), ("C", "9", "pre", 4)], "m string, p string, use string, seq int")
    out = groups.keep_first_category(df, KEYS, "use", ["seq"], mode, light_rows)
    assert rows(out, "m", "p", "use", "seq") == [
        ("A", "1", "sol", 1), ("A", "1", "sol", 3), ("C", "9", "pre", 4)]


@pytest.mark.parametrize("mode,light_rows", MODES)
def test_flag_is_null_for_null_keys_and_false_when_unknown(spark, mode, light_rows):
    df = frame(spark, [("A", "1", "Dep", 1), ("A", "1", "Mai", 2), ("A", "2", None, 3),
                       ("B", None, "Dep", 4)], "m string, p string, t string, seq int")
    out = groups.flag_group(df, KEYS, F.col("t") == "Dep", "dep", ["seq"], mode, light_rows)
    assert rows(out, "seq", "dep") == [(1, True), (2, True), (3, False), (4, None)]


@pytest.mark.parametrize("mode,light_rows", MODES)
def test_totals_and_shares(spark, mode, light_rows):
    df = frame(spark, [("A", 1, 120.0, 317000.0, 1), ("A", 1, 55.0, 317000.0, 2),
                       ("A", 2, 75.0, 180000.0, 3), ("B", 1, None, None, 4),
                       (None, 1, 10.0, 5.0, 5)],
               "m string, d long, s double, v double, seq int")
    out = groups.group_totals(df, ["m", "d"], {"total": "s"}, {"mean": "v"}, ["seq"], mode,
                              light_rows)
    out = groups.allocate(out, "mean", "total", "s", "share")
    got = {r.seq: (r.total, r["mean"], r.share) for r in out.collect()}
    assert got[1][0] == 175.0 and got[3][0] == 75.0
    assert got[1][2] + got[2][2] == pytest.approx(317000.0)
    assert got[4] == (0.0, None, None)          # an all-null sum is 0
    assert got[5] == (None, None, None)         # null keys match nothing


@pytest.mark.parametrize("mode", ["light", "auto"])
def test_reduce_keeps_nulls_order_and_alignment(spark, mode):
    df = frame(spark, [("A", 3, None, "z", 2), ("A", 1, None, None, None), ("A", 2, 5, "y", 1),
                       (None, 1, 7, "n", 4)],
               "m string, seq int, a int, b string, rooms long")
    out = groups.reduce_groups(df.withColumn("fa", F.col("a")), ["m"], ["seq"], ["fa"],
                               ["a", "b"], ["rooms"], mode=mode)
    assert [(r.m, r.fa, r.a, r.b, r.rooms) for r in out.orderBy("m").collect()] == [
        (None, 7, [7], ["n"], 4), ("A", None, [None, 5, None], [None, "y", "z"], 3)]


def test_reduce_all_null_sum_is_zero(spark):
    df = frame(spark, [("A", 1, None), ("A", 2, None)], "m string, seq int, rooms long")
    assert groups.reduce_groups(df, ["m"], ["seq"], sums=["rooms"]).first().rooms == 0


@pytest.mark.parametrize("light_rows", [1_000_000, 100, 3])
def test_a_group_is_one_row_whatever_its_size(spark, light_rows):
    data = [("hot", i // 50, i, i * 3 % 11) for i in range(400)] + [("cold", 0, 1, 4), (None, 2, 5, None)]
    df = frame(spark, data, "m string, day int, seq int, v int").repartition(5)
    out = groups.reduce_groups(df, ["m"], ["day", "seq"], ["day"], ["v", "seq"],
                               part_by=["day"], light_rows=light_rows)
    assert rows(out, "m", "day", "v", "seq") == [
        ("cold", 0, [4], [1]), ("hot", 0, [i * 3 % 11 for i in range(400)], list(range(400))),
        (None, 2, [None], [5])]
    pieces = groups.list_pieces(df, ["m"], ["day", "seq"], ["v", "seq"], ["day"])
    hot = pieces.where("m = 'hot'").orderBy("part").collect()
    assert [r.part for r in hot] == list(range(8))
    assert [s for r in hot for s in r.seq] == list(range(400))
    assert pieces.where("m is null").first().v == [None]


def test_uniqueness(spark):
    df = frame(spark, [(1,), (1,), (2,)], "k int")
    assert tuple(groups.duplicate_keys(df, F.col("k")).first()) == (3, 2, False)
    with pytest.raises(ValueError):
        groups.require_unique(df, F.col("k"))
    assert groups.require_unique(df.distinct(), F.col("k")).count() == 2


def test_attach_spreads_heavy_keys_and_equals_a_plain_join(spark):
    rng = random.Random(7)
    fact = frame(spark, [(None if i % 7 == 0 else "hot" if i % 3 else f"k{rng.randrange(40)}", i)
                         for i in range(3000)], "k string, id int")
    lookup = frame(spark, [("hot", 1.0)] + [(f"k{i}", float(i)) for i in range(35)],
                   "k string, v double")
    for how in ("left", "inner"):
        plain = rows(fact.join(lookup, "k", how), "k", "id", "v")
        salted = skew.attach(fact, lookup, ["k"], ["id"], how, max_rows=0, light_rows=100)
        assert rows(salted, "k", "id", "v") == plain
        assert rows(skew.attach(fact, lookup, ["k"], ["id"], how), "k", "id", "v") == plain


def test_split_keeps_every_row_once(spark):
    df = frame(spark, [(None, i) for i in range(50)] + [("a", i) for i in range(3)],
               "k string, id int")
    light, heavy = skew.split_heavy(df, ["k"], light_rows=10)
    assert light.count() == 3 and heavy.count() == 50
    assert skew.split_heavy(df, ["k"])[1] is None


@pytest.mark.parametrize("buckets", [1, 1 << 16])
def test_many_keys_split_alike_and_are_not_counted_one_by_one(spark, monkeypatch, buckets):
    monkeypatch.setattr(skew, "KEY_BUCKETS", buckets)  # in one bucket light keys are counted with heavy ones
    data = [(None, 1, i) for i in range(12)] + [("a", None, i) for i in range(11)] + [(f"k{i}", i % 3, i) for i in range(40)]
    df = frame(spark, data, "k string, p int, id int").repartition(3)
    for light_rows in (0, 10, 11, 50):
        both = [skew.split_heavy(df, ["k", "p"], light_rows, many) for many in (False, True)]
        (light, heavy), (other, others) = both
        assert rows(light) == rows(other) and (heavy is None) == (others is None)
        assert heavy is None or rows(heavy) == rows(others)
    monkeypatch.setattr(skew, "heavy_keys", None)  # every key of its own, and the bucket of all of them, is small
    assert skew.split_heavy(df, ["k", "p"], 1000, many=True)[1] is None


@pytest.mark.parametrize("light_rows", [1_000_000, 40, 0])
def test_items_have_running_numbers_at_any_size(spark, light_rows):
    rng = random.Random(light_rows)
    data = [(rng.choice([None, "a", "b", "c"]) if i % 3 else "hot", i // 2 if i % 5 else None, i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, day int, seq int, v int").repartition(7)
    out = groups.number_items(df, ["k"], ["day", "seq"], {"total": "v"}, light_rows=light_rows)
    assert out.columns == ["k", "day", "seq", "v", "position", "total"]
    want = []
    for k in (None, "a", "b", "c", "hot"):
        own = sorted((r for r in data if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        total = sum(r[3] or 0 for r in own)
        want += [(*r, i, total) for i, r in enumerate(own)]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[2]) == sorted(want, key=lambda r: r[2])
    none = groups.number_items(df.where("false"), ["k"], ["seq"], {"total": "v"}, light_rows=light_rows)
    assert none.count() == 0
