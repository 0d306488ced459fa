"""Exact medians and nearest-rank quantiles per group.

Two ways with one answer:

``arrays``  one shuffle; each group's values are sorted in an array. For groups
            small enough for one task.
``rank``    for groups of any size. A monotone function cuts the value axis into
            buckets. Counting rows per (group, bucket), which combines map-side,
            tells in which bucket each wanted rank lies. Wanted buckets that are
            still large are cut again; the rows of the rest are ranked. No task
            ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.operators.skew import BROADCAST_BYTES, BROADCAST_ROWS, key_struct, split_heavy
from terrier.session import staged

#: Groups above this many rows go the ``rank`` way under ``auto``.
ARRAY_ROWS = 100_000
#: Buckets per doubling of (1 + |value|), and pieces a large bucket is cut into.
RESOLUTION = 64
PIECES = 1024
#: A bucket with more rows than this is cut before its rows are ranked.
BUCKET_ROWS = 1_000_000


@dataclass(frozen=True)
class Stat:
    """One order statistic: of ``value``, over the rows of ``subset`` (all when None)."""

    name: str
    value: str
    q: float = 0.5
    median: bool = True
    subset: str | None = None

    def ranks(self, n: str) -> tuple[str, str]:
        """SQL for the zero-based ranks, among ``n`` values, whose mean is the statistic."""
        if self.median:
            return f"(({n} - 1) div 2)", f"({n} div 2)"
        at = f"cast(round(({n} - 1) * {self.q!r}D) as bigint)"
        return at, at


def median(name: str, value: str, subset: str | None = None) -> Stat:
    """Middle value, or the mean of the two middle values."""
    return Stat(name, value, subset=subset)


def nearest(name: str, value: str, q: float, subset: str | None = None) -> Stat:
    """The value at rank ``round(q * (n - 1))``; never interpolated."""
    return Stat(name, value, q, median=False, subset=subset)


def order_stats(df: DataFrame, keys: Sequence[str], stats: Sequence[Stat],
                subsets: Mapping[str, Column] | None = None, strategy: str = "auto",
                aggs: Sequence[Column] = (), array_rows: int = ARRAY_ROWS,
                resolution: int = RESOLUTION, bucket_rows: int = BUCKET_ROWS,
                broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, one column per statistic, and ``aggs``: other named aggregates.

    Null values are skipped and null keys form groups. A group without any value
    for a statistic gets null there, whatever the strategy.
    """
    subsets = dict(subsets or {})

    def rank(rows: DataFrame) -> DataFrame:
        ranked = _by_rank(rows, keys, stats, subsets, resolution, bucket_rows, broadcast_rows)
        # two tables with one row per group; groups without a value have no ranks
        plain = rows.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("__n")])).withColumn(
            "__k", key_struct(keys))
        both = plain.join(ranked.withColumn("__k", key_struct(keys)).drop(*keys), "__k", "left")
        return both.drop("__k") if aggs else both.drop("__k", "__n")

    if strategy == "arrays":
        return _by_arrays(df, keys, stats, subsets, aggs)
    if strategy == "rank":
        return rank(df)
    if strategy != "auto":
        raise ValueError(f"strategy must be auto, arrays or rank, not {strategy!r}")
    light, heavy = split_heavy(df, keys, array_rows)
    out = _by_arrays(light, keys, stats, subsets, aggs)
    return out if heavy is None else out.unionByName(rank(heavy))


def _pairs(stats: Sequence[Stat]) -> dict[tuple[str, str | None], str]:
    seen: dict[tuple[str, str | None], str] = {}
    for s in stats:
        seen.setdefault((s.value, s.subset), f"__a{len(seen)}")
    return seen


def _by_arrays(df: DataFrame, keys: Sequence[str], stats: Sequence[Stat],
               subsets: Mapping[str, Column], aggs: Sequence[Column]) -> DataFrame:
    arrays = _pairs(stats)
    sorted_values = [
        F.array_sort(F.collect_list(
            F.col(value).cast("double") if subset is None
            else F.when(subsets[subset], F.col(value).cast("double")))).alias(a)
        for (value, subset), a in arrays.items()
    ]
    grouped = df.groupBy(*keys).agg(*aggs, *sorted_values)

    def pick(stat: Stat) -> str:
        a = arrays[stat.value, stat.subset]
        lo, hi = (f"get({a}, cast({r} as int))" for r in stat.ranks(f"size({a})"))
        return lo if not stat.median else f"({lo} + {hi}) / 2"

    return grouped.select("*", *[F.expr(pick(s)).alias(s.name) for s in stats]).drop(
        *arrays.values())


def _bucket(v: str, resolution: int) -> str:
    """SQL for a bucket number that never falls as ``v`` rises; NaN sorts last, as in Spark."""
    level = f"floor(signum({v}) * log2(abs({v}) + 1) * {resolution})"
    end = 2**29
    return f"case when isnan({v}) then {2 * end}L else least({end}L, greatest(-{end}L, {level})) end"


def _by_rank(df: DataFrame, keys: Sequence[str], stats: Sequence[Stat],
             subsets: Mapping[str, Column], resolution: int, bucket_rows: int,
             broadcast_rows: int) -> DataFrame:
    # expressions are SQL text here: there are many, and text is cheap to hand over
    values = list(dict.fromkeys(s.value for s in stats))
    labels = list(dict.fromkeys(s.subset for s in stats))
    at = {label: i for i, label in enumerate(labels)}
    every = range(len(labels))
    flags, totals = [f"in{i}" for i in every], [f"n{i}" for i in every]
    inside = [F.lit(True) if label is None else F.coalesce(subsets[label], F.lit(False))
              for label in labels]
    measures = F.array(*[F.struct(F.lit(m).alias("m"), F.col(v).cast("double").alias("v"))
                         for m, v in enumerate(values)])
    # one row per (row, measured column), with its subset flags
    points = (
        df.select(key_struct(keys).alias("k"), *[c.alias(n) for c, n in zip(inside, flags)],
                  F.explode(measures).alias("p"))
        .selectExpr("k", "p.m", "p.v", *flags, f"{_bucket('p.v', resolution)} as b")
        .where("v is not null"))
    counts = [F.expr(f"count_if(in{i}) as c{i}") for i in every]
    extent = [F.expr("min(v) as lo"), F.expr("max(v) as hi"), F.expr("count(1) as size")]

    def holds(stat: Stat, which: int, start: str) -> str:
        i = at[stat.subset]
        r = stat.ranks(f"n{i}")[which]
        return (f"m = {values.index(stat.value)} and n{i} > 0 "
                f"and {r} >= {start}{i} and {r} < {start}{i} + c{i}")

    needed = " or ".join(f"({holds(s, w, 'o')})" for s in stats for w in range(1 + s.median))

    def before(over: str) -> list[str]:
        along = f"(partition by {over} order by b rows unbounded preceding)"
        return [f"sum(c{i}) over {along} - c{i} as o{i}" for i in every]

    def wanted(buckets: DataFrame) -> DataFrame:
        """The buckets that hold a wanted rank, with the ranks before them (``o``)."""
        return staged(buckets.where(needed).drop(*[f"c{i}" for i in every]))

    targets = wanted(points.groupBy("k", "m", "b").agg(*counts, *extent).selectExpr(
        "*", *before("k, m"), *[f"sum(c{i}) over (partition by k, m) as n{i}" for i in every]))
    on = ["k", "m", "b"]
    n_targets, largest, weight = targets.agg(
        F.count(F.lit(1)), F.max(F.when(F.col("lo") < F.col("hi"), F.col("size"))),
        F.coalesce(F.sum(F.length(F.to_json("k")) + 128), F.lit(0))).first()
    small = n_targets <= broadcast_rows and weight <= BROADCAST_BYTES

    def sent(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if small else table

    while (largest or 0) > bucket_rows:  # each cut parts a bucket's least from its largest value
        # cut evenly between the bucket's own least and largest value
        cut = (f"case when lo < hi then least({PIECES - 1}L, floor((v - lo) / (hi - lo) * {PIECES}))"
               " else 0L end")
        points = points.join(sent(targets.select(*on, "lo", "hi")), on).selectExpr(
            "k", "m", "b as parent", "v", *flags, f"b * {PIECES} + {cut} as b")
        parents = targets.selectExpr("k", "m", "b as parent", *totals,
                                     *[f"o{i} as p{i}" for i in every])
        pieces = points.groupBy("k", "m", "parent", "b").agg(*counts, *extent).selectExpr(
            "*", *before("k, m, parent"))
        deeper = pieces.join(sent(parents), ["k", "m", "parent"]).selectExpr(
            "k", "m", "b", *[f"c{i}" for i in every], "lo", "hi", "size", *totals,
            *[f"o{i} + p{i} as o{i}" for i in every])
        points = points.drop("parent")
        targets = wanted(deeper)
        largest = targets.agg(
            F.max(F.when(F.col("lo") < F.col("hi"), F.col("size")))).first()[0]

    targets = targets.drop("lo", "hi", "size")
    if small:
        # the scan keeps only rows of wanted buckets, before anything is shuffled
        near = points.join(F.broadcast(targets.select(*on)), on, "left_semi")
        ties = near.groupBy(*on, "v").agg(*counts).join(F.broadcast(targets), on)
    else:
        ties = points.groupBy(*on, "v").agg(*counts).join(targets, on)

    up = "(partition by k, m, b order by v rows unbounded preceding)"
    ranked = ties.selectExpr(
        "k", "m", "v", *totals, *[f"c{i}" for i in every],
        *[f"o{i} + sum(c{i}) over {up} - c{i} as r{i}" for i in every])

    def value(stat: Stat) -> str:
        lo, hi = (f"max(case when {holds(stat, w, 'r')} then v end)" for w in (0, 1))
        return lo if not stat.median else f"({lo} + {hi}) / 2"

    return ranked.groupBy("k").agg(*[F.expr(value(s)).alias(s.name) for s in stats]).select(
        "k.*", *[s.name for s in stats])
