"""Statistics of several geographic levels and time spans from shared passes.

Spans are open-ended, so they nest: each row falls in one slice, numbered from the
narrowest span that holds it, and span i is the slices up to i. Rows are never
multiplied by spans or levels.

``nested_levels``  levels whose groups are unions of the finest one's. Rows are counted
                   once per (finest group, slice, kind, value bucket); that table rolls
                   up to every level and span. The buckets that hold wanted ranks are
                   then read in a second pass for all levels together.
``sliced_level``   a level of small groups: one grouping, spans cut from its arrays.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.operators import order_stats as O
from terrier.operators.price_stats import COUNT_COLUMNS, STAT_COLUMNS, Level, PriceRoles, _quantiles, level_stats
from terrier.operators.skew import BROADCAST_ROWS, fits_broadcast, split_heavy
from terrier.session import staged

#: Buckets per doubling of (1 + |value|). The table rolled up is this fine; the second pass reads about a
#: dozen of them for each group and span.
RESOLUTION = 16
#: Kinds by number; 2 is every other.
_SUBSETS = {None: "true", "house": "kind = 0", "flat": "kind = 1"}
_TAGS = {None: "", "house": "_maison", "flat": "_appart"}


def _narrowest_first(spans: Mapping[str, date | None]) -> list[str]:
    return sorted(spans, key=lambda n: (spans[n] is None, -(spans[n].toordinal() if spans[n] else 0)))


def _sliced(df: DataFrame, spans: Mapping[str, date | None], roles: PriceRoles) -> DataFrame:
    """Add ``slice`` and ``kind`` numbers and both prices as doubles; rows outside all spans go."""
    slice_ = F.coalesce(*[F.when(F.lit(True) if spans[n] is None else F.col(roles.day) >= F.lit(spans[n]), i)
                          for i, n in enumerate(_narrowest_first(spans))])
    kind = F.when(F.col(roles.kind) == roles.house, 0).when(F.col(roles.kind) == roles.flat, 1).otherwise(2)
    return df.withColumns({"__slice": slice_, "__kind": kind, "__price": F.col(roles.price).cast("double"),
                           "__adjusted": F.col(roles.adjusted).cast("double")}).where("__slice IS NOT NULL")


def _finished(out: DataFrame, level: Level, every: Sequence[str]) -> DataFrame:
    """Columns of ``level_stats``; a level without keys has a row for each span."""
    if not level.keys:
        spans = out.sparkSession.createDataFrame([(s,) for s in every], "span string")
        out = spans.join(out, "span", "left").fillna(0, list(COUNT_COLUMNS))
    out = out.withColumns({n: F.lit(v) for n, v in level.constants.items()})
    return out.select("span", *level.constants, *level.keys, *STAT_COLUMNS, *level.firsts)


def nested_levels(df: DataFrame, levels: Mapping[str, Level], roles: PriceRoles,
                  spans: Mapping[str, date | None], resolution: int = RESOLUTION,
                  bucket_rows: int = O.BUCKET_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> dict[str, DataFrame]:
    """Statistics of levels that take no first values, in two passes over ``df`` for all of them.

    Every wanted bucket of more than ``bucket_rows`` rows costs one pass more, in which
    all of them are cut. Null keys form groups. Results are those of ``level_stats``.
    """
    names, stats = _narrowest_first(spans), _quantiles(roles)
    finest = list(dict.fromkeys(c for level in levels.values() for c in level.keys))
    kinds = dict(df.dtypes)
    points = _sliced(df, spans, roles).select(
        F.struct(F.lit(0).alias("all"), *finest).alias("k"), F.col("__slice").alias("slice"), F.col("__kind").alias("kind"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(v).alias("v")) for m, v in enumerate(("__price", "__adjusted"))])).alias("p"))
    points = points.selectExpr("k", "slice", "kind", "p.m", "p.v", f"if(p.v is null, null, {O._bucket('p.v', resolution)}) as b")
    at = {label: i for i, label in enumerate(_SUBSETS)}
    every, measure = range(len(at)), {roles.price: 0, roles.adjusted: 1}
    counts = [F.expr(f"sum(if({cond}, n, 0)) as c{i}") for i, cond in enumerate(_SUBSETS.values())]
    place = ["group", "span", "m"]

    def light(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if fits_broadcast(table, max_rows=broadcast_rows) else table

    # first pass
    tally = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    hist = staged(points.groupBy("k", "slice", "kind", "m", "b").agg(*tally, F.sum("v").alias("total")))
    # every finest group and the group of each level around it, by number
    around = hist.select("k").distinct().select("k", F.explode(F.array(*[
        F.struct(F.lit(n).alias("level"), F.struct(F.lit(0).alias("all"), *[
            (F.col(f"k.{c}") if c in level.keys else F.lit(None).cast(kinds[c])).alias(c) for c in finest]).alias("key"))
        for n, level in levels.items()])).alias("g")).select("k", "g.*")
    groups = staged(around.select("level", "key").distinct().withColumn("group", F.monotonically_increasing_id()))
    homes = staged(around.join(groups, ["level", "key"]).select("k", "group"))
    homes = light(homes)

    def rolled(table: DataFrame, by: Sequence[str], *more: Column, only: DataFrame | None = None) -> DataFrame:
        """Counts of the groups of every level and span, from those of the finest groups and slices."""
        wide = table.join(homes, "k").withColumn("span", F.explode(F.sequence("slice", F.lit(len(names) - 1))))
        wide = wide if only is None else wide.join(only, [*place, "b"], "left_semi")
        return wide.groupBy(*place, *by).agg(*counts, *more)

    def holds(stat: O.Stat, which: int, start: str) -> str:
        i = at[stat.subset]
        r = stat.ranks(f"n{i}")[which]
        return (f"m = {measure[stat.value]} and n{i} > 0 and {r} >= {start}{i} and {r} < {start}{i} + c{i}")
    needed = " or ".join(f"({holds(s, w, 'o')})" for s in stats for w in range(1 + s.median))

    def before(over: str) -> list[str]:
        return [f"sum(c{i}) over (partition by {over} order by b rows unbounded preceding) - c{i} as o{i}" for i in every]

    def wanted(buckets: DataFrame) -> DataFrame:
        return staged(buckets.where(needed).drop(*[f"c{i}" for i in every]))

    extent = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("size")]
    totals = [F.expr(f"sum(if({cond}, total, null)) / sum(if({cond} and b is not null, n, null)) as prix_m2{_TAGS[label]}_mean")
              for label, cond in _SUBSETS.items()]
    plain = rolled(hist.where("m = 0"), [], *totals).withColumnsRenamed(dict(zip([f"c{i}" for i in every], COUNT_COLUMNS))).drop("m")
    over = ", ".join(place)
    targets = wanted(rolled(hist.where("b is not null"), ["b"], *extent).selectExpr(
        "*", *before(over), *[f"sum(c{i}) over (partition by {over}) as n{i}" for i in every]))

    def near(rows: DataFrame, table: DataFrame) -> DataFrame:
        """The rows in buckets that any group around their finest one wants."""
        return rows.join(light(staged(table.join(homes, "group").select("k", "m", "b").distinct())), ["k", "m", "b"], "left_semi")

    points = near(points, targets)
    largest = targets.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("size")))).first()[0]
    while (largest or 0) > bucket_rows:  # cut every wanted bucket evenly, alike for all groups
        cuts = staged(targets.groupBy("m", "b").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        piece = (f"case when lo < hi then least({O.PIECES - 1}L, floor((v - lo) / (hi - lo) * {O.PIECES})) else 0L end")
        points = points.join(light(cuts), ["m", "b"]).selectExpr("k", "slice", "kind", "m", "v", "b as parent", f"b * {O.PIECES} + {piece} as b")
        hist = staged(points.groupBy("k", "slice", "kind", "m", "parent", "b").agg(*tally))
        parents = targets.selectExpr(*place, "b as parent", *[f"n{i}" for i in every], *[f"o{i} as p{i}" for i in every])
        pieces = rolled(hist, ["parent", "b"], *extent).selectExpr("*", *before(f"{over}, parent"))
        targets = wanted(pieces.join(parents, [*place, "parent"]).selectExpr(
            *place, "b", *[f"c{i}" for i in every], "lo", "hi", "size", *[f"n{i}" for i in every],
            *[f"o{i} + p{i} as o{i}" for i in every]))
        points = near(points.drop("parent"), targets)
        largest = targets.agg(F.max(F.when(F.col("lo") < F.col("hi"), F.col("size")))).first()[0]

    # second pass: the values of the wanted buckets
    ties = points.groupBy("k", "slice", "kind", "m", "b", "v").agg(F.count(F.lit(1)).alias("n"))
    asked = light(targets.drop("lo", "hi", "size"))
    known = rolled(ties, ["b", "v"], only=asked).join(asked, [*place, "b"])
    up = f"(partition by {over}, b order by v rows unbounded preceding)"
    ranked = known.selectExpr(*place, "v", *[f"n{i}" for i in every], *[f"c{i}" for i in every],
                              *[f"o{i} + sum(c{i}) over {up} - c{i} as r{i}" for i in every])

    def value(stat: O.Stat) -> str:
        lo, hi = (f"max(case when {holds(stat, w, 'r')} then v end)" for w in (0, 1))
        return lo if not stat.median else f"({lo} + {hi}) / 2"
    ranks = ranked.groupBy("group", "span").agg(*[F.expr(value(s)).alias(s.name) for s in stats])
    both = staged(plain.join(ranks, ["group", "span"], "left").join(groups, "group"))
    span = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("span") + 1)
    return {n: _finished(both.where(F.col("level") == n).select(
        span.alias("span"), *[F.col(f"key.{c}").alias(c) for c in level.keys], *STAT_COLUMNS), level, list(spans))
        for n, level in levels.items()}


def sliced_level(df: DataFrame, level: Level, roles: PriceRoles, spans: Mapping[str, date | None],
                 order_by: Sequence[str] = (), array_rows: int = O.ARRAY_ROWS) -> DataFrame:
    """Statistics of one level and all spans from one grouping; groups above ``array_rows`` go the ``rank`` way."""
    if level.not_null:
        df = df.where(F.col(level.not_null).isNotNull())
    light, heavy = split_heavy(df, list(level.keys), array_rows)
    names = _narrowest_first(spans)
    rows = _sliced(light, spans, roles)
    if level.firsts:
        place = F.struct(*order_by)
        firsts = [F.collect_list(F.struct(place.alias("place"), F.col("__slice").alias("slice"), F.struct(*level.firsts).alias("f"))).alias("__first")]
    else:
        firsts = []
    grouped = rows.groupBy(*level.keys).agg(*[F.array_sort(F.collect_list(F.struct(
        F.col(f"__{v}").alias("v"), F.col("__kind").alias("kind"), F.col("__slice").alias("slice")))).alias(f"__{v}s")
        for v in ("price", "adjusted")], *firsts)
    each = grouped.withColumn("__span", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    for v in ("price", "adjusted"):  # sorted arrays of the span, then of its kinds
        each = each.withColumn(f"__{v}s", F.filter(f"__{v}s", lambda x: x["slice"] <= F.col("__span")))
    each = each.where(F.size("__prices") > 0)
    arrays = {}
    for measure, v in ((roles.price, "price"), (roles.adjusted, "adjusted")):
        for label, kind in ((None, None), ("house", 0), ("flat", 1)):
            arrays[measure, label] = name = f"__{v}_{label or 'all'}"
            kept = "v is not null" if kind is None else f"v is not null and x.kind = {kind}"
            each = each.withColumn(name, F.expr(f"transform(filter(__{v}s, x -> x.{kept}), x -> x.v)"))

    def pick(stat: O.Stat) -> Column:
        a = arrays[stat.value, stat.subset]
        lo, hi = (f"get({a}, cast({r} as int))" for r in stat.ranks(f"size({a})"))
        return F.expr(lo if not stat.median else f"({lo} + {hi}) / 2").alias(stat.name)

    def mean(label: str | None) -> Column:
        a = arrays[roles.price, label]
        return F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).alias(f"prix_m2{_TAGS[label]}_mean")

    def number(kind: int) -> Column:
        return F.size(F.filter("__prices", lambda x: x["kind"] == kind)).cast("long")
    first = F.array_min(F.filter("__first", lambda x: x["slice"] <= F.col("__span")))["f"] if firsts else None
    out = each.select(
        F.element_at(F.array(*[F.lit(n) for n in names]), F.col("__span") + 1).alias("span"), *level.keys,
        F.size("__prices").cast("long").alias("nb_transactions"), number(0).alias("nb_maisons"), number(1).alias("nb_appartements"),
        *[mean(label) for label in _TAGS], *[pick(s) for s in _quantiles(roles)], *[first[c].alias(c) for c in level.firsts])
    out = _finished(out, level, list(spans))
    if heavy is None:
        return out
    return out.unionByName(level_stats(heavy, level, roles, spans, order_by, array_rows))


def all_levels(df: DataFrame, levels: Mapping[str, Level], roles: PriceRoles, spans: Mapping[str, date | None],
               order_by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Statistics of every level and span: big levels in shared passes, the others by one grouping each."""
    big = {n: level for n, level in levels.items() if level.big and not level.firsts and not level.not_null}
    out = nested_levels(df, big, roles, spans) if big else {}
    return {n: out[n] if n in out else sliced_level(df, level, roles, spans, order_by) for n, level in levels.items()}
