"""Price statistics by geographic level and time span, and the ranked reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.operators.order_stats import ARRAY_ROWS, Stat, median, nearest, order_stats
from terrier.session import staged


@dataclass(frozen=True)
class PriceRoles:
    """Which columns play which part."""

    price: str = "prix_m2"
    adjusted: str = "prix_m2_ajuste"
    kind: str = "type_local"
    house: str = "Maison"
    flat: str = "Appartement"
    day: str = "date_mutation"


@dataclass(frozen=True)
class Level:
    """One geographic level. ``big`` marks levels with few, large groups, whose spans share passes."""

    keys: tuple[str, ...]
    not_null: str | None = None
    firsts: tuple[str, ...] = ()
    big: bool = False
    constants: Mapping[str, str] = field(default_factory=dict)


#: Fixed output names, in output order.
STAT_COLUMNS = (
    "nb_transactions", "nb_maisons", "nb_appartements",
    "prix_m2_mean", "prix_m2_q25", "prix_m2_median", "prix_m2_q75",
    "prix_m2_maison_mean", "prix_m2_maison_q25", "prix_m2_maison_median", "prix_m2_maison_q75",
    "prix_m2_appart_mean", "prix_m2_appart_q25", "prix_m2_appart_median", "prix_m2_appart_q75",
    "prix_m2_ajuste_median", "prix_m2_ajuste_maison_median", "prix_m2_ajuste_appart_median",
)
COUNT_COLUMNS = STAT_COLUMNS[:3]


def _quantiles(roles: PriceRoles) -> list[Stat]:
    out: list[Stat] = []
    for tag, subset in (("", None), ("_maison", "house"), ("_appart", "flat")):
        out += [nearest(f"prix_m2{tag}_q25", roles.price, 0.25, subset),
                median(f"prix_m2{tag}_median", roles.price, subset),
                nearest(f"prix_m2{tag}_q75", roles.price, 0.75, subset),
                median(f"prix_m2_ajuste{tag}_median", roles.adjusted, subset)]
    return out


def price_stats(df: DataFrame, keys: Sequence[str], roles: PriceRoles = PriceRoles(),
                firsts: Sequence[str] = (), order_by: Sequence[str] = (),
                strategy: str = "auto", array_rows: int = ARRAY_ROWS) -> DataFrame:
    """``keys``, the 18 statistics, and the first value of each of ``firsts`` per group."""
    kind, price = F.col(roles.kind), F.col(roles.price)
    house, flat = kind == roles.house, kind == roles.flat
    aggs = [
        F.count(F.lit(1)).alias("nb_transactions"),
        F.count_if(house).alias("nb_maisons"),
        F.count_if(flat).alias("nb_appartements"),
        F.avg(price).alias("prix_m2_mean"),
        F.avg(F.when(house, price)).alias("prix_m2_maison_mean"),
        F.avg(F.when(flat, price)).alias("prix_m2_appart_mean"),
    ]
    # the struct keeps a null first value, which min_by alone would skip
    aggs += [F.min_by(F.struct(c), F.struct(*order_by)).alias(f"__{c}") for c in firsts]
    out = order_stats(df, keys, _quantiles(roles), {"house": house, "flat": flat}, strategy, aggs,
                      array_rows=array_rows)
    return out.select(*keys, *STAT_COLUMNS, *[F.col(f"__{c}")[c].alias(c) for c in firsts])


def in_spans(df: DataFrame, spans: Mapping[str, date | None], day: str) -> DataFrame:
    """One row per (row, span it falls in), in a new column ``span``."""
    names = F.array(*[
        F.lit(n) if start is None else F.when(F.col(day) >= F.lit(start), F.lit(n))
        for n, start in spans.items()])
    return df.withColumn("span", F.explode(F.array_compact(names)))


def level_stats(df: DataFrame, level: Level, roles: PriceRoles = PriceRoles(),
                spans: Mapping[str, date | None] | None = None,
                order_by: Sequence[str] = (), array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Statistics of one level; with ``spans``, one row per group and span.

    A level without keys has exactly one row per span, also for an empty input.
    """
    if level.not_null:
        df = df.where(F.col(level.not_null).isNotNull())
    if spans is not None:
        df = in_spans(df, spans, roles.day)
        tags = ["span"]
    else:
        df = df.withColumn("span", F.lit("all"))
        spans, tags = {"all": None}, []
    out = price_stats(df, ["span", *level.keys], roles, level.firsts, order_by,
                      "auto" if level.keys else "rank", array_rows)
    if not level.keys:
        every = df.sparkSession.createDataFrame([(s,) for s in spans], "span string")
        out = every.join(out, "span", "left").fillna(0, list(COUNT_COLUMNS))
    out = out.withColumns({n: F.lit(v) for n, v in level.constants.items()})
    return out.select(*tags, *level.constants, *level.keys, *STAT_COLUMNS, *level.firsts)


def span_counts(df: DataFrame, spans: Mapping[str, date | None], day: str) -> DataFrame:
    """Rows per span, in one pass and without multiplying rows."""
    counts = df.agg(*[
        F.count(F.lit(1)).alias(n) if start is None
        else F.count_if(F.col(day) >= F.lit(start)).alias(n) for n, start in spans.items()])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("span"), F.col(f"`{n}`").alias("n_rows")) for n in spans
    ])).alias("r")).select("r.*")


def top_groups(df: DataFrame, name: str, limit: int = 50,
               roles: PriceRoles = PriceRoles()) -> DataFrame:
    """The ``limit`` names with most rows, with counts and medians; ties go by name.

    Medians are computed only for the names that made the list.
    """
    house, flat = F.col(roles.kind) == roles.house, F.col(roles.kind) == roles.flat
    valid = df.where(F.col(roles.kind).isin(roles.house, roles.flat) & (F.col(roles.price) > 0))
    valid = valid.withColumn("name", F.col(name))
    leaders = staged(
        valid.groupBy("name")
        .agg(F.count(F.lit(1)).alias("nb_transactions"), F.count_if(house).alias("nb_maisons"),
             F.count_if(flat).alias("nb_appartements"))
        .orderBy(F.desc("nb_transactions"), F.asc("name")).limit(limit)
    ).withColumn("__k", F.struct("name"))
    rows = valid.withColumn("__k", F.struct("name")).join(
        F.broadcast(leaders.select("__k")), "__k", "left_semi")
    medians = order_stats(
        rows, ["name"],
        [median("prix_m2_median", roles.price),
         median("prix_m2_maison_median", roles.price, "house"),
         median("prix_m2_appart_median", roles.price, "flat")],
        {"house": house, "flat": flat}, strategy="rank")
    return (leaders.join(medians.select(F.struct("name").alias("__k"), F.col("prix_m2_median"),
                                        "prix_m2_maison_median", "prix_m2_appart_median"),
                         "__k", "left").drop("__k")
            .orderBy(F.desc("nb_transactions"), F.asc("name")))


def top_by(stats: DataFrame, measure: str, limit: int, tie: str,
           min_rows: int | None = None) -> DataFrame:
    """The ``limit`` groups with the largest ``measure``, optionally among well-filled ones."""
    if min_rows is not None:
        stats = stats.where(F.col("nb_transactions") >= min_rows)
    return stats.orderBy(F.desc_nulls_last(measure), F.asc(tie)).limit(limit)


def summary(df: DataFrame, roles: PriceRoles = PriceRoles()) -> DataFrame:
    """One row: count, date range, and mean, median, min and max of both prices."""
    aggs = [F.count(F.lit(1)).alias("n_rows"),
            F.min(roles.day).alias("date_min"), F.max(roles.day).alias("date_max")]
    stats = []
    for tag, column in (("prix_m2", roles.price), ("prix_m2_ajuste", roles.adjusted)):
        aggs += [F.avg(column).alias(f"{tag}_mean"), F.min(column).alias(f"{tag}_min"),
                 F.max(column).alias(f"{tag}_max")]
        stats.append(median(f"{tag}_median", column))
    one = df.withColumn("__one", F.lit(1))
    medians = order_stats(one, ["__one"], stats, strategy="rank")
    return (df.agg(*aggs).withColumn("__one", F.lit(1))
            .join(F.broadcast(medians), "__one", "left").drop("__one"))
