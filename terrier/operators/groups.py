"""Deed-line cleaning: first category, group flag, group totals, reduction."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.operators.skew import LIGHT_ROWS, attach, by_weight, key_struct, small_side
from terrier.session import staged


def _no_null(keys: Sequence[str]) -> Column:
    return fold(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def keep_first_category(df: DataFrame, keys: Sequence[str], category: str,
                        order_by: Sequence[str], mode: str = "auto",
                        light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Keep the rows whose ``category`` equals the first one of their group.

    All such rows stay. A null in a key matches nothing, so the row is dropped;
    so is a group whose first category is null.
    """
    first = "__first"
    rows = df.where(_no_null(keys))

    def light(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        return (part.withColumn(first, F.first(F.col(category)).over(w))
                .where(F.col(category) == F.col(first)).drop(first))

    def heavy(part: DataFrame) -> DataFrame:
        # the struct keeps a null first value, which min_by alone would skip
        firsts = part.groupBy(*keys).agg(
            F.min_by(F.struct(F.col(category).alias("v")), F.struct(*order_by)).alias(first))
        return (attach(part, firsts, keys, order_by, light_rows=light_rows)
                .where(F.col(category) == F.col(f"{first}.v")).drop(first))

    return by_weight(rows, keys, light, heavy, mode, light_rows)


def flag_group(df: DataFrame, keys: Sequence[str], condition: Column, name: str,
               salt_by: Sequence[str], mode: str = "auto",
               light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Add ``name``: does any row of the group meet ``condition``? Null where a key is null."""

    def light(part: DataFrame) -> DataFrame:
        met = F.bool_or(condition).over(Window.partitionBy(*keys))
        return part.withColumn(name, F.when(_no_null(keys), F.coalesce(met, F.lit(False))))

    def heavy(part: DataFrame) -> DataFrame:
        flags = part.where(_no_null(keys)).groupBy(*keys).agg(
            F.coalesce(F.bool_or(condition), F.lit(False)).alias(name))
        columns = [*part.columns, name]
        return attach(part, flags, keys, salt_by, light_rows=light_rows).select(*columns)

    return by_weight(df, keys, light, heavy, mode, light_rows)


def group_totals(df: DataFrame, keys: Sequence[str], sums: dict[str, str], means: dict[str, str],
                 salt_by: Sequence[str], mode: str = "auto",
                 light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Add group sums and means (``{new column: source}``); an all-null sum is 0."""

    def light(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        new = {n: F.when(_no_null(keys), F.coalesce(F.sum(c).over(w), F.lit(0)))
               for n, c in sums.items()}
        new |= {n: F.when(_no_null(keys), F.avg(c).over(w)) for n, c in means.items()}
        return part.withColumns(new)

    def heavy(part: DataFrame) -> DataFrame:
        totals = part.where(_no_null(keys)).groupBy(*keys).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
            *[F.avg(c).alias(n) for n, c in means.items()])
        columns = [*part.columns, *sums, *means]
        return attach(part, totals, keys, salt_by, light_rows=light_rows).select(*columns)

    return by_weight(df, keys, light, heavy, mode, light_rows)


def allocate(df: DataFrame, amount: str, total: str, share: str, name: str) -> DataFrame:
    """Add ``name``: ``amount`` split in proportion to ``share`` out of ``total``."""
    return df.withColumn(name, F.try_divide(F.col(amount), F.col(total)) * F.col(share))


def _items(order_by: Sequence[str], lists: Sequence[str]) -> Column:
    """The wanted columns of a group's rows, in order, as one sorted list ``__l``."""
    return F.sort_array(F.collect_list(F.struct(
        F.struct(*order_by).alias("o"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(lists)]))).alias("__l")


def _as_lists(lists: Sequence[str]) -> list[Column]:
    def field(name: str) -> Callable[[Column], Column]:
        return lambda item: item[name]
    return [F.transform("__l", field(f"v{i}")).alias(c) for i, c in enumerate(lists)]


def reduce_groups(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                  firsts: Sequence[str] = (), lists: Sequence[str] = (),
                  sums: Sequence[str] = (), part_by: Sequence[str] = (),
                  mode: str = "auto", light_rows: int = LIGHT_ROWS) -> DataFrame:
    """One row per group: first values, aligned lists and sums, in ``order_by`` order.

    A first value may be null, lists keep their nulls, an all-null sum is 0, and
    null keys form groups. Groups above ``light_rows`` give the same row: only their
    lists are first sorted in pieces, cut where ``part_by`` (leading columns of
    ``order_by``; the first one by default) changes value. A list is one cell, so
    it must fit a task; ``number_items`` gives lists of any length as rows.
    """
    part_by = list(part_by or order_by[:1])
    order = F.struct(*order_by)
    scalars = []
    if firsts:
        scalars.append(F.min_by(F.struct(*firsts), order).alias("__f"))
    scalars += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]
    whole = [_items(order_by, lists)] if lists else []
    if not scalars and not whole:
        scalars.append(F.count(F.lit(1)).alias("__n"))

    def project(row: DataFrame) -> DataFrame:
        return row.select(*keys, *[F.col(f"__f.{c}").alias(c) for c in firsts], *_as_lists(lists), *sums)

    def light(rows: DataFrame) -> DataFrame:
        return project(rows.groupBy(*keys).agg(*scalars, *whole))

    def heavy(rows: DataFrame) -> DataFrame:
        if not lists:
            return light(rows)
        pieces = rows.groupBy(*keys, F.struct(*part_by).alias("__p")).agg(*whole)
        joined = pieces.groupBy(key_struct(keys).alias("__k")).agg(
            F.sort_array(F.collect_list(F.struct("__p", "__l"))).alias("__l")).withColumn(
            "__l", F.flatten(F.col("__l.__l")))
        if scalars:
            more = rows.groupBy(*keys).agg(*scalars)
            joined = joined.join(more.withColumn("__k", key_struct(keys)).drop(*keys), "__k")
        return project(joined.select("*", "__k.*"))

    return by_weight(df, keys, light, heavy, mode, light_rows)


def list_pieces(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                lists: Sequence[str], part_by: Sequence[str]) -> DataFrame:
    """The lists of each group in pieces: one row per value of ``part_by``, numbered by ``part``.

    ``part_by`` are leading columns of ``order_by``. The form is the same for groups
    of any size; only counts of pieces, not their lists, meet in one task.
    """
    pieces = df.groupBy(*keys, F.struct(*part_by).alias("__p")).agg(_items(order_by, lists))
    nth = Window.partitionBy(*keys).orderBy("__p")
    places = df.groupBy(*keys, F.struct(*part_by).alias("__p")).agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "part", F.row_number().over(nth) - 1)
    key = F.struct(*keys, "__p").alias("__k")
    return pieces.withColumn("__k", key).join(places.select(key, "part"), "__k").select(
        *keys, "part", *_as_lists(lists))


def _running_numbers(rows: DataFrame, keys: Sequence[str], order_by: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 0, in ``order_by`` order; a group may span many tasks.

    Rows are dealt by ranges of key and order, so a group is a run over neighbouring
    partitions. Its rows count on from those of the partitions before, of which only
    one number a group and partition is gathered.
    """
    place = [*keys, *order_by]
    dealt = staged(rows.repartitionByRange(*place).sortWithinPartitions(*place).withColumn(
        "__row", F.monotonically_increasing_id()))
    # the number holds the partition above 33 bits, and the row in it below
    part, row = F.shiftright("__row", 33).alias("__part"), F.col("__row").bitwiseAND((1 << 33) - 1)
    runs = dealt.groupBy(key_struct(keys).alias("__k"), part).agg(F.min(row).alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__k").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = small_side(staged(runs.select("__k", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__from"))))
    numbered = dealt.withColumns({"__k": key_struct(keys), "__part": F.shiftright("__row", 33)}).join(runs, ["__k", "__part"])
    return numbered.withColumn(name, row + F.col("__from")).select(*rows.columns, name)


def number_items(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], sums: dict[str, str] | None = None,
                 name: str = "position", mode: str = "auto", light_rows: int = LIGHT_ROWS) -> DataFrame:
    """The rows with their ``name`` in the group, from 0 in ``order_by`` order, and group sums.

    A list of any length is the rows of its group in this order, a group's first values
    are those of row 0, and ``sums`` (``{new column: source}``; an all-null sum is 0) are
    the same on all its rows. So the form does not depend on the size of a group, and no
    cell grows with it. Null keys form groups; rows alike in ``order_by`` have any order.
    """
    sums = dict(sums or {})

    def light(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        out = rows.withColumn(name, F.row_number().over(w.orderBy(*order_by)).cast("long") - 1)
        return out.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()})

    def heavy(rows: DataFrame) -> DataFrame:
        out = _running_numbers(rows, keys, order_by, name)
        if not sums:
            return out
        # one row a large group
        totals = small_side(staged(rows.groupBy(key_struct(keys).alias("__k")).agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])))
        return out.withColumn("__k", key_struct(keys)).join(totals, "__k").drop("__k")

    return by_weight(df, keys, light, heavy, mode, light_rows)


def duplicate_keys(df: DataFrame, key: Column) -> DataFrame:
    """One row: ``n_rows``, ``n_keys`` and whether they agree (``is_unique``)."""
    per_key = df.groupBy(key.alias("__key")).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).cast("long").alias("n_keys"),
    ).withColumn("is_unique", F.col("n_rows") == F.col("n_keys"))


def require_unique(df: DataFrame, key: Column) -> DataFrame:
    """Return ``df``; raise when ``key`` repeats."""
    n_rows, n_keys, unique = duplicate_keys(df, key).first()
    if not unique:
        raise ValueError(f"{n_rows} rows but {n_keys} distinct keys")
    return df
