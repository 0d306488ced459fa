"""Splitting heavy groups off, and joining a per-key table to a skewed one.

Any key may hold a third of all rows. Group operators therefore come in two
forms: a window or sorted list for light groups, one shuffle and bounded memory
per group; and a map-side combined aggregate joined back with salted keys for
heavy groups. :func:`split_heavy` decides which rows go which way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.session import staged

#: A group up to this many rows may be handled by one task.
LIGHT_ROWS = 1_000_000
#: A lookup is broadcast up to this many rows and bytes, joined by shuffle beyond.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024

#: Buckets in which rows are counted before keys that are many are.
KEY_BUCKETS = 1 << 16

_KEY, _SPREAD, _SALT = "__key", "__spread", "__salt"


def dealt_out(df: DataFrame) -> DataFrame:
    """The same rows, dealt evenly to all tasks.

    Spark reads a small file as one task. Rows that are few bytes and much work,
    such as keys that shapes are made of, should not stay in it.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              2 * spark.sparkContext.defaultParallelism))


def key_struct(keys: Sequence[str]) -> Column:
    """All keys as one column. Unlike bare keys it is never null, so null keys match."""
    return F.struct(*[F.col(k) for k in keys])


def heavy_keys(df: DataFrame, keys: Sequence[str], light_rows: int = LIGHT_ROWS) -> DataFrame:
    """``(__key, rows)`` of all keys with more than ``light_rows`` rows."""
    return (
        df.groupBy(key_struct(keys).alias(_KEY))
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > light_rows)
    )


def _crowded(df: DataFrame, keys: Sequence[str], light_rows: int) -> DataFrame | None:
    """The rows whose key shares its hash bucket with more than ``light_rows`` rows, ``None`` when there are none.

    They hold all rows of heavy keys. Buckets are counted before the shuffle, which then
    moves a bounded number of rows a task, however many keys there are.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    large = staged(df.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("rows"))
                   .where(F.col("rows") > light_rows).select("__bucket"))
    if large.isEmpty():
        return None
    # at most KEY_BUCKETS numbers
    return df.withColumn("__bucket", bucket).join(F.broadcast(large), "__bucket", "left_semi").drop("__bucket")


def split_heavy(df: DataFrame, keys: Sequence[str], light_rows: int = LIGHT_ROWS,
                many: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Rows of light groups and rows of heavy groups (``None`` when there are none).

    ``many`` says that keys are nearly as many as rows: they are not counted one by one
    where no bucket of them is large. The rows are the same either way.
    """
    rows = _crowded(df, keys, light_rows) if many else df
    if rows is None:
        return df, None
    heavy = staged(heavy_keys(rows, keys, light_rows))
    if heavy.isEmpty():
        return df, None
    tagged = df.withColumn(_KEY, key_struct(keys))
    listed = small_side(heavy.select(_KEY))
    light = tagged.join(listed, _KEY, "left_anti").drop(_KEY)
    dense = tagged.join(listed, _KEY, "left_semi").drop(_KEY)
    return light, dense


def by_weight(df: DataFrame, keys: Sequence[str],
              light: Callable[[DataFrame], DataFrame],
              heavy: Callable[[DataFrame], DataFrame],
              mode: str = "auto", light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Run ``light`` on light groups and ``heavy`` on heavy ones.

    ``mode`` "light" or "heavy" skips the split for a caller who already made it.
    """
    if mode == "light":
        return light(df)
    if mode == "heavy":
        return heavy(df)
    if mode != "auto":
        raise ValueError(f"mode must be auto, light or heavy, not {mode!r}")
    sparse, dense = split_heavy(df, keys, light_rows)
    return light(sparse) if dense is None else light(sparse).unionByName(heavy(dense))


def fits_broadcast(table: DataFrame, row_bytes: Column | None = None,
                   max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a staged table is small enough to send to every executor.

    ``row_bytes`` weighs a row; without it the length of its JSON text does.
    """
    size = row_bytes if row_bytes is not None else F.length(F.to_json(F.struct(*table.columns)))
    rows, total = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= max_rows and total <= max_bytes


def small_side(table: DataFrame) -> DataFrame:
    """A staged table, with a broadcast hint where it is small enough; else it is joined by shuffle."""
    return F.broadcast(table) if fits_broadcast(table) else table


def attach(fact: DataFrame, lookup: DataFrame, keys: Sequence[str], salt_by: Sequence[str],
           how: str = "left", row_bytes: Column | None = None,
           max_rows: int = BROADCAST_ROWS, light_rows: int = LIGHT_ROWS) -> DataFrame:
    """Join ``lookup`` (one row per key) to ``fact``, whose keys may be skewed.

    A lookup of checked small size is broadcast. Otherwise both sides shuffle,
    and the rows of heavy keys are spread over several salts chosen by hashing
    ``salt_by`` (columns that tell rows apart, so a rerun salts them alike);
    only the lookup rows of those keys are repeated. Null keys do not match.
    """
    lookup = staged(lookup)
    if fits_broadcast(lookup, row_bytes, max_rows):
        return fact.join(F.broadcast(lookup), list(keys), how)
    heavy = staged(heavy_keys(fact, keys, light_rows))
    if heavy.isEmpty():
        return fact.join(lookup, list(keys), how)
    spread = small_side(
        heavy.select(_KEY, F.ceil(F.col("rows") / light_rows).cast("int").alias(_SPREAD)))
    salted = (
        fact.withColumn(_KEY, key_struct(keys)).join(spread, _KEY, "left")
        .withColumn(_SALT, F.coalesce(
            F.pmod(F.xxhash64(*salt_by), F.col(_SPREAD).cast("long")).cast("int"), F.lit(0)))
        .drop(_KEY, _SPREAD)
    )
    repeated = (
        lookup.withColumn(_KEY, key_struct(keys)).join(spread, _KEY, "left")
        .withColumn(_SALT, F.explode(
            F.sequence(F.lit(0), F.coalesce(F.col(_SPREAD), F.lit(1)) - 1)))
        .drop(_KEY, _SPREAD)
    )
    return salted.join(repeated, [*keys, _SALT], how).drop(_SALT)
