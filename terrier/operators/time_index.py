"""Re-basing prices to a reference period with a median index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrier.operators.order_stats import ARRAY_ROWS, median, order_stats
from terrier.operators.skew import BROADCAST_ROWS, attach


def latest_per_group(df: DataFrame, keys: Sequence[str], value: str, period: str,
                     name: str) -> DataFrame:
    """The value of the last period of each group, even when that value is null."""
    return df.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(period)).alias("__l")
    ).select(*keys, F.col("__l.v").alias(name))


def median_index(df: DataFrame, keys: Sequence[str], period: str, value: str,
                 reference: int, array_rows: int = ARRAY_ROWS) -> DataFrame:
    """``keys``, ``period``, ``factor``: target median over the period's own median.

    The target is the median of the ``reference`` period, or of the last period
    there is. The factor is 1 where a median is missing or not positive.
    """
    medians = order_stats(df, [*keys, period], [median("m", value)], array_rows=array_rows)
    w = Window.partitionBy(*keys)
    target = F.coalesce(
        F.max(F.when(F.col(period) == reference, F.col("m"))).over(w),
        F.max_by(F.struct(F.col("m").alias("v")), F.struct(period)).over(w)["v"])
    factor = F.when((F.col("m") > 0) & F.col("target").isNotNull(), F.col("target") / F.col("m"))
    return medians.withColumn("target", target).select(
        *keys, period, F.coalesce(factor, F.lit(1.0)).alias("factor"))


def adjust_prices(df: DataFrame, keys: Sequence[str], period: str, value: str, reference: int,
                  name: str, salt_by: Sequence[str], array_rows: int = ARRAY_ROWS,
                  max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Add ``name``: ``value`` times its index factor, or times 1 where it has none."""
    index = median_index(df, keys, period, value, reference, array_rows)
    joined = attach(df, index, [*keys, period], salt_by, max_rows=max_rows)
    return joined.select(
        *df.columns, (F.col(value) * F.coalesce(F.col("factor"), F.lit(1.0))).alias(name))
