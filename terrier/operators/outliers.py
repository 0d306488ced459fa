"""Outlier removal: fixed bounds, then interquartile fences per area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.functions.columns import within_bounds
from terrier.operators.order_stats import ARRAY_ROWS, nearest, order_stats
from terrier.operators.skew import BROADCAST_ROWS, attach


def iqr_fences(df: DataFrame, key: str, columns: Sequence[str], k: float = 1.5,
               array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Per known area: ``group_rows`` and, per column, the fence ``{c}_min`` .. ``{c}_max``."""
    stats = [s for c in columns for s in (nearest(f"{c}_q1", c, 0.25), nearest(f"{c}_q3", c, 0.75))]
    sized = order_stats(df.where(F.col(key).isNotNull()), [key], stats,
                        aggs=[F.count(F.lit(1)).alias("group_rows")], array_rows=array_rows)
    return sized.select(key, "group_rows", *[e.alias(n) for c in columns for n, e in _fence(c, k)])


def _fence(column: str, k: float) -> list[tuple[str, Column]]:
    q1, q3 = F.col(f"{column}_q1"), F.col(f"{column}_q3")
    return [(f"{column}_min", q1 - k * (q3 - q1)), (f"{column}_max", q3 + k * (q3 - q1))]


def remove_iqr_outliers(df: DataFrame, key: str, columns: Sequence[str], salt_by: Sequence[str],
                        min_rows: int = 10, k: float = 1.5, strict: bool = True,
                        array_rows: int = ARRAY_ROWS, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Keep areas below ``min_rows`` whole; elsewhere keep rows inside every fence.

    With ``strict`` a value on the fence is dropped, so an area whose quartiles
    coincide loses all its rows. Rows without an area are dropped.
    """
    fences = iqr_fences(df, key, columns, k, array_rows)

    def inside(c: str) -> Column:
        v, lo, hi = F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max")
        return (v > lo) & (v < hi) if strict else (v >= lo) & (v <= hi)

    keep = (F.col("group_rows") < min_rows) | fold(
        lambda a, b: a & b, [inside(c) for c in columns])
    return attach(df, fences, [key], salt_by, max_rows=max_rows).where(keep).select(*df.columns)


def remove_outliers(df: DataFrame, bounds: Mapping[str, tuple[float, float]], key: str,
                    salt_by: Sequence[str], min_rows: int = 10, k: float = 1.5,
                    array_rows: int = ARRAY_ROWS) -> DataFrame:
    """Fixed bounds first; the fences are then computed on what is left."""
    return remove_iqr_outliers(df.where(within_bounds(bounds)), key, list(bounds), salt_by,
                               min_rows, k, array_rows=array_rows)
