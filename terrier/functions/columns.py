"""Column expressions: no shuffles, no Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_unknown(df: DataFrame, columns: Sequence[str], label: str = "unknown") -> DataFrame:
    """Replace nulls of text columns by ``label``."""
    return df.fillna(label, subset=list(columns))


def unit_price(amount: str, size: str) -> Column:
    """Amount per unit of size; null where the size is zero or null."""
    return F.try_divide(F.col(amount).cast("double"), F.col(size).cast("double"))


def composite_key(*parts: str, sep: str = "_") -> Column:
    """Parts joined by ``sep``; null when any part is null."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(F.col(part).cast("string"))
    return F.concat(*pieces)


def first_of_list(column: str) -> Column:
    """First element, null for an empty or null list."""
    return F.get(F.col(column), F.lit(0))


def parse_day(column: str, strict: bool = True) -> Column:
    """Text ``yyyy-MM-dd`` to a date. Bad text raises when strict, else gives null."""
    if strict:
        return F.to_date(F.col(column), "yyyy-MM-dd")
    return F.try_to_date(F.col(column), "yyyy-MM-dd")


def map_or_keep(code: str, mapping: Mapping[str, str], otherwise: str) -> Column:
    """The mapped name of ``code``, or column ``otherwise`` where it has none."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.col(code)], F.col(otherwise))


def first_known(*columns: str) -> Column:
    """The first non-null of a chain of names."""
    return F.coalesce(*[F.col(c) for c in columns])


def round_half_even(column: str | Column, digits: int = 2) -> Column:
    """Round like binary arrays do: scale, round to even, scale back."""
    c = F.col(column) if isinstance(column, str) else column
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


def round_doubles(df: DataFrame, digits: int = 2,
                  keep: Iterable[str] = ("longitude", "latitude")) -> DataFrame:
    """Round every double column except those in ``keep``."""
    keep = set(keep)
    return df.select(*[
        round_half_even(f.name, digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) and f.name not in keep else F.col(f.name)
        for f in df.schema.fields])


def within_bounds(bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Every column strictly between its two bounds; null fails."""
    tests = [(F.col(c) > lo) & (F.col(c) < hi) for c, (lo, hi) in bounds.items()]
    return fold(lambda a, b: a & b, tests)


def relevant(nature: str, natures: Sequence[str], kind: str, kinds: Sequence[str],
             value: str, min_value: float, size: str, required: Sequence[str]) -> Column:
    """Kept natures and kinds, value above ``min_value``, positive size, no nulls in ``required``."""
    tests = [F.col(nature).isin(*natures), F.col(kind).isin(*kinds),
             F.col(value) > min_value, F.col(size) > 0]
    tests += [F.col(c).isNotNull() for c in required]
    return fold(lambda a, b: a & b, tests)


def not_in_or_null(column: str, values: Sequence[str]) -> Column:
    """Keeps nulls, unlike a bare NOT IN."""
    return F.col(column).isNull() | ~F.col(column).isin(*values)


def display_class(count: str, min_count: int) -> Column:
    """How a polygon is drawn: ``none``, ``few`` or ``scaled``. ``min_count`` 0 turns ``few`` off."""
    return (F.when(F.col(count).isNull() | (F.col(count) == 0), F.lit("none"))
            .when(F.col(count) < min_count, F.lit("few")).otherwise(F.lit("scaled")))


def scale_position(price: str, low: float, high: float) -> Column:
    """Place of a price on the fixed colour scale, clamped to [0, 1]; null without a price."""
    place = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(price) - low) / (high - low)))
    return F.when(F.col(price).isNotNull(), place)
