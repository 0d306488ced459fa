"""Writing tables, statistics, features and tile rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.operators.features import exportable, feature_text
from terrier.operators.skew import small_side
from terrier.session import staged

#: Features and characters of one document; larger layers have several files.
FEATURES, CHARACTERS = 20_000, 64_000_000


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def save_aggregate(stats: DataFrame, base: str, level: str, keys: Sequence[str]) -> None:
    """Statistics of one level, one folder per ``span``.

    Rows are dealt by ranges of span and key, so a span of any size is written by
    several tasks, and its files follow one another in the order of the keys.
    """
    (stats.repartitionByRange("span", *keys).sortWithinPartitions("span", *keys).write.mode("overwrite")
     .partitionBy("span").parquet(f"{base}/{level}"))


def collection_text(features: Column) -> Column:
    """One GeoJSON document of feature texts."""
    return F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}"))


def as_collections(lines: DataFrame, keys: Sequence[str] = (), features: int = FEATURES,
                   characters: int = CHARACTERS) -> DataFrame:
    """Feature texts ``value`` as documents, ``value`` by ``keys``.

    A key has as many documents as its features need, dealt by their hash, so no
    document grows with a key. Without keys an empty table gives one empty document.
    """
    lines = staged(lines.select(*keys, "value"))
    need = F.greatest(F.ceil(F.count(F.lit(1)) / features), F.ceil(F.coalesce(F.sum(F.length("value")), F.lit(0)) / characters), F.lit(1))
    key = F.struct(F.lit(0).alias("all"), *keys).alias("__k")
    sizes = small_side(staged(lines.groupBy(key).agg(need.alias("__need"))))
    dealt = lines.withColumn("__k", key).join(sizes, "__k").withColumn("__document", F.pmod(F.xxhash64("value"), "__need"))
    out = dealt.groupBy(*keys, "__document").agg(collection_text(F.sort_array(F.collect_list("value"))).alias("value")).drop("__document")
    if not keys and lines.isEmpty():
        return lines.sparkSession.range(1).select(collection_text(F.array().cast("array<string>")).alias("value"))
    return out


def _write_documents(documents: DataFrame, path: str, *partition_by: str) -> None:
    """One file for each row, which is a whole document."""
    writer = documents.write.mode("overwrite").option("maxRecordsPerFile", 1)
    (writer.partitionBy(*partition_by) if partition_by else writer).text(path)


def save_geojson(df: DataFrame, path: str, geom: str = "geom", tolerance: float | None = 0.001,
                 keep_empty: bool = False) -> None:
    """Publishable rows as GeoJSON; every part file is one document, a small layer is one file."""
    rows = exportable(df, geom, keep_empty=keep_empty, tolerance=tolerance)
    _write_documents(as_collections(rows.select(feature_text(rows, geom).alias("value"))), path)


def save_parcels(df: DataFrame, path: str, commune: str, geom: str = "geom") -> None:
    """Features by commune, one folder each; every part file is one document."""
    names = [c for c in df.columns if c not in (geom, commune)]
    lines = df.select(F.col(commune).alias("commune"), feature_text(df, geom, names).alias("value"))
    _write_documents(as_collections(lines, ["commune"]), path, "commune")


def save_list(df: DataFrame, path: str, limit: int) -> None:
    """The rows as one JSON array, nulls written as null; more than ``limit`` rows are an error."""
    rows = df.select(F.struct(*df.columns).alias("r"))
    text = F.to_json(F.collect_list("r"), {"ignoreNullFields": "false"})
    many = F.raise_error(F.lit(f"more than {limit} rows for one list"))
    one = rows.agg(F.when(F.count(F.lit(1)) > limit, many).otherwise(text).alias("value"))
    one.write.mode("overwrite").text(path)


def save_tiles(tiles: DataFrame, path: str, geom: str = "geom") -> None:
    """Tile rows with their features as text, one folder per zoom."""
    names = [c for c in tiles.columns if c not in (geom, "z", "x", "y", "box", "area")]
    (tiles.select("z", "x", "y", feature_text(tiles, geom, names).alias("feature"))
     .hint("rebalance", F.col("z"), F.col("x"), F.col("y"))
     .write.mode("overwrite").partitionBy("z").parquet(path))
