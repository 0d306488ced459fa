"""A Spark data source for GeoPackage layers.

A GeoPackage is an SQLite file whose geometry column holds a short header and
well-known binary. Each task opens the file read-only and decodes one range of
row ids, so the file must lie where every executor can open it.
"""

from __future__ import annotations

import sqlite3
import struct
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# executors get these helpers with the source and need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = ("properties map<string,string>, "
          "geom struct<srid:int,parts:array<array<array<struct<x:double,y:double>>>>>")
# Envelope lengths of the header by its flag, and geometry codes.
ENVELOPE_BYTES = (0, 32, 48, 48, 64)
POLYGON, MULTIPOLYGON = 3, 6


def decode_wkb(data: bytes, at: int) -> tuple[list, int]:
    """Parts of a polygon or multipolygon at offset ``at``, and where it ends."""
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    kind, extra = (code & 0xFFFF) % 1000, (code & 0xFFFF) // 1000
    width = 2 + (extra in (1, 2)) + 2 * (extra == 3)
    width += bool(code & 0x80000000) + bool(code & 0x40000000)
    count = struct.unpack_from(order + "I", data, at + 5)[0]
    at += 9
    if kind == MULTIPOLYGON:
        parts = []
        for _ in range(count):
            inner, at = decode_wkb(data, at)
            parts += inner
        return parts, at
    if kind != POLYGON:
        return [], len(data)
    rings = []
    for _ in range(count):
        n = struct.unpack_from(order + "I", data, at)[0]
        values = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
        rings.append([(values[i], values[i + 1]) for i in range(0, n * width, width)])
        at += 4 + n * width * 8
    return [rings], at


def decode_geometry(blob: bytes | None) -> tuple[int, list] | None:
    """``(srid, parts)`` of a GeoPackage geometry; None for null, empty or other types."""
    if blob is None or blob[3] & 0x10:
        return None
    order = "<" if blob[3] & 1 else ">"
    srid = struct.unpack_from(order + "i", blob, 4)[0]
    parts, _ = decode_wkb(blob, 8 + ENVELOPE_BYTES[(blob[3] >> 1) & 7])
    return (srid, parts) if parts else None


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.rows = int(options.get("rowsperpartition", 5000))
        with connect(self.path) as con:
            shapes = dict(con.execute("SELECT table_name, column_name FROM gpkg_geometry_columns"))
        # a file with a single layer needs no table name
        self.table = options.get("table")
        if self.table not in shapes and len(shapes) == 1:
            self.table = next(iter(shapes))
        if self.table not in shapes:
            raise ValueError(f"no layer {self.table!r} in {self.path}; it has {sorted(shapes)}")
        self.shape = shapes[self.table]

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as con:
            low, high = con.execute(
                f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        return [RowRange(a, a + self.rows) for a in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        with connect(self.path) as con:
            rows = con.execute(f"SELECT * FROM {quoted(self.table)} WHERE rowid >= ? AND rowid < ?",
                               (partition.low, partition.high))
            names = [d[0] for d in rows.description]
            for row in rows:
                cells = dict(zip(names, row))
                geometry = decode_geometry(cells.pop(self.shape))
                yield {k: None if v is None else str(v) for k, v in cells.items()}, geometry


class GeoPackageSource(DataSource):
    """``spark.read.format("geopackage").option("table", layer).load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "geopackage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(self.options)
