"""Polygon shapefiles as a Spark data source: coastline areas with ids in file order.

Register with ``spark.dataSource.register(ShapefileSource)`` and read with ``spark.read.format("shapefile").load(path)``. Outer rings
run clockwise in a shapefile; each inner ring goes to the smallest outer ring that holds it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators.shapes import SHAPES
from tessera.sources.shared import storage

SCHEMA = f"id long, shapes {SHAPES}"
POLYGONS = (5, 15, 25)
RECORDS = 256


def rings(record: bytes) -> list[list[tuple[int, int]]]:
    """The rings of a polygon record in fixed-point units."""
    (kind,) = struct.unpack_from("<i", record)
    if kind not in POLYGONS:
        return []
    n_parts, n_points = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", record, 44), n_points]
    values = struct.unpack_from(f"<{2 * n_points}d", record, 44 + 4 * n_parts)
    points = [(math.floor(x * 1e7), math.floor(y * 1e7)) for x, y in zip(values[::2], values[1::2])]
    return [points[a:b] for a, b in zip(starts, starts[1:])]


def twice_area(ring: list[tuple[int, int]]) -> int:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:]))


def holds(ring: list[tuple[int, int]], p: tuple[int, int]) -> bool:
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if (y1 > p[1]) != (y2 > p[1]) and p[0] < (x2 - x1) * (p[1] - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def shapes(record: bytes) -> list[dict]:
    """Rings of at least four points, closed, nested one deep."""
    valid = [r for r in rings(record) if len(r) >= 4 and r[0] == r[-1]]
    out = [{"outer": r, "inners": []} for r in valid if twice_area(r) < 0]
    for r in valid:
        if twice_area(r) > 0:
            around = [s for s in out if holds(s["outer"], r[0])]
            if around:
                min(around, key=lambda s: abs(twice_area(s["outer"])))["inners"].append(r)
    return out


def records(file, size: int) -> Iterator[tuple[int, int]]:
    """``(offset, length)`` of each record."""
    at = 100
    while at < size:
        _, words = struct.unpack(">2i", file.read_at(8, at))
        yield at + 8, 2 * words
        at += 8 + 2 * words


class _Records(InputPartition):
    def __init__(self, first: int, places: list[tuple[int, int]]):
        self.first, self.places = first, places


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_Records]:
        fs, inner = storage(self.path)
        file = fs.open_input_file(inner)
        places = list(records(file, file.size()))
        return [_Records(i, places[i : i + RECORDS]) for i in range(0, len(places), RECORDS)]

    def read(self, partition: _Records) -> Iterator[tuple]:
        fs, inner = storage(self.path)
        file = fs.open_input_file(inner)
        for i, (at, length) in enumerate(partition.places):
            made = shapes(file.read_at(length, at))
            if made:
                point = lambda r: [{"x": x, "y": y} for x, y in r]
                yield partition.first + i, [{"outer": point(s["outer"]), "inners": [point(r) for r in s["inners"]]} for s in made]


class ShapefileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("shapefile").load(path)
