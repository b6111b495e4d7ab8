"""OSM PBF files as a Spark data source: one partition for each run of blobs, elements as rows.

Register with ``spark.dataSource.register(PbfSource)`` and read with ``spark.read.format("osm_pbf").load(path)``. The header must say
that the file holds history and is sorted by type and id, unless the option ``anyOrder`` is true.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.sources.shared import storage

SCHEMA = "type int, id long, version int, visible boolean, tags map<string,string>, nodes array<long>, members array<struct<combined_id:long,role:string>>, x int, y int"
# The features that a history file in order announces.
REQUIRED = ("HistoricalInformation", "Sort.Type_then_ID")
BLOBS = 16


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol buffer message: numbers as ints, all else as bytes."""
    at, n = 0, len(data)
    while at < n:
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            size, at = varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def signed(value: int) -> int:
    """A zigzag number."""
    return (value >> 1) ^ -(value & 1)


def wrapped(value: int) -> int:
    """A plain number of 64 bits, which may be negative."""
    return value - (1 << 64) if value >> 63 else value


def numbers(data: bytes) -> list[int]:
    at, out = 0, []
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def running(data: bytes) -> list[int]:
    """Packed zigzag differences, summed."""
    total, out = 0, []
    for value in numbers(data):
        total += signed(value)
        out.append(total)
    return out


def blobs(file, size: int) -> Iterator[tuple[str, int, int]]:
    """``(kind, offset, length)`` of each blob; only headers are read."""
    at = 0
    while at < size:
        (length,) = struct.unpack(">I", file.read_at(4, at))
        header = dict(fields(file.read_at(length, at + 4)))
        at += 4 + length
        yield header[1].decode(), at, header[3]
        at += header[3]


def unpacked(blob: bytes) -> bytes:
    held = dict(fields(blob))
    if 1 in held:
        return held[1]
    if 3 in held:
        return zlib.decompress(held[3])
    raise ValueError("a blob is neither raw nor zlib")


def header(path: str) -> dict:
    """Features and the replication properties of a file."""
    fs, inner = storage(path)
    file = fs.open_input_file(inner)
    kind, at, length = next(blobs(file, file.size()))
    if kind != "OSMHeader":
        raise ValueError("no header")
    out: dict = {"features": []}
    for key, value in fields(unpacked(file.read_at(length, at))):
        if key in (4, 5):
            out["features"].append(value.decode())
        elif key == 32:
            out["timestamp"] = wrapped(value)
        elif key == 33:
            out["sequence"] = wrapped(value)
        elif key == 34:
            out["base_url"] = value.decode()
    return out


def elements(block: bytes) -> Iterator[tuple]:
    """The rows of a primitive block."""
    strings: list[str] = []
    groups, granularity, lat_offset, lon_offset = [], 100, 0, 0
    for key, value in fields(block):
        if key == 1:
            strings = [v.decode("utf-8", "replace") for _, v in fields(value)]
        elif key == 2:
            groups.append(value)
        elif key == 17:
            granularity = value
        elif key == 19:
            lat_offset = wrapped(value)
        elif key == 20:
            lon_offset = wrapped(value)
    fixed = lambda value, offset: (offset + granularity * value) // 100  # noqa: E731  nanodegrees to units of 1e-7
    for group in groups:
        for key, value in fields(group):
            if key == 1:
                f = _fields_of(value)
                version, visible = _info(f.get(4, b""))
                place = (fixed(signed(f[9]), lon_offset), fixed(signed(f[8]), lat_offset)) if visible else (None, None)
                yield 0, signed(f[1]), version, visible, _tags(f, strings), None, None, *place
            elif key == 2:
                yield from _dense(value, strings, fixed, lat_offset, lon_offset)
            elif key in (3, 4):
                f = _fields_of(value)
                version, visible = _info(f.get(4, b""))
                own, tags = wrapped(f[1]), _tags(f, strings)
                if key == 3:
                    yield 1, own, version, visible, tags, running(f.get(8, b"")), None, None, None
                else:
                    kinds = numbers(f.get(10, b""))
                    members = [{"combined_id": _combined(k, i), "role": strings[r]} for r, i, k in zip(numbers(f.get(8, b"")), running(f.get(9, b"")), kinds)]
                    yield 2, own, version, visible, tags, None, members, None, None


def _combined(kind: int, number: int) -> int:
    return wrapped((kind << 62 | number) & ((1 << 64) - 1))


def _fields_of(data: bytes) -> dict:
    return dict(fields(data))


def _info(data: bytes) -> tuple[int, bool]:
    held = _fields_of(data)
    return wrapped(held.get(1, 0)), bool(held.get(6, 1))


def _tags(f: dict, strings: list[str]) -> dict[str, str]:
    return {strings[k]: strings[v] for k, v in zip(numbers(f.get(2, b"")), numbers(f.get(3, b"")))}


def _dense(data: bytes, strings: list[str], fixed, lat_offset: int, lon_offset: int) -> Iterator[tuple]:
    f = _fields_of(data)
    own, lats, lons = running(f[1]), running(f[8]), running(f[9])
    info = _fields_of(f.get(5, b""))
    versions = numbers(info.get(1, b"")) or [0] * len(own)
    visible = [bool(v) for v in numbers(info.get(6, b""))] or [True] * len(own)
    pairs, at = numbers(f.get(10, b"")), 0
    for i, number in enumerate(own):
        tags = {}
        while at < len(pairs) and pairs[at]:
            tags[strings[pairs[at]]] = strings[pairs[at + 1]]
            at += 2
        at += 1
        place = (fixed(lons[i], lon_offset), fixed(lats[i], lat_offset)) if visible[i] else (None, None)
        yield 0, number, versions[i], visible[i], tags, None, None, *place


class _Blobs(InputPartition):
    def __init__(self, places: list[tuple[int, int]]):
        self.places = places


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        if options.get("anyorder", "false") != "true":
            lacking = [x for x in REQUIRED if x not in header(self.path)["features"]]
            if lacking:
                raise ValueError(f"the file does not announce {', '.join(lacking)}")

    def partitions(self) -> list[_Blobs]:
        fs, inner = storage(self.path)
        file = fs.open_input_file(inner)
        places = [(at, n) for kind, at, n in blobs(file, file.size()) if kind == "OSMData"]
        return [_Blobs(places[i : i + BLOBS]) for i in range(0, len(places), BLOBS)]

    def read(self, partition: _Blobs) -> Iterator[tuple]:
        fs, inner = storage(self.path)
        file = fs.open_input_file(inner)
        for at, length in partition.places:
            yield from elements(unpacked(file.read_at(length, at)))


class PbfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, any_order: bool = False) -> DataFrame:
    spark.dataSource.register(PbfSource)
    return spark.read.format("osm_pbf").option("anyOrder", str(any_order).lower()).load(path)


def tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The latest elements as the tables of a store: nodes, points (visible nodes only), ways and relations."""
    latest = elements.groupBy("type", "id").agg(F.max_by(F.struct("version", "visible", "tags", "nodes", "members", "x", "y"), "version").alias("e")).select("type", "id", "e.*")
    common = ["id", "version", "visible", "tags"]
    return {
        "nodes": latest.filter("type = 0").select(*common),
        "points": latest.filter("type = 0 AND visible").select("id", "x", "y"),
        "ways": latest.filter("type = 1").select(*common, "nodes"),
        "relations": latest.filter("type = 2").select(*common, "members"),
    }
