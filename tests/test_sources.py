import gzip
import struct
import zlib

import pytest

from tessera.plans import build
from tessera.sources import osm_xml, pbf, shapefile
from tessera.sources.store import Store

CHANGESET = """<?xml version="1.0"?>
<osmChange version="0.6">
 <create><node id="1" version="1" timestamp="2024-01-02T03:04:05Z" lon="-0.5" lat="1.23456789"><tag k="a" v="b"/></node></create>
 <modify><way id="7" version="2" timestamp="2024-01-02T03:04:06Z"><nd ref="1"/><nd ref="2"/><nd ref="1"/></way></modify>
 <delete><relation id="3" version="4" timestamp="2024-01-02T03:04:07Z"><member type="way" ref="7" role="outer"/></relation></delete>
</osmChange>"""


def test_changeset_xml(spark, tmp_path):
    folder = tmp_path / "000" / "001"
    folder.mkdir(parents=True)
    (folder / "002.osc.gz").write_bytes(gzip.compress(CHANGESET.encode()))
    got = osm_xml.changes(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.seq, r.op, r.type, r.id, r.version) for r in got] == [(1002, "create", 0, 1, 1), (1002, "modify", 1, 7, 2), (1002, "delete", 2, 3, 4)]
    assert (got[0].x, got[0].y, got[0].tags) == (-5_000_000, 12_345_678, {"a": "b"})
    assert got[1].refs == [1, 2, 1] and got[2].refs == [(1 << 62) + 7] and got[2].roles == ["outer"]


def test_state_file(spark, tmp_path):
    (tmp_path / "1.state.txt").write_text("#x\ntimestamp=2023-02-27T00\\:00\\:00Z\nsequenceNumber=5466051\n")
    row = osm_xml.states(spark, str(tmp_path)).first()
    assert row.sequence == 5466051 and str(row.timestamp) == "2023-02-27 00:00:00"


def number(v):
    v &= (1 << 64) - 1
    out = b""
    while True:
        out += bytes([v & 127 | (128 if v > 127 else 0)])
        v >>= 7
        if not v:
            return out


def zig(v):
    return number(v << 1 ^ v >> 63)


def field(key, value):
    if isinstance(value, int):
        return number(key << 3) + number(value)
    return number(key << 3 | 2) + number(len(value)) + value


def diffs(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values))


def pbf_file(path, features=pbf.REQUIRED):
    strings = [b"", b"highway", b"residential", b"outer", b"type", b"multipolygon", b"building", b"yes"]
    table = field(1, b"".join(field(1, s) for s in strings))
    ids, lats, lons = [1, 2, 3, 4, 5], [0, 0, 4_000_000, 4_000_000, 7], [0, 4_000_000, 4_000_000, 0, 7]
    info = field(1, b"".join(map(number, [1, 1, 1, 2, 3]))) + field(6, b"\1\1\1\1\0")
    dense = field(1, diffs(ids)) + field(5, info) + field(8, diffs(lats)) + field(9, diffs(lons)) + field(10, number(1) + number(2) + b"\0" * 5)
    way = field(1, 10) + field(2, number(6)) + field(3, number(7)) + field(4, field(1, 3)) + field(8, diffs([1, 2, 3, 4, 1]))
    old = field(1, 10) + field(4, field(1, 2)) + field(8, diffs([1, 5]))
    relation = field(1, 20) + field(2, number(4)) + field(3, number(5)) + field(4, field(1, 1)) + field(8, number(3)) + field(9, diffs([10])) + field(10, number(1))
    block = table + field(2, field(2, dense)) + field(2, field(3, old) + field(3, way)) + field(2, field(4, relation))
    head = b"".join(field(4, f.encode()) for f in features) + field(33, 77)

    def blob(kind, data):
        body = field(2, len(data)) + field(3, zlib.compress(data))
        header = field(1, kind.encode()) + field(3, len(body))
        return struct.pack(">I", len(header)) + header + body

    path.write_bytes(blob("OSMHeader", head) + blob("OSMData", block))


def test_pbf_to_tiles(spark, tmp_path):
    pbf_file(tmp_path / "map.osm.pbf")
    store = Store(spark, str(tmp_path / "store"))
    build.digest_pbf(store, str(tmp_path / "map.osm.pbf"))
    assert store.properties()["sequence"] == 77
    assert {(r.id, r.version, r.visible) for r in store.read("nodes").collect()} == {(1, 1, True), (2, 1, True), (3, 1, True), (4, 2, True), (5, 3, False)}
    assert {(r.id, r.x, r.y) for r in store.read("points").collect()} == {(1, 0, 0), (2, 4_000_000, 0), (3, 4_000_000, 4_000_000), (4, 0, 4_000_000)}
    assert store.read("ways").first().nodes == [1, 2, 3, 4, 1]
    assert store.read("refs").count() == 5
    build.assemble_geometry(store, levels=2)
    text = build.tile(store, 0, 3, 3)
    assert '"id":"way/10"' in text and '"type":"Polygon"' in text and text.index("way/10") < text.index("relation/20")
    assert build.tile(store, 0, 900, 900) == "" and '"way/10"' in build.tile(store, 1, 1, 1)
    assert build.external(store, 0, "way/000/000/010.json") is None
    assert build.average_point_density(store).first().mean == 4_000_000.0
    build.recompute_references(store)
    assert store.read("refs").count() == 5


def test_pbf_needs_history(spark, tmp_path):
    pbf_file(tmp_path / "map.osm.pbf", features=("DenseNodes",))
    with pytest.raises(Exception, match="HistoricalInformation"):
        pbf.read(spark, str(tmp_path / "map.osm.pbf")).collect()
    assert pbf.read(spark, str(tmp_path / "map.osm.pbf"), any_order=True).count() == 8


def test_shapefile(spark, tmp_path):
    outer = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    hole = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8), (0.2, 0.2)]
    points = [c for p in outer + hole for c in p]
    record = struct.pack("<i4d2i2i", 5, 0, 0, 1, 1, 2, 10, 0, 5) + struct.pack(f"<{len(points)}d", *points)
    data = b"\0" * 100 + b"".join(struct.pack(">2i", i + 1, len(record) // 2) + record for i in range(2))
    (tmp_path / "coast.shp").write_bytes(data)
    got = shapefile.read(spark, str(tmp_path / "coast.shp")).orderBy("id").collect()
    assert [r.id for r in got] == [0, 1] and len(got[0].shapes[0].inners) == 1 and got[0].shapes[0].outer[1].y == 10_000_000


def test_paths_name_their_file_system(spark):
    from tessera.sources import shared

    assert shared.located(spark, "/a/b") == "file:///a/b" and shared.located(spark, "s3a://bucket/x") == "s3a://bucket/x"
    assert shared.storage("file:///a/b")[1] == shared.storage("/a/b")[1] == "/a/b"
    assert shared.shared_dir(spark).startswith("file:/")
