import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import coords, ids, tagrules
from tessera.operators import features


def values(spark, kind, rows, *columns):
    table = spark.createDataFrame([(r,) for r in rows], f"v {kind}")
    return [tuple(r) for r in table.select(*[c(F.col("v")) for c in columns]).collect()]


def test_coordinate_text(spark):
    want = {0: "0.0", 1: "0.0000001", -5_000_000: "-0.5", 10_000_000: "1.0", 123_456_789: "12.3456789", -1_800_000_000: "-180.0"}
    assert [x for (x,) in values(spark, "int", want, coords.text)] == list(want.values())


def test_coordinate_parse(spark):
    want = {"1": 10_000_000, "-0.5": -5_000_000, "1.23456789": 12_345_678, "-1.23456789": -12_345_678, "-0.00000015": -1}
    assert [x for (x,) in values(spark, "string", want, coords.parse)] == list(want.values())
    for wrong in ("+1", ".5", "1e3", ""):
        with pytest.raises(Exception, match="not a coordinate"):
            values(spark, "string", [wrong], coords.parse)


def test_fixed_floors(spark):
    assert values(spark, "double", [-0.00000015, 1.5], coords.to_fixed) == [(-2,), (15_000_000,)]


def test_tile_of_point(spark):
    assert values(spark, "int", [-1, 0, 156_249, 156_250], coords.to_tile) == [(-1,), (0,), (0,), (1,)]
    assert values(spark, "int", [156_250], lambda v: coords.to_tile(v, 1)) == [(0,)]


EDGES = [(0, 0), (-1, 0), (0, -1), (-1, -1), (2**31 - 1, -(2**31)), (-(2**31), 2**31 - 1), (11520, 5760), (-11520, -5760)]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**31), 2**31 - 1), st.integers(-(2**31), 2**31 - 1)), min_size=1, max_size=50))
def test_morton_round_trip(spark, pairs):
    pairs = pairs + EDGES
    table = spark.createDataFrame(pairs, "x int, y int").withColumn("m", ids.morton(F.col("x"), F.col("y")))
    got = table.select("x", "y", ids.morton_x(F.col("m")), ids.morton_y(F.col("m")), "m").collect()

    def plain(x, y):
        code = sum(((x >> i) & 1) << 2 * i | ((y >> i) & 1) << 2 * i + 1 for i in range(32))
        return code - (1 << 64) if code >> 63 else code

    assert all((r[0], r[1]) == (r[2], r[3]) and r[4] == plain(r[0], r[1]) for r in got)


def test_combined_ids(spark):
    rows = spark.createDataFrame([(k, 7) for k in range(4)], "k int, i long").withColumn("c", ids.combined_id(F.col("k"), F.col("i")))
    got = rows.select(ids.element_type(F.col("c")), ids.element_id(F.col("c")), ids.type_name(F.col("k")), "c").collect()
    assert [tuple(r)[:3] for r in got] == [(k, 7, n) for k, n in enumerate(ids.TYPE_NAMES)]
    order = [r[0] for r in rows.orderBy(*ids.unsigned(F.col("c"))).select("k").collect()]
    assert order == [0, 1, 2, 3]
    with pytest.raises(Exception, match="unknown element type"):
        spark.createDataFrame([("area",)], "n string").select(ids.type_id(F.col("n"))).collect()


def test_locations(spark):
    rows = [(1, 5, "way/000/000/005.json"), (1, 123_456_789, "way/123/456/789.json"), (3, 1234, "coastline/001/234.json"), (1, 5_123_456_789, "way/5123/456/789.json")]
    table = spark.createDataFrame([r[:2] for r in rows], "k int, i long").withColumn("c", ids.combined_id(F.col("k"), F.col("i")))
    got = table.select(features.location(F.col("c")).alias("p"), "c").select("p", "c", features.location_id(F.col("p"))).collect()
    assert [r[0] for r in got] == [r[2] for r in rows]
    assert all(r[1] == r[2] for r in got)
    assert values(spark, "string", ["way/1/2.json", "x", "way/000/000/00a.json"], features.location_id) == [(None,)] * 3


def test_external_rule(spark):
    rows = [(1, 1, "x" * 5000), (1, 2, "x" * 2048), (1, 2, "x" * 2049), (3, 1, "x")]
    table = spark.createDataFrame(rows, "k int, n int, t string")
    got = table.select(features.is_external(ids.combined_id(F.col("k"), F.lit(1)), F.col("n"), F.col("t"))).collect()
    assert [r[0] for r in got] == [False, False, True, True]


def test_area_rules(spark):
    cases = [
        ({}, False), ({"area": "yes"}, True), ({"area": "no", "building": "yes"}, False), ({"building": "no"}, False), ({"natural": "coastline"}, False),
        ({"natural": "wood"}, True), ({"waterway": "dam"}, True), ({"aeroway": "taxiway"}, False), ({"area": "maybe", "shop": "x"}, True), (None, False),
    ]
    table = spark.createDataFrame([(c[0],) for c in cases], "t map<string,string>")
    assert [r[0] for r in table.select(tagrules.is_way_area(F.col("t"))).collect()] == [c[1] for c in cases]
    cases = [({"type": "boundary"}, True), ({"type": "route"}, False), ({"type": "route", "postal_code": "1"}, True), ({}, False)]
    table = spark.createDataFrame([(c[0],) for c in cases], "t map<string,string>")
    assert [r[0] for r in table.select(tagrules.is_relation_area(F.col("t"))).collect()] == [c[1] for c in cases]


def test_feature_text(spark):
    table = spark.createDataFrame([({"b": 'q"\n', "a": "1"}, [(0, 0), (-5_000_000, 1)]), ({}, [(1, 1), (2, 2)])], "t map<string,string>, l array<struct<x:int,y:int>>")
    got = [r[0] for r in table.select(features.feature(features.line_geometry(F.col("l")), F.col("t"), ids.combined_id(1, F.lit(9).cast("long")))).collect()]
    assert got[0] == '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0.0,0.0],[-0.5,0.0000001]]},"properties":{"a":"1","b":"q\\"\\n"},"id":"way/9"}'
    assert '"properties"' not in got[1]
