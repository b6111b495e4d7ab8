"""The changeset files of a replication folder as a stream."""

import gzip
import io
import os
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import changes as ch
from tessera.sources import osc_stream, osm_xml
from tessera.sources.store import Store
from tessera.streaming import replication

ONE = """<osmChange version="0.6" generator="x"><create><node id="1" version="1" timestamp="2024-01-02T03:04:05Z" lon="-0.5" lat="1.23456789"><tag k="a" v="b &amp; c"/></node>
<way id="7" version="1" timestamp="2024-01-02T03:04:06Z"><nd ref="1"/><nd ref="2"/><nd ref="1"/></way></create><delete><relation id="3" version="4" timestamp="2024-01-02T03:04:07Z"/></delete>
<modify><relation id="4" version="2" timestamp="2024-01-02T03:04:08Z"><member type="way" ref="7" role="outer"/><member type="relation" ref="3" role=""/></relation></modify></osmChange>"""
NODE = '<osmChange><{op}><node id="{i}" version="{v}" timestamp="2024-02-01T00:00:0{v}Z" lon="0.00{v}" lat="7"/></{op}></osmChange>'


def put(folder, sequence, text, state=True):
    path = folder / osc_stream.changeset_path(sequence)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()))
    if state:
        (folder / "state.txt").write_text(f"#now\nsequenceNumber={sequence}\ntimestamp=2024-02-01T00\\:00\\:00Z\n")


def read(spark, folder, tmp_path, after):
    got = []
    stream = osc_stream.stream(spark, str(folder), after).writeStream.foreachBatch(lambda b, _: got.extend(b.collect()))
    stream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return got


def test_rows_are_those_of_the_batch_reader(spark, tmp_path):
    put(tmp_path / "feed", 1_234_567, ONE)
    got = read(spark, tmp_path / "feed", tmp_path, 1_234_566)
    assert [(r.seq, r.ord, r.op, r.type, r.id) for r in got] == [(1_234_567, 0, "create", 0, 1), (1_234_567, 1, "create", 1, 7), (1_234_567, 2, "delete", 2, 3), (1_234_567, 3, "modify", 2, 4)]
    kept = ["op", "type", "id", "version", "ts", "tags", "refs", "roles", "x", "y"]
    plain = osm_xml.changes(spark, str(tmp_path / "feed" / "001")).select(kept).collect()
    assert sorted(str([r[c] for c in kept]) for r in got) == sorted(str(list(r)) for r in plain)
    assert got[3].roles == ["outer", ""] and got[0].x == -5_000_000 and got[0].y == 12_345_678


def test_it_goes_on_where_it_ended(spark, tmp_path):
    folder = tmp_path / "feed"
    for i in range(5):
        put(folder, i, NODE.format(op="create", i=i, v=1))
    assert sorted(r.seq for r in read(spark, folder, tmp_path, 1)) == [2, 3, 4]
    assert read(spark, folder, tmp_path, 1) == []
    put(folder, 5, NODE.format(op="create", i=9, v=1))
    put(folder, 6, "<osmChange/>")
    assert [r.id for r in read(spark, folder, tmp_path, 1)] == [9]


def test_without_a_state_file_it_reads_as_far_as_files_follow(spark, tmp_path):
    for i in (0, 1, 3):
        put(tmp_path / "feed", i, NODE.format(op="create", i=i, v=1), state=False)
    assert sorted(r.seq for r in read(spark, tmp_path / "feed", tmp_path, -1)) == [0, 1]


def test_a_missing_changeset_is_an_error(spark, tmp_path):
    put(tmp_path / "feed", 1, NODE.format(op="create", i=1, v=1))
    put(tmp_path / "feed", 3, NODE.format(op="create", i=2, v=1))
    with pytest.raises(Exception, match="002.osc.gz"):
        read(spark, tmp_path / "feed", tmp_path, 0)


def test_followed_into_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"elements": spark.createDataFrame([], ch.ELEMENT)}, sequence=7)
    put(tmp_path / "feed", 8, NODE.format(op="create", i=1, v=1))
    put(tmp_path / "feed", 9, NODE.format(op="modify", i=1, v=2))
    for _ in range(2):
        replication.follow(spark, store, str(tmp_path / "feed"), str(tmp_path / "followed"), feed="osmchange").awaitTermination()
    assert [(r.id, r.version, r.x) for r in store.read("elements").collect()] == [(1, 2, 20_000)] and store.properties()["sequence"] == 9


def test_a_long_document_is_read_piece_by_piece():
    text = "<osmChange><modify>" + '<node id="1" version="2" lat="1" lon="1"><tag k="k" v="v"/></node>' * 20_000 + "</modify></osmChange>"
    rows = osc_stream.rows_of(io.BytesIO(text.encode()), 3)
    assert next(rows)[:6] == (3, 0, "modify", 0, 1, 2) and sum(1 for _ in rows) == 19_999


@pytest.mark.parametrize("text,want", [("1", 10_000_000), ("-0.00000019", -1), ("180.0", 1_800_000_000), (None, None)])
def test_fixed(text, want):
    assert osc_stream.fixed(text) == want


def test_wrong_coordinates():
    for text in ("+1", "1e3", ".5", "1."):
        with pytest.raises(ValueError):
            osc_stream.fixed(text)


def test_written_feeds_hold_every_day(spark, tmp_path):
    from tessera.plans import standin

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    made = standin.changes(spark, sf)
    first = standin.write_feed(made, str(tmp_path / "feed"))
    got = spark.createDataFrame(read(spark, tmp_path / "feed", tmp_path, first - 1), ch.FEED)
    kept = ["seq", "op", "type", "id", "version", "ts", "tags"]
    assert sorted(map(str, got.select(kept).collect())) == sorted(map(str, made.select(kept).collect()))
    assert got.filter("op <> 'delete'").select(F.sum("x"), F.sum("y")).first() == made.filter("op <> 'delete'").select(F.sum("x"), F.sum("y")).first()


def test_a_feeds_files_are_written_in_pieces(spark, tmp_path, monkeypatch):
    """A changeset's file is put together of pieces in their order, and none of them holds the changeset."""
    from tessera.plans import standin

    monkeypatch.setattr(standin, "CHANGES_BITS", 3)
    made = spark.range(0, 100, 1, 7).repartition(5).select(
        F.when(F.col("id") < 90, 5).otherwise(8).cast("long").alias("seq"), F.col("id").alias("ord"), F.lit("create").alias("op"), F.lit(0).alias("type"), (F.col("id") * 7).alias("id"),
        F.lit(1).alias("version"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.create_map(F.lit("k"), F.lit("<&")).alias("tags"), F.lit(1).alias("x"), F.lit(2).alias("y"),
    )
    assert standin.write_feed(made, str(tmp_path / "feed")) == 5
    held = {i: (tmp_path / "feed" / osc_stream.changeset_path(i)).read_bytes() for i in range(5, 9)}
    assert gzip.decompress(held[6]) == gzip.decompress(held[7]) == b'<osmChange version="0.6"></osmChange>'
    for i, ids in ((5, range(0, 90)), (8, range(90, 100))):
        assert [r[4] for r in osc_stream.rows_of(io.BytesIO(gzip.decompress(held[i])), i)] == [k * 7 for k in ids]
    members, rest = 0, held[5]
    while rest:
        one = zlib.decompressobj(31)
        assert one.decompress(rest).count(b"<create>") <= 8
        members, rest = members + 1, one.unused_data
    assert members == 14


def test_a_batch_is_not_held_by_executors(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(replication, "advance", lambda store, batch: seen.append((batch.is_cached, batch.count())))
    store = Store(spark, str(tmp_path / "store"))
    store.set_properties(sequence=0)
    put(tmp_path / "feed", 1, NODE.format(op="create", i=1, v=1))
    replication.follow(spark, store, str(tmp_path / "feed"), str(tmp_path / "followed"), feed="osmchange").awaitTermination()
    assert seen == [(False, 1)]
