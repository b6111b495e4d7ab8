"""GeoJSON text of features, references to externally stored ones, and tile documents."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import coords, ids

#: A feature in more than one tile is stored once if its text has more bytes than this.
INLINE_BYTES = 2048
#: Ids of a range, of which a tile's features are gathered at once, as a power of two.
ID_RANGE_BITS = 16
#: The same for the features of which digests' pieces are made in one task, and how many of them make a piece.
PIECE_RANGE_BITS, FEATURES_AT_ONCE = 14, 4096


def point_text(p: Column) -> Column:
    return F.concat(F.lit("["), coords.text(p["x"]), F.lit(","), coords.text(p["y"]), F.lit("]"))


def _list(points: Column, one) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(points, one), ","), F.lit("]"))


def _geometry(kind: str, coordinates: Column) -> Column:
    return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coordinates, F.lit("}"))


def point_geometry(p: Column) -> Column:
    return _geometry("Point", point_text(p))


def line_geometry(line: Column) -> Column:
    return _geometry("LineString", _list(line, point_text))


def multipoint_geometry(points: Column) -> Column:
    return F.when(F.size(points) == 1, point_geometry(F.get(points, F.lit(0)))).otherwise(_geometry("MultiPoint", _list(points, point_text)))


def _rings(shape: Column) -> Column:
    return _list(F.concat(F.array(shape["outer"]), F.coalesce(shape["inners"], F.array())), lambda ring: _list(ring, point_text))


def area_geometry(shapes: Column) -> Column:
    """A polygon for one shape (outer ring and inner rings), else a multipolygon."""
    return F.when(F.size(shapes) == 1, _geometry("Polygon", _rings(F.get(shapes, F.lit(0))))).otherwise(_geometry("MultiPolygon", _list(shapes, _rings)))


def feature(geometry: Column, tags: Column, combined: Column) -> Column:
    """A feature's text. Properties go by key and are left out where there are none."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(tags)))
    properties = F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat(F.lit(',"properties":'), F.to_json(ordered))).otherwise("")
    name = F.concat(ids.type_name(ids.element_type(combined)), F.lit("/"), ids.element_id(combined).cast("string"))
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, properties, F.lit(',"id":"'), name, F.lit('"}'))


def location(combined: Column) -> Column:
    """Where an externally stored feature lies: its type, and its id in groups of three digits (two groups for coastlines)."""
    kind, number = ids.type_name(ids.element_type(combined)), ids.element_id(combined)
    deep = F.format_string("%s/%03d/%03d/%03d.json", kind, F.floor(number / 1_000_000), F.floor(number / 1000) % 1000, number % 1000)
    return F.when(ids.element_type(combined) == ids.COASTLINE, F.format_string("%s/%03d/%03d.json", kind, F.floor(number / 1000), number % 1000)).otherwise(deep)


def location_id(path: Column) -> Column:
    """The combined id that a location names; null for other text."""
    parts = F.split(F.regexp_replace(path, r"\.json$", ""), "/")
    number = F.aggregate(F.slice(parts, 2, 3), F.lit(0).cast("long"), lambda a, x: a * 1000 + x.try_cast("long"))
    right = path.rlike(r"^(node|way|relation)/\d{3,}/\d{3}/\d{3}\.json$|^coastline/\d{3,}/\d{3}\.json$")
    return F.when(right, ids.combined_id(ids.type_id(F.when(right, F.get(parts, F.lit(0)))), number))


def reference(combined: Column) -> Column:
    return F.concat(F.lit('{"type":"Reference","location":"'), location(combined), F.lit('"}'))


def is_external(combined: Column, n_tiles: Column, json: Column) -> Column:
    return (ids.element_type(combined) == ids.COASTLINE) | ((n_tiles > 1) & (F.octet_length(json) > INLINE_BYTES))


def _runs(intervals: Column) -> Column:
    """Ascending intervals that do not overlap, those that follow each other made one."""
    at = lambda i: F.get(intervals, i)
    firsts = F.filter(intervals, lambda x, i: F.coalesce(at(i - 1)["last"] + 1 != x["first"], F.lit(True)))
    lasts = F.filter(intervals, lambda x, i: F.coalesce(at(i + 1)["first"] - 1 != x["last"], F.lit(True)))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last")))


def place(features: DataFrame, hits: DataFrame) -> DataFrame:
    """``features (combined_id, json)`` with tiles, n_tiles and external; those without a tile go. ``tiles`` is an array of intervals
    ``first, last`` of tile positions, so its size goes with a feature's border and not with its area.

    ``hits`` is ``(combined_id, tile_pos)`` or, for intervals one of which may lie inside another but not across its end,
    ``(combined_id, first, last)``. Both may repeat: they are gathered once by feature and made distinct there.
    """
    if "tile_pos" in hits.columns:
        # tiles of lines seldom follow each other, so each is an interval
        gathered = hits.groupBy("combined_id").agg(F.sort_array(F.collect_set("tile_pos")).alias("held"))
        tiles = gathered.select("combined_id", F.arrays_zip(F.col("held").alias("first"), F.col("held").alias("last")).alias("tiles"), F.size("held").cast("long").alias("n_tiles"))
    else:
        before = Window.partitionBy("combined_id").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
        outermost = hits.withColumn("upto", F.max("last").over(before)).filter("upto is null or upto < first")
        gathered = outermost.groupBy("combined_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("held"), F.sum(F.col("last") - F.col("first") + 1).alias("n_tiles"))
        tiles = gathered.select("combined_id", _runs(F.col("held")).alias("tiles"), "n_tiles")
    return _counted(features.join(tiles, "combined_id"))


def place_lists(features: DataFrame) -> DataFrame:
    """``place`` where ``held``, an array of the feature's distinct tile positions in ascending order, is a column already."""
    listed = features.filter(F.size("held") > 0).withColumns({"tiles": F.arrays_zip(F.col("held").alias("first"), F.col("held").alias("last")), "n_tiles": F.size("held").cast("long")})
    return _counted(listed.drop("held"))


def _counted(placed: DataFrame) -> DataFrame:
    return placed.withColumn("external", is_external(F.col("combined_id"), F.col("n_tiles"), F.col("json")))


def line_text() -> Column:
    """What stands for a placed feature in its tiles: the feature itself, or its reference where it is external."""
    return F.when(F.col("external"), reference(F.col("combined_id"))).otherwise(F.col("json"))


def entry_text() -> Column:
    """``line_text`` as a store's tiles keep it: a text that stands in several tiles is left to the table of features, and is null there."""
    return F.when(F.col("n_tiles") == 1, line_text())


def spread(placed: DataFrame, text: Column) -> DataFrame:
    """A row of placed features for every tile, ``(tile_pos, combined_id, json)``, json being what ``text`` gives of the feature; with
    ``level`` before them where ``placed`` has it."""
    level = [c for c in placed.columns if c == "level"]
    # Spark drops the names of a struct's fields where a row is spread out beside it
    spans = placed.select(*level, "tiles", "combined_id", text.alias("json")).select(*level, F.explode("tiles").alias("t"), "combined_id", "json")
    return spans.select(*level, F.explode(F.sequence("t.first", "t.last")).alias("tile_pos"), "combined_id", "json")


def tile_rows(placed: DataFrame) -> DataFrame:
    """``(tile_pos, combined_id, json)``: the feature itself, or its reference where it is external, in every tile of its intervals; with
    ``level`` before them where ``placed`` has it."""
    return spread(placed, line_text())


def with_texts(entries: DataFrame, placed: DataFrame, of: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """A store's tiles as ``tile_rows`` again, the texts from the features that they were made of; ``of`` gives what is wanted of a text
    (a digest, say), so that no more than that travels to a feature's tiles."""
    shared = placed.filter("n_tiles > 1").select("level", "combined_id", of(line_text()).alias("_text"))
    met = entries.join(shared, ["level", "combined_id"], "left")
    return met.select("level", "tile_pos", "combined_id", F.coalesce(of(F.col("json")), "_text").alias("json"))


def tile_documents(rows: DataFrame, collection: bool = False) -> DataFrame:
    """``(tile_pos, n, document)``: a tile's features in unsigned id order, one on each line, or as one feature collection.

    Features are gathered by ranges of ids first, which spreads a full tile over many tasks and bounds their lists, and
    a tile's ranges are then put together in order.
    """
    mark = "," if collection else "\n"
    rows = rows.withColumn("range", F.shiftright("combined_id", ID_RANGE_BITS))
    held = F.sort_array(F.collect_list(F.struct("combined_id", "json")))
    parts = rows.groupBy("tile_pos", "range").agg(held.alias("held"))
    parts = parts.select("tile_pos", "range", F.size("held").cast("long").alias("n"), F.array_join("held.json", mark).alias("text"))
    # a range holds ids of one sign, in which signed order is unsigned order
    whole = F.sort_array(F.collect_list(F.struct((F.col("range") < 0).alias("high"), "range", "text")))
    text = F.array_join(F.col("held.text"), mark)
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), text, F.lit("]}")) if collection else text
    return parts.groupBy("tile_pos").agg(F.sum("n").alias("n"), whole.alias("held")).select("tile_pos", "n", text.alias("document"))


def tile_digests(placed: DataFrame) -> DataFrame:
    """``(tile_pos, n, n_bytes, digest)``: what ``tile_documents(tile_rows(placed))`` gives, its documents told by bytes and MD5.

    A document may have more bytes than a task has memory, so none is put together. Features are gathered by ranges of ids; a
    range's tasks make pieces of documents, a batch of features at a time, and a tile's pieces, compressed, go through its digest in order.
    """
    high = (F.col("combined_id") < 0).alias("high")
    rows = placed.select(F.shiftright("combined_id", PIECE_RANGE_BITS).alias("range"), high, "combined_id", line_text().alias("json"), F.transform("tiles", lambda t: t["first"]).alias("firsts"), F.transform("tiles", lambda t: t["last"]).alias("lasts"))
    # in a task's order no range of another task lies inside a batch's ids unless the range changes there
    ordered = rows.repartition("range").sortWithinPartitions("high", "combined_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = batch.column("range").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for a, b in zip(bounds, bounds[1:]):
                for at in range(a, b, FEATURES_AT_ONCE):
                    yield pieces(batch.slice(at, min(b - at, FEATURES_AT_ONCE)))

    def pieces(some: pa.RecordBatch) -> pa.RecordBatch:
        firsts, lasts = (some.column(c).flatten().to_numpy() for c in ("firsts", "lasts"))
        of = np.repeat(np.arange(some.num_rows), pc.list_value_length(some.column("firsts")).to_numpy())
        size = lasts - firsts + 1
        tile = np.repeat(firsts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        of = np.repeat(of, size)
        order = np.argsort(tile, kind="stable")
        tile, of = tile[order], of[order]
        starts = np.flatnonzero(np.diff(tile, prepend=tile[:1] - 1))
        ends = np.append(starts[1:], len(tile))
        texts = [x.as_buffer().to_pybytes() for x in some.column("json").cast(pa.binary())]
        made = [b"\n".join([texts[i] for i in of[a:b].tolist()]) for a, b in zip(starts.tolist(), ends.tolist())]
        first = some.column("combined_id").to_numpy()[of[starts]]
        columns = [pa.array(tile[starts]), pa.array(first < 0), pa.array(first), pa.array(ends - starts), pa.array([zlib.compress(x, 1) for x in made], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["tile_pos", "high", "first", "n", "piece"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([n], pa.int64()), pa.array([n_bytes], pa.int64()), pa.array([digest.hexdigest()])], names=["tile_pos", "n", "n_bytes", "digest"])

        tile = None
        for batch in batches:
            for pos, more, held in zip(batch.column("tile_pos").to_pylist(), batch.column("n").to_pylist(), batch.column("piece")):
                if pos != tile:
                    if tile is not None:
                        yield row()
                    tile, n, n_bytes, digest = pos, 0, -1, hashlib.md5(usedforsecurity=False)
                text = zlib.decompress(held.as_buffer())
                if n:
                    digest.update(b"\n")
                digest.update(text)
                n, n_bytes = n + more, n_bytes + 1 + len(text)
        if tile is not None:
            yield row()

    made = ordered.mapInArrow(cut, "tile_pos long, high boolean, first long, n long, piece binary")
    return made.repartition("tile_pos").sortWithinPartitions("tile_pos", "high", "first").mapInArrow(digested, "tile_pos long, n long, n_bytes long, digest string")


def tile(rows: DataFrame, x: int, y: int) -> DataFrame:
    """One tile's rows; the filter on the key reaches the scan of a table sorted by tile_pos."""
    return rows.filter(F.col("tile_pos") == ids.morton(F.lit(x), F.lit(y)))
