"""The jobs of the engine, by mode: digest, assemble, update, serve and upkeep, each a few Spark plans over a store."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids, tagrules
from tessera.operators import compare, elements, features, rings, shapes, tiling
from tessera.sources import osm_xml, pbf, shapefile
from tessera.sources.shared import materialize
from tessera.sources.store import Store


def digest_pbf(store: Store, path: str, any_order: bool = False) -> None:
    """Latest elements and their references from a PBF file, with its replication properties."""
    found = pbf.tables(pbf.read(store.spark, path, any_order))
    head = pbf.header(path)
    edges = elements.references(found["ways"], found["relations"])
    order = {"nodes": "id", "points": "id", "ways": "id", "relations": "id", "refs": "ref"}
    store.commit(found | {"refs": edges}, sort=order, sequence=head.get("sequence", -1), timestamp=head.get("timestamp"), base_url=head.get("base_url"))


def digest_coastlines(store: Store, path: str) -> None:
    store.commit({"coastlines": shapefile.read(store.spark, path)})


def recompute_references(store: Store) -> None:
    store.commit({"refs": elements.references(store.read("ways"), store.read("relations"))}, sort={"refs": "ref"})


def geometries(tables: dict[str, DataFrame], only: DataFrame | None = None, areas: bool = True) -> DataFrame:
    """``(combined_id, tags, line, shapes)`` of every visible way, relation and coastline that has a geometry.

    ``tables`` are a store's by name; ``only``, a table of combined_id, keeps the elements to be assembled to those. They and what they
    refer to are then read by key. Without ``areas`` every way is a line, closed ones too, and nothing else is assembled.
    """
    points, by_key = tables["points"], only is not None

    def wanted(table: DataFrame, kind: int) -> DataFrame:
        if only is None:
            return table
        own = only.filter(ids.element_type(F.col("combined_id")) == kind).select(ids.element_id(F.col("combined_id")).alias("id"))
        return elements.narrowed(table, "id", own)

    own = lambda kind: ids.combined_id(kind, F.col("id")).alias("combined_id")
    ways = elements.way_geometries(wanted(tables["ways"].filter("visible"), ids.WAY), points, by_key)
    if not areas:
        return ways.select(own(ids.WAY), "tags", "line", F.lit(None).cast(shapes.SHAPES).alias("shapes"))
    ways = materialize(ways.select(own(ids.WAY), "tags", "kind", "line"), "ways")
    relations = wanted(tables["relations"].filter("visible"), ids.RELATION)
    closed = ways.filter("kind = 'area'").select(F.col("combined_id").alias("id"), F.lit(0).alias("line"), F.posexplode("line").alias("pos", "p")).select("id", "line", "pos", "p.x", "p.y")
    of_relations = elements.relation_points(relations, tables["ways"], points, by_key).select(ids.combined_id(ids.RELATION, F.col("id")).alias("id"), "line", "pos", "x", "y")
    areas = rings.assemble(materialize(closed.union(of_relations), "borders")).withColumnRenamed("id", "combined_id")
    areas = materialize(areas, "areas")
    # a closed way whose ring is not valid stays a line
    made = ways.join(areas, "combined_id", "left")
    none = F.lit(None).cast(elements.POINTS).alias("line")
    parts = [made.select("combined_id", "tags", F.when(F.col("shapes").isNull(), F.col("line")).alias("line"), "shapes")]
    parts.append(areas.join(relations.select(own(ids.RELATION), "tags"), "combined_id").select("combined_id", "tags", none, "shapes"))
    if "coastlines" in tables:
        coast = wanted(tables["coastlines"], ids.COASTLINE)
        parts.append(coast.select(own(ids.COASTLINE), F.create_map(F.lit("natural"), F.lit("coastline")).alias("tags"), none, "shapes"))
    return reduce(DataFrame.union, parts)


def simplified(made: DataFrame, level: int) -> DataFrame:
    """``made`` with ``_line`` and ``_shapes``, its geometries simplified for a level; those that the level drops are gone."""
    simple = made.withColumns({"_line": shapes.simplify(F.col("line"), level), "_shapes": shapes.simplify_shapes(F.col("shapes"), level)})
    return simple.filter("_line is not null or _shapes is not null")


def geometry_features(made: DataFrame, level: int, areas: bool = True) -> DataFrame:
    """``(combined_id, json, tiles, n_tiles, external)`` of each geometry; ``areas`` says that there may be some. A line's text and tiles
    are made where the line is, so neither is shuffled."""
    own = lambda geometry: features.feature(geometry, F.col("tags"), F.col("combined_id")).alias("json")
    held = tiling.tiles_of_line(F.col("line"), level).alias("held")
    lines = features.place_lists(made.filter("line is not null").select("combined_id", own(features.line_geometry(F.col("line"))), held))
    if not areas:
        return lines
    shaped = made.filter("shapes is not null")
    each = shaped.select("combined_id", F.explode("shapes").alias("s")).select("combined_id", "s.outer", "s.inners")
    return lines.union(features.place(shaped.select("combined_id", own(features.area_geometry(F.col("shapes")))), tiling.polygon_intervals(each, "combined_id", level=level)))


def node_features(tables: dict[str, DataFrame], only: DataFrame | None = None) -> DataFrame:
    """``laid_out`` for the visible tagged nodes, on level 0: nodes that were asked for in tiles; ``only`` as in ``geometries``."""
    own = ids.combined_id(ids.NODE, F.col("id")).alias("combined_id")
    nodes, points = tables["nodes"], tables["points"]
    if only is not None:
        keys = only.filter(ids.element_type(F.col("combined_id")) == ids.NODE)
        nodes, points = (elements.narrowed(t, "id", keys) for t in (nodes, points))
    tagged = nodes.filter(tagrules.allowed_in_tiles(F.lit(ids.NODE), F.col("visible"), nodes=True) & (F.size("tags") > 0))
    placed = tiling.point_tiles(tagged.join(points, "id"))
    text = features.feature(features.point_geometry(F.struct("x", "y")), F.col("tags"), ids.combined_id(ids.NODE, F.col("id")))
    return features.place(placed.select(own, text.alias("json")), placed.select(own, "tile_pos")).withColumn("level", F.lit(0))


def laid_out(made: DataFrame, levels: int) -> DataFrame:
    """Table ``features (level, combined_id, json, tiles, n_tiles, external)`` of every level below ``levels``.

    A level simplifies the geometries that the levels below it keep. They are written once, as text and tiles read them several times.
    """
    placed, made = [], materialize(made, "geometries")
    areas = not made.filter("shapes is not null").isEmpty()
    for level in range(levels):
        simple = made
        if level:
            both = materialize(simplified(made, level), "simplified")
            made = both.drop("_line", "_shapes")
            simple = both.drop("line", "shapes").withColumnsRenamed({"_line": "line", "_shapes": "shapes"})
        placed.append(geometry_features(simple, level, areas).withColumn("level", F.lit(level)))
    return reduce(DataFrame.union, placed)


def tables_of(store: Store) -> dict[str, DataFrame]:
    return {name: store.read(name) for name in store.tables()}


def assemble_geometry(store: Store, levels: int = 1, nodes: bool = False, areas: bool = True) -> None:
    """Write the features of ``laid_out`` for everything in the store, and the tiles that they make; tagged nodes are among them only if
    they are asked for, and areas unless they are not. An update keeps to both.

    A text that stands in several tiles is written once, with the feature, and not in each of them (``features.entry_text``):
    ``tile_rows`` and ``tile`` give tiles with all their texts."""
    tables = tables_of(store)
    placed = laid_out(geometries(tables, areas=areas), levels)
    placed = materialize(placed.unionByName(node_features(tables)) if nodes else placed, "features")
    sort = {"features": "combined_id", "tiles": ["level", "tile_pos", "combined_id"]}
    store.commit({"features": placed, "tiles": features.spread(placed, features.entry_text())}, sort=sort, levels=levels, nodes=nodes, areas=areas)


def tile_rows(store: Store, of: Callable[[Column], Column] = lambda text: text) -> DataFrame:
    """``(level, tile_pos, combined_id, json)``: the store's tiles, every entry with its text or with ``of`` it."""
    return features.with_texts(store.read("tiles"), store.read("features"), of)


def average_point_density(store: Store) -> DataFrame:
    made = geometries(tables_of(store), areas=store.properties().get("areas", True))
    borders = made.filter("shapes is not null").select(F.explode("shapes").alias("s")).select(F.explode(F.concat(F.array("s.outer"), F.coalesce("s.inners", F.array()))).alias("line"))
    return elements.mean_segment_length(made.filter("line is not null").select("line").union(borders))


def tile(store: Store, level: int, x: int, y: int) -> str:
    """A tile's text, empty where nothing is; the features of which it needs the texts are read by key."""
    mine = features.tile(store.read("tiles").filter(F.col("level") == level), x, y)
    near = elements.narrowed(store.read("features").filter(F.col("level") == level), "combined_id", mine.filter("json is null").select("combined_id"))
    found = features.tile_documents(features.with_texts(mine, near)).select("document").first()
    return found[0] if found else ""


def external(store: Store, level: int, path: str) -> str | None:
    """An externally stored feature by its location."""
    wanted = features.location_id(F.lit(path))
    found = store.read("features").filter((F.col("level") == level) & F.col("external") & (F.col("combined_id") == wanted)).select("json").first()
    return found[0] if found else None


#: What names a row of each table.
KEYS = {
    "nodes": ["id"], "points": ["id"], "ways": ["id"], "relations": ["id"], "coastlines": ["id"], "refs": ["ref", "referrer"],
    "features": ["combined_id", "level"], "tiles": ["tile_pos", "level", "combined_id"],
}


def compare_stores(one: Store, other: Store, tables: list[str] | None = None) -> DataFrame:
    """``(table_name, change, n)``: how many rows of each table were added, removed or changed from one store to the other; tables that
    one of them lacks are passed over."""
    both = [t for t in one.tables() if t in KEYS and t in other.tables() and t in (tables or KEYS)]
    rows = lambda store, t: tile_rows(store) if t == "tiles" else store.read(t)
    counts = [compare.diff_by_ranges(rows(one, t), rows(other, t).select(rows(one, t).columns), KEYS[t]).groupBy("change").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "change", "n") for t in both]
    return reduce(DataFrame.union, counts)


PURGES = {"coastlines": ("coastlines",), "geometry": ("features", "tiles"), "osm": ("nodes", "points", "ways", "relations", "refs")}


def main(argv: list[str] | None = None) -> None:
    from tessera.plans import update  # these two build on this module
    from tessera.streaming import replication

    parser = argparse.ArgumentParser(description="Jobs over a store of map data")
    parser.add_argument("mode", choices=["digest_pbf", "digest_coastlines", "recompute_references", "assemble_geometry", "average_point_density", "compare", "compact", "create_snapshot", "purge", "stats", "start", "update_to", "rollback_to", "release", "info", "get", "follow"])
    parser.add_argument("store")
    parser.add_argument("arguments", nargs="*")
    parser.add_argument("--levels", type=int, default=1)
    parser.add_argument("--nodes", action="store_true", help="tagged nodes in tiles too")
    given = parser.parse_args(argv)
    store = Store(SparkSession.builder.getOrCreate(), given.store)
    if given.mode == "digest_pbf":
        digest_pbf(store, *given.arguments)
    elif given.mode == "digest_coastlines":
        digest_coastlines(store, *given.arguments)
    elif given.mode == "recompute_references":
        recompute_references(store)
    elif given.mode == "assemble_geometry":
        assemble_geometry(store, given.levels, given.nodes)
    elif given.mode == "average_point_density":
        average_point_density(store).show()
    elif given.mode == "compare":
        compare_stores(store, Store(store.spark, given.arguments[0])).show()
    elif given.mode == "compact":
        for name in store.tables():
            store.compact(name)
    elif given.mode == "create_snapshot":
        store.snapshot(given.arguments[0])
    elif given.mode == "purge":
        for name in given.arguments:
            store.purge(*PURGES[name], properties=("sequence", "followed", "timestamp", "base_url") if name == "osm" else ())
    elif given.mode == "stats":
        store.stats().show()
    elif given.mode == "start":
        print(update.start(store, osm_xml.states(store.spark, given.arguments[0]), given.arguments[1]))
    elif given.mode == "update_to":
        print(update.update_to(store, given.arguments[0], int(given.arguments[1])))
    elif given.mode == "rollback_to":
        update.rollback_to(store, int(given.arguments[0]))
    elif given.mode == "release":
        store.release()
    elif given.mode == "info":
        print(update.info(store))
    elif given.mode == "get":
        kind, number, *what = given.arguments
        update.get(store, kind, int(number), *what).show(truncate=False)
    else:
        source, checkpoint, *feed = given.arguments
        replication.follow(store.spark, store, source, checkpoint, feed=feed[0] if feed else "osmchange").awaitTermination()


if __name__ == "__main__":
    main()
