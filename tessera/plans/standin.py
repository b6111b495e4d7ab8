"""Map-like tables worked out from the driver's tables, by arithmetic that any SQL engine repeats."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import coords, ids
from tessera.sources import osc_stream
from tessera.sources.shared import storage

#: Places in a file of which one task makes pieces, as a power of two.
CHANGES_BITS = 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: Column, factor: int) -> Column:
    return (key * factor % 2000003 - 1000000).cast("int")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(k.alias("id"), place(k, 48271).alias("x"), place(k, 69621).alias("y"), F.create_map(F.lit("brand"), "p_brand", F.lit("type"), "p_type").alias("tags"))


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways without tags: what the joins read."""
    item = table(spark, sf_dir, "lineitem")
    held = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return item.groupBy(F.col("l_orderkey").alias("id")).agg(held.alias("held")).select("id", F.col("held.l_partkey").alias("nodes"))


def way_tags(status: Column, priority: Column) -> Column:
    kind = F.when(status == "F", "building").when(status == "O", "highway").otherwise("natural")
    value = F.when(status == "F", "yes").when(status == "O", "residential").otherwise("coastline")
    return F.map_from_arrays(F.array(kind, F.lit("priority")), F.array(value, priority))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), way_tags(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("tags"))
    return way_nodes(spark, sf_dir).join(order, "id")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, order = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    role = F.when(F.col("o_orderstatus") == "F", "outer").when(F.col("o_orderstatus") == "O", "inner").otherwise("")
    member = F.struct("o_orderkey", F.struct(ids.combined_id(ids.WAY, F.col("o_orderkey")).alias("combined_id"), role.alias("role")).alias("m"))
    held = order.groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_list(member)).alias("held"))
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "multipolygon").otherwise("route")
    tags = customer.select(F.col("c_custkey").alias("id"), F.create_map(F.lit("type"), kind).alias("tags"))
    return held.select("id", F.col("held.m").alias("members")).join(tags, "id")


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, cx, cy, h, outer, inners)``: squares of half side h, those of even ids with a hole of half that."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(
        k.alias("id"), (k * 104729 % 1600000 - 800000).cast("int").alias("cx"), (k * 130363 % 1600000 - 800000).cast("int").alias("cy"), ((k % 7 + 1) * 40000).cast("int").alias("h")
    )

    def ring(h: Column) -> Column:
        return F.array(*[F.struct((F.col("cx") + a * h).cast("int").alias("x"), (F.col("cy") + b * h).cast("int").alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])

    hole = ring(F.floor(F.col("h") / 2).cast("int"))
    return base.withColumns({"outer": ring(F.col("h")), "inners": F.when(F.col("id") % 2 == 0, F.array(hole)).otherwise(F.slice(F.array(hole), 1, 0))})


def square_store(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of a store: ``squares``' corners as nodes 10 * id + i (i from 0, the hole's from 4), the squares as closed ways 2 * id that are
    buildings and the holes as closed ways 2 * id + 1 that are not areas, and relations of both for even ids. Every third square's first corner is
    tagged."""
    s = squares(spark, sf_dir)
    common = [F.lit(1).alias("version"), F.lit(True).alias("visible")]
    corners = F.flatten(F.array(F.slice("outer", 1, 4), F.slice(F.coalesce(F.get("inners", F.lit(0)), F.slice("outer", 1, 0)), 1, 4)))
    at = s.select("id", F.posexplode(corners).alias("i", "p")).select("id", "i", (F.col("id") * 10 + F.col("i")).alias("node"), "p.x", "p.y")
    no_tags = F.create_map().cast("map<string,string>")
    shop = F.when((F.col("id") % 3 == 0) & (F.col("i") == 0), F.create_map(F.lit("shop"), F.lit("a"))).otherwise(no_tags)
    ring = lambda first: F.array(*[F.col("id") * 10 + first + i for i in (0, 1, 2, 3, 0)])
    ways = s.select((F.col("id") * 2).alias("id"), *common, F.create_map(F.lit("building"), F.lit("yes")).alias("tags"), ring(0).alias("nodes"))
    holes = s.filter("id % 2 = 0").select((F.col("id") * 2 + 1).alias("id"), *common, no_tags.alias("tags"), ring(4).alias("nodes"))
    member = lambda k, role: F.struct(ids.combined_id(ids.WAY, F.col("id") * 2 + k).alias("combined_id"), F.lit(role).alias("role"))
    relations = s.filter("id % 2 = 0").select("id", *common, F.create_map(F.lit("type"), F.lit("multipolygon")).alias("tags"), F.array(member(0, "outer"), member(1, "inner")).alias("members"))
    return {
        "nodes": at.select(F.col("node").alias("id"), *common, shop.alias("tags")),
        "points": at.select(F.col("node").alias("id"), "x", "y"),
        "ways": ways.union(holes),
        "relations": relations,
    }


def square_changes(tables: dict[str, DataFrame]) -> DataFrame:
    """A changeset for ``square_store``: the nodes of every seventh square move by 70,000 in x, relations of ids that 10 divides have their roles left out,
    squares whose id 13 divides are deleted with their relations, and the third corners of those that 17 divides get tags."""
    none, nothing = F.lit(None).cast("int"), F.array().cast("array<long>")

    def change(rows: DataFrame, op: str, kind: int, tags: Column, refs: Column, roles: Column, x: Column = none, y: Column = none) -> DataFrame:
        return rows.select(
            F.lit(1).cast("long").alias("seq"), F.col("id").alias("ord"), F.lit(op).alias("op"), F.lit(kind).alias("type"), "id", F.lit(2).alias("version"),
            F.lit("2024-01-01").cast("timestamp").alias("ts"), tags.alias("tags"), refs.alias("refs"), x.alias("x"), y.alias("y"), roles.alias("roles"),
        )

    no_roles, no_tags = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    square = F.floor(F.col("id") / 10)
    nodes = tables["nodes"].join(tables["points"], "id").withColumn("square", square).filter("square % 13 <> 0")
    tags = F.when((F.col("square") % 17 == 0) & (F.col("id") % 10 == 2), F.create_map(F.lit("shop"), F.lit("b"))).otherwise(F.col("tags"))
    touched = nodes.filter("square % 7 = 0 or (square % 17 = 0 and id % 10 = 2)")
    moved = change(touched, "modify", ids.NODE, tags, nothing, no_roles, F.when(F.col("square") % 7 == 0, F.col("x") + 70_000).otherwise(F.col("x")), F.col("y"))
    bare = change(tables["relations"].filter("id % 10 = 0 and id % 13 <> 0"), "modify", ids.RELATION, F.col("tags"), F.col("members.combined_id"), no_roles)
    gone = change(tables["relations"].filter("id % 13 = 0"), "delete", ids.RELATION, no_tags, nothing, no_roles)
    ways = change(tables["ways"].filter(F.floor(F.col("id") / 2) % 13 == 0), "delete", ids.WAY, no_tags, nothing, no_roles)
    return moved.union(bare).union(gone).union(ways)


def square_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, line, pos, x, y)``: for each supplier, the sides of the squares of a grid of n by n, n being 3, 4 or 5, without the one in the
    second column and row, as a relation's members; grids of 5 have in that hole a smaller square. Each side is a line of three points, every
    other one backwards. Those of every seventh supplier lack a side, those of every eleventh have a thin triangle across."""
    k = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").select(
        k.alias("id"), (k * 104729 % 1600000 - 800000).cast("int").alias("ox"), (k * 130363 % 1600000 - 800000).cast("int").alias("oy"), (k % 3 + 3).cast("int").alias("n"), ((k % 5 + 1) * 1000).cast("int").alias("w")
    )
    cells = base.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1))).filter((F.col("c") % F.col("n") != 1) | (F.floor(F.col("c") / F.col("n")) != 1))
    cells = cells.select("id", "n", "c", "w", (F.col("ox") + F.col("c") % F.col("n") * F.col("w")).alias("x"), (F.col("oy") + F.floor(F.col("c") / F.col("n")) * F.col("w")).alias("y"))
    q = F.floor(F.col("w") / 4)
    island = base.filter("n = 5").select("id", "n", F.lit(25).alias("c"), (F.col("w") - 2 * q).alias("w"), (F.col("ox") + F.col("w") + q).alias("x"), (F.col("oy") + F.col("w") + q).alias("y"))
    corners = ((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    side = lambda i: F.array(*[F.struct(*[F.lit((corners[i][d] * (2 - m) + corners[i + 1][d] * m) // 2).alias("xy"[d]) for d in (0, 1)]) for m in (0, 1, 2)])
    sides = cells.union(island).select("*", F.posexplode(F.array(*[side(i) for i in range(4)])).alias("s", "p"))
    sides = sides.filter((F.col("id") % 7 != 0) | (F.col("c") != 0) | (F.col("s") != 0))
    sides = sides.select("id", (F.col("c") * 4 + F.col("s")).alias("line"), F.when(F.col("c") % 2 == 0, F.col("p")).otherwise(F.reverse("p")).alias("p"), "x", "y", "w")
    at = lambda c: (F.col(c) + F.col(f"q.{c}") * F.col("w") / 2).cast("int").alias(c)
    across = base.filter("id % 11 = 0").select("id", F.lit(1000).alias("line"), F.posexplode(F.array(*map(F.lit, (7, 10, 13, 7)))).alias("pos", "up"), "ox", "oy", "n", "w")
    across = across.select("id", "line", "pos", (F.col("ox") - 1 + F.when(F.col("pos") == 1, F.col("n") * F.col("w") + 2).otherwise(0)).alias("x"), (F.col("oy") + F.col("up")).alias("y"))
    return sides.select("id", "line", F.posexplode("p").alias("pos", "q"), "x", "y", "w").select("id", "line", "pos", at("x"), at("y")).union(across.select("id", "line", "pos", F.col("x").cast("int"), F.col("y").cast("int")))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a version of its user, by time and then id."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    event = table(spark, sf_dir, "events")
    return event.select(F.lit(0).alias("type"), F.col("user_id").alias("id"), F.row_number().over(order).alias("version"), (F.col("event_type") != "error").alias("visible"), "event_id", "event_type", "ts", "value")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as changes, numbered by day: a user's first creates it, errors delete it, the others modify it."""
    v = versions(spark, sf_dir)
    op = F.when(F.col("version") == 1, "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    x, y = (F.floor(F.col("value") * k).cast("int") for k in (1000, 10))
    return v.select(
        F.unix_date(F.col("ts").cast("date")).cast("long").alias("seq"), F.col("event_id").alias("ord"), op.alias("op"), "type", "id", "version", F.col("ts").cast("timestamp").alias("ts"),
        F.create_map(F.lit("event"), "event_type").alias("tags"), F.array().cast("array<long>").alias("refs"), x.alias("x"), y.alias("y"),
    )


def write_feed(changes: DataFrame, folder: str) -> int:
    """Write changes of nodes as a replication folder, a changeset file for each number from the least to the greatest; gives the least.

    A changeset may have more text than a task has memory: ranges of changes make compressed pieces, some changes at a time, and a file
    is its pieces one after the other, each a member of gzip's.
    """
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    time = F.date_format(F.to_utc_timestamp("ts", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    at = F.when(F.col("op") != "delete", F.concat(F.lit(' lon="'), coords.text(F.col("x")), F.lit('" lat="'), coords.text(F.col("y")), F.lit('"'))).otherwise("")
    tags = F.array_join(F.transform(F.map_entries("tags"), lambda t: F.concat(F.lit('<tag k="'), text(t["key"]), F.lit('" v="'), text(t["value"]), F.lit('"/>'))), "")
    node = F.format_string('<%s><node id="%d" version="%d" timestamp="%s"%s>%s</node></%s>', "op", "id", "version", time, at, tags, "op")
    first, last = changes.agg(F.min("seq"), F.max("seq")).first()
    block = F.shiftright("ord", CHANGES_BITS).alias("block")
    # a task's order has gaps between blocks of places in the file, where those of other tasks lie, and none inside
    ordered = changes.select("seq", block, "ord", node.alias("text")).repartition("seq", "block").sortWithinPartitions("seq", "ord")

    def compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = np.diff(batch.column("seq").to_numpy()) | np.diff(batch.column("block").to_numpy())
            bounds = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
            parts = [batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:]) if b > a]
            pieces = [gzip.compress("".join(p.column("text").to_pylist()).encode(), 6) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([p.column(c)[0].as_py() for p in parts], pa.int64()) for c in ("seq", "ord")] + [pa.array(pieces, pa.binary())], names=["seq", "ord", "piece"])

    def write(rows) -> None:
        for number, pieces in groupby(rows, lambda row: row.seq):
            fs, path = storage(f"{folder}/{osc_stream.changeset_path(number)}")
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path, compression=None) as out:
                for row in pieces:
                    out.write(row.piece)

    # a file's first piece and its last one, which changesets without changes have too
    every = changes.sparkSession.range(first, last + 1)
    ends = [every.select(F.col("id").alias("seq"), F.lit(at).cast("long").alias("ord"), F.lit(gzip.compress(text)).alias("piece")) for at, text in ((None, b'<osmChange version="0.6">'), (2**63 - 1, b"</osmChange>"))]
    pieces = ordered.mapInArrow(compressed, "seq long, ord long, piece binary").union(ends[0]).union(ends[1])
    pieces.repartition("seq").sortWithinPartitions("seq", F.asc_nulls_first("ord")).foreachPartition(write)
    fs, path = storage(folder)
    with fs.open_output_stream(f"{path}/state.txt") as out:
        out.write(f"sequenceNumber={last}\n".encode())
    return first


def orders_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with some dropped, some repriced and some added."""
    order = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    kept = order.filter(k % 97 != 0).withColumn("o_totalprice", F.when(k % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return kept.union(order.filter(k % 83 == 0).withColumn("o_orderkey", k + 1_000_000_000))
