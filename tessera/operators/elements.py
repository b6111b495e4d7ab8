"""Elements: their latest versions, references between them, and geometries assembled through those references."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids, tagrules
from tessera.sources.shared import materialize

POINTS = "array<struct<x:int,y:int>>"
#: Keys that a filter lists at most, keys that are broadcast at most, and ranges of them that reach a scan.
FEW, MAX_KEYS, RANGES = 500, 1_000_000, 64


def latest(versions: DataFrame, keys: tuple[str, ...] = ("type", "id")) -> DataFrame:
    """The row of the highest version for each key; tombstones take part. Equal versions must not meet in the input."""
    row = F.struct(*versions.columns)
    best = versions.groupBy(*keys).agg(F.max_by(row, "version").alias("row"))
    return best.select("row.*")


def references(ways: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Distinct ``(ref, referrer)`` over combined ids, from ways' nodes and relations' members."""
    edges = ways.select(F.explode("nodes").alias("ref"), ids.combined_id(ids.WAY, F.col("id")).alias("referrer"))
    if relations is not None:
        edges = edges.union(relations.select(F.explode("members.combined_id").alias("ref"), ids.combined_id(ids.RELATION, F.col("id")).alias("referrer")))
    return edges.distinct()


def referrer_lists(edges: DataFrame) -> DataFrame:
    """``(ref, referrers)``, the referrers as an ascending array in unsigned order."""
    held = F.array_sort(F.collect_list(ids.unsigned_struct(F.col("referrer"))))
    return edges.groupBy("ref").agg(held.alias("held")).select("ref", F.col("held.combined_id").alias("referrers"))


def key_ranges(keys: DataFrame, max_keys: int = MAX_KEYS, ranges: int = RANGES) -> list[tuple[int, int]] | None:
    """Ranges, ends included, that hold all keys of a table of one long column without nulls, cut where keys lie furthest apart; None
    for more than ``max_keys``."""
    key = F.col(keys.columns[0])
    # one task sorts the keys, of which it takes no more than tell that they are too many
    some = keys.limit(max_keys + 1)
    last, every = F.lag(key).over(Window.orderBy(key)), Window.partitionBy()
    seen = some.select(key.alias("first"), last.alias("last"), (key.cast("double") - last).alias("gap"), F.count("*").over(every).alias("n"), F.max(key).over(every).alias("end"))
    cuts = sorted(seen.orderBy(F.desc_nulls_first("gap")).limit(ranges).collect())
    if not cuts or cuts[0]["n"] > max_keys:
        return None if cuts else []
    return list(zip((c["first"] for c in cuts), [c["last"] for c in cuts[1:]] + [cuts[0]["end"]]))


def _few_ranges(keys: list[int], ranges: int = RANGES) -> list[tuple[int, int]]:
    """``key_ranges`` of a few rising keys."""
    cuts = sorted(range(1, len(keys)), key=lambda i: keys[i - 1] - keys[i])[: ranges - 1]
    firsts = [0, *sorted(cuts)]
    return [(keys[i], keys[j - 1]) for i, j in zip(firsts, [*firsts[1:], len(keys)])]


def narrowed(table: DataFrame, key: str, wanted: DataFrame, max_keys: int = MAX_KEYS, distinct: bool = False, few: int = FEW) -> DataFrame:
    """The rows of a table whose long ``key`` is among the first column of ``wanted``, read by key.

    A ``few`` keys become the filter itself. More are written and counted, and while there are no more than ``max_keys`` they reach the
    table's scan as ranges, by which Parquet passes over what lies elsewhere, and then meet it by a broadcast semi-join, so
    the table is not shuffled; more than that meet it by a shuffle. A null key is in no table; without keys there are no
    rows. ``distinct`` says that the keys are so already, and written.
    """
    keys = wanted.select(F.col(wanted.columns[0]).alias("_key"))
    keys = keys if distinct else keys.filter("_key is not null").distinct()
    near = lambda ranges: reduce(or_, [F.col(key) == a if a == b else F.col(key).between(a, b) for a, b in ranges], F.lit(False))
    some = sorted(r["_key"] for r in keys.limit(few + 1).collect())
    if len(some) <= few:
        return table.filter(near(_few_ranges(some)) & F.col(key).isin(some)) if some else table.filter(F.lit(False))
    keys = keys if distinct else materialize(keys, "keys")
    ranges = key_ranges(keys, max_keys)
    if ranges is not None:
        table, keys = table.filter(near(ranges)), F.broadcast(keys)
    return table.join(keys, F.col(key) == F.col("_key"), "left_semi")


def _found(table: DataFrame, keys: str, values: DataFrame, key: str, value: Column, by_key: bool) -> DataFrame:
    """For each id with keys: ``wanted`` keys, ``n`` found and ``held``, the values in the keys' order."""
    each = table.select("id", F.posexplode(keys).alias("pos", "key"))
    values = values.select(F.col(key).alias("key"), value.alias("value"))
    met = each.join(narrowed(values, "key", each.select("key")) if by_key else values, "key", "left")
    lists = met.groupBy("id").agg(F.count("value").alias("n"), F.count("*").alias("wanted"), F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("held"))
    return lists.select("id", "n", "wanted", F.col("held.value").alias("held"))


def batched_lookup(table: DataFrame, keys: str, values: DataFrame, key: str, value: Column, out: str, by_key: bool = False) -> DataFrame:
    """``table`` with the values of an array of keys, in the array's order, and null in the place of a key that is not found.

    The rows must have a column id that is unique; an empty array has no values and a null one gives null. ``by_key`` reads
    from ``values``, a table laid out by key, the wanted ones alone.
    """
    met = table.join(_found(table, keys, values, key, value, by_key).select("id", "held"), "id", "left")
    none = F.when(F.size(keys) == 0, F.array().cast(met.schema["held"].dataType))
    return met.select(*table.columns, F.coalesce("held", none).alias(out))


def ordered_lookup(table: DataFrame, keys: str, values: DataFrame, key: str, value: Column, out: str, by_key: bool = False) -> DataFrame:
    """``batched_lookup`` of only the rows all of whose keys are found; an empty array gives no row."""
    whole = _found(table, keys, values, key, value, by_key).filter("n = wanted").select("id", F.col("held").alias(out))
    return table.join(whole, "id")


def way_lines(ways: DataFrame, points: DataFrame, by_key: bool = False) -> DataFrame:
    """Ways with ``line``, their points in order; a way with a missing point, or with fewer than two nodes, has no geometry."""
    able = ways.filter((F.size("nodes") >= 2) & ~F.coalesce(F.try_element_at("tags", F.lit("natural")) == "coastline", F.lit(False)))
    return ordered_lookup(able, "nodes", points, "id", F.struct("x", "y"), "line", by_key)


def is_ring(nodes: Column) -> Column:
    return (F.size(nodes) >= 4) & (F.get(nodes, F.lit(0)) == F.element_at(nodes, -1))


def way_geometries(ways: DataFrame, points: DataFrame, by_key: bool = False) -> DataFrame:
    """``way_lines`` with ``kind``: area for closed ways whose tags say so, else line."""
    kind = F.when(tagrules.is_way_area(F.col("tags")) & is_ring(F.col("nodes")), "area").otherwise("line")
    return way_lines(ways, points, by_key).withColumn("kind", kind)


def role_code(role: Column) -> Column:
    return F.when(role == "outer", 0).when(role == "inner", 1).when(F.coalesce(role, F.lit("")) == "", 2).otherwise(3)


def _member_points(relations: DataFrame, ways: DataFrame, points: DataFrame, by_key: bool) -> DataFrame:
    """``(id, pos, role, there, at, node, point)``: the nodes of the way members of area relations, in order. A way that is there without
    nodes has one row with no node, which counts for nothing."""
    able = relations.filter(tagrules.is_relation_area(F.col("tags")))
    each = able.select("id", F.posexplode("members").alias("pos", "member")).filter(ids.element_type(F.col("member.combined_id")) == ids.WAY)
    each = each.select("id", "pos", F.col("member.role").alias("role"), ids.element_id(F.col("member.combined_id")).alias("way"))
    ways = narrowed(ways, "id", each.select("way")) if by_key else ways
    nodes = each.join(ways.select(F.col("id").alias("way"), F.coalesce("nodes", F.array().cast("array<long>")).alias("nodes")), "way", "left")
    spread = nodes.select("id", "pos", "role", F.col("nodes").isNotNull().alias("there"), F.posexplode_outer("nodes").alias("at", "node"))
    points = narrowed(points, "id", spread.select("node")) if by_key else points
    return spread.join(points.select(F.col("id").alias("node"), F.struct("x", "y").alias("point")), "node", "left")


def relation_lines(relations: DataFrame, ways: DataFrame, points: DataFrame) -> DataFrame:
    """``(id, members)`` of area relations: ``(pos, role, line)`` of their way members in order.

    Other members are passed over, and so is a way without nodes, as a deleted one is; a relation with a missing way, or with a
    way a point of which is missing, has no row.
    """
    lines = _member_points(relations, ways, points, False).groupBy("id", "pos", "role").agg(
        (F.bool_and("there") & (F.count("point") == F.count("node"))).alias("whole"), F.count("node").alias("n"), F.array_sort(F.collect_list(F.struct("at", "point"))).alias("held")
    )
    member = F.when(F.col("n") > 0, F.struct("pos", role_code(F.col("role")).alias("role"), F.col("held.point").alias("line")))
    members = F.array_sort(F.collect_list(member))
    return lines.groupBy("id").agg(F.bool_and("whole").alias("whole"), members.alias("members")).filter("whole").drop("whole")


def relation_points(relations: DataFrame, ways: DataFrame, points: DataFrame, by_key: bool = False) -> DataFrame:
    """``(id, line, pos, x, y)``: the lines of ``relation_lines`` point by point, of the same relations, without a list of a relation's points."""
    met = materialize(_member_points(relations, ways, points, by_key), "members")
    broken = met.filter("not there or (node is not null and point is null)").select("id").distinct()
    return met.filter("point is not null").join(broken, "id", "left_anti").select("id", F.col("pos").alias("line"), F.col("at").alias("pos"), "point.x", "point.y")


def bounds(line: Column) -> Column:
    """Inclusive bounds of an array of points."""
    x, y = F.transform(line, lambda p: p["x"]), F.transform(line, lambda p: p["y"])
    return F.struct(F.array_min(x).alias("min_x"), F.array_max(x).alias("max_x"), F.array_min(y).alias("min_y"), F.array_max(y).alias("max_y"))


def bounds_contain(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["min_x"]) & (a["max_x"] >= b["max_x"]) & (a["min_y"] <= b["min_y"]) & (a["max_y"] >= b["max_y"])


def bounds_intersect(a: Column, b: Column) -> Column:
    return (a["min_x"] <= b["max_x"]) & (a["max_x"] >= b["min_x"]) & (a["min_y"] <= b["max_y"]) & (a["max_y"] >= b["min_y"])


def mean_segment_length(lines: DataFrame, column: str = "line") -> DataFrame:
    """One row ``(total, segments, mean)`` over segments that are not zero; partial sums only are shuffled."""
    step = F.transform(
        F.sequence(F.lit(1), F.size(column) - 1),
        lambda i: F.sqrt(
            F.pow(F.get(F.col(column), i)["x"].cast("double") - F.get(F.col(column), i - 1)["x"], 2)
            + F.pow(F.get(F.col(column), i)["y"].cast("double") - F.get(F.col(column), i - 1)["y"], 2)
        ),
    )
    each = lines.filter(F.size(column) > 1).select(F.filter(step, lambda d: d > 0).alias("d"))
    part = each.select(F.aggregate("d", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("d").cast("long").alias("segments"))
    return part.agg(F.sum("total").alias("total"), F.sum("segments").alias("segments")).withColumn("mean", F.col("total") / F.col("segments"))


def lookup(table: DataFrame, ids_wanted: list[int], id_col: str = "id") -> DataFrame:
    return table.filter(F.col(id_col).isin(ids_wanted))


def segments(lines: DataFrame, column: str = "line") -> DataFrame:
    """A row for each segment of each line, ``x1, y1, x2, y2``, with the line's other columns."""
    at = F.transform(F.sequence(F.lit(1), F.size(column) - 1), lambda i: F.struct(F.get(F.col(column), i - 1).alias("a"), F.get(F.col(column), i).alias("b")))
    rows = lines.filter(F.size(column) > 1).withColumn("segment", F.explode(at))
    parts = [F.col(f"segment.{p}.{c}").cast("long").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in ("x", "y")]
    return rows.select(*[c for c in lines.columns if c != column], *parts)
