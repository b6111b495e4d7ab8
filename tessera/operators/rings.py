"""Areas put together from lines, as joins and aggregations over segments: no geometry is in one row before the output.

Segments met an even number of times cancel, so shared borders go. What is left must meet in even numbers at each point and must not
cross. Stretches of a line between points where something else happens become arcs; arcs that meet at a point are paired by
angle, and pointer doubling along the pairs finds each cycle, its first arc and every arc's place in it, in as many rounds
as the logarithm of the longest cycle. A cycle that comes through a point twice is split there. Rings nest by the parity of
how often the row through one of their points meets the others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.elements import POINTS
from tessera.operators.tiling import walk
from tessera.sources.shared import materialize

EXACT = "decimal(38,0)"
SHAPES = f"array<struct<outer:{POINTS},inners:array<{POINTS}>>>"


def _point(x: str, y: str) -> Column:
    return F.struct(F.col(x).alias("x"), F.col(y).alias("y"))


def odd_segments(points: DataFrame) -> DataFrame:
    """``(id, a, b, line, pos)`` of the segments met an odd number of times, each once and as its first line runs, from ``points
    (id, line, pos, x, y)``, the points of each line in order."""
    place = Window.partitionBy("id", "line").orderBy("pos")
    each = points.select("id", "line", "pos", _point("x", "y").alias("a"), F.lead(_point("x", "y")).over(place).alias("b")).filter("b is not null and a <> b")
    met = each.groupBy("id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    met = met.agg(F.count("*").alias("n"), F.min(F.struct("line", "pos", "a", "b")).alias("first")).filter("n % 2 = 1")
    return met.select("id", "first.a", "first.b", "first.line", "first.pos")


def degrees(segments: DataFrame) -> DataFrame:
    """``(id, p, degree)``: how many segments end at each point."""
    return segments.select("id", F.explode(F.array("a", "b")).alias("p")).groupBy("id", "p").agg(F.count("*").alias("degree"))


def _side(a: str, b: str, c: str) -> Column:
    """On which side of the line from a to b c lies, -1, 0 or 1; the products fit a long."""
    long = lambda p, f: F.col(f"{p}.{f}").cast("long")
    left = (long(b, "x") - long(a, "x")) * (long(c, "y") - long(a, "y"))
    right = (long(b, "y") - long(a, "y")) * (long(c, "x") - long(a, "x"))
    return F.when(left > right, 1).when(left < right, -1).otherwise(0)


def crossing(segments: DataFrame) -> DataFrame:
    """Distinct ids with two segments that meet in a point that is not an end of both, or that lie on each other from a shared end.

    Segments meet in the cells of a grid as wide as the geometry's mean segment, through which they are walked, so a segment
    is in as many cells as its length has means.
    """
    x, y = (F.abs(F.col(f"a.{c}").cast("long") - F.col(f"b.{c}")) for c in ("x", "y"))
    sides = segments.groupBy("id").agg(F.ceil(F.avg(F.greatest(x, y))).alias("side"))
    ends = [F.col(f"{p}.{c}").cast("long").alias(f"{c}{i}") for i, p in ((1, "a"), (2, "b")) for c in ("x", "y")]
    cells = walk(segments.join(sides, "id").select("id", "side", F.struct("line", "pos").alias("name"), "a", "b", *ends), F.col("side"))
    cells = cells.select("id", "tile_x", "tile_y", "name", "a", "b")
    other = cells.select("id", "tile_x", "tile_y", F.col("name").alias("other"), F.col("a").alias("c"), F.col("b").alias("d"))
    met = cells.join(other, ["id", "tile_x", "tile_y"]).filter("name < other")
    s1, s2, s3, s4 = _side("a", "b", "c"), _side("a", "b", "d"), _side("c", "d", "a"), _side("c", "d", "b")
    between = lambda u, v, w, f: F.col(f"{w}.{f}").between(F.least(f"{u}.{f}", f"{v}.{f}"), F.greatest(f"{u}.{f}", f"{v}.{f}"))
    within = lambda u, v, w: between(u, v, w, "x") & between(u, v, w, "y")
    on = ((s1 == 0) & within("a", "b", "c")) | ((s2 == 0) & within("a", "b", "d")) | ((s3 == 0) & within("c", "d", "a")) | ((s4 == 0) & within("c", "d", "b"))
    shared = (F.col("a") == F.col("c")) | (F.col("a") == F.col("d")) | (F.col("b") == F.col("c")) | (F.col("b") == F.col("d"))
    # with a shared end, the other end of one lies on the other one only if they run the same way
    beyond = lambda p, q, r: (_side(p, q, r) == 0) & (_dot(p, q, r) > 0)
    along = (
        F.when(F.col("a") == F.col("c"), beyond("a", "b", "d")).when(F.col("a") == F.col("d"), beyond("a", "b", "c")).when(F.col("b") == F.col("c"), beyond("b", "a", "d")).otherwise(beyond("b", "a", "c"))
    )
    bad = F.when(shared, along).otherwise(((s1 * s2 < 0) & (s3 * s4 < 0)) | on)
    return met.filter(bad).select("id").distinct()


def _dot(p: str, q: str, r: str) -> Column:
    """Above zero where q and r lie the same way from p."""
    d = lambda f: (F.col(f"{q}.{f}").cast("double") - F.col(f"{p}.{f}")) * (F.col(f"{r}.{f}").cast("double") - F.col(f"{p}.{f}"))
    return d("x") + d("y")


def arcs_of(segments: DataFrame, met: DataFrame) -> DataFrame:
    """``segments`` with ``arc``: stretches of a line whose inner points are ends of two segments only."""
    branch = met.filter("degree > 2").select("id", F.col("p").alias("a"), F.lit(True).alias("branch"))
    along = Window.partitionBy("id", "line").orderBy("pos")
    cut = F.coalesce("branch", F.lit(False)) | F.coalesce(F.lag("pos").over(along) + 1 != F.col("pos"), F.lit(True))
    numbered = segments.join(branch, ["id", "a"], "left").withColumn("cut", cut)
    run = F.sum(F.col("cut").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return numbered.select("id", "a", "b", "line", "pos", (F.shiftleft(F.col("line").cast("long"), 31) + run).alias("arc"))


def _angle(at: Column, to: Column) -> Column:
    return F.atan2(to["y"].cast("double") - at["y"], to["x"].cast("double") - at["x"])


def cycles(arcs: DataFrame) -> DataFrame:
    """``(id, arc, ring, back, rank)`` of arcs ``(id, arc, first, second, before_last, last)``, their first and last two points: the cycle
    that each arc is in, whether it runs backwards there, and its place.

    A directed arc is a number, twice its arc's and one more if it runs backwards. Each knows the next one. In a round it learns
    the least number within twice as many steps as before, and how many steps ahead it is; when nobody learns a lesser
    one, all have been around.
    """
    ends = arcs.select("id", "arc", F.explode(F.array(
        F.struct(F.col("first").alias("p"), F.lit(0).alias("end"), _angle(F.col("first"), F.col("second")).alias("angle")),
        F.struct(F.col("last").alias("p"), F.lit(1).alias("end"), _angle(F.col("last"), F.col("before_last")).alias("angle")),
    )).alias("e")).select("id", "arc", "e.*")
    around = Window.partitionBy("id", "p").orderBy("angle", "arc", "end")
    placed = ends.select("id", "p", "arc", "end", (F.row_number().over(around) - 1).alias("k")).withColumn("pair", F.floor(F.col("k") / 2))
    other = placed.select("id", "p", "pair", F.col("arc").alias("to_arc"), F.col("end").alias("to_end"), F.col("k").alias("to_k"))
    met = placed.join(other, ["id", "p", "pair"]).filter("k <> to_k")
    # who comes to a point by its end runs forwards, and who leaves it by its end runs backwards
    step = met.select("id", (F.col("arc") * 2 + 1 - F.col("end")).alias("h"), (F.col("to_arc") * 2 + F.col("to_end")).alias("jump"))
    known = materialize(step.select("id", "h", "jump", F.col("h").alias("least"), F.lit(0).cast("long").alias("ahead"), F.lit(True).alias("learnt")), "cycles")
    span = 1
    while not known.filter("learnt").isEmpty():
        there = known.select("id", F.col("h").alias("jump"), F.col("jump").alias("then"), F.col("least").alias("its"), (F.col("ahead") + span).alias("its_ahead"))
        best = F.least(F.struct("least", "ahead"), F.struct(F.col("its").alias("least"), F.col("its_ahead").alias("ahead")))
        met = known.join(there, ["id", "jump"]).select("id", "h", F.col("then").alias("jump"), best.alias("best"), "least")
        known = materialize(met.select("id", "h", "jump", "best.least", "best.ahead", (F.col("best.least") < F.col("least")).alias("learnt")), "cycles")
        span *= 2
    # a cycle comes in both directions; the one that runs its least arc forwards stays
    one = known.filter("least % 2 = 0")
    rank = F.row_number().over(Window.partitionBy("id", "least").orderBy(F.col("ahead") > 0, F.desc("ahead"))).cast("long")
    return one.select("id", F.shiftright("h", 1).alias("arc"), F.col("least").alias("ring"), (F.col("h") % 2 == 1).alias("back"), rank.alias("rank"))


def _labels(visits: pa.Array) -> pa.Array:
    """For the points that a cycle's arcs start from, in order, the number of the simple ring that each arc belongs to."""
    out = []
    for row in visits.to_pylist():
        ring, stack, at, n = [0] * len(row), [], {}, 0
        for i, p in enumerate(row):
            p = p["x"], p["y"]
            if (first := at.get(p)) is not None:
                for j, q in stack[first:]:
                    ring[j] = n
                    del at[q]
                del stack[first:]
                n += 1
            at[p] = len(stack)
            stack.append((i, p))
        for j, _ in stack:
            ring[j] = n
        out.append(ring)
    return pa.array(out, pa.list_(pa.int32()))


def split(chained: DataFrame) -> DataFrame:
    """``cycles`` with ``start``, the point where each arc begins there: a cycle that comes through a point twice becomes several rings."""
    twice = chained.groupBy("id", "ring", "start").count().filter("count > 1").select("id", "ring").distinct()
    simple = chained.join(twice, ["id", "ring"], "left_anti").withColumn("part", F.lit(0))
    lists = chained.join(twice, ["id", "ring"], "left_semi").groupBy("id", "ring").agg(F.array_sort(F.collect_list(F.struct("rank", "arc", "back", "start"))).alias("held"))
    rows = lists.withColumn("part", F.arrow_udf(_labels, "array<int>")(F.col("held.start"))).select("id", "ring", F.explode(F.arrays_zip("held", "part")).alias("z"))
    return simple.select("id", "arc", "ring", "part", "back", "rank").union(rows.select("id", "z.held.arc", "ring", "z.part", "z.held.back", "z.held.rank"))


def ring_segments(points: DataFrame) -> DataFrame:
    """``(id, ring, part, i, x, y, to_x, to_y)``: the segments of every ring in order, of the geometries that close to valid rings.

    ``points`` are ``odd_segments``'. A geometry whose ends stay open, whose segments cross or of which nothing is left has no rows.
    """
    found = materialize(odd_segments(points), "segments")
    met = degrees(found)
    bad = met.filter("degree % 2 = 1").select("id").distinct().union(crossing(found))
    segments = materialize(arcs_of(found.join(bad.distinct(), "id", "left_anti"), met), "segments")
    arcs = segments.groupBy("id", "arc").agg(
        F.min_by("a", "pos").alias("first"), F.min_by("b", "pos").alias("second"), F.max_by("a", "pos").alias("before_last"), F.max_by("b", "pos").alias("last")
    )
    arcs = materialize(arcs, "arcs")
    closed = arcs.filter("first = last").select("id", "arc", (F.col("arc") * 2).alias("ring"), F.lit(0).alias("part"), F.lit(False).alias("back"), F.lit(0).cast("long").alias("rank"))
    ends = arcs.filter("first <> last")
    chained = cycles(ends).join(ends, ["id", "arc"]).withColumn("start", F.when(F.col("back"), F.col("last")).otherwise(F.col("first")))
    rings = closed.union(split(chained))
    rows = segments.join(rings, ["id", "arc"])
    back = F.col("back")
    a, b = F.when(back, F.col("b")).otherwise(F.col("a")), F.when(back, F.col("a")).otherwise(F.col("b"))
    order = Window.partitionBy("id", "ring", "part").orderBy("rank", F.when(back, -F.col("pos")).otherwise(F.col("pos")))
    return rows.select("id", "ring", "part", (F.row_number().over(order) - 1).alias("i"), a["x"].alias("x"), a["y"].alias("y"), b["x"].alias("to_x"), b["y"].alias("to_y"))


def nesting(edges: DataFrame, rings: DataFrame) -> DataFrame:
    """``(id, inner, outer)``: which rings lie in which, by the row through the middle of one segment (``rings`` has its ends).

    A ring's segments and the rows are met by bands as high as the geometry's mean segment; places are doubled, so middles are whole.
    """
    many = rings.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    edges = edges.join(many, "id", "left_semi")
    high = edges.groupBy("id").agg(F.ceil(F.avg(F.abs(F.col("y").cast("long") - F.col("to_y"))) + 1).alias("high"))
    band = lambda y: F.floor(y / F.col("high"))
    spread = edges.join(high, "id").filter("y <> to_y").withColumn("band", F.explode(F.sequence(band(F.least("y", "to_y")), band(F.greatest("y", "to_y")))))
    spread = spread.select("id", "band", F.struct("ring", "part").alias("outer"), *[F.col(c).cast(EXACT) for c in ("x", "y", "to_x", "to_y")])
    double = lambda c: (F.col(f"probe.{c}").cast("long") + F.col(f"probe.to_{c}"))
    asked = rings.join(high, "id").select("id", F.struct("ring", "part").alias("inner"), double("x").cast(EXACT).alias("px"), double("y").cast(EXACT).alias("py"), band(double("y") / 2).alias("band"))
    met = spread.join(asked, ["id", "band"]).filter("outer <> inner and (2 * y > py) <> (2 * to_y > py)")
    # the segment meets the row to the right of the point
    right = F.expr("(px - 2 * x) * (to_y - y)"), F.expr("(to_x - x) * (py - 2 * y)")
    hit = met.filter(F.when(F.col("to_y") > F.col("y"), right[0] < right[1]).otherwise(right[0] > right[1]))
    return hit.groupBy("id", "inner", "outer").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("id", "inner", "outer")


def ring_points(points: DataFrame) -> DataFrame:
    """``(id, shape, ring, pos, x, y)``: the points of every ring, the first one again at the end; ``shape`` names the outer ring that a
    ring belongs to, as ``ring`` names itself. Rings start at their smallest point, outer ones run counter-clockwise and inner ones
    clockwise."""
    edges = materialize(ring_segments(points), "rings")
    cross = F.col("x").cast(EXACT) * F.col("to_y").cast(EXACT) - F.col("to_x").cast(EXACT) * F.col("y").cast(EXACT)
    place = F.struct("x", "y")
    rings = edges.groupBy("id", "ring", "part").agg(
        F.count("*").alias("n"), F.sum(cross).alias("twice"), F.min_by("i", place).alias("start"), F.min_by(F.struct("x", "y", "to_x", "to_y"), "i").alias("probe")
    )
    rings = materialize(rings, "rings")
    inside = materialize(nesting(edges, rings), "nesting")
    depth = inside.groupBy("id", "inner").agg(F.count("*").alias("depth"))
    above = inside.join(depth, ["id", "inner"]).join(depth.select("id", F.col("inner").alias("outer"), F.col("depth").alias("its")), ["id", "outer"], "left")
    # a hole belongs to the ring around it that lies one less deep
    holder = above.filter((F.col("depth") % 2 == 1) & (F.coalesce("its", F.lit(0)) == F.col("depth") - 1)).select("id", "inner", F.col("outer").alias("holder"))
    named = rings.select("id", "ring", "part", "n", "twice", "start", F.struct("ring", "part").alias("inner")).join(holder, ["id", "inner"], "left")
    forwards = (F.col("twice") > 0) == F.col("holder").isNull()
    met = edges.join(named, ["id", "ring", "part"])
    at = F.when(forwards, F.col("i") - F.col("start")).otherwise(F.col("start") - F.col("i"))
    rows = met.select("id", F.coalesce("holder", "inner").alias("shape"), F.col("inner").alias("ring"), F.pmod(at, F.col("n")).cast("long").alias("pos"), "x", "y", "n")
    again = F.when(F.col("pos") == 0, F.array(F.col("pos"), F.col("n"))).otherwise(F.array("pos"))
    return rows.select("id", "shape", "ring", F.explode(again).alias("pos"), "x", "y")


def assemble(points: DataFrame) -> DataFrame:
    """``(id, shapes)`` of ``points (id, line, pos, x, y)``: arrays of ``outer`` and ``inners``, ordered by their points; a geometry that does not
    close to valid rings has no row."""
    if points.isEmpty():
        return points.sparkSession.createDataFrame([], f"id {points.schema['id'].dataType.simpleString()}, shapes {SHAPES}")
    line = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    rings = ring_points(points).groupBy("id", "shape", "ring").agg(line.alias("held"))
    rings = rings.select("id", "shape", (F.col("shape") == F.col("ring")).alias("is_outer"), F.transform("held", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))
    inners = F.array_sort(F.collect_list(F.when(~F.col("is_outer"), F.col("line"))))
    shapes = rings.groupBy("id", "shape").agg(F.max(F.when(F.col("is_outer"), F.col("line"))).alias("outer"), inners.alias("inners"))
    return shapes.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("outer", "inners"))).alias("shapes"))
