"""Which tiles a geometry touches.

A geometry whose bounds lie in one row or one column of tiles hits every tile of its bounds without an exact test. Otherwise
lines hit the closed tiles that a segment touches; polygons hit the tiles whose open inside their outer ring meets, less those
that a hole contains. Candidates are generated from the grid, by walking segments; there is no join with the grid.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import coords, ids
from tessera.operators.elements import bounds, segments

#: Points whose tiles are found at once.
POINTS_AT_ONCE = 20_000


def point_tiles(points: DataFrame, level: int = 0) -> DataFrame:
    """``points`` with tile_x, tile_y and tile_pos."""
    return with_pos(points.withColumns({"tile_x": coords.to_tile(F.col("x"), level), "tile_y": coords.to_tile(F.col("y"), level)}))


def with_pos(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("tile_pos", ids.morton(F.col("tile_x"), F.col("tile_y")))


def multipoint_tiles(points: DataFrame, key: str, column: str, level: int = 0) -> DataFrame:
    each = points.select(key, F.explode(column).alias("p")).select(key, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return point_tiles(each, level).select(key, "tile_x", "tile_y", "tile_pos").distinct()


def _range(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last))


def _tile_range(box: Column, level: int) -> Column:
    return F.struct(*[coords.to_tile(box[c], level).alias(c) for c in ("min_x", "max_x", "min_y", "max_y")])


def _sides(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, bottom: Column, side: int) -> list[tuple[Column, Column]]:
    """For each corner of a tile, the two products whose order tells on which side of the segment it lies; each fits a long."""
    return [((x2 - x1) * (y - y1), (y2 - y1) * (x - x1)) for x in (left, left + side) for y in (bottom, bottom + side)]


def touches(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, bottom: Column, side: int) -> Column:
    """Whether a segment touches a closed tile."""
    near = (F.least(x1, x2) <= left + side) & (F.greatest(x1, x2) >= left) & (F.least(y1, y2) <= bottom + side) & (F.greatest(y1, y2) >= bottom)
    corners = _sides(x1, y1, x2, y2, left, bottom, side)
    return near & ~reduce(and_, (a > b for a, b in corners)) & ~reduce(and_, (a < b for a, b in corners))


def crosses(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, bottom: Column, side: int) -> Column:
    """Whether a ring's edge goes through a tile's open inside. A level edge between bottom and top counts as soon as it reaches the left side."""
    corners = _sides(x1, y1, x2, y2, left, bottom, side)
    near = (F.least(x1, x2) < left + side) & (F.greatest(x1, x2) > left) & (F.least(y1, y2) < bottom + side) & (F.greatest(y1, y2) > bottom)
    through = near & reduce(or_, (a > b for a, b in corners)) & reduce(or_, (a < b for a, b in corners))
    level_edge = (y1 == y2) & (y1 > bottom) & (y1 < bottom + side) & (F.least(x1, x2) < left + side) & (F.greatest(x1, x2) >= left)
    return through | level_edge


def walk(edges: DataFrame, side: Column | int, low_x: Column | None = None, low_y: Column | None = None) -> DataFrame:
    """``edges`` with each tile (``tile_x``, ``tile_y``) of a side that a segment x1, y1, x2, y2 may touch: for each column of tiles, the
    rows between where the segment enters the column and leaves it, in whole numbers. So the rows made go with a segment's
    length and not with its bounds. ``low_x`` and ``low_y`` are tiles before which there are none."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    tile = lambda value: F.floor(value / side).cast("int")
    # a segment that lies on a tile's low side touches the tile before it too
    first = lambda value, low: tile(value - 1) if low is None else F.greatest(low, tile(value - 1))
    columns = edges.withColumn("tile_x", _range(first(F.least(x1, x2), low_x), tile(F.greatest(x1, x2))))
    left = F.col("tile_x").cast("long") * side
    columns = columns.withColumns({"_in": F.greatest(left, F.least(x1, x2)), "_out": F.least(left + side, F.greatest(x1, x2))})
    at = lambda x: F.expr(f"y1 + ((y2 - y1) * ({x} - x1)) div nullif(x2 - x1, 0)")
    # the division cuts towards zero, so one unit more on either side
    low = F.greatest(F.coalesce(F.least(at("_in"), at("_out")) - 1, F.least(y1, y2)), F.least(y1, y2))
    high = F.least(F.coalesce(F.greatest(at("_in"), at("_out")) + 1, F.greatest(y1, y2)), F.greatest(y1, y2))
    return columns.withColumn("tile_y", _range(first(low, low_y), tile(high))).drop("_in", "_out")


def _cells(x: np.ndarray, y: np.ndarray, line: np.ndarray, run: np.ndarray, side: int, n: int) -> np.ndarray:
    """Distinct rows ``(line, tile_x, tile_y)`` of the tiles that lines touch, whose points (fixed values) lie end to end: ``line`` is the
    line of each, of ``n``, and there is no segment between points of two runs. As ``walk`` and ``touches`` have it."""
    starts = np.flatnonzero(np.diff(line, prepend=-1))
    low_x, low_y, high_x, high_y = (np.zeros(n, np.int64) for _ in range(4))
    for out, f, v in ((low_x, np.minimum, x), (low_y, np.minimum, y), (high_x, np.maximum, x), (high_y, np.maximum, y)):
        out[line[starts]] = f.reduceat(v, starts)
    one_row_or_column = (low_x // side == high_x // side) | (low_y // side == high_y // side)
    at = np.flatnonzero((line[1:] == line[:-1]) & (run[1:] == run[:-1]) & ~one_row_or_column[line[1:]])
    narrow = np.flatnonzero(one_row_or_column & np.isin(np.arange(n), line[starts]))
    # a narrow line stands for all tiles of its bounds, as if it were one segment through them
    x1, y1, x2, y2 = (np.concatenate(v) for v in ((x[at], low_x[narrow]), (y[at], low_y[narrow]), (x[at + 1], high_x[narrow]), (y[at + 1], high_y[narrow])))
    of, whole = np.concatenate((line[at], narrow)), np.arange(len(at) + len(narrow)) >= len(at)

    def ranged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each number from first to last, ends included, the place of its range, and the number."""
        size = np.maximum(last - first + 1, 0)
        place = np.repeat(np.arange(len(first)), size)
        return place, first[place] + np.arange(len(place)) - (np.cumsum(size) - size)[place]

    # a segment that lies on a tile's low side touches the tile before it too
    i, tile_x = ranged(np.maximum(low_x[of] // side, (np.minimum(x1, x2) - 1) // side), np.maximum(x1, x2) // side)
    left = tile_x * side
    dx, dy, low, high = (x2 - x1)[i], (y2 - y1)[i], np.minimum(y1, y2)[i], np.maximum(y1, y2)[i]
    edges = [y1[i] + dy * (e - x1[i]) // np.where(dx == 0, 1, dx) for e in (np.maximum(left, np.minimum(x1, x2)[i]), np.minimum(left + side, np.maximum(x1, x2)[i]))]
    first = np.where(dx == 0, low, np.clip(np.minimum(*edges) - 1, low, high))
    last = np.where(dx == 0, high, np.clip(np.maximum(*edges) + 1, low, high))
    j, tile_y = ranged(np.maximum(low_y[of[i]] // side, (first - 1) // side), last // side)
    i, tile_x, left, bottom = i[j], tile_x[j], left[j], tile_y * side
    near = (np.minimum(x1, x2)[i] <= left + side) & (np.maximum(x1, x2)[i] >= left) & (np.minimum(y1, y2)[i] <= bottom + side) & (np.maximum(y1, y2)[i] >= bottom)
    signs = [(x2 - x1)[i] * (b - y1[i]) - (y2 - y1)[i] * (a - x1[i]) for a in (left, left + side) for b in (bottom, bottom + side)]
    hit = whole[i] | (near & (reduce(np.minimum, signs) <= 0) & (reduce(np.maximum, signs) >= 0))
    return np.unique(np.stack((of[i], tile_x, tile_y), axis=1)[hit], axis=0)


def _interleaved(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``ids.morton`` of arrays."""
    out = [v.astype(np.uint64) & np.uint64(0xFFFFFFFF) for v in (x, y)]
    for shift, mask in ids.STEPS:
        out = [(v | v << np.uint64(shift)) & np.uint64(mask) for v in out]
    return (out[0] | out[1] << np.uint64(1)).view(np.int64)


def tiles_of_line(line: Column, level: int = 0) -> Column:
    """The distinct positions of the tiles that a line touches, ascending; none for a line of fewer than two points.

    Made line by line, so nothing is shuffled or held for it but the lines of a batch, a few points at a time.
    """
    side = coords.tile_side(level)

    def run(lines: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lines), 0).to_numpy().astype(np.int64)
        flat = lines.flatten()
        fields = [pc.struct_field(flat, c) for c in ("x", "y")]
        x, y = (pc.fill_null(f, 0).to_numpy().astype(np.int64) for f in fields)
        # a point without a place ends a run of segments
        there = pc.and_(*[pc.is_valid(f) for f in fields]).to_numpy(zero_copy_only=False)
        runs = np.cumsum(~there)
        ends = np.cumsum(sizes)
        held, first = [], 0
        while first < len(sizes):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + POINTS_AT_ONCE, side="right")))
            a, b = ends[first] - sizes[first], ends[last - 1]
            of = np.repeat(np.arange(last - first), sizes[first:last])
            able = (sizes[first:last] > 1)[of] & there[a:b]
            found = _cells(x[a:b][able], y[a:b][able], of[able], runs[a:b][able], side, last - first) if able.any() else np.zeros((0, 3), np.int64)
            pos = _interleaved(found[:, 1], found[:, 2])
            order = np.lexsort((pos, found[:, 0]))
            held.append((np.bincount(found[:, 0], minlength=last - first), pos[order]))
            first = last
        offsets = np.concatenate(([0], np.cumsum(np.concatenate([n for n, _ in held])))) if held else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate([p for _, p in held]) if held else np.zeros(0, np.int64)))

    # so that Spark does not run it once more for a filter or a second use
    return F.arrow_udf(run, "array<long>").asNondeterministic()(line)


def line_tiles(lines: DataFrame, key: str = "id", column: str = "line", level: int = 0) -> DataFrame:
    """Distinct ``(key, tile_x, tile_y, tile_pos)`` of lines of two points or more."""
    listed = lines.select(key, tiles_of_line(F.col(column), level).alias("held"))
    pos = F.col("tile_pos")
    return listed.select(key, F.explode("held").alias("tile_pos")).select(key, ids.morton_x(pos).alias("tile_x"), ids.morton_y(pos).alias("tile_y"), "tile_pos")


def polygon_intervals(shapes: DataFrame, key: str = "id", outer: str = "outer", inners: str = "inners", level: int = 0) -> DataFrame:
    """``(key, first, last)``: intervals of tile positions, ends included, of shapes: a closed outer ring and an array of closed inner
    rings that do not overlap. Two shapes of one key may give a tile twice.

    Edges are walked as lines are. The tiles that they touch are told one by one; so are, in the quadtree above those tiles, the
    blocks without such a tile whose parent has one: no edge comes near a block, so it is in or out as a whole, and its
    tiles are one interval. In or out is the parity of the rings met by the row through a tile's centre, before the
    centre. So the rows made go with the length of the border, whatever the area, and no row holds a ring.
    """
    side = coords.tile_side(level)
    # two shapes of one key may share a tile, so each shape is its own
    ranged = shapes.select(key, F.monotonically_increasing_id().alias("shape"), F.concat(F.array(outer), F.coalesce(inners, F.array())).alias("rings"), _tile_range(bounds(F.col(outer)), level).alias("r"))
    narrow = (F.col("r.min_x") == F.col("r.max_x")) | (F.col("r.min_y") == F.col("r.max_y"))
    whole = ranged.filter(narrow).select(key, "r", _range(F.col("r.min_x"), F.col("r.max_x")).alias("tile_x"))
    whole = whole.select(key, "tile_x", _range(F.col("r.min_y"), F.col("r.max_y")).alias("tile_y"))
    # from this height of the quadtree on a block is larger than the bounds, and so never inside
    top = F.ceil(F.log2(F.greatest(F.col("r.max_x") - F.col("r.min_x"), F.col("r.max_y") - F.col("r.min_y")) + 3)).cast("int")
    rings = ranged.filter(~narrow).select(key, "shape", top.alias("top"), F.posexplode("rings").alias("ring", "line"))
    edges = segments(rings.withColumn("box", bounds(F.col("line"))).repartition(key, "shape", "ring")).filter("x1 <> x2 or y1 <> y2")
    x1, y1, x2, y2, box = (F.col(c) for c in ("x1", "y1", "x2", "y2", "box"))
    left, bottom = coords.tile_start(F.col("tile_x"), level), coords.tile_start(F.col("tile_y"), level)
    overlaps = (box["min_x"] < left + side) & (box["max_x"] > left) & (box["min_y"] < bottom + side) & (box["max_y"] > bottom)
    through = overlaps & crosses(x1, y1, x2, y2, left, bottom, side)
    near = walk(edges, side).filter(touches(x1, y1, x2, y2, left, bottom, side))
    place = [key, "shape", "tile_x", "tile_y"]
    border = near.groupBy(*place).agg(F.max("top").alias("top"), F.bool_or(through & (F.col("ring") == 0)).alias("edge"), F.bool_or(through & (F.col("ring") > 0)).alias("hole_edge"))
    # blocks of height k are named by their first tile's place over 2^k
    up = border.select(key, "shape", "tile_x", "tile_y", F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("k"))
    high, parent = (lambda c: F.expr(f"shiftright({c}, k)")), (lambda c: F.expr(f"shiftright({c}, k + 1)"))
    quarter = F.when(high("tile_x") % 2 != 0, F.when(high("tile_y") % 2 != 0, 8).otherwise(4)).otherwise(F.when(high("tile_y") % 2 != 0, 2).otherwise(1))
    # one grouping tells which quarters of a block have such a tile; the others are asked for
    touched = up.groupBy(key, "shape", "k", parent("tile_x").alias("px"), parent("tile_y").alias("py")).agg(F.bit_or(quarter).alias("quarters"))
    below = F.explode(F.array(*[F.struct((F.col("px") * 2 + dx).alias("bx"), (F.col("py") * 2 + dy).alias("by"), F.lit(1 << 2 * dx + dy).alias("quarter")) for dx in (0, 1) for dy in (0, 1)]))
    blocks = touched.filter("quarters <> 15").select(key, "shape", "k", "quarters", below.alias("b")).filter("(quarters & b.quarter) = 0").select(key, "shape", "k", "b.bx", "b.by")
    first_tile = lambda c: F.expr(f"shiftleft({c}, k)")
    asked = blocks.select(key, "shape", "k", first_tile("bx").alias("tile_x"), first_tile("by").alias("tile_y"), F.lit(None).cast("boolean").alias("edge"), F.lit(None).cast("boolean").alias("hole_edge"))
    asked = asked.union(border.select(key, "shape", F.lit(0).alias("k"), "tile_x", "tile_y", "edge", "hole_edge"))
    # the rows of tiles whose centre line an edge meets, and where; then one sweep over each row
    centre = lambda tile: coords.tile_start(tile, level) + side // 2
    met = edges.withColumn("tile_y", _range(coords.to_tile(F.least(y1, y2), level), coords.to_tile(F.greatest(y1, y2), level)))
    cy = centre(F.col("tile_y"))
    met = met.filter((y1 > cy) != (y2 > cy)).withColumn("x", (x2 - x1) * (cy - y1) / (y2 - y1) + x1)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("k", "int"), ("tile_x", "int"), ("edge", "boolean"), ("hole_edge", "boolean"))]
    ends = met.select(key, "shape", "tile_y", "x", (F.col("ring") == 0).cast("int").alias("of_outer"), (F.col("ring") > 0).cast("int").alias("of_hole"), *none)
    zero = F.lit(0)
    places = asked.select(key, "shape", "tile_y", centre(F.col("tile_x")).cast("double").alias("x"), zero.alias("of_outer"), zero.alias("of_hole"), "k", "tile_x", "edge", "hole_edge")
    # crossings at a centre come before it
    row = Window.partitionBy(key, "shape", "tile_y").orderBy("x", F.col("k").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ends.union(places).withColumns({"in_outer": F.sum("of_outer").over(row) % 2 == 1, "in_hole": F.sum("of_hole").over(row) % 2 == 1}).filter("k is not null")
    # a tile goes with its shape's outer ring unless a hole has all of it
    kept = swept.filter((F.col("in_outer") | F.coalesce("edge", F.lit(False))) & ~(F.col("in_hole") & ~F.coalesce("hole_edge", F.lit(False))))
    first = ids.morton(F.col("tile_x"), F.col("tile_y"))
    exact = kept.select(key, first.alias("first"), (first + F.expr("shiftleft(1L, 2 * k)") - 1).alias("last"))
    return exact.union(whole.select(key, first.alias("first"), first.alias("last")).distinct())


def polygon_tiles(shapes: DataFrame, key: str = "id", outer: str = "outer", inners: str = "inners", level: int = 0) -> DataFrame:
    """Distinct ``(key, tile_x, tile_y, tile_pos)`` of ``polygon_intervals``, spread out."""
    spread = polygon_intervals(shapes, key, outer, inners, level).select(key, _range(F.col("first"), F.col("last")).alias("tile_pos")).distinct()
    return spread.select(key, ids.morton_x(F.col("tile_pos")).alias("tile_x"), ids.morton_y(F.col("tile_pos")).alias("tile_y"), "tile_pos")
