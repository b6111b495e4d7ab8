"""Simplification of lines and rings, one at a time, as Arrow functions."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import coords

POINTS = "array<struct<x:int,y:int>>"
SHAPES = f"array<struct<outer:{POINTS},inners:array<{POINTS}>>>"
Point = tuple[int, int]


def simplified(line: list[Point], level: int, closed: bool) -> list[Point] | None:
    """Drops the inner vertex of the smallest triangle (ties: the earlier one) while inner vertices are at least what the level
    leaves of them and the mean segment is shorter than the level's least; None for what is then too small to keep."""
    n = len(line)
    least = coords.least_density(level)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))

    def area(i: int) -> float:
        (x0, y0), (x1, y1), (x2, y2) = line[before[i]], line[i], line[after[i]]
        return 0.5 * abs(float(x0) * y1 + float(x1) * y2 + float(x2) * y0 - float(x0) * y2 - float(x1) * y0 - float(x2) * y1)

    current = {i: area(i) for i in range(1, n - 1)}
    heap = [(a, i) for i, a in current.items()]
    heapq.heapify(heap)
    total, count = sum(math.dist(a, b) for a, b in zip(line, line[1:])), n - 1
    floor = len(current) >> level
    while current and len(current) >= floor and total / count < least:
        a, i = heapq.heappop(heap)
        if current.get(i) != a:
            continue
        del current[i]
        p, q = before[i], after[i]
        total += math.dist(line[p], line[q]) - math.dist(line[i], line[p]) - math.dist(line[i], line[q])
        count -= 1
        after[p], before[q] = q, p
        for j in (p, q):
            if j in current:
                current[j] = area(j)
                heapq.heappush(heap, (current[j], j))
    if closed and len(current) < 2:
        return None
    if not closed and not current and math.dist(line[0], line[-1]) < least:
        return None
    return [line[0], *[line[i] for i in sorted(current)], line[-1]]


def simplify(line: Column, level: int, closed: bool = False) -> Column:
    """A line or closed ring at a level; level 0 is the line itself, and null what the level drops."""
    if level == 0:
        return line

    def run(lines: pa.Array) -> pa.Array:
        out = []
        for row in lines.to_pylist():
            made = simplified([(p["x"], p["y"]) for p in row], level, closed) if row and len(row) > 1 else None
            out.append(made and [{"x": x, "y": y} for x, y in made])
        return pa.array(out, pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())])))

    return F.arrow_udf(run, POINTS)(line)


def simplify_points(points: Column, level: int) -> Column:
    """Points and multipoints, which are on level 0 only: null above it."""
    return points if level == 0 else F.when(F.lit(False), points)


def simplify_shapes(shapes: Column, level: int) -> Column:
    """Shapes whose outer ring goes are dropped, inner rings one by one; null when no shape is left."""
    if level == 0:
        return shapes
    ring = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))

    def run(column: pa.Array) -> pa.Array:
        def one(points: list[dict]) -> list[dict] | None:
            made = simplified([(p["x"], p["y"]) for p in points], level, True)
            return made and [{"x": x, "y": y} for x, y in made]

        out = []
        for row in column.to_pylist():
            kept = [{"outer": o, "inners": [i for i in map(one, s["inners"] or []) if i]} for s in row or [] if (o := one(s["outer"]))]
            out.append(kept or None)
        return pa.array(out, pa.list_(pa.struct([("outer", ring), ("inners", pa.list_(ring))])))

    return F.arrow_udf(run, SHAPES)(shapes)
