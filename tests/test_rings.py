"""Areas put together by joins, held against a plain Python version."""

import math
import random

import pyarrow as pa
import pytest

from tessera.operators import elements, rings
from tests.plain_rings import plain_shapes

POINTS = "id long, line int, pos int, x int, y int"


def assembled(spark, geometries):
    rows = [(i, k, j, *p) for i, lines in geometries.items() for k, line in enumerate(lines) for j, p in enumerate(line)]
    plain = lambda line: [tuple(p) for p in line]
    found = rings.assemble(spark.createDataFrame(rows, POINTS)).collect()
    assert len({r.id for r in found}) == len(found)
    return {r.id: [{"outer": plain(s.outer), "inners": [plain(x) for x in s.inners]} for s in r.shapes] for r in found}


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def cut(draw, ring):
    """A closed ring as lines that start and end anywhere and run either way."""
    body = ring[:-1]
    k = draw.randrange(len(body))
    body = body[k:] + body[:k] + [body[k]]
    ends = sorted({0, len(body) - 1, *(draw.randrange(len(body)) for _ in range(draw.randrange(6)))})
    lines = [body[a : b + 1] for a, b in zip(ends, ends[1:])]
    draw.shuffle(lines)
    return [x[::-1] if draw.random() < 0.5 else x for x in lines]


def star(draw, cx, cy, r, n):
    far = [r * draw.uniform(0.7, 1) for _ in range(n)]
    at = [(cx + int(far[i] * math.cos(2 * math.pi * i / n)), cy + int(far[i] * math.sin(2 * math.pi * i / n))) for i in range(n)]
    return at + at[:1]


def test_known_shapes(spark):
    draw = random.Random(1)
    outer, hole, island = square(0, 0, 100, 100), square(10, 10, 90, 90), square(20, 20, 30, 30)
    given = {
        1: [*cut(draw, outer), *cut(draw, hole), island],
        2: [outer[:4]],
        3: [[(0, 0), (10, 10), (10, 0), (0, 10), (0, 0)]],
        4: [square(0, 0, 10, 10), square(10, 0, 20, 10)],
        5: [square(0, 0, 10, 10), square(10, 10, 20, 20)],
        6: [outer, outer],
        7: [outer, [(0, 0), (50, 0)], [(50, 0), (0, 0)]],
        8: [[(0, 0), (50, 0), (100, 0), (100, 100), (30, 0), (0, 100), (0, 0)]],
        9: [square(0, 0, 10, 10), square(5, 5, 15, 15)],
        10: [[(-1_800_000_000, -900_000_000), (1_800_000_000, -900_000_000)], [(1_800_000_000, -900_000_000), (0, 900_000_000), (-1_800_000_000, -900_000_000)]],
        11: [[(0, 0), (0, 0), (9, 0), (9, 9), (9, 9), (0, 0)]],
        12: [outer, square(0, 40, 20, 60)[:2] + [(0, 40)], square(0, 50, 30, 60)],
    }
    got = assembled(spark, given)
    want = {i: made for i, lines in given.items() if (made := plain_shapes(lines))}
    assert set(want) == {1, 4, 5, 7, 10, 11}
    assert got == want
    assert len(got[1]) == 2 and len(got[1][0]["inners"]) == 1 and len(got[5]) == 2


def test_rings_without_shared_points(spark):
    draw = random.Random(2)
    given = {}
    for i in range(40):
        lines = cut(draw, star(draw, 0, 0, 10_000, draw.randrange(3, 60)))
        lines += [x for _ in range(draw.randrange(3)) for x in cut(draw, star(draw, 0, 0, draw.choice([300, 1500, 5000]), draw.randrange(3, 20)))]
        if i % 5 == 0:
            lines.pop()
        given[i] = lines
    assert assembled(spark, given) == {i: made for i, lines in given.items() if (made := plain_shapes(lines))}


def test_random_closed_lines_are_valid_or_not(spark):
    draw = random.Random(3)
    given = {}
    for i in range(150):
        body = [(draw.randrange(7), draw.randrange(7)) for _ in range(draw.randrange(3, 7))]
        given[i] = [body + body[:1]]
    got = assembled(spark, given)
    assert set(got) == {i for i, lines in given.items() if plain_shapes(lines)} and len(got) > 20


def test_grids_with_touching_corners(spark):
    """Squares of a grid taken at random: rings are simple, all segments are there, and the area is that of the squares."""
    draw = random.Random(4)
    given, n = {}, {}
    for i in range(25):
        cells = [(x, y) for x in range(6) for y in range(6) if draw.random() < 0.55]
        given[i] = [side for x, y in cells for side in cut(draw, square(10 * x, 10 * y, 10 * x + 10, 10 * y + 10))]
        n[i] = len(cells)
    got = assembled(spark, given)
    assert set(got) == {i for i in given if n[i]}
    twice = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
    for i, shapes in got.items():
        every = [s["outer"] for s in shapes] + [x for s in shapes for x in s["inners"]]
        assert all(len(set(r)) == len(r) - 1 and r[0] == min(r) == r[-1] for r in every)
        assert all(twice(s["outer"]) > 0 and all(twice(x) < 0 for x in s["inners"]) for s in shapes)
        assert sum(map(twice, every)) == 200 * n[i]
        met = {}
        for line in given[i]:
            for a, b in zip(line, line[1:]):
                met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
        assert sorted((min(a, b), max(a, b)) for r in every for a, b in zip(r, r[1:])) == sorted(e for e, k in met.items() if k % 2)


def test_a_ring_of_many_lines(spark):
    """Pointer doubling goes around a ring of 300 lines in a few rounds."""
    draw = random.Random(5)
    ring = star(draw, 0, 0, 1_000_000, 300)
    lines = [[a, b] if draw.random() < 0.5 else [b, a] for a, b in zip(ring, ring[1:])]
    draw.shuffle(lines)
    assert assembled(spark, {7: lines}) == {7: plain_shapes(lines)}


def test_nothing(spark):
    assert assembled(spark, {}) == {}


def test_relation_points_leave_broken_relations_out(spark):
    member = lambda *ways: [((1 << 62) + w, "outer") for w in ways]
    area = {"type": "multipolygon"}
    relations = spark.createDataFrame([(1, area, member(10)), (2, area, member(10, 11)), (3, area, member(10, 12)), (4, area, member(13, 10)), (5, {"type": "route"}, member(10))], "id long, tags map<string,string>, members array<struct<combined_id:long,role:string>>")
    ways = spark.createDataFrame([(10, [1, 2]), (12, [1, 9]), (13, None)], "id long, nodes array<long>")
    points = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "id long, x int, y int")
    for by_key in (False, True):
        got = sorted(map(tuple, elements.relation_points(relations, ways, points, by_key).collect()))
        assert got == [(1, 0, 0, 5, 5), (1, 0, 1, 6, 6), (4, 1, 0, 5, 5), (4, 1, 1, 6, 6)]


@pytest.mark.parametrize("visits,want", [(["a", "b", "c"], [0, 0, 0]), (["a", "b", "a", "c"], [0, 0, 1, 1]), (["a", "b", "c", "b", "d"], [1, 0, 0, 1, 1])])
def test_labels(visits, want):
    assert rings._labels(pa.array([[{"x": ord(v), "y": 0} for v in visits]])).to_pylist() == [want]
