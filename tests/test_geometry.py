import json
import random
from fractions import Fraction

from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import elements, features, shapes, tiling
from tessera.plans import build

S = 156_250
W = 1 << 62
LINE = "id int, line array<struct<x:int,y:int>>"


def tiles(rows):
    return {(r.id, r.tile_x, r.tile_y) for r in rows.collect()}


def hits(spark, *lines):
    return tiles(tiling.line_tiles(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], LINE)))


def test_line_on_a_tile_edge(spark):
    got = hits(spark, [(100, 100), (S, 100), (S, 400_000)], [(S, 100), (S, 400_000)])
    assert {t[1:] for t in got if t[0] == 0} == {(x, y) for x in (0, 1) for y in (0, 1, 2)}
    assert {t[1:] for t in got if t[0] == 1} == {(1, 0), (1, 1), (1, 2)}


def test_single_row_takes_every_tile(spark):
    assert hits(spark, [(10, 10), (3 * S + 5, 20)]) == {(0, x, 0) for x in range(4)}


def _touches(a, b, left, bottom):
    """Whether a segment meets a closed square, by clipping in exact fractions."""
    lo, hi = Fraction(0), Fraction(1)
    for p, d, low in ((a[0], b[0] - a[0], left), (a[1], b[1] - a[1], bottom)):
        if d == 0:
            if not low <= p <= low + S:
                return False
            continue
        t = sorted((Fraction(low - p, d), Fraction(low + S - p, d)))
        lo, hi = max(lo, t[0]), min(hi, t[1])
    return lo <= hi


def test_lines_against_exact_clipping(spark):
    draw = random.Random(5)
    lines = []
    for _ in range(60):
        grid = lambda: draw.choice([draw.randrange(-5 * S, 5 * S), S * draw.randrange(-5, 5)])
        lines.append([(grid(), grid()) for _ in range(draw.randrange(2, 5))])
    want = set()
    for i, line in enumerate(lines):
        xs, ys = [p[0] // S for p in line], [p[1] // S for p in line]
        narrow = min(xs) == max(xs) or min(ys) == max(ys)
        for x in range(min(xs), max(xs) + 1):
            for y in range(min(ys), max(ys) + 1):
                if narrow or any(_touches(a, b, x * S, y * S) for a, b in zip(line, line[1:])):
                    want.add((i, x, y))
    assert hits(spark, *lines) == want


POLYGON = "id int, outer array<struct<x:int,y:int>>, inners array<array<struct<x:int,y:int>>>"


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def test_polygons_on_tile_edges(spark):
    rows = [(0, square(0, 0, S, 400_000), []), (1, square(0, 0, S, 100_000), []), (2, square(10, 10, 5 * S - 10, 5 * S - 10), [square(S, S, 4 * S, 4 * S)])]
    got = tiles(tiling.polygon_tiles(spark.createDataFrame(rows, POLYGON)))
    assert {t for t in got if t[0] == 0} == {(0, 0, y) for y in range(3)}
    assert {t for t in got if t[0] == 1} == {(1, 0, 0), (1, 1, 0)}
    ring = {(2, x, y) for x in range(5) for y in range(5)} - {(2, x, y) for x in range(1, 4) for y in range(1, 4)}
    assert {t for t in got if t[0] == 2} == ring


def _clipped_area(ring, left, bottom):
    """Twice the area of a convex ring inside a square, by exact clipping."""
    points = [(Fraction(x), Fraction(y)) for x, y in ring[:-1]]
    for axis, low, sign in ((0, left, 1), (0, left + S, -1), (1, bottom, 1), (1, bottom + S, -1)):
        out = []
        for p, q in zip(points, points[1:] + points[:1]):
            a, b = sign * (p[axis] - low), sign * (q[axis] - low)
            if a >= 0:
                out.append(p)
            if (a > 0 > b) or (a < 0 < b):
                t = a / (a - b)
                out.append(tuple(p[k] + t * (q[k] - p[k]) for k in (0, 1)))
        points = out
        if not points:
            return 0
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(points, points[1:] + points[:1]))


def test_convex_polygons_against_clipped_area(spark):
    draw = random.Random(8)
    rows = []
    for i in range(25):
        cx, cy, r = draw.randrange(-S, S), draw.randrange(-S, S), draw.randrange(S, 3 * S)
        ring = [(cx - r, cy + draw.randrange(1000)), (cx + draw.randrange(1000), cy - r), (cx + r, cy + draw.randrange(1000)), (cx, cy + r)]
        rows.append((i, ring + ring[:1], []))
    want = set()
    for i, ring, _ in rows:
        xs, ys = [p[0] // S for p in ring], [p[1] // S for p in ring]
        want |= {(i, x, y) for x in range(min(xs), max(xs) + 1) for y in range(min(ys), max(ys) + 1) if _clipped_area(ring, x * S, y * S) > 0}
    assert tiles(tiling.polygon_tiles(spark.createDataFrame(rows, POLYGON))) == want


def test_simplification():
    zigzag = [(i * 100, (i % 2) * 10) for i in range(40)]
    for level in (1, 2, 3):
        made = shapes.simplified(zigzag, level, False)
        assert made[0] == zigzag[0] and made[-1] == zigzag[-1] and len(made) - 2 >= (38 >> level) - 1
        assert made == [p for p in zigzag if p in made]
    far = [(0, 0), (10**7, 5), (2 * 10**7, 0)]
    assert shapes.simplified(far, 3, False) == far
    assert shapes.simplified([(0, 0), (10, 0)], 1, False) is None
    assert shapes.simplified(square(0, 0, 9, 9), 4, True) is None


def test_simplification_column(spark):
    table = spark.createDataFrame([(1, [(0, 0), (5, 5), (10, 0)]), (2, None)], LINE)
    got = {r.id: r.s for r in table.select("id", shapes.simplify(F.col("line"), 5).alias("s")).collect()}
    assert got == {1: None, 2: None}
    assert table.select(shapes.simplify(F.col("line"), 0).alias("s")).first().s[1].x == 5


def test_rows_of_a_polygon_go_with_its_border(spark):
    """A polygon of some 400 by 400 tiles with a hole comes out as the same tiles and as far fewer intervals."""
    diamond = [(0, -200 * S - 7), (201 * S + 3, 5), (11, 199 * S), (-200 * S, 31), (0, -200 * S - 7)]
    hole = [(x // 3, y // 3) for x, y in diamond]
    table = spark.createDataFrame([(0, diamond, [hole])], POLYGON)
    spans = [(r.first, r.last) for r in tiling.polygon_intervals(table).collect()]
    whole = sum(b - a + 1 for a, b in spans)
    assert whole > 60_000 and len(spans) < 8_000
    covered = sorted(spans)
    assert all(a[1] < b[0] for a, b in zip(covered, covered[1:]))
    for x, y, want in ((0, 0, False), (0, 100, True), (-150, 0, True), (30, -30, False), (150, 150, False)):
        pos = spark.range(1).select(ids.morton(F.lit(x), F.lit(y)).alias("p")).first().p
        assert any(a <= pos <= b for a, b in spans) == want, (x, y)


def test_a_long_segment_makes_rows_along_its_length(spark):
    line = spark.createDataFrame([(1, [(0, 0), (1000 * S, 900 * S), (1000 * S, 901 * S)])], LINE)
    edges = elements.segments(line)
    assert tiling.walk(edges, S).count() < 8_000
    got = tiling.line_tiles(line)
    assert 1900 < got.count() < 4_000 and got.filter("tile_x = 500 and tile_y = 450").count() == 1


def test_features_of_many_id_ranges_make_one_document(spark):
    big = (1 << 62) + 5
    rows = [(1, c, f"t{i}") for i, c in enumerate([7, 70_000, big, -5, -(1 << 63) + 3, 8])]
    got = features.tile_documents(spark.createDataFrame(rows, "tile_pos long, combined_id long, json string")).first()
    assert (got.n, got.document) == (6, "t0\nt5\nt1\nt2\nt4\nt3")


def test_tiles_as_intervals(spark):
    made = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "combined_id long, json string")
    hits = spark.createDataFrame([(1, 4), (1, 5), (1, 4), (1, 9), (2, -1), (2, 0)], "combined_id long, tile_pos long")
    got = {r.combined_id: (r.n_tiles, [tuple(t) for t in r.tiles]) for r in features.place(made, hits).collect()}
    assert got == {1: (3, [(4, 4), (5, 5), (9, 9)]), 2: (2, [(-1, -1), (0, 0)])}
    spans = spark.createDataFrame([(1, 0, 15), (1, 1, 1), (1, 4, 7), (1, 16, 16), (1, 0, 15), (2, 3, 3)], "combined_id long, first long, last long")
    got = {r.combined_id: (r.n_tiles, [tuple(t) for t in r.tiles]) for r in features.place(made, spans).collect()}
    assert got == {1: (17, [(0, 16)]), 2: (1, [(3, 3)])}
    assert features.tile_rows(features.place(made, spans)).filter("combined_id = 1").count() == 17


def test_missing_point_kills_the_way(spark):
    ways = spark.createDataFrame([(1, [1, 2, 1], {}), (2, [1, 9], {}), (3, [1], {}), (4, [1, 2], {"natural": "coastline"})], "id long, nodes array<long>, tags map<string,string>")
    points = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "id long, x int, y int")
    got = elements.way_lines(ways, points).collect()
    assert [(r.id, [tuple(p) for p in r.line]) for r in got] == [(1, [(5, 5), (6, 6), (5, 5)])]


def test_mean_segment_length_skips_zero(spark):
    table = spark.createDataFrame([(1, [(0, 0), (3, 4), (3, 4), (3, 14)]), (2, [(1, 1)])], LINE)
    assert tuple(elements.mean_segment_length(table).first()) == (15.0, 2, 7.5)


def test_bounds(spark):
    table = spark.createDataFrame([(1, [(0, 5), (3, -4)])], LINE).select(elements.bounds(F.col("line")).alias("b"))
    assert tuple(table.first().b) == (0, 3, -4, 5)
    row = table.select(elements.bounds_contain(F.col("b"), F.col("b")), elements.bounds_intersect(F.col("b"), F.col("b"))).first()
    assert tuple(row) == (True, True)


def walked(lines):
    """The tiles of lines as a join of walked segments gives them, narrow lines left out."""
    hits = tiling.walk(elements.segments(lines), S)
    x1, y1, x2, y2, left, bottom = (F.col(c) for c in ("x1", "y1", "x2", "y2", "left", "bottom"))
    hits = hits.withColumns({"left": F.col("tile_x").cast("long") * S, "bottom": F.col("tile_y").cast("long") * S})
    return {(r.id, r.tile_x, r.tile_y) for r in hits.filter(tiling.touches(x1, y1, x2, y2, left, bottom, S)).collect()}


def test_tiles_of_lines_need_no_shuffle(spark, monkeypatch):
    """Each line's tiles are made distinct where the line is, whatever lines lie in a batch beside it."""
    draw = random.Random(8)
    at = lambda k: draw.choice([0, S, -S, draw.randint(-k * S, k * S)])
    # the first points make every line wide, and its bounds' low sides lie inside a tile
    lines = [(i, [(-9 * S + 5, -9 * S + 5), (9 * S + 3, 9 * S + 1)] + [(at(8), at(8)) for _ in range(draw.choice([0, 1, 2, 30]))]) for i in range(60)]
    table = spark.createDataFrame([*lines, (60, [(5, 5)]), (61, []), (62, None), (63, [(5, 5), (None, 7), (3 * S + 9, 5)])], LINE)
    whole = table.filter("id < 60")
    for at_once in (1, 100, 20_000):
        monkeypatch.setattr(tiling, "POINTS_AT_ONCE", at_once)
        got = tiling.line_tiles(table)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        found = [(r.id, r.tile_x, r.tile_y) for r in got.collect()]
        assert len(found) == len(set(found)) and {x for x in found if x[0] < 60} == walked(whole)
        assert sorted(x for x in found if x[0] >= 60) == [(63, x, 0) for x in range(4)]
    big = spark.createDataFrame([(1, [(-1_799_999_995, -899_999_995), (1_799_999_990, 899_999_000)])], LINE)
    assert {(r.id, r.tile_x, r.tile_y) for r in tiling.line_tiles(big).collect()} == walked(big)


def test_digests_are_those_of_the_documents(spark, monkeypatch):
    """From pieces that cut ranges of ids of both signs; no document is put together."""
    monkeypatch.setattr(features, "FEATURES_AT_ONCE", 7)
    draw = random.Random(3)
    keys = sorted({draw.choice([1, -1]) * draw.randint(1, 200_000) for _ in range(200)} | {-(1 << 63) + i for i in range(20)}, key=lambda _: draw.random())
    made = spark.createDataFrame([(k, f'{{"ö": {k}}}' * draw.randint(0, 3)) for k in keys], "combined_id long, json string")
    hits = spark.createDataFrame([(k, 5, 5 + draw.choice([0, 2])) for k in keys] + [(k, -9, -9) for k in keys[::3]], "combined_id long, first long, last long")
    placed = features.place(made, hits).withColumn("external", F.col("combined_id") % 11 == 0)
    whole = features.tile_documents(features.tile_rows(placed)).select("tile_pos", "n", F.octet_length("document").cast("long"), F.md5("document"))
    got = features.tile_digests(placed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect())) and got.count() == 4
    assert "array_join" not in got._jdf.queryExecution().executedPlan().toString()


def test_the_blocks_of_a_polygon_take_no_join(spark):
    """Which blocks of the quadtree are asked for is told by one grouping, whose tasks hold a row a block and no sorted copies."""
    table = spark.createDataFrame([(0, square(-3 * S + 5, -9, 6 * S, 7 * S), [square(-S, S, 4 * S, 5 * S)])], POLYGON)
    spans = tiling.polygon_intervals(table)
    assert "Join" not in spans._jdf.queryExecution().executedPlan().toString()
    got = tiles(tiling.polygon_tiles(table))
    assert got == {(0, x, y) for x in range(-3, 6) for y in range(-1, 7)} - {(0, x, y) for x in range(-1, 4) for y in range(1, 5)}


def test_a_level_is_simplified_once(spark):
    """Text and tiles of three levels read what is written once for each level, made from the geometries that the levels below it keep."""
    zigzag = [(i * 100, (i % 2) * 10) for i in range(40)]
    rings = {2: square(0, 0, 500_000, 500_000), 3: square(0, 0, 9, 9)}
    rows = [(W + 1, {}, zigzag, None), *[(W + i, {}, None, [(ring, [])]) for i, ring in rings.items()]]
    made = spark.createDataFrame(rows, f"combined_id long, tags map<string,string>, line {shapes.POINTS}, shapes {shapes.SHAPES}")
    # compiling the plans would take most of the time
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    placed = build.laid_out(made, 3)
    # what is left in the plan are the tiles of lines, one function a level
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 3
    got = {(r.level, r.combined_id - W): len(json.loads(r.json)["geometry"]["coordinates"]) for r in placed.select("level", "combined_id", "json").collect()}
    spark.conf.unset("spark.sql.codegen.wholeStage")
    want = {(0, 1): 40, (0, 2): 1, (0, 3): 1}
    for level in (1, 2):
        want |= {(level, 1): len(line)} if (line := shapes.simplified(zigzag, level, False)) and (level == 1 or (1, 1) in want) else {}
        want |= {(level, i): 1 for i, ring in rings.items() if (level - 1, i) in want and shapes.simplified(ring, level, True)}
    assert got == want


def test_a_document_of_more_bytes_than_an_int_holds(spark, monkeypatch):
    """A tile's bytes come out whole; where all fit, they are an integer as in SQL."""
    from tessera.plans import queries as geo

    for n_bytes, kind in ((3_000_000_000, "bigint"), (2**31 - 1, "int")):
        monkeypatch.setattr(geo, "_placed", lambda *_: None)
        monkeypatch.setattr(features, "tile_digests", lambda _, n=n_bytes: spark.createDataFrame([(1, 2, 5, "a"), (7, 9, n, "b")], "tile_pos long, n long, n_bytes long, digest string"))
        got = geo.tile_document(spark, "")
        assert dict(got.dtypes)["n_bytes"] == kind and sorted(r.n_bytes for r in got.collect()) == [5, n_bytes]
    monkeypatch.setattr(features, "tile_digests", lambda _: spark.createDataFrame([], "tile_pos long, n long, n_bytes long, digest string"))
    assert dict(geo.tile_document(spark, "").dtypes)["n_bytes"] == "int"
