"""Fixed-point coordinates (one unit is 1e-7 degree), their text, the tile grid and level densities, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Units to a degree, a level-0 tile's side, and the least mean segment length at level 0.
PER_DEGREE = 10_000_000
TILE_SIDE = 156_250
LEAST_DENSITY = 927.067380381451
WORLD_X, WORLD_Y = 1_800_000_000, 900_000_000


def to_fixed(degrees: Column) -> Column:
    """Floors, unlike ``parse``, which cuts towards zero."""
    return F.floor(degrees * float(PER_DEGREE)).cast("int")


def to_degrees(fixed: Column) -> Column:
    return fixed * F.lit(1.0 / PER_DEGREE)


def parse(text: Column) -> Column:
    """Decimal text as fixed point; further decimals are cut. Signs other than a minus, exponents and bare points are errors."""
    form = r"^(-?)(\d+)(?:\.(\d+))?$"
    whole = F.regexp_extract(text, form, 2).try_cast("long") * PER_DEGREE
    part = F.rpad(F.substring(F.regexp_extract(text, form, 3), 1, 7), 7, "0").try_cast("long")
    sign = F.when(F.regexp_extract(text, form, 1) == "-", -1).otherwise(1)
    wrong = F.raise_error(F.concat(F.lit("not a coordinate: "), text)).cast("int")
    return F.when(text.isNull(), F.lit(None)).when(text.rlike(form), (sign * (whole + part)).cast("int")).otherwise(wrong)


def text(fixed: Column) -> Column:
    """The shortest decimal text with a digit on either side of the point."""
    size = F.abs(fixed.cast("long"))
    part = F.regexp_replace(F.lpad((size % PER_DEGREE).cast("string"), 7, "0"), "0+$", "")
    whole = F.floor(size / PER_DEGREE).cast("string")
    return F.concat(F.when(fixed < 0, "-").otherwise(""), whole, F.lit("."), F.when(part == "", "0").otherwise(part))


def tile_side(level: int) -> int:
    return TILE_SIDE << level


def to_tile(fixed: Column, level: int = 0) -> Column:
    return F.floor(fixed / tile_side(level)).cast("int")


def tile_start(tile: Column, level: int = 0) -> Column:
    return tile.cast("long") * tile_side(level)


def tiles_within(boxes: DataFrame) -> DataFrame:
    """Every tile ``(tile_x, tile_y)`` of ranges of tiles ``(min_x, max_x, min_y, max_y)``, ends included, row by row."""
    rows = boxes.select("min_x", "max_x", F.explode(F.sequence("min_y", "max_y")).alias("tile_y"))
    return rows.select(F.explode(F.sequence("min_x", "max_x")).alias("tile_x"), "tile_y")


def level_tiles(spark: SparkSession, level: int = 0) -> DataFrame:
    """Every tile of the world at a level, ends included."""
    x, y = (size // tile_side(level) for size in (WORLD_X, WORLD_Y))
    return tiles_within(spark.createDataFrame([(-x, x, -y, y)], "min_x int, max_x int, min_y int, max_y int"))


def least_density(level: int) -> float:
    return LEAST_DENSITY * (1 << level)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = (x2.cast("double") - x1), (y2.cast("double") - y1)
    return F.sqrt(dx * dx + dy * dy)


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    """Of three points with fields x and y."""
    x, y = (lambda p: p["x"].cast("double")), (lambda p: p["y"].cast("double"))
    return 0.5 * F.abs(x(a) * (y(b) - y(c)) + x(b) * (y(c) - y(a)) + x(c) * (y(a) - y(b)))


def size_text(n_bytes: Column) -> Column:
    """Bytes in the largest binary unit that leaves at least one, with two decimals."""
    out = F.format_string("%d B", n_bytes.cast("long"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n_bytes >= 1 << 10 * power, F.format_string(f"%.2f {unit}", n_bytes / float(1 << 10 * power))).otherwise(out)
    return out
