"""Combined ids, type names, unsigned order and Morton codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE, WAY, RELATION, COASTLINE = 0, 1, 2, 3
TYPE_NAMES = ("node", "way", "relation", "coastline")
ID_MASK = (1 << 62) - 1


def combined_id(kind: Column | int, element_id: Column) -> Column:
    """The type in the top two bits and the id below; relations and coastlines come out negative."""
    kind = F.lit(kind) if isinstance(kind, int) else kind
    return F.shiftleft(kind.cast("long"), 62).bitwiseOR(element_id)


def element_id(combined: Column) -> Column:
    return combined.bitwiseAND(F.lit(ID_MASK))


def element_type(combined: Column) -> Column:
    return F.shiftrightunsigned(combined, 62).cast("int")


def type_name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TYPE_NAMES)), kind + 1)


def type_id(name: Column) -> Column:
    """The number of a type's name; any other name is an error."""
    known = F.coalesce(*[F.when(name == n, i) for i, n in enumerate(TYPE_NAMES)])
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown element type: "), name)).cast("int"))


def unsigned(combined: Column) -> list[Column]:
    """Sort keys that order ids as unsigned numbers: nodes, ways, relations, coastlines."""
    return [combined < 0, combined]


def unsigned_struct(combined: Column, *more: Column) -> Column:
    """A struct that sorts as ``unsigned`` does."""
    return F.struct((combined < 0).alias("high"), combined.alias("combined_id"), *more)


STEPS = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _spread(value: Column) -> Column:
    out = value.cast("long").bitwiseAND(0xFFFFFFFF)
    for shift, mask in STEPS:
        out = out.bitwiseOR(F.shiftleft(out, shift)).bitwiseAND(mask)
    return out


def _gather(value: Column) -> Column:
    out = value.bitwiseAND(STEPS[-1][1])
    for shift, mask in (*((s, m) for s, m in zip((1, 2, 4, 8, 16), (0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF, 0xFFFFFFFF))),):
        out = out.bitwiseOR(F.shiftrightunsigned(out, shift)).bitwiseAND(mask)
    return F.when(out >= 1 << 31, out - (1 << 32)).otherwise(out).cast("int")


def morton(x: Column, y: Column) -> Column:
    """Interleaves two signed 32-bit numbers: x on even bits, y on odd ones."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def morton_x(code: Column) -> Column:
    return _gather(code)


def morton_y(code: Column) -> Column:
    return _gather(F.shiftrightunsigned(code, 1))
