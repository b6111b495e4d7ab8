"""Rules over tags, compiled to column expressions.

A rule is a list of alternatives; each is a list of conditions that must all hold. A condition is (key, test, value): test is
"has" (the key is present), "is", "not" (true also where the key is missing) or "in".
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = tuple[str, str, object]


def _present(key: str, *excluded: str) -> list[Condition]:
    return [(key, "has", None), *((key, "not", v) for v in excluded)]


# Which tags make a closed way an area.
WAY_AREA: list[list[Condition]] = [
    _present("building", "no"),
    [("highway", "is", "services")],
    [("highway", "is", "rest_area")],
    _present("natural", "no", "coastline", "ridge", "arete", "tree_row"),
    _present("landuse", "no"),
    [("waterway", "in", ["riverbank", "dock", "boatyard", "dam"])],
    _present("amenity", "no"),
    _present("leisure", "no"),
    [("barrier", "in", ["city_wall", "ditch", "hedge", "retaining_wall", "wall", "spikes"])],
    [("railway", "in", ["station", "turntable", "roundhouse", "platform"])],
    _present("boundary", "no"),
    _present("man_made", "no", "cutline", "embankment", "pipeline"),
    [("power", "in", ["generator", "station", "sub_station", "transformer"])],
    _present("place", "no"),
    _present("shop", "no"),
    _present("aeroway", "no", "taxiway"),
    _present("tourism", "no"),
    _present("historic", "no"),
    _present("office", "no"),
    _present("building:part", "no"),
    _present("military", "no"),
    _present("craft", "no"),
]
# Which tags make a relation an area.
RELATION_AREA: list[list[Condition]] = [
    [("type", "in", ["multipolygon", "boundary"])],
    _present("admin_level"),
    _present("postal_code"),
    _present("addr:postcode"),
]


def condition(tags: Column, key: str, test: str, value: object) -> Column:
    held = F.try_element_at(tags, F.lit(key))
    if test == "has":
        return held.isNotNull()
    if test == "not":
        return ~held.eqNullSafe(value)
    return F.coalesce(held == value if test == "is" else held.isin(value), F.lit(False))


def matches(tags: Column, rule: list[list[Condition]]) -> Column:
    return reduce(or_, (reduce(and_, (condition(tags, *c) for c in every)) for every in rule))


def is_way_area(tags: Column) -> Column:
    area = F.try_element_at(tags, F.lit("area"))
    empty = F.coalesce(F.size(tags) <= 0, F.lit(True))
    return F.when(empty, False).when(area == "yes", True).when(area == "no", False).otherwise(matches(tags, WAY_AREA))


def is_relation_area(tags: Column) -> Column:
    return F.coalesce(matches(tags, RELATION_AREA), F.lit(False))


def allowed_in_tiles(kind: Column, visible: Column, nodes: bool = False) -> Column:
    """Nodes stay out of tiles unless asked for."""
    return visible & (F.lit(nodes) | (kind != 0))
