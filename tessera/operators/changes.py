"""Applying changesets to the element table, and finding what they affect.

An element is ``(type, id, version, visible, tags, refs, x, y)``, refs being combined ids; a change adds ``seq``, ``ord`` (its
place in the file), ``op`` and ``ts``. A changeset applies as a whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators.compare import missing_references
from tessera.operators.elements import narrowed
from tessera.sources.shared import materialize

ELEMENT = "type int, id long, version int, visible boolean, tags map<string,string>, refs array<long>, x int, y int"
CHANGE = "seq long, ord long, op string, type int, id long, version int, ts timestamp, tags map<string,string>, refs array<long>, x int, y int"
#: A change as feeds give it, with the roles of a relation's members in their order.
FEED = f"{CHANGE}, roles array<string>"
FIELDS = ["type", "id", "version", "visible", "tags", "refs", "x", "y"]


class ChangesetRejected(ValueError):
    """A changeset broke a rule; nothing of it has been applied."""


def newer(changes: DataFrame, since) -> DataFrame:
    """Late or repeated changes, those not after ``since``, are dropped."""
    return changes.filter(F.col("ts") > F.lit(since).cast("timestamp"))


def element_edges(elements: DataFrame) -> DataFrame:
    own = ids.combined_id(F.col("type"), F.col("id"))
    return elements.filter("visible").select(F.explode("refs").alias("ref"), own.alias("referrer")).distinct()


def steps(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """Each change with the state it meets: the change of the same element before it (by version, then place in the file) or the store's row."""
    none = F.coalesce("refs", F.array().cast("array<long>"))
    made = changes.select("type", "id", "version", (F.col("op") != "delete").alias("visible"), "tags", none.alias("refs"), "x", "y", "op", "ord")
    held = elements.join(changes.select("type", "id").distinct(), ["type", "id"], "left_semi")
    held = held.select("type", "id", "version", "visible", "tags", none.alias("refs"), "x", "y", F.lit(None).cast("string").alias("op"), F.lit(-1).cast("long").alias("ord"))
    order = Window.partitionBy("type", "id").orderBy(F.col("op").isNotNull(), "version", "ord")
    state = F.struct("version", "visible", "refs")
    return held.union(made).withColumns({"before": F.lag(state).over(order), "last": F.lead("ord").over(order).isNull()})


def violations(elements: DataFrame, changes: DataFrame, edges: DataFrame | None = None, made: bool = False) -> DataFrame:
    """Changes that may not be applied, ``(type, id, version, problem)``: a created element has version 1, is new and nothing refers to it; a
    modified or deleted one exists, a visible one going up by one version (a deleted one comes back with any) and listed
    as a referrer by all that it referred to; a deleted way or relation lists no members.

    ``edges`` is a store's table ``(ref, referrer)``. Without one, edges are those of ``elements``, which list all that refers.
    ``made`` says that the edges are made from the elements that the store holds, so that each of these is listed.
    """
    met = steps(elements, changes).filter("op is not null").withColumn("own", ids.combined_id(F.col("type"), F.col("id")))
    listed = element_edges(elements) if edges is None else edges
    created = met.filter("op = 'create'").select(F.col("own").alias("ref"))
    referred = listed.join(created, "ref", "left_semi").select(F.col("ref").alias("own")).distinct().withColumn("referred", F.lit(True))
    met = met.join(referred, "own", "left")
    if edges is None or made:
        met = met.withColumn("broken", F.lit(None).cast("boolean"))
    else:
        old = element_edges(elements)
        mine = edges.join(old.select("referrer").distinct(), "referrer", "left_semi").select("ref", "referrer")
        broken = missing_references(old, mine).select(F.col("referrer").alias("own")).distinct().withColumn("broken", F.lit(True))
        met = met.join(broken, "own", "left")
    before = F.col("before")
    problem = (
        F.when((F.col("op") == "create") & (F.col("version") != 1), "created with a version other than 1")
        .when((F.col("op") == "create") & before.isNotNull(), "created but exists")
        .when((F.col("op") == "create") & F.col("referred"), "created but referred to")
        .when((F.col("op") != "create") & before.isNull(), "does not exist")
        .when((F.col("op") == "modify") & before["visible"] & (F.col("version") != before["version"] + 1), "version does not follow")
        .when((F.col("op") != "create") & F.col("broken"), "a reference does not list it")
        .when((F.col("op") == "delete") & (F.col("type") != 0) & (F.size("refs") > 0), "deleted with members")
    )
    return met.select("type", "id", "version", problem.alias("problem")).filter("problem is not null")


def touched_states(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """What the changes leave of the elements that they touch; deleted ones stay as tombstones without references or place."""
    last = steps(elements, changes).filter("op is not null and last").select(*FIELDS)
    gone = ~F.col("visible")
    return last.withColumns({"refs": F.when(gone, F.array().cast("array<long>")).otherwise(F.col("refs")), "x": F.when(~gone, F.col("x")), "y": F.when(~gone, F.col("y"))})


def final_states(elements: DataFrame, changes: DataFrame) -> DataFrame:
    """The elements that the changes leave: ``touched_states`` and those that are not touched."""
    untouched = elements.select(*FIELDS).join(changes.select("type", "id").distinct(), ["type", "id"], "left_anti")
    return touched_states(elements, changes).union(untouched.select(*FIELDS))


def apply_changeset(elements: DataFrame, changes: DataFrame, since=None) -> DataFrame:
    """The element table after a changeset; raises if any of its changes breaks a rule."""
    changes = newer(changes, since) if since is not None else changes
    check(violations(elements, changes))
    return final_states(elements, changes)


def check(found: DataFrame) -> None:
    """Raise if there are violations, and name a few of them."""
    wrong = found.limit(5).collect()
    if wrong:
        raise ChangesetRejected("; ".join(f"{ids.TYPE_NAMES[r.type]}/{r.id} v{r.version}: {r.problem}" for r in wrong))


def dirty(changes: DataFrame, key: str = "id", order: Column | None = None, old: str = "old", new: str = "new") -> DataFrame:
    """The first old and the last new state of each element that changes."""
    order = F.col("ord") if order is None else order
    return changes.groupBy(key).agg(F.min_by(old, order).alias("first_old"), F.max_by(new, order).alias("last_new"))


def closure(edges: DataFrame, seeds: DataFrame, max_rounds: int = 1000, written: bool = False) -> DataFrame:
    """``(combined_id)``: the seeds and everything that refers to them, however far; cycles end.

    Works frontier by frontier; each is written to the shared folder, so the lineage stays short and no id passes through the
    driver. A round reads the ranges of the edges in which its frontier lies. The edges are laid out by ref for that and
    written there once, unless they are a table that is read as it lies (``written``).
    """
    edges = edges if written else materialize(edges.select("ref", "referrer").repartitionByRange("ref").sortWithinPartitions("ref"), "edges")
    frontier = materialize(seeds.select(F.col(seeds.columns[0]).alias("combined_id")).distinct(), "frontier")
    seen = frontier
    for _ in range(max_rounds):
        met = narrowed(edges, "ref", frontier, distinct=True).select(F.col("referrer").alias("combined_id")).distinct()
        frontier = materialize(met.join(seen, "combined_id", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)
    raise RuntimeError("the closure did not end")


def start_sequence(states: DataFrame, timestamp: str, margin: int = 60) -> int | None:
    """The last sequence number not after a time, less a margin for safety, from ``(sequence, timestamp)``."""
    found = states.filter(F.col("timestamp") <= F.lit(timestamp).cast("timestamp")).agg(F.max("sequence")).first()[0]
    return None if found is None else max(0, found - margin)
