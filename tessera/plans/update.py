"""Applying changesets to a digested store: elements, references, geometries and tiles, each changeset in one commit.

A changeset touches few elements, so each table gets a delta: the keys that it replaces and the rows that come instead. What
refers to a touched element, however far, is assembled again and compared with what the store has; only tile entries that
differ are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import changes as ch
from tessera.operators import compare, elements, features, merges
from tessera.plans import build
from tessera.sources import osm_xml
from tessera.sources.shared import materialize
from tessera.sources.store import Store

Delta = tuple[DataFrame, DataFrame]


def _no_refs() -> Column:
    return F.array().cast("array<long>")


def touched(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """The store's rows of the elements ``keys (type, id)``, as ``changes.ELEMENT``, read by key."""

    def some(name: str, kind: int) -> DataFrame:
        return elements.narrowed(tables[name], "id", keys.filter(F.col("type") == kind).select("id"))

    none = F.lit(None).cast("int")

    def row(table: DataFrame, kind: int, refs: Column, x: Column = none, y: Column = none) -> DataFrame:
        return table.select(F.lit(kind).alias("type"), "id", "version", "visible", "tags", refs.alias("refs"), x.alias("x"), y.alias("y"))

    nodes = some("nodes", ids.NODE).join(some("points", ids.NODE), "id", "left")
    out = row(nodes, ids.NODE, _no_refs(), F.col("x"), F.col("y"))
    out = out.union(row(some("ways", ids.WAY), ids.WAY, F.coalesce("nodes", _no_refs())))
    return out.union(row(some("relations", ids.RELATION), ids.RELATION, F.coalesce("members.combined_id", _no_refs())))


def deltas(after: DataFrame) -> dict[str, Delta]:
    """What becomes of the tables of elements when ``after (changes.ELEMENT and roles)`` are the states of the touched ones."""

    def rows(kind: int, *columns) -> Delta:
        mine = after.filter(F.col("type") == kind)
        return mine.select("id"), mine.select("id", "version", "visible", "tags", *columns)

    role = F.transform("refs", lambda r, i: F.struct(r.alias("combined_id"), F.coalesce(F.get("roles", i), F.lit("")).alias("role")))
    nodes = after.filter(F.col("type") == ids.NODE)
    return {
        "nodes": rows(ids.NODE),
        "points": (nodes.select("id"), nodes.filter("visible").select("id", "x", "y")),
        "ways": rows(ids.WAY, F.col("refs").alias("nodes")),
        "relations": rows(ids.RELATION, role.alias("members")),
    }


def edge_delta(before: DataFrame, changes: DataFrame) -> Delta:
    """What becomes of the table of references: each change takes its element out of the lists of what it referred to and puts it in
    those of what it refers to. These operands are merged by reference and referrer, the last one counting, and only edges
    that come or go are left."""
    none = F.array().cast("array<long>")
    steps = ch.steps(before, changes).filter("op is not null")
    own = F.array(ids.combined_id(F.col("type"), F.col("id")))
    met = steps.select(F.struct("version", "ord").alias("op_seq"), own.alias("own"), F.coalesce("before.refs", none).alias("old"), F.when(F.col("visible"), F.col("refs")).otherwise(none).alias("new"))
    adds = met.select(F.explode("new").alias("key"), "op_seq", F.col("own").alias("adds"), none.alias("dels"))
    dels = met.select(F.explode("old").alias("key"), "op_seq", none.alias("adds"), F.col("own").alias("dels"))
    net = merges.merge_sets(merges.set_operands(adds.union(dels))).select(F.col("key").alias("ref"), F.col("value").alias("referrer"), "added")
    had = ch.element_edges(before).withColumn("had", F.lit(True))
    turned = materialize(net.join(had, ["ref", "referrer"], "left").filter(F.col("added") != F.coalesce("had", F.lit(False))).select("ref", "referrer", "added"), "edges")
    return turned.filter("not added").select("ref", "referrer"), turned.filter("added").select("ref", "referrer")


def merged(table: DataFrame, delta: Delta) -> DataFrame:
    gone, rows = delta
    return table.join(gone, gone.columns, "left_anti").unionByName(rows)


def apply_changeset(store: Store, changes: DataFrame, sequence: int) -> None:
    """Apply one changeset ``(changes.CHANGE, with or without roles)`` and store its sequence, all in one commit.

    Changes that are not after the store's timestamp, where it has one, are dropped as late; that time is the one that the
    store started from and stays. A changeset that breaks a rule raises and leaves the store as it was. Features and tiles
    are brought up to date where the store has them.
    """
    found = store.properties()
    changes = ch.newer(changes, found["timestamp"]) if found.get("timestamp") else changes
    changes = materialize(changes if "roles" in changes.columns else changes.withColumn("roles", F.array().cast("array<string>")), "changes")
    tables = build.tables_of(store)
    before = materialize(touched(tables, changes.select("type", "id").distinct()), "before")
    # the rules ask for the edges to what is touched, and those from there, by what they refer to
    near = changes.select(ids.combined_id(F.col("type"), F.col("id")).alias("ref")).union(ch.element_edges(before).select("ref"))
    ch.check(ch.violations(before, changes, elements.narrowed(tables["refs"], "ref", near)))
    roles = changes.groupBy("type", "id").agg(F.max_by("roles", F.struct("version", "ord")).alias("roles"))
    after = materialize(ch.touched_states(before, changes).join(roles, ["type", "id"], "left"), "after")
    made = deltas(after) | {"refs": edge_delta(before, changes)}
    made |= geometry_deltas(store, tables, made, after) if "tiles" in tables else {}
    store.commit({}, deltas=made, sequence=sequence)


def geometry_deltas(store: Store, tables: dict[str, DataFrame], made: dict[str, Delta], after: DataFrame) -> dict[str, Delta]:
    """What becomes of features and tiles: everything that refers to a touched element, before or after, is assembled again.

    What a feature had in tiles is told by the feature, so the tiles are not read. Nodes are among them if the store has them in tiles. The
    entries of a text that differs are replaced in all its tiles, though a text that stands in several of them is the feature's: so the
    delta of tiles tells every tile whose document is another.
    """
    edges = tables["refs"].select("ref", "referrer").union(made["refs"][1])
    seeds = after.select(ids.combined_id(F.col("type"), F.col("id")).alias("combined_id"))
    affected = materialize(ch.closure(edges, seeds, written=True), "affected")
    now = tables | {name: merged(tables[name], delta) for name, delta in made.items()}
    known = store.properties()
    placed = build.laid_out(build.geometries(now, affected, known.get("areas", True)), known["levels"])
    placed = materialize(placed.unionByName(build.node_features(now, affected)) if known.get("nodes") else placed, "features")
    old = materialize(elements.narrowed(tables["features"], "combined_id", affected, distinct=True).select(placed.columns), "features")
    keys = ["level", "tile_pos", "combined_id"]
    was, now = (t.select("level", "combined_id", features.line_text().alias(c)) for t, c in ((old, "was"), (placed, "now")))
    turned = was.join(now, ["level", "combined_id"]).filter("was <> now").select("level", "combined_id", F.lit(True).alias("turned"))
    entry = lambda turned: F.struct(F.coalesce(turned, F.lit(False)).alias("turned"), features.entry_text().alias("json"))
    stood, stand = features.spread(old, entry(F.lit(False))), features.spread(placed.join(turned, ["level", "combined_id"], "left"), entry(F.col("turned")))
    patch = materialize(compare.tile_patch(stood, stand, keys), "patch")
    other = materialize(compare.diff(old, placed, ["level", "combined_id"]).select("level", "combined_id"), "patch")
    return {
        "tiles": (patch.select(*keys), patch.filter("action <> 'delete'").select(*keys, F.col("after.json").alias("json"))),
        "features": (other, placed.join(other, ["level", "combined_id"], "left_semi")),
    }


def start(store: Store, states: DataFrame, timestamp: str) -> int | None:
    """Set where updates go on from: the last sequence not after a time, less a margin, and that time as the one below which changes are late."""
    found = ch.start_sequence(states, timestamp)
    if found is not None:
        store.set_properties(sequence=found, timestamp=timestamp)
    return found


def update_to(store: Store, source: str, last: int) -> list[int]:
    """Apply the changeset files of a replication folder after the store's sequence up to ``last``, with a savepoint before each.

    A missing file ends the run with an error, and what was applied before it stays.
    """
    done = list(range(store.properties().get("sequence", -1) + 1, last + 1))
    for sequence in done:
        path = f"{source}/{sequence // 1_000_000:03d}/{sequence // 1000 % 1000:03d}/{sequence % 1000:03d}.osc.gz"
        changes = osm_xml.changes(store.spark, path)
        store.savepoint()
        try:
            apply_changeset(store, changes, sequence)
        except Exception:
            store.forget()
            raise
    return done


def rollback_to(store: Store, sequence: int) -> None:
    """Back to the latest savepoint whose sequence is not after ``sequence``; without one the store stays as it is."""
    kept = store.manifest()["savepoints"]
    if store.properties().get("sequence", -1) > sequence and not any(s["properties"].get("sequence", -1) <= sequence for s in kept):
        raise ValueError(f"there is no savepoint to go back to before {sequence + 1}")
    while store.properties().get("sequence", -1) > sequence:
        store.rollback()


def info(store: Store) -> dict:
    """The store's sequence, those that it can go back to, and its tables."""
    found = store.manifest()
    return {"sequence": found["properties"].get("sequence"), "back_to": [s["properties"].get("sequence") for s in found["savepoints"]], "tables": sorted(found["tables"])}


def pending(delta: Delta) -> DataFrame:
    """One row ``(n_replaced, n_written)``: the size of a delta before it is committed."""
    gone, rows = delta
    return gone.agg(F.count("*").alias("n_replaced")).join(rows.agg(F.count("*").alias("n_written")))


def get(store: Store, kind: str, number: int, what: str = "element") -> DataFrame:
    """An element as the store has it: the element itself, its geometry, the tiles it is in, or its features' text by level."""
    code = ids.TYPE_NAMES.index(kind)
    own = store.spark.range(1).select(ids.combined_id(code, F.lit(number).cast("long")).alias("combined_id"))
    tables = build.tables_of(store)
    if what == "element":
        return elements.lookup(tables[("nodes", "ways", "relations", "coastlines")[code]], [number])
    if what == "geometry":
        return build.geometries(tables, own, store.properties().get("areas", True))
    mine = elements.narrowed(tables["features"], "combined_id", own)
    return features.tile_rows(mine) if what == "tiles" else mine
