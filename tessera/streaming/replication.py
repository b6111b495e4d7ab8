"""Following a replication folder: changes arrive as files, each changeset is applied once and in order.

The number of the last applied changeset lies in the same manifest as the tables, so a batch that runs again skips what it
has already applied. A trigger takes every file that lies in the folder, so a changeset may be any number of files, but
they must appear together (written elsewhere and moved in) where the folder is followed while it grows; a part that comes
after its changeset was applied is an error and never passed over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import changes as ch
from tessera.plans import update
from tessera.sources import osc_stream
from tessera.sources.shared import materialize
from tessera.sources.store import Store


def advance(store: Store, batch: DataFrame) -> list[int]:
    """Apply a batch's changesets after the store's sequence, one commit each; a rejected one stops the batch and changes nothing.

    A digested store is brought up to date as ``plans.update`` says; a store of one table ``elements`` gets a delta of it.
    """
    found = store.properties()
    done, since = found.get("sequence", -1), found.get("timestamp")
    _no_late_parts(store, batch, found.get("followed"), done, since)
    waiting = [r.seq for r in batch.filter(F.col("seq") > done).select("seq").distinct().orderBy("seq").collect()]  # one number a changeset
    for seq in waiting:
        mine, followed = batch.filter(F.col("seq") == seq), found.get("followed", waiting[0])
        if "elements" not in store.tables():
            update.apply_changeset(store, mine, seq)
            store.set_properties(followed=followed)
            continue
        mine = materialize(ch.newer(mine, since) if since is not None else mine, "changes")
        keys = mine.select("type", "id").distinct()
        before = materialize(store.read("elements").join(keys, ["type", "id"], "left_semi"), "before")
        # the table's own references are its edges, so only what refers to created elements is asked of it
        ch.check(ch.violations(before, mine, ch.element_edges(store.read("elements")), made=True))
        store.commit({}, deltas={"elements": (keys, ch.touched_states(before, mine))}, sequence=seq, followed=followed)
    return waiting


def _no_late_parts(store: Store, batch: DataFrame, followed: int | None, done: int, since) -> None:
    """Raise if the batch holds changes of a changeset that was applied without them; those that were applied may come again."""
    if followed is None:
        return
    again = batch.filter(F.col("seq").between(followed, done))
    again = ch.newer(again, since) if since is not None else again
    have = _versions(store)
    late = again.join(have, ["type", "id"], "left").filter(F.col("had").isNull() | (F.col("had") < F.col("version"))).select("seq").first()
    if late:
        raise ch.ChangesetRejected(f"changeset {late.seq}: a part came after it was applied")


def _versions(store: Store) -> DataFrame:
    if "elements" in store.tables():
        return store.read("elements").select("type", "id", F.col("version").alias("had"))
    kinds = enumerate(("nodes", "ways", "relations"))
    return reduce(DataFrame.union, [store.read(name).select(F.lit(k).alias("type"), "id", F.col("version").alias("had")) for k, name in kinds])


def follow(spark: SparkSession, store: Store, source: str, checkpoint: str, once: bool = True, every: str = "1 minute", feed: str = "parquet") -> StreamingQuery:
    """Read changes as a stream and apply them to the store: Parquet files of ``changes.FEED``, with or without roles, or with ``feed``
    osmchange the numbered changeset files of a replication folder after the store's sequence."""
    if feed == osc_stream.NAME:
        stream = osc_stream.stream(spark, source, store.properties().get("sequence", -1))
    else:
        stream = spark.readStream.schema(ch.FEED).parquet(source)  # no limit of files: a trigger must not end within a changeset
    trigger = {"availableNow": True} if once else {"processingTime": every}

    def step(batch: DataFrame, _: int) -> None:
        # written and not persisted: each changeset is read by its number, and a batch of many takes no executor's memory
        advance(store, materialize(batch, "batch"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()
