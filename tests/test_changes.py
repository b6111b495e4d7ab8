import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.operators import changes as ch
from tessera.operators import compare
from tessera.plans import queries
from tessera.sources.store import Store
from tessera.streaming import replication

W = 1 << 62
T = dt.datetime(2024, 1, 1)


def change(seq, ord, op, kind, i, version, refs=(), x=None):
    return (seq, ord, op, kind, i, version, T + dt.timedelta(days=seq), {}, list(refs), x, x)


def elements(spark, *rows):
    return spark.createDataFrame([(k, i, v, s, {}, list(r), None, None) for k, i, v, s, r in rows], ch.ELEMENT)


def applied(spark, base, *rows, since=None):
    return {(r.type, r.id): (r.version, r.visible, r.refs) for r in ch.apply_changeset(base, spark.createDataFrame(list(rows), ch.CHANGE), since).collect()}


def test_rules(spark):
    base = elements(spark, (0, 1, 1, True, []), (1, 5, 2, True, [1]), (0, 9, 4, False, []))
    got = applied(spark, base, change(1, 0, "modify", 1, 5, 3, [1, 1]), change(1, 1, "modify", 0, 9, 7), change(1, 2, "create", 0, 2, 1), change(1, 3, "modify", 0, 2, 2))
    assert got == {(0, 1): (1, True, []), (1, 5): (3, True, [1, 1]), (0, 9): (7, True, []), (0, 2): (2, True, [])}
    assert applied(spark, base, change(1, 0, "delete", 1, 5, 3))[1, 5] == (3, False, [])
    for wrong in (
        change(1, 0, "create", 0, 2, 2), change(1, 0, "create", 0, 1, 1), change(1, 0, "modify", 1, 5, 4, [1]), change(1, 0, "modify", 0, 77, 2), change(1, 0, "delete", 1, 5, 3, [1]), change(1, 0, "delete", 0, 77, 1),
    ):
        with pytest.raises(ch.ChangesetRejected):
            applied(spark, base, change(1, 5, "create", 0, 3, 1), wrong)
    dangling = elements(spark, (1, 5, 2, True, [1]))
    with pytest.raises(ch.ChangesetRejected, match="referred"):
        applied(spark, dangling, change(1, 0, "create", 0, 1, 1))


def test_late_changes_are_dropped(spark):
    base = elements(spark, (0, 1, 1, True, []))
    assert applied(spark, base, change(0, 0, "modify", 0, 1, 9), since="2024-01-01 00:00:00")[0, 1][0] == 1


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (9, 8)], "ref long, referrer long")
    assert {r[0] for r in ch.closure(edges, spark.createDataFrame([(1,)], "i long")).collect()} == {1, 2, 3, 4}


def test_start_sequence(spark):
    states = spark.createDataFrame([(100 + i, T + dt.timedelta(minutes=i)) for i in range(200)], "sequence long, timestamp timestamp")
    assert ch.start_sequence(states, "2024-01-01 01:40:00") == 140
    assert ch.start_sequence(states, "2020-01-01 00:00:00") is None


def test_patch_equals_the_new_version(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, json string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k long, json string")
    patch = compare.tile_patch(old, new, ["k"])
    assert {(r.k, r.action) for r in patch.collect()} == {(2, "replace"), (3, "delete"), (4, "add")}
    assert sorted(map(tuple, compare.apply_patch(old, patch, ["k"]).collect())) == sorted(map(tuple, new.collect()))


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one, two = spark.range(5), spark.range(7)
    store.commit({"a": one}, sequence=1)
    store.savepoint()
    store.commit({"a": two, "b": one}, sequence=2)
    snapshot = store.snapshot(str(tmp_path / "copy"))
    assert store.read("a").count() == 7 and store.properties()["sequence"] == 2
    store.rollback()
    assert store.read("a").count() == 5 and store.tables() == ["a"] and store.properties()["sequence"] == 1
    assert snapshot.read("a").count() == 7
    store.delete_range("a", "id", 1, 3)
    assert sorted(r.id for r in store.read("a").collect()) == [0, 3, 4]
    store.compact("a", "id")
    assert [(r.table_name, r.n_rows) for r in store.stats().collect()] == [("a", 3)]
    store.purge("a", properties=("sequence",))
    assert store.tables() == [] and store.properties() == {}


def test_stream_applies_each_changeset_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"elements": spark.createDataFrame([], ch.ELEMENT)})
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    rows = [change(1, 0, "create", 0, 1, 1, x=4), change(2, 0, "modify", 0, 1, 2, x=5), change(2, 1, "create", 1, 1, 1, [1, 1])]
    spark.createDataFrame(rows, ch.CHANGE).write.parquet(source)
    replication.follow(spark, store, source, checkpoint).awaitTermination()
    spark.createDataFrame([change(2, 0, "modify", 0, 1, 2, x=5), change(3, 0, "delete", 0, 1, 3)], ch.CHANGE).write.mode("append").parquet(source)
    replication.follow(spark, store, source, checkpoint).awaitTermination()
    got = {(r.type, r.id): (r.version, r.visible, r.x) for r in store.read("elements").collect()}
    assert got == {(0, 1): (3, False, None), (1, 1): (1, True, None)} and store.properties()["sequence"] == 3


def test_a_changeset_of_many_files_is_applied_whole(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"elements": spark.createDataFrame([], ch.ELEMENT)})
    source, checkpoint = str(tmp_path / "source"), str(tmp_path / "checkpoint")
    rows = [change(seq, i, "modify" if seq > 1 else "create", 0, i, seq, x=seq) for seq in (1, 2) for i in range(40)]
    spark.createDataFrame(rows, ch.CHANGE).repartition(40).write.parquet(source)
    assert len(list((tmp_path / "source").glob("*.parquet"))) > 16
    replication.follow(spark, store, source, checkpoint).awaitTermination()
    assert sorted((r.id, r.version, r.x) for r in store.read("elements").collect()) == [(i, 2, 2) for i in range(40)]
    spark.createDataFrame([change(2, 40, "create", 0, 40, 1)], ch.CHANGE).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="a part came after"):
        replication.follow(spark, store, source, checkpoint).awaitTermination()


def test_registered_stream_applies_every_day(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(replication, "advance", lambda store, batch: seen.append(sorted(r.seq for r in batch.select("seq").distinct().collect())))
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    queries.changes_stream(spark, sf)
    days = sorted(r.seq for r in queries.st.changes(spark, sf).select("seq").distinct().collect())
    assert len(days) > 1 and seen == [days]


def test_edges_of_elements(spark):
    got = ch.element_edges(elements(spark, (1, 5, 2, True, [1, 1, 2]), (2, 6, 1, False, [1]))).collect()
    assert {(r.ref, r.referrer) for r in got} == {(1, W + 5), (2, W + 5)}
    assert spark.range(1).select(ids.combined_id(1, F.lit(5).cast("long")).alias("c")).first().c == W + 5


def test_references_that_are_not_listed_take_no_join_and_tasks_of_bounded_rows(spark, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "ref long, referrer long")
    edges, held = rows((1, 10), (1, 10), (2, 10), (3, 11), (None, 11)), rows((1, 10), (1, 10), (3, 10), (None, 11), (7, 7))
    for n in (None, 10):
        got = compare.missing_references(edges, held, n).collect()
        assert sorted((r.ref or 0, r.referrer) for r in got) == [(0, 11), (2, 10), (3, 11)]
    monkeypatch.setattr(compare, "ROWS_A_TASK", 100)
    many = spark.range(1000).select(F.col("id").alias("ref"), (F.col("id") % 7).alias("referrer"))
    missing = compare.missing_references(many, many.filter("ref % 9 <> 0"), 1889)
    assert missing.count() == 112 and missing.rdd.getNumPartitions() == 19
    assert "Join" not in missing._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_elements_is_its_own_edges(spark, tmp_path, monkeypatch):
    """A changeset asks such a store only what refers to created elements; it is not joined with itself to see that it lists them."""

    def never(*_):
        raise AssertionError("edges were compared with the elements that they are made from")

    monkeypatch.setattr(ch, "missing_references", never)
    store = Store(spark, str(tmp_path / "s"))
    store.commit({"elements": elements(spark, (0, 1, 1, True, []), (1, 5, 2, True, [1, 2]))}, sequence=0)
    with pytest.raises(ch.ChangesetRejected, match="created but referred to"):
        replication.advance(store, spark.createDataFrame([change(1, 0, "create", 0, 2, 1)], ch.CHANGE))
    replication.advance(store, spark.createDataFrame([change(1, 0, "modify", 1, 5, 3, [1]), change(1, 1, "create", 0, 3, 1)], ch.CHANGE))
    assert sorted((r.type, r.id, r.version, r.refs) for r in store.read("elements").collect()) == [(0, 1, 1, []), (0, 3, 1, []), (1, 5, 3, [1])]
