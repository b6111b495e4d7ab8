"""Reading by key: ranges of keys, narrowed tables and what their plans read."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import changes as ch
from tessera.operators import elements


@pytest.fixture
def table(spark, tmp_path):
    """Keys 0, 10, 20, ... in ranges of many files."""
    spark.range(0, 100_000, 10).withColumn("x", F.col("id") * 2).repartitionByRange(20, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_few_keys_are_the_filter(spark, table):
    got = elements.narrowed(table, "id", keys(spark, [40, 41, 99_990, 40, None]))
    assert sorted(r.id for r in got.collect()) == [40, 99_990] and "Join" not in plan(got) and "Exchange" not in plan(got)
    assert re.search(r"PushedFilters: \[.*EqualTo\(id,40\)", plan(got)) and max(metrics(got)) <= 2500  # of 10,000 rows
    assert elements.narrowed(table, "id", keys(spark, [])).count() == 0


def test_more_keys_reach_the_scan_as_ranges_and_shuffle_nothing(spark, table):
    got = elements.narrowed(table, "id", keys(spark, [*range(0, 1000, 10), 41, 90_000, None]), few=10)
    assert got.count() == 101 and "BroadcastHashJoin" in plan(got) and "hashpartitioning" not in plan(got)
    assert max(metrics(got)) <= 2500


def test_many_keys_meet_by_a_shuffle(spark, table):
    wanted = keys(spark, range(0, 5000, 5))
    got = elements.narrowed(table, "id", wanted, max_keys=10, few=10)
    assert sorted(r.id for r in got.collect()) == list(range(0, 5000, 10))


@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), min_size=1, max_size=30), st.integers(1, 5))
def test_few_ranges(values, n):
    found = elements._few_ranges(sorted(values), n)
    assert len(found) == min(n, len(values)) and all(sum(a <= v <= b for a, b in found) == 1 for v in values) and all(x in values for r in found for x in r)


@settings(deadline=None, max_examples=15)
@given(st.sets(st.integers(-(1 << 63), (1 << 63) - 1), max_size=30), st.integers(1, 5))
def test_ranges_hold_all_keys_and_split_at_the_widest_gaps(spark, values, n):
    found = elements.key_ranges(keys(spark, values), ranges=n)
    assert len(found) == min(n, len(values)) and all(sum(a <= v <= b for a, b in found) == 1 for v in values)
    assert [x for r in found for x in r] == sorted(x for r in found for x in r) and all(x in values for r in found for x in r)


def test_ranges_of_too_many_keys(spark):
    assert elements.key_ranges(keys(spark, range(20)), max_keys=19) is None and elements.key_ranges(keys(spark, range(20)), max_keys=20) == [(i, i) for i in range(20)]


def test_misses_are_null_in_place(spark, table):
    rows = spark.createDataFrame([(1, [40, 41, 40]), (2, []), (3, None), (4, [7])], "id long, keys array<long>")
    for by_key in (False, True):
        got = {r.id: r.out for r in elements.batched_lookup(rows, "keys", table, "id", F.col("x"), "out", by_key).collect()}
        assert got == {1: [80, None, 80], 2: [], 3: None, 4: [None]}
        assert elements.ordered_lookup(rows, "keys", table, "id", F.col("x"), "out", by_key).count() == 0


def test_a_lookup_by_key_shuffles_only_what_is_wanted(spark, table):
    rows = spark.createDataFrame([(1, [40, 50])], "id long, keys array<long>")
    got = elements.ordered_lookup(rows, "keys", table, "id", F.col("x"), "out", by_key=True)
    assert got.first().out == [80, 100] and "EqualTo(id,40)" in plan(got)


def test_a_round_of_the_closure_reads_the_ranges_of_its_frontier(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "edges")
    edges = spark.range(0, 100_000).select(F.col("id").alias("ref"), (F.col("id") + 1_000_000).alias("referrer"))
    edges.repartitionByRange(20, "ref").sortWithinPartitions("ref").write.parquet(path)
    seen, plain = [], elements.narrowed
    monkeypatch.setattr(ch, "narrowed", lambda *a, **k: seen.append(plain(*a, **k)) or seen[-1])
    got = ch.closure(spark.read.parquet(path), keys(spark, [5, 70_000]), written=True)
    assert sorted(r[0] for r in got.collect()) == [5, 70_000, 1_000_005, 1_070_000]
    assert "EqualTo(ref,5)" in plan(seen[0]) and "hashpartitioning" not in plan(seen[0])
    # of the rows written, those that a round takes out of the files are a few groups of rows
    scanned = [n for n in metrics(seen[0])]
    assert max(scanned) <= 20_000


def metrics(df):
    """Rows out of each scan of a plan that has run."""
    df.collect()
    out = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("Scan") or name.startswith("BatchScan"):
            out.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))
        if name == "AdaptiveSparkPlan":
            walk(node.executedPlan())
        if "QueryStage" in name:
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return out
