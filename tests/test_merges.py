import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import merges

SETS = "key string, op_seq long, adds array<long>, dels array<long>"
MAPS = "key string, id long, op_seq long, value string"


def sets(spark, operands, upto=None):
    rows = [("k", i, a, d) for i, (a, d) in enumerate(operands)][:upto]
    arrays = merges.set_arrays(merges.set_state(merges.set_operands(spark.createDataFrame(rows, SETS)))).collect()
    return arrays[0].state if arrays else []


def test_set_goldens(spark):
    simple = [([5], []), ([7], []), ([], [5])]
    assert [sets(spark, simple, n) for n in (1, 2, 3)] == [[5], [5, 7], [7]]
    whole = [([5, 6, 7], []), ([1, 2, 3], [4, 5]), ([2, 5], [1, 4, 7])]
    assert [sets(spark, whole, n) for n in (1, 2, 3)] == [[5, 6, 7], [1, 2, 3, 6, 7], [2, 3, 5, 6]]
    assert sets(spark, [([4], [4])]) == [4]
    assert sets(spark, [([-1, 3], [])]) == [3, -1]
    assert sets(spark, [([1], []), ([], [1])]) == []


def test_set_random_model(spark):
    draw = random.Random(2)
    model, rows = {k: set() for k in "abcd"}, []
    for i in range(100):
        k = draw.choice("abcd")
        adds = set(draw.sample(range(10), draw.randrange(5)))
        dels = set(draw.sample(range(10), draw.randrange(3))) - adds
        model[k] = (model[k] - dels) | adds
        rows.append((k, i, sorted(adds), sorted(dels)))
    got = {r.key: r.state for r in merges.set_arrays(merges.set_state(merges.set_operands(spark.createDataFrame(rows, SETS)))).collect()}
    assert got == {k: sorted(v) for k, v in model.items() if v}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 5), max_size=3), st.lists(st.integers(0, 5), max_size=3)), min_size=2, max_size=12), st.data())
def test_sets_merge_in_any_grouping(spark, operands, data):
    cut = data.draw(st.integers(1, len(operands) - 1))
    ops = merges.set_operands(spark.createDataFrame([("k", i, a, d) for i, (a, d) in enumerate(operands)], SETS))
    parts = merges.merge_sets(ops.filter(f"op_seq < {cut}")).union(merges.merge_sets(ops.filter(f"op_seq >= {cut}")))
    assert sorted(map(tuple, merges.set_state(parts).collect())) == sorted(map(tuple, merges.set_state(ops).collect()))


def test_map_goldens(spark):
    operands = [{5: "hello", 6: "world", 7: "!"}, {1: "name", 2: "jeff", 3: "lol", 4: None, 5: None}, {1: None, 2: "jef", 4: None, 5: "hey", 7: None}]
    rows = [("k", i, n, v) for n, o in enumerate(operands) for i, v in o.items()]
    want = [{5: "hello", 6: "world", 7: "!"}, {1: "name", 2: "jeff", 3: "lol", 6: "world", 7: "!"}, {2: "jef", 3: "lol", 5: "hey", 6: "world"}]
    for n, w in enumerate(want):
        got = merges.map_state(spark.createDataFrame([r for r in rows if r[2] <= n], MAPS)).collect()
        assert {r.id: r.value for r in got} == w
    halves = [merges.merge_maps(spark.createDataFrame([r for r in rows if (r[2] == 0) == first], MAPS)) for first in (True, False)]
    assert {r.id: r.value for r in merges.map_state(halves[0].union(halves[1].select("key", "id", "op_seq", "value"))).collect()} == want[2]


def test_counters(spark):
    base, deltas = (spark.createDataFrame(rows, "key string, value long") for rows in ([("a", 5)], [("a", -2), ("b", 1), ("a", 1)]))
    assert {r.key: r.value for r in merges.add_counters(base, deltas).collect()} == {"a": 4, "b": 1}
