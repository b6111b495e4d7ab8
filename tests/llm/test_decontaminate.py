import random

import numpy as np

from tessera.llm import decontaminate as dc

ITEMS = "item_id long, text string, score double"


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 0.0) for i, t in rows], ITEMS)


def plain_alignment(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i, j] = max(0, table[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), table[i - 1, j] - 1, table[i, j - 1] - 1)
    return table.max()


def test_alignment_against_the_full_table():
    draw = np.random.default_rng(2)
    items = [draw.integers(1, 5, draw.integers(1, 9)).astype(np.int32) for _ in range(40)]
    passages = [draw.integers(0, 5, draw.integers(1, 15)).astype(np.int32) for _ in range(40)]
    assert dc.align(items, passages).tolist() == [plain_alignment(a, b) for a, b in zip(items, passages)]


def test_copies_edits_and_clean_texts(spark, make, odd_rows):
    draw = random.Random(3)
    words = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(draw.choice(words) for _ in range(30))) for i in range(12)] + [(50, "tiny item"), (51, None), (52, ""), (None, "x y z")]
    noise = lambda n: " ".join(draw.choice(words) for _ in range(n))
    edited = items[4][1].split()
    edited[7], edited[20] = "changed", "other"
    del edited[14]
    rows = [(100, f"{noise(50)} {items[3][1]} {noise(40)}"), (101, f"{noise(9)} {' '.join(edited)}"), (102, noise(300)), (103, items[5][1].upper().replace(" ", "!! ")), (104, f"{items[6][1]} {items[7][1]}"), (105, "a tiny item here")]
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.leaks(make(rows + odd_rows), benchmark(spark, items)).collect()}
    assert set(got) == {(100, 3), (101, 4), (103, 5), (104, 6), (104, 7), (105, 50)}
    assert got[100, 3] == 1.0 and 0.7 < got[101, 4] < 1.0
    kept = dc.clean(make(rows + odd_rows), benchmark(spark, items))
    assert 102 in {r.doc_id for r in kept.collect()} and kept.filter("doc_id in (100, 101, 103, 104, 105)").count() == 0
    assert kept.columns == make(rows).columns and kept.filter("doc_id is null").count() == 1


def test_items_that_share_a_passage(spark, make):
    shared = ["s%d" % i for i in range(20)]
    items = [(i, " ".join([*shared[:10], f"v{i}", *shared[10:]])) for i in range(6)]
    rows = [(100, " ".join(["before", *shared[:10], "edited", *shared[10:], "after"])), (101, " ".join(["x y z", *shared[10:], "rest"])), (102, " ".join(shared[:14]))]
    got = {(r.doc_id, r.item_id) for r in dc.leaks(make(rows), benchmark(spark, items)).collect()}
    assert got == {(d, i) for d in (100, 102) for i in range(6)}
    kept = [r.doc_id for r in dc.clean(make(rows), benchmark(spark, items)).collect()]
    assert kept == [101]


def test_short_items_without_a_run_of_four(spark, make):
    item = ["w%d" % i for i in range(15)]
    edited = [w if i % 4 < 3 else "x" for i, w in enumerate(item)]
    assert [r.doc_id for r in dc.leaks(make([(1, " ".join(edited))]), benchmark(spark, [(1, " ".join(item))])).collect()] == [1]


def test_blocks_agree(spark, make, monkeypatch):
    draw = random.Random(5)
    words = ["w%d" % i for i in range(50)]
    items = [(i, " ".join(draw.choice(words) for _ in range(12))) for i in range(30)]
    rows = [(i, " ".join([items[i][1], *(draw.choice(words) for _ in range(20))])) for i in range(0, 30, 3)]
    one = sorted(map(tuple, dc.leaks(make(rows), benchmark(spark, items)).collect()))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 60)
    assert sorted(map(tuple, dc.leaks(make(rows), benchmark(spark, items)).collect())) == one and len(one) >= 10


def test_empty(spark, make):
    assert dc.leaks(make([]), benchmark(spark, [(1, "a b c")])).count() == 0
    assert dc.leaks(make([(1, "a b c")]), benchmark(spark, [])).count() == 0
