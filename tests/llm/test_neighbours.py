import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def plain(rows, queries, k=5):
    rows = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and len(v) and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    out = {}
    for q, x in rows:
        if queries(q):
            scored = sorted((-(v * x).sum() / (np.sqrt((v * v).sum()) * np.sqrt((x * x).sum())), i) for i, v in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_recall_and_scores(spark):
    draw = np.random.default_rng(7)
    vectors = draw.standard_normal((3000, 24)).astype(np.float32)
    vectors[100:140] = vectors[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    want = plain(rows, lambda i: i % 100 == 0)
    found = neighbours.search(table(spark, rows), F.col("vec_id") % 100 == 0, block_rows=700).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    exact = {q: dict(plain(rows, lambda i: i == q, 3000)[q]) for q in list(want)[:3]}
    for q, near in exact.items():
        assert all(abs(near[i] - s) < 1e-12 for i, s in got[q])
    assert [i for i, _ in got[100]] == [7, 101, 102, 103, 104]


def test_a_truncated_vector_removes_no_other(spark):
    rows = [(0, [1.0, 0.0], 0)] + [(i, [1.0, float(i), 0.5], 0) for i in range(1, 9)]
    found = neighbours.search(table(spark, rows), F.col("vec_id") == 1).collect()
    want = plain(rows[1:], lambda i: i == 1)[1]
    assert [(r.query_id, r.vec_id) for r in sorted(found, key=lambda r: r["rank"])] == [(1, i) for i, _ in want]


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (None, [1.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [1.0, None], 1), (50, [-1.0, 0.0], None), (1, [1.0, 1.0], 1)]
    got = [tuple(r) for r in neighbours.search(table(spark, rows), F.col("vec_id") % 50 == 0).collect()]
    half = 1 / np.sqrt(2)
    want = [(0, 1, 1, half), (0, 2, 1, half), (0, 3, 50, -1.0), (50, 1, 1, -half), (50, 2, 1, -half), (50, 3, 0, -1.0)]
    assert len(got) == 6 and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-9 for a, b in zip(sorted(got), want))
    assert neighbours.search(table(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_recall_over_the_whole_table(spark):
    """The query over all rows of the embeddings, and again in blocks of a tenth of its size, against every pair."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("the driver's tables are not here")
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = vectors.select("vec_id", "embedding").toArrow()
    ids, v = rows.column("vec_id").to_numpy(), np.stack(rows.column("embedding").to_numpy()).astype(float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    for block_rows in (neighbours.BLOCK_ROWS, 200):
        got = neighbours.search(vectors, F.col("vec_id") % 50 == 0, block_rows=block_rows).toPandas()
        hits = 0
        asked = np.flatnonzero(ids % 50 == 0)
        for i in asked:
            near = v @ v[i]
            near[i] = -9
            hits += len(set(got[got.query_id == ids[i]].vec_id) & set(ids[np.lexsort((ids, -near))[:5]]))
        assert hits >= 0.9 * 5 * len(asked)


def test_tiny_and_huge_components(spark):
    rows = [(0, [1e-200, 1e-200], 0), (1, [1e200, 1e200], 0), (2, [1e-200, -1e-200], 0), (3, [0.0, 5e-324], 0)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = neighbours.search(made, F.col("vec_id") == 0).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [1, 3, 2] and all(abs(r.score) <= 1 + 1e-12 for r in got)


def test_of_a_repeated_query_the_least_vector_is_asked_for(spark):
    rows = [(50, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (1, [0.1, 1.0], 0), (2, [1.0, 0.1], 0)]
    got = neighbours.search(table(spark, rows), F.col("vec_id") == 50).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(50, 1), (50, 2)]
