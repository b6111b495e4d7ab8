import os
import zlib

import numpy as np
import pytest

from tessera.llm import quality, toxicity

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
LABELS = "doc_id long, quality int, toxic int, score double"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@needs_tables
def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    met = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = met[met.held_out]
    assert ((held.predicted == held.quality).mean()) > 0.95
    assert (met.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in met.doc_id]).all()
    assert ((met.score >= 0) & (met.score <= 1)).all() and (met.predicted == (met.score >= 0.3)).all()


@needs_tables
def test_held_out_labels_are_not_read(spark):
    docs, labels = tables(spark)
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "CASE WHEN crc32(CAST(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert np.allclose(quality.train(docs, labels).weights, quality.train(docs, flipped).weights)
    assert all(np.allclose(a, b) for a, b in zip(toxicity.train(docs, labels).models, toxicity.train(docs, flipped).models))


@needs_tables
def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    met = toxicity.scores(docs, labels).join(labels.withColumnRenamed("toxic", "label"), "doc_id").toPandas()
    held = met[met.held_out]
    assert held[held.label == 0].predicted.mean() < 0.05 and held[held.label == 1].predicted.mean() > 0.6


def test_prior_is_found():
    draw = np.random.default_rng(1)
    good = lambda n: np.column_stack((draw.normal(2, 1, (n, 3)), draw.normal(0, 1, (n, quality.WIDTH - 3))))
    bad = lambda n: np.column_stack((draw.normal(-2, 1, (n, 3)), draw.normal(0, 1, (n, quality.WIDTH - 3))))
    model = quality.fit(good(2000), np.vstack((good(2100), bad(900))))
    assert abs(model.prior - 0.7) < 0.1
    assert (model.scores(good(500)) > 0.5).mean() > 0.95 and (model.scores(bad(500)) < 0.5).mean() > 0.9


def test_later_models_see_earlier_ones():
    draw = np.random.default_rng(2)
    x = draw.integers(0, 2, (400, 6)).astype(float)
    first = x[:, 0]
    chain = toxicity.fit(x, np.column_stack((first, first * x[:, 1], first * x[:, 2])), {})
    assert [len(w) for w in chain.models] == [7, 8, 9] and chain.models[1][6] > 0
    assert ((chain.probabilities(x) > 0.5) == np.column_stack((first, first * x[:, 1], first * x[:, 2]))).mean() > 0.97


def test_odd_rows(spark, make, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0, 0.0), (2, 0, 1, 0.0), (None, 1, 1, 0.0), (6, None, None, 0.0), (6, 1, 1, 0.0)], LABELS)
    docs = make(odd_rows)
    for rows in (quality.quality_scores(docs, labels).collect(), toxicity.scores(docs, labels).collect()):
        assert len(rows) == len(odd_rows) and sum(r.held_out is None for r in rows) == 1
    nothing = labels.limit(0)
    assert {r.score for r in quality.quality_scores(docs, nothing).collect()} == {0.5}
    assert {r.predicted for r in toxicity.scores(docs, nothing).collect()} == {0}
    assert quality.quality_scores(make([]), labels).count() == 0 and toxicity.scores(make([]), labels).count() == 0
    assert quality.classify(docs, quality.train(docs, nothing)).columns == [*[c for c in docs.columns], "predicted"]


@needs_tables
def test_the_model_does_not_depend_on_the_split(spark):
    docs, labels = tables(spark)
    one, other = quality.train(docs, labels), quality.train(docs.repartition(7).orderBy("n_chars"), labels.repartition(3))
    assert np.array_equal(one.weights, other.weights) and one.bias == other.bias and one.prior == other.prior


def test_slope_of_the_risk():
    draw = np.random.default_rng(3)
    for shift in (0.0, -6.0):  # the negative part of the risk above zero, and below
        z = np.concatenate((draw.standard_normal(7), draw.standard_normal(11) + shift))
        slope = quality.risk_slope(z, 7, 0.4)
        for i in range(len(z)):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert abs((quality.risk(up, 7, 0.4) - quality.risk(down, 7, 0.4)) / 2e-5 - slope[i]) < 1e-8


def test_finer_categories_are_of_the_text():
    texts = ["a b c d", "a a a a", "LOUD words!!", "calm LOUD LOUD LOUD LOUD!", "a a a a a"]
    toxic = np.array([1, 1, 1, 1, 0.0])
    made = toxicity.categories(np.array([toxicity.manner(t) for t in texts]), toxic)
    assert made.tolist() == [[1, 0, 0], [1, 1, 0], [1, 0, 1], [1, 1, 1], [0, 0, 0]]
    assert toxicity.manner("") == (0.0, 0.0)
