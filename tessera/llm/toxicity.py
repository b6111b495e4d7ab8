"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; each model sees the text's terms and the probabilities of the categories before
it. Those probabilities are taken out of fold while the models are trained, so a later model learns from earlier ones as they
will be on new text. Terms are lower-case words and their beginnings, which catch inflected forms; the few hundred that
best tell toxic from other labelled text are chosen by counts over the training rows, in Spark.

The label table marks toxic text only, so the finer categories are derived from it and from what the terms do not state: a
toxic document whose words come back more than in half of the toxic ones is ``repeated``, one with more capitals and
exclamation marks than half of them is ``shouted``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, materialize

CATEGORIES = ("toxic", "repeated", "shouted")
BEGINNINGS = (4, 5, 6)
_WORD = regex.compile(r"\p{L}+")


def terms(text: str) -> Counter[str]:
    """How often each lower-case word (runs of letters) and each beginning of one, with a dash, occurs."""
    out: Counter[str] = Counter()
    for word, n in Counter(text.lower().split()).items():
        for w in [word] if word.isalpha() else _WORD.findall(word):
            out[w] += n
            for k in BEGINNINGS:
                if len(w) > k:
                    out[w[:k] + "-"] += n
    return out


def chosen_terms(rows: DataFrame, at_most: int = 600, at_least: int = 3) -> list[str]:
    """The terms of ``rows (text, toxic)`` with the highest log odds of toxic documents that hold them, times their share; ties by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, other = Counter(), Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if y else other).update(terms(text).keys())
            listed = list(toxic.keys() | other.keys())
            columns = [pa.array(listed, pa.string()), pa.array([toxic[t] for t in listed], pa.int64()), pa.array([other[t] for t in listed], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["term", "t", "o"])

    n = rows.agg(F.sum("toxic"), F.count("*")).first()
    n_toxic, n_other = (n[0] or 0) + 1, n[1] - (n[0] or 0) + 1
    counted = rows.select("text", "toxic").mapInArrow(run, "term string, t long, o long").groupBy("term").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    odds = F.log((F.col("t") + 0.2) / n_toxic) - F.log((F.col("o") + 0.2) / n_other)
    best = counted.filter(F.col("t") >= at_least).withColumn("gain", odds * F.sqrt(F.col("t") / n_toxic)).filter("gain > 0")
    return [r.term for r in best.orderBy(F.desc("gain"), "term").limit(at_most).select("term").collect()]


def vector(text: str, place: dict[str, int]) -> np.ndarray:
    """Damped counts of the chosen terms."""
    out = np.zeros(len(place), np.float32)
    for term, n in terms(text).items():
        at = place.get(term)
        if at is not None:
            out[at] = 1 + math.log(n)
    return out


@dataclass
class Chain:
    """One linear model for each category, over the terms and the probabilities of the categories before."""

    place: dict[str, int]
    models: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for weights in self.models:
            out = np.column_stack((out, _apply(weights, np.column_stack((x, _logit(out))))))
        return out


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-3, 1 - 1e-3) / np.clip(1 - p, 1e-3, 1 - 1e-3))


def _apply(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, ridge: float = 2e-4) -> np.ndarray:
    weights, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    rate = 0.05
    weights[-1] = -2.0
    for step in range(1, steps + 1):
        slope = (_apply(weights, x) - y) / max(1, len(y))
        g = np.append(x.T @ slope + ridge * weights[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights


def fit(x: np.ndarray, labels: np.ndarray, place: dict[str, int], folds: int = 5) -> Chain:
    """``labels`` has a column for each category, in the chain's order; rows are dealt to folds in turn."""
    earlier, models = np.zeros((len(x), 0)), []
    fold = np.arange(len(x)) % folds
    for y in labels.T:
        inputs = np.column_stack((x, _logit(earlier)))
        models.append(_logistic(inputs, y))
        out_of_fold = np.zeros(len(x))
        for f in range(folds):
            if (fold == f).any():
                out_of_fold[fold == f] = _apply(_logistic(inputs[fold != f], y[fold != f]), inputs[fold == f])
        earlier = np.column_stack((earlier, out_of_fold))
    return Chain(place, models)


def manner(text: str) -> tuple[float, float]:
    """The share of words that have come before in a text, and that of capitals and exclamation marks among its characters."""
    words = text.lower().split()
    loud = sum(c.isupper() for c in text) + text.count("!")
    return (len(words) - len(set(words))) / max(1, len(words)), loud / max(1, len(text))


def categories(manners: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The labels of the chain from the toxic mark and the manner of each row."""
    usual = np.median(manners[toxic > 0], axis=0) if toxic.any() else np.zeros(2)
    return np.column_stack((toxic, (manners > usual) * toxic[:, None]))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_other: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Fit on at most about ``max_toxic`` and ``max_other`` labelled rows whose crc32 of the id, as text, is not 0 modulo 5.

    The rows are drawn by a hash of the id at rates set from the full counts. A row labelled more than once is toxic if any label says so.
    """
    marked = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).dropna()
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    n = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("toxic") == 1, min(1.0, max_toxic / max(1, n.get(1, 0)))).otherwise(min(1.0, max_other / max(1, n.get(0, 0))))
    sample = marked.filter(F.crc32(F.concat(F.lit("t"), F.col("doc_id").cast("string"))) / float(1 << 32) < rate)
    # at most about max_toxic + max_other ids, so the broadcast is bounded
    rows = materialize(id_and_text(docs, id_col, text_col).join(F.broadcast(sample), "doc_id"), "toxicity-sample")
    place = {t: i for i, t in enumerate(chosen_terms(rows))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            made = [vector(t, place).tobytes() for t in texts]
            manners = [pa.array(m, pa.float64()) for m in np.array([manner(t) for t in texts], np.float64).reshape(-1, 2).T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary()), *manners], names=["doc_id", "toxic", "x", "again", "loud"])

    kinds = "doc_id long, toxic int, x binary, again double, loud double"
    made = sorted(rows.select("doc_id", "toxic", "text").mapInArrow(run, kinds).collect())
    x = np.frombuffer(b"".join(bytes(r.x) for r in made), np.float32).reshape(len(made), len(place)).astype(np.float64)
    toxic = np.array([r.toxic for r in made], np.float64)
    if not made or not place:
        return Chain(place, [np.append(np.zeros(len(place) + i), -4.0) for i in range(len(CATEGORIES))])
    return fit(x, categories(np.array([(r.again, r.loud) for r in made]), toxic), place)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.35) -> DataFrame:
    """``(doc_id, held_out, toxic, repeated, shouted, predicted)`` for every row of ``docs``; predicted is 1 where toxic reaches the threshold.

    A null or empty text has the chain's probabilities of no terms; a null doc_id is carried, with a null held_out;
    repeated rows score alike; an empty table gives an empty result; with no toxic labels every probability is low.
    Texts are read whole, other columns are not read.
    """
    table = id_and_text(docs)
    chain = train(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([vector(t, chain.place) for t in batch.column(1).to_pylist()], np.float64).reshape(batch.num_rows, len(chain.place))
            p = chain.probabilities(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in p.T)], names=["doc_id", *CATEGORIES])

    scored = table.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in CATEGORIES))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), *CATEGORIES, (F.col("toxic") >= threshold).cast("int").alias("predicted"))
