"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents that the label table marks good; the unlabelled set is a plain sample of all web text.
The class prior is estimated from the two samples, and a linear model minimises the non-negative unbiased risk, so that
nothing is gained by pushing the negative part of the risk below zero. Both samples are bounded by documented
parameters; every document is then scored where it lies, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, utf8

HASHED = 256
SHAPES = 20
WIDTH = SHAPES + HASHED

#: Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 other ASCII marks, 7 above ASCII.
_CLASS = np.zeros(256, np.uint8)
for _byte in range(256):
    _char = chr(_byte)
    _CLASS[_byte] = 7 if _byte > 127 else 1 if _char.islower() else 2 if _char.isupper() else 3 if _char.isdigit() else 4 if _char.isspace() else 5 if _char in ".,;:'\"-()" else 6 if _byte > 32 else 0
_MARKED = re.compile(rb"[^\w\s.,;:'\"()\x80-\xff-](?:\s|\Z)")


def features(text: bytes) -> np.ndarray:
    """Shapes of the text and its words, then hashed shares of its lower-case words; an empty text has its own vector."""
    out = np.zeros(WIDTH, np.float32)
    words = text.split()
    n = len(words)
    out[0] = 1.0
    if not n:
        out[1] = 1.0
        return out
    chars = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=8) / len(text)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = n - 1
    repeats = sum(map(bytes.__eq__, words, words[1:])) if pairs else 0
    out[2] = np.log1p(n) / 10
    out[3] = min(len(text) / n, 40) / 10
    out[4:11] = chars[1:]
    letters = chars[1] + chars[2]
    out[11] = chars[2] / letters if letters else 0
    out[12] = len(counts) / n
    out[13] = max(counts.values()) / n
    out[14] = repeats / pairs if pairs else 0
    out[15] = len(_MARKED.findall(text)) / n
    out[16] = 1 - len(set(lines)) / len(lines)
    out[17] = min(n / len(lines), 100) / 100
    out[18] = sum(v for v in counts.values() if v > 3) / n
    out[19] = min(1.0, max(len(w) for w in counts) / 100)
    slots = np.fromiter((zlib.crc32(w.lower()) for w in counts), np.int64, len(counts)) % HASHED
    shares = np.bincount(slots, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=HASHED)
    out[SHAPES:] = np.sqrt(shares / n)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(x: np.ndarray, gradient, steps: int, rate: float = 0.05, ridge: float = 2e-3) -> tuple[np.ndarray, float]:
    """Adam over weights and bias; ``gradient(z)`` gives the slope of the risk at each row's logit."""
    weights, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    for step in range(1, steps + 1):
        slope = gradient(x @ weights[:-1] + weights[-1])
        g = np.append(x.T @ slope + ridge * weights[:-1], slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        weights = weights - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], weights[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200) -> float:
    """The share of positives among the unlabelled rows, from a classifier of positive against unlabelled.

    Where only positives lie, the density of the positives over that of the unlabelled rows is one over the class prior.
    The log ratio is learnt on half of each sample from the shape features alone, and read off as its median over the
    other half of the positives, most of which lie in such places when good text is not mistaken for bad.
    """
    positive, unlabelled = positive[:, :SHAPES], unlabelled[:, :SHAPES]
    x = np.vstack([positive[::2], unlabelled[::2]])
    y = np.repeat([1.0, 0.0], [len(positive[::2]), len(unlabelled[::2])])
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    weights, bias = _descend(x, lambda z: share * (_sigmoid(z) - y), steps, ridge=1e-2)
    held_out = positive[1::2] if len(positive) > 1 else positive
    return float(np.clip(np.exp(-np.median(held_out @ weights + bias)), 0.05, 0.95))


def risk(z: np.ndarray, n_pos: int, prior: float) -> float:
    """The non-negative unbiased risk of logits, those of the positives first."""
    zp, zu = z[:n_pos], z[n_pos:]
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def risk_slope(z: np.ndarray, n_pos: int, prior: float) -> np.ndarray:
    zp, zu = z[:n_pos], z[n_pos:]
    good = -prior * _sigmoid(-zp) / n_pos
    if np.logaddexp(0, zu).mean() < prior * np.logaddexp(0, zp).mean():  # the negative part counts as zero, and so does its slope
        return np.concatenate([good, np.zeros(len(zu))])
    return np.concatenate([good - prior * _sigmoid(zp) / n_pos, _sigmoid(zu) / len(zu)])


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600) -> Model:
    """Minimise prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) with the logistic loss l.

    With no positives, or nothing unlabelled, there is nothing to learn from and every score is 0.5.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-4, scale, np.inf)
    positive, unlabelled = (positive - mean) / scale, (unlabelled - mean) / scale
    prior = estimate_prior(positive, unlabelled)
    weights, bias = _descend(np.vstack([positive, unlabelled]), lambda z: risk_slope(z, len(positive), prior), steps, 0.02)
    return Model(mean, scale, weights, float(bias), prior)


def _bucket(salt: str, id_col: Column) -> Column:
    """A stable number in [0, 1) for each id."""
    return F.crc32(F.concat(F.lit(salt), id_col.cast("string"))) / F.lit(float(1 << 32))


def _feature_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t).tobytes() for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["kind", "doc_id", "x"])

    return docs.select("kind", "doc_id", "text").mapInArrow(run, "kind int, doc_id long, x binary")


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 6000, max_unlabelled: int = 9000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit the model on at most about ``max_positive`` labelled rows and ``max_unlabelled`` rows of all text.

    Labels are taken only from rows whose crc32 of the id, as text, is not 0 modulo 5. Both samples are drawn by a hash of
    the id at a rate set from the full counts, so their size does not grow with the tables.
    """
    table = id_and_text(docs, id_col, text_col)
    good = labels.filter(F.col(f"`{label_col}`") == 1).select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).distinct()
    good = good.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    rate_p = min(1.0, max_positive / max(1, good.count()))
    rate_u = min(1.0, max_unlabelled / max(1, docs.count()))
    good = good.filter(_bucket("p", F.col("doc_id")) < rate_p)
    # at most about max_positive ids of eight bytes each, so the broadcast is bounded
    positive = table.join(F.broadcast(good), "doc_id", "left_semi").select(F.lit(1).alias("kind"), "doc_id", "text")
    unlabelled = table.filter(_bucket("u", F.coalesce("doc_id", F.lit(-1))) < rate_u).select(F.lit(0).alias("kind"), "doc_id", "text")
    # in order, so that the model does not depend on how the tables are split
    rows = sorted(_feature_rows(positive.union(unlabelled)).collect(), key=lambda r: (r.kind, r.doc_id is not None, r.doc_id or 0, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, WIDTH).astype(np.float64)
    kind = np.array([r.kind for r in rows])
    return fit(x[kind == 1], x[kind == 0])


def _scored(model: Model, text_col: str) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in utf8(texts)], dtype=np.float64).reshape(-1, WIDTH)
        return pa.array(model.scores(x), pa.float64())

    return F.arrow_udf(run, "double")(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns as they are.

    A null or empty text has the score of the empty vector; repeated rows go or stay together; texts are read whole; an
    empty table gives an empty result.
    """
    return docs.filter(_scored(model, text_col) >= threshold)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` after its own columns, in its own order.

    A null or empty text gets the score of the empty vector; repeated rows score alike; an empty table gives an empty
    result. Columns of ``docs`` named score or predicted give way to the new ones.
    """
    scored = docs.withColumn("score", _scored(model, text_col))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    A null or empty text gets the score of the empty vector; a row with a null doc_id has a null held_out, is never a
    trusted positive and may be among the unlabelled; repeated rows score alike; labels repeated for an id count once.
    With no good labels every score is 0.5. Texts are read whole; an empty table gives an empty result; other columns
    are not read.
    """
    table = id_and_text(docs)
    scored = classify(table, train(table, labels), threshold)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
