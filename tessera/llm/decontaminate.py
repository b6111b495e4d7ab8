"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them.

The test items are the query set. Every n-gram of an item is a seed, one that items share standing for all of them, so each
part of an item can be found. Items go in blocks of bounded size; a block's words and seeds are what a task holds, every
document is streamed past it once, and each passage around seeds of an item that holds enough of the item's words to reach
the threshold is aligned with that item. A copy without a run of n of the item's words is not found.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns_of, id_and_text, materialize, small_side

MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_WORDS = 50_000
CELLS = 1 << 21

_TO_SPACE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words: what ASCII white space, controls and punctuation leave between them."""
    return text.lower().encode("utf-8", "replace").translate(_TO_SPACE).split()


class Block:
    """The items of one block: their words as ids from 1, and each seed's code with the (item, place) pairs it stands for."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids = [r[0] for r in rows]
        split = [words(r[1]) for r in rows]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for s in split for w in s), 1)}
        self.base = len(self.vocabulary) + 1
        self.items = [np.array([self.vocabulary[w] for w in s], np.int32) for s in split]
        where: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, item in enumerate(self.items):
            size = min(n, len(item))
            if size:
                for place, code in enumerate(self.codes(item, size).tolist()):
                    where[size][code].append((k, place))
        self.seeds = {}
        for size, found in where.items():
            keys = np.array(sorted(found), np.uint64)
            self.seeds[size] = keys, [found[int(k)] for k in keys]

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of ``size`` ids, different runs of known words having different ones; 0 where a word is unknown."""
        if len(ids) < size:
            return np.zeros(0, np.uint64)
        ids = ids.astype(np.uint64)
        out, known = np.zeros(len(ids) - size + 1, np.uint64), np.ones(len(ids) - size + 1, bool)
        for i in range(size):
            part = ids[i : len(ids) - size + 1 + i]
            out = out * np.uint64(self.base) + part
            known &= part > 0
        return np.where(known, out, np.uint64(0))

    def passages(self, ids: np.ndarray) -> list[tuple[int, int, int, int]]:
        """``(item, first, last, seeds)`` for each stretch of a document around seeds of an item; overlapping ones are joined."""
        starts = defaultdict(list)
        for size, (keys, pairs) in self.seeds.items():
            codes = self.codes(ids, size)
            at = np.flatnonzero(codes)
            slot = np.searchsorted(keys, codes[at])
            hit = slot < len(keys)
            at, slot = at[hit], slot[hit]
            hit = keys[slot] == codes[at]
            for place, k in zip(at[hit].tolist(), slot[hit].tolist()):
                for item, inside in pairs[k]:
                    starts[item].append(place - inside)
        out = []
        for item, found in starts.items():
            size = len(self.items[item])
            margin = size // 2 + 2
            found.sort()
            first, last, n = found[0] - margin, found[0] + size + margin, 0
            for start in found:
                if start - margin > last:
                    out.append((item, max(0, first), min(len(ids), last), n))
                    first, n = start - margin, 0
                last = start + size + margin
                n += 1
            out.append((item, max(0, first), min(len(ids), last), n))
        return out


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The Smith-Waterman score of each item with its passage, many pairs at a time."""
    scores = np.zeros(len(items), np.int32)
    order = sorted(range(len(items)), key=lambda k: (len(passages[k]), len(items[k])))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(passages[order[end]]) <= CELLS:
            end += 1
        chunk, at = order[at:end], end
        rows, cols = max(len(items[k]) for k in chunk), max(len(passages[k]) for k in chunk)
        item, passage = np.full((len(chunk), rows), -1, np.int32), np.zeros((len(chunk), cols), np.int32)
        for i, k in enumerate(chunk):
            item[i, : len(items[k])] = items[k]
            passage[i, : len(passages[k])] = passages[k]
        slope = -GAP * np.arange(cols + 1, dtype=np.int32)
        last, best = np.zeros((len(chunk), cols + 1), np.int32), np.zeros(len(chunk), np.int32)
        for r in range(rows):
            here = np.maximum(last + GAP, 0)
            step = np.where(passage == item[:, r : r + 1], MATCH, MISMATCH).astype(np.int32)
            np.maximum(here[:, 1:], last[:, :-1] + step, out=here[:, 1:])
            last = np.maximum.accumulate(here + slope, axis=1) - slope
            np.maximum(best, last.max(axis=1), out=best)
        scores[chunk] = best
    return scores


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, similarity, n_seeds)`` for each document row and item aligned at ``threshold`` or more.

    similarity is the best alignment's score over the item's score with itself. Null or empty texts, items without words
    and items with a null id take no part; a null doc_id is carried; each repeated document row gives its own rows, and of
    items repeated under one id the longest text counts (ties: the greatest). Empty tables give an empty result. Long
    texts are streamed whole.
    """
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).dropna()
    items = items.groupBy("item_id").agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("text"))
    planned = materialize(items, "items")
    total = planned.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (4 * BLOCK_WORDS)))
    table = id_and_text(docs, id_col, text_col)
    spark = docs.sparkSession
    parts = []
    for b in range(blocks):
        mine = planned.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id")
        rows = [(r.item_id, r.text) for r in mine.collect()]  # a block's items: about 4 * BLOCK_WORDS characters
        parts.append(_scan(table, spark.sparkContext.broadcast(Block(rows, n)), threshold))
    return reduce(DataFrame.union, parts)


def _scan(table: DataFrame, shared, threshold: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        get = block.vocabulary.get
        for batch in batches:
            rows, items, stretches = [], [], []
            counts: dict[tuple[int, int], int] = defaultdict(int)  # by row of the batch and item
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.array([get(w, 0) for w in words(text)], np.int32)
                for item, first, last, n in block.passages(ids):
                    counts[row, item] += n
                    stretch, wanted = ids[first:last], block.items[item]
                    if np.isin(wanted, stretch).sum() >= threshold * len(wanted):  # or no alignment can reach it
                        rows.append(row)
                        items.append(item)
                        stretches.append(stretch)
            scores = align([block.items[k] for k in items], stretches).tolist()
            best: dict[tuple[int, int], int] = {}
            for row, item, score in zip(rows, items, scores):
                best[row, item] = max(score, best.get((row, item), 0))
            ids_of = batch.column(0).to_pylist()
            out = [(ids_of[row], block.ids[item], score, score / (MATCH * len(block.items[item])), counts[row, item]) for (row, item), score in best.items()]
            kept = [x for x in out if x[3] >= threshold]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32())
            columns = [pa.array(c, t) for c, t in zip(zip(*kept), kinds)] if kept else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "score", "similarity", "n_seeds"])

    return table.mapInArrow(run, "doc_id long, item_id long, score int, similarity double, n_seeds int")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose doc_id no leak carries; rows with a null doc_id stay, and so do null and empty texts.

    Of rows that repeat one id, all go if one of them holds a passage. Texts are read whole; empty tables give ``docs`` as
    it is; the columns keep their names and places.
    """
    found = materialize(leaks(docs, benchmark, threshold=threshold).select("doc_id").filter("doc_id is not null").distinct(), "leaks")
    return docs.join(small_side(found), "doc_id", "left_anti").select(columns_of(docs))
