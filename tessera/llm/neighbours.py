"""Approximate nearest neighbours by collision counting over sorted projections.

Every vector is hashed by its projections on a fixed set of random lines, and each line keeps the vectors of a block in
sorted order: that is the whole index. A query's window on a line is centred on its own projection. Virtual rehashing widens
all its windows by a factor a round, and a vector collides on the lines where its place in the order is inside the
window. Vectors that collide on enough lines are verified by their exact cosine, and a query is done with a block at the
first round in which enough of the block's vectors are to be verified. Collisions only grow with the windows, so that
round is found by halving the range of rounds.

Every vector is indexed, in blocks of bounded size dealt at random. Queries are a stated set; they go past the blocks in
batches of bounded size, one batch after another, and each block gives its nearest few for each query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

LINES = 80
SEED = 20
#: Lines on which a vector has to collide with the query, of LINES: a count tells near from far best where most lines collide.
THRESHOLD = 64
FIRST_WIDTH, GROWTH, ROUNDS = 0.15, 1.15, 32
#: More than the distance between any two projections of unit vectors, so all lines fit in one sorted array.
APART = 1000.0
BLOCK_ROWS = 8192
QUERY_ROWS = 16_384


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest component near 1, so that no square vanishes or overflows."""
    exponent = np.frexp(np.abs(vectors).max(axis=-1, keepdims=True))[1]
    return np.ldexp(vectors, -exponent)


class Block:
    """The sorted projections of some vectors, and the search over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int = LINES, threshold: int = THRESHOLD):
        self.ids, self.vectors, self.threshold = ids, scaled(vectors), threshold
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], lines))
        hashes = ((self.vectors / self.norms[:, None]) @ self.lines).T
        order = np.argsort(hashes, axis=1, kind="stable")
        self.first = len(ids) * np.arange(lines)
        self.sorted = (np.take_along_axis(hashes, order, axis=1) + APART * np.arange(lines)[:, None]).ravel()
        self.places = np.empty(hashes.shape, np.uint16 if len(ids) < 1 << 16 else np.uint32)
        np.put_along_axis(self.places, order, np.arange(len(ids), dtype=self.places.dtype)[None, :], axis=1)

    def collisions(self, at: np.ndarray, width: float) -> np.ndarray:
        """On how many lines each vector lies in the window of that width around the query's projection."""
        low, high = (np.searchsorted(self.sorted, x) - self.first for x in (at - width, at + width))
        kind = self.places.dtype
        inside = self.places - low.astype(kind)[:, None] < (high - low).astype(kind)[:, None]  # unsigned: below low wraps to large
        return np.add.reduce(inside, axis=0, dtype=np.int16)

    def nearest(self, query_id: int, query: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest verified vectors, by falling cosine and then rising id; at least ``least`` are verified."""
        n = len(self.ids)
        query = scaled(query)
        norm = np.sqrt((query * query).sum())
        at = (query / norm) @ self.lines + APART * np.arange(self.lines.shape[1])
        least = min(least, n)
        low, high = 0, ROUNDS
        found = np.arange(n)
        while low < high:
            middle = (low + high) // 2
            some = np.flatnonzero(self.collisions(at, FIRST_WIDTH * GROWTH**middle) >= self.threshold)
            if len(some) >= least:
                high, found = middle, some
            else:
                low = middle + 1
        found = found[self.ids[found] != query_id]
        if len(found) < min(k, n):
            found = np.flatnonzero(self.ids != query_id)
        score = (self.vectors[found] * query).sum(axis=1) / (self.norms[found] * norm)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][best], score[best]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the rows that take part: not null, with finite components only and not all zero."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    table = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).dropna()

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return table.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, is_query: Column, k: int = 5, verified: float = 0.15, at_least: int = 96, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k nearest, score being the cosine in double precision.

    ``is_query`` tells queries by the column vec_id. A query is not its own neighbour, nor is a row that repeats its id; of
    other repeated rows each counts; of several vectors of one query's id the least, component by component, is asked for; ties go to the smaller vec_id, and a query with fewer than k candidates gets them
    all. Rows with a null id or vector, or a vector that is zero or holds null or non-finite components, take no part; so
    do vectors of another length than the most frequent one (ties: the greatest). An empty table gives an empty result. In each block at least
    ``at_least`` vectors, or the share ``verified`` of them, are verified for each query.
    """
    table = materialize(usable(vectors, id_col, vector_col), "vectors")
    found = table.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    n, width = (found.n, found.width) if found else (0, 0)
    table = table.filter(F.size("v") == width)
    spark = vectors.sparkSession
    queries = table.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    batches = max(1, -(-queries.count() // QUERY_ROWS))
    dealt = table.repartition(max(1, -(-n // block_rows)))
    parts = []
    for b in range(batches):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(batches)) == b).collect()  # a batch: about QUERY_ROWS vectors
        batch = np.array([r.vec_id for r in rows], np.int64), np.array([r.v for r in rows], np.float64)
        shared = spark.sparkContext.broadcast(batch)
        parts.append(materialize(_past(dealt, shared, k, verified, at_least, block_rows), "nearest"))
        shared.destroy()
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _past(table: DataFrame, shared, k: int, verified: float, at_least: int, block_rows: int) -> DataFrame:
    def block(ids: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        index = Block(ids, vectors)
        least = max(at_least, int(verified * len(ids)))
        columns = [], [], []
        for query_id, query in zip(*shared.value):
            found, scores = index.nearest(query_id, query, k, least)
            for column, x in zip(columns, (np.full(len(found), query_id), found, scores)):
                column.append(x)
        names = ["query_id", "vec_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                ids.append(part.column(0).to_numpy())
                rows.append(part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
                held += part.num_rows
                if held >= 2 * block_rows:
                    if len(shared.value[0]):
                        yield block(np.concatenate(ids), np.concatenate(rows))
                    ids, rows, held = [], [], 0
        if held and len(shared.value[0]):
            yield block(np.concatenate(ids), np.concatenate(rows))

    return table.mapInArrow(run, "query_id long, vec_id long, score double")
