"""SimHash near-duplicate groups with a hierarchical index over fingerprints in Gray order.

Fingerprints come from a pass over whole texts. Equal fingerprints collapse to one node, represented by its smallest
doc_id. Two 64-bit fingerprints that differ in at most ``max_bits`` bits agree in at least one of ``max_bits + 1``
segments, so every node is dealt to one bucket per segment. Within a bucket the fingerprints are sorted by Gray rank,
bits that a run of neighbours shares are kept once in an upper node, and a search drops a whole run as soon as the
differences gathered on the way down exceed the bound. A bucket gives a star per group that it finds, never all pairs,
and the stars are joined to components by rounds of distributed star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import columns_of, id_and_text, materialize, small_side, utf8

SEED = 42
FANOUT = 16
QUERY_BLOCK = 1024


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a UTF-8 text; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())]
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    ones = np.unpackbits(packed, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray sequence."""
    rank = values.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """A tree over fingerprints in Gray order; each node holds the bits all its leaves share and its parent has not."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.leaves = fps[self.order]
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        pattern, mask = self.leaves, np.full(len(fps), full)
        levels = [(pattern, mask)]
        while len(pattern) > 1:
            cuts = np.arange(0, len(pattern), FANOUT)
            shared_or = np.bitwise_or.reduceat(pattern, cuts)
            shared_and = np.bitwise_and.reduceat(pattern, cuts)
            mask = np.bitwise_and.reduceat(mask, cuts) & ~(shared_or ^ shared_and)
            pattern = shared_and
            levels.append((pattern, mask))
        self.levels = []
        for depth, (pattern, mask) in enumerate(levels):
            if depth + 1 < len(levels):
                mask = mask & ~np.repeat(levels[depth + 1][1], FANOUT)[: len(mask)]
            self.levels.append((pattern, mask))

    def search(self, first: int, last: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs ``(i, j)`` of sorted places with first <= i < last, i < j, that differ in at most max_bits bits."""
        query = np.arange(first, last)
        node = np.zeros(len(query), np.int64)
        gathered = np.zeros(len(query), np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[depth]
            gathered = gathered + np.bitwise_count((self.leaves[query] ^ pattern[node]) & mask[node])
            keep = gathered <= max_bits
            keep &= (node + 1) * FANOUT**depth > query + 1
            query, node, gathered = query[keep], node[keep], gathered[keep]
            if depth:
                below = len(self.levels[depth - 1][0])
                query, gathered = np.repeat(query, FANOUT), np.repeat(gathered, FANOUT)
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                inside = node < below
                query, node, gathered = query[inside], node[inside], gathered[inside]
        return query, node


def hook(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Join the groups in ``label`` (each element's smallest member) along the pairs."""
    while len(left):
        a, b = label[left], label[right]
        apart = a != b
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        if not len(left):
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, up := label[label]):
            label = up
    return label


def bucket_stars(fps: np.ndarray, reps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (representative, smaller representative), one for each node of a bucket that is linked in it to a smaller one."""
    index = GrayIndex(fps)
    reps = reps[index.order]
    label = np.arange(len(fps))
    block = max(64, QUERY_BLOCK * 8192 // max(8192, len(fps)))  # what a search holds grows with the bucket
    for first in range(0, len(fps), block):
        label = hook(label, *index.search(first, min(first + block, len(fps)), max_bits))
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, label, reps)
    to = least[label]
    linked = reps != to
    return reps[linked], to[linked]


def links(nodes: DataFrame, max_bits: int = 4, max_bucket: int = 32768) -> DataFrame:
    """Edges ``(u, v)``, u > v, that connect exactly the nodes ``(fp, rep)`` within max_bits of each other.

    A bucket of more than ``max_bucket`` fingerprints is cut into chunks by hash and every two chunks meet in a task of
    their own, so no task holds more than two chunks and no link is lost. The table of large buckets is broadcast; it
    has at most one row for each value of a segment.
    """
    segments = max_bits + 1
    width = [64 // segments + (i < 64 % segments) for i in range(segments)]
    starts = [sum(width[:i]) for i in range(segments)]
    keys = F.array(*[F.shiftrightunsigned("fp", s).bitwiseAND((1 << w) - 1) * segments + i for i, (s, w) in enumerate(zip(starts, width))])
    dealt = nodes.select("fp", "rep", F.explode(keys).alias("bucket"))
    large = dealt.groupBy("bucket").count().filter(F.col("count") > max_bucket)
    large = large.select("bucket", F.ceil(F.col("count") / max_bucket).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = dealt.join(F.broadcast(large), "bucket", "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", other)
    met = met.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp", "rep")

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            fps, reps = (np.concatenate(x) for x in zip(*parts))
            u, v = bucket_stars(fps.view(np.uint64), reps, max_bits) if len(fps) > 1 else (reps[:0], reps[:0])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        held: list[tuple[np.ndarray, ...]] = []
        at = None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
            fps, reps = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if at is not None and tuple(key[a]) != at:
                    yield from out(held)
                    held = []
                at = tuple(key[a])
                held.append((fps[a:b], reps[a:b]))
        if held:
            yield from out(held)

    dealt_out = met.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return dealt_out.mapInArrow(stars, "u long, v long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges (u, v)``: root is the smallest node that can be reached.

    Alternates large-star and small-star rounds until the edges no longer change; each round's edges are written to the
    shared folder. Minima are taken by partial aggregation and joined back, so a star with many leaves is never held as one group.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialize(edges.filter("u <> v").distinct(), "edges")
    before = mark(edges)
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(smallest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = smallest(down)
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter("u <> v").distinct(), "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, max_bucket: int = 32768, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    Nulls: a null text is an empty one (fingerprint zero); a row with a null doc_id keeps a null doc_id and takes the
    component of its fingerprint, null if no row with an id has that fingerprint. Repeated rows are kept. Ties and
    copies share a component, named by its smallest doc_id. Texts are read whole; an empty table gives an empty result.
    Only the id and text columns are read, so other columns may have any names.
    """
    made = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = materialize(made.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes, max_bits, max_bucket))
    named = nodes.join(roots, nodes["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = made.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component: those whose id is its smallest; rows with a null id stay.

    Of rows that repeat one id, all stay if that id stays. Null and empty texts are copies of each other; texts are read whole;
    an empty table gives an empty result; the columns keep their names and places.
    """
    marked = near_duplicates(docs, shingle, max_bits, id_col=id_col, text_col=text_col)
    gone = materialize(marked.filter("doc_id > component_id").select("doc_id").distinct(), "copies")
    return docs.join(small_side(gone), docs[f"`{id_col}`"].cast("long") == gone["doc_id"], "left_anti").select(columns_of(docs))
