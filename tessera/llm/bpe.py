"""Byte-level BPE with Spark's higher-order functions for the corpus's frequent words.

Texts are cut into pieces that byte-level BPE never joins (see ``pieces``). The pieces of the corpus are counted, and each
distinct one of the most frequent (a documented number) is encoded once by higher-order functions: they fold over its
bytes, each step looking up the ranks of neighbouring pieces in a literal rank map and merging the leftmost pair of the
least rank. That bounded table goes to every task. A piece that is not in it is merged in the task, by the same rule over the
same ranks, many words at a time, since the fold takes some hundred times as long for a word and rare words are most of
the distinct ones. Decoding looks ids up in the list of pieces and concatenates them.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import pieces as cutting
from tessera.llm.common import id_and_text, materialize
from tessera.llm.pieces import Cache, chunks, spread

#: How many frequent units are encoded once and looked up from then on.
FREQUENT = 60_000
#: Longer words are not worth a place in that table, and are merged one by one.
LONGEST = 64
#: Bytes of the texts that are cut and decoded at once.
TOGETHER = 2_000_000
#: Other pieces that a worker keeps, in each half of its cache.
CACHED = 150_000
NO_RANK = (1 << 31) - 1
#: Bytes of an id's decimal text, with the space before it.
NAME = 8


def _bucketed(entries: dict[str, object], buckets: int) -> list[dict[str, object]]:
    out: list[dict[str, object]] = [{} for _ in range(buckets)]
    for key, value in entries.items():
        out[zlib.crc32(key.encode()) % buckets][key] = value
    return out


class Table:
    """A literal map from strings, as an array of small maps: Spark searches a map from end to end, so a large one is cut by crc32."""

    def __init__(self, entries: dict[str, object], value_type: str):
        self.buckets = 1 << max(4, (len(entries) or 1).bit_length())
        text = json.dumps(_bucketed(entries, self.buckets), ensure_ascii=False, separators=(",", ":"))
        self.column = F.from_json(F.lit(text), f"array<map<string,{value_type}>>")

    def get(self, key: Column, held: Column) -> Column:
        """The value of ``key``, null if there is none; ``held`` stands for the table's column, which a plan then writes out once."""
        slot = F.pmod(F.crc32(key), F.lit(self.buckets)).cast("int")
        return F.try_element_at(F.get(held, slot), key)


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a base64 piece and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _let(value: Column, body) -> Column:
    """``body(value)`` with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Codec:
    """Encoding and decoding expressions over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = f"(?U){pattern}"
        self.ranks = Table({piece.hex().upper(): rank for piece, rank in ranks.items()}, "int")

    def _merged(self, h: Column, held: Column) -> Column:
        def rank(left: Column, right: Column) -> Column:
            return F.coalesce(self.ranks.get(F.concat(left, right), held), F.lit(NO_RANK))

        size = (F.length(h) / 2).cast("int")
        pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(h, i * 2 - 1, F.lit(2)))
        start = _let(pieces, lambda p: F.struct(p.alias("p"), F.transform(F.slice(p, 1, F.size(p) - 1), lambda x, i: rank(x, F.get(p, i + 1))).alias("r")))

        def merge(s: Column) -> Column:
            p, r = s["p"], s["r"]

            def at(k: Column) -> Column:
                joined = F.concat(F.get(p, k - 1), F.get(p, k))
                left = F.when(k > 1, F.array(rank(F.get(p, k - 2), joined))).otherwise(F.array().cast("array<int>"))
                right = F.when(k + 1 < F.size(p), F.array(rank(joined, F.get(p, k + 1)))).otherwise(F.array().cast("array<int>"))
                return F.struct(
                    F.concat(F.slice(p, F.lit(1), k - 1), F.array(joined), F.slice(p, k + 2, F.size(p))).alias("p"),
                    F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(p))).alias("r"),
                )

            return _let(F.array_position(r, F.array_min(r)).cast("int"), at)

        def step(s: Column, _: Column) -> Column:
            return F.when(F.coalesce(F.array_min(s["r"]), F.lit(NO_RANK)) < NO_RANK, merge(s)).otherwise(s)

        steps = F.when(size > 1, F.sequence(F.lit(1), size - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda s: F.transform(s["p"], lambda x: self.ranks.get(x, held)))

    def unit(self, unit: Column) -> Column:
        """The ids of a stretch of text, match by match: a match that is a piece itself, or its merged bytes."""

        def word(w: Column, held: Column) -> Column:
            def whole(h: Column) -> Column:
                return _let(self.ranks.get(h, held), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(self._merged(h, held)))

            return _let(F.hex(w.cast("binary")), whole)

        matches = F.regexp_extract_all(unit, F.lit(self.pattern), F.lit(0))
        return _let(self.ranks.column, lambda held: F.flatten(F.transform(matches, lambda w: word(w, held))))


class Pairs:
    """The rank of each pair of pieces that make a piece, by the ids of the two, looked up many at a time."""

    BITS = 20

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for piece, rank in ranks.items():
            for i in range(1, len(piece)):
                left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
                if left is not None and right is not None:
                    found[left << 32 | right] = rank
        self.one = found.get
        self.keys = np.fromiter(sorted(found), np.int64, len(found))
        self.values = np.fromiter(map(found.__getitem__, self.keys.tolist()), np.int32, len(found))
        slots = self._slot(self.keys)
        self.first = np.full(1 << self.BITS, -1, np.int32)
        self.first[slots[::-1]] = np.arange(len(slots) - 1, -1, -1)
        self.crowded = np.bincount(slots, minlength=1 << self.BITS) > 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, NO_RANK, np.int32)
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        at = self.first[slots]
        hit = (at >= 0) & (self.keys[at] == keys)
        out = np.where(hit, self.values[at], np.int32(NO_RANK))
        rest = np.flatnonzero(self.crowded[slots] & ~hit)
        if len(rest):
            at = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            out[rest] = np.where(self.keys[at] == keys[rest], self.values[at], NO_RANK)
        return out


class Merger:
    """Texts and their ids inside a task: the given table first, then merges over the ranks, kept in a bounded cache.

    It is sent to tasks without its cache, and the tasks that a Python worker runs one after another share one.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, table: dict[str, bytes]):
        self.ranks, self.pattern, self.table = ranks, pattern, table
        self.cache = Cache(self._missing, table, CACHED)
        self._match = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)] if ranks else [0] * 256, np.int32)

    def __reduce__(self):
        return Merger, (self.ranks, self.pattern, self.table)

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.ranks)

    @cached_property
    def _listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The decimal texts of ids, padded; then the pieces of all ids end to end and where each ends."""
        n = max(self.ranks.values(), default=-1) + 1
        by_id = [b""] * n
        for piece, rank in self.ranks.items():
            by_id[rank] = piece
        names = np.frombuffer(b"".join((b" %d" % i).ljust(NAME, b"\0") for i in range(n)), f"V{NAME}")
        return names, np.frombuffer(b"".join(by_id), np.uint8), np.cumsum(np.fromiter(map(len, by_id), np.int64, n))

    def _long(self, word: bytes) -> np.ndarray:
        """The ids of one match of any length: a heap of the pairs that may be merged, by rank and place."""
        one = self.pairs.one
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := one(a << 32 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < len(ids):
                before[k] = i
                if (r := one(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := one(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], "<u4")

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of like lengths, all merged at once: in each round every word that has a pair with a rank merges the
        leftmost of least rank, so the words that are left have all lost one part a round."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        parts = np.full((len(words), width), -1, np.int32)
        parts[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), width - 1), NO_RANK, np.int32)
        both = inside[:, 1:]
        ranks[both] = self.pairs.ranks(parts[:, :-1][both], parts[:, 1:][both])
        out: list[bytes] = [b""] * len(words)
        left = np.arange(len(words))

        def done(rows: np.ndarray, width: int) -> None:
            flat = parts[rows, :width].astype("<u4")
            for i, row, n in zip(left[rows].tolist(), flat, (sizes[rows]).tolist()):
                out[i] = row[:n].tobytes()

        while width > 1:
            k = ranks.argmin(axis=1)
            rows = np.arange(len(k))
            least = ranks[rows, k]
            go = least < NO_RANK
            if not go.all():
                done(np.flatnonzero(~go), width)
                if not go.any():
                    return out
                parts, ranks, left, sizes, k, least = parts[go], ranks[go], left[go], sizes[go], k[go], least[go]
                rows = np.arange(len(k))
            shift = np.arange(width - 1) > k[:, None]
            parts = np.where(shift, parts[:, 1:], parts[:, :-1])
            parts[rows, k] = least
            width -= 1
            sizes = sizes - 1
            if width == 1:
                break
            ranks = np.where(shift[:, 1:] | (np.arange(width - 1) == k[:, None]), ranks[:, 1:], ranks[:, :-1])
            right = np.flatnonzero(k < sizes - 1)
            ranks[right, k[right]] = self.pairs.ranks(least[right], parts[right, k[right] + 1])
            ends = np.flatnonzero((k >= sizes - 1) & (k < width - 1))
            ranks[ends, k[ends]] = NO_RANK
            before = np.flatnonzero(k > 0)
            ranks[before, k[before] - 1] = self.pairs.ranks(parts[before, k[before] - 1], least[before])
        done(np.arange(len(left)), width)
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct matches: a match that is a piece itself, or its bytes merged."""
        out: list[bytes] = [b""] * len(words)
        to_merge = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(word) > LONGEST:
                out[i] = self._long(word).tobytes()
            else:
                to_merge.append(i)
        to_merge.sort(key=lambda i: len(words[i]))
        at = 0
        while at < len(to_merge):
            end, most = at, len(words[to_merge[at]])
            while end < len(to_merge) and len(words[to_merge[end]]) <= most + most // 4 and end - at < 1 << 15:
                end += 1
            some, at = to_merge[at:end], end
            for i, ids in zip(some, self._merged([words[i] for i in some])):
                out[i] = ids
        return out

    def _missing(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces, match by match."""
        cut = [[p] if p[:1] == " " and p[1:].isalpha() else self._match.findall(p) for p in pieces]
        words = list({w: None for matches in cut for w in matches})
        ids = dict(zip(words, self._words([w.encode("utf-8", "replace") for w in words])))
        return [b"".join(map(ids.__getitem__, matches)) for matches in cut]

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end."""
        return cutting.encode(texts, self.cache, self._missing)

    def names(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self._listed[0][ids].tobytes().translate(None, b"\0")[1:]

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes that known ids stand for, their pieces concatenated, and where the bytes end of the texts whose ids end at ``ends``."""
        _, flat, stops = self._listed
        lengths = np.diff(stops, prepend=0)[ids]
        upto = np.cumsum(lengths)
        return memoryview(flat[spread(stops[ids] - lengths, lengths, upto)]), np.concatenate(([0], upto))[ends]


def frequent_units(texts: DataFrame, codec: Codec, at_most: int = FREQUENT) -> dict[str, bytes]:
    """The ids, as little-endian unsigned 32-bit integers, of the corpus's most frequent units, counted over whole texts.

    The least count is the lowest of a geometric scale (at most 256 steps) that no more than ``at_most`` units reach, so
    no more than that many come to the driver. Each of these distinct units is encoded once, by the fold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch.column(0), TOGETHER):
                listed, n = cutting.counts(some, LONGEST)
                yield pa.RecordBatch.from_arrays([listed.cast(pa.string()), n], names=["unit", "n"])

    counted = texts.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counted = materialize(counted.filter("n > 1").withColumn("step", F.floor(4 * F.log2("n")).cast("int")), "units")
    least, total = NO_RANK, 0
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):
        total += n
        if total > at_most:
            break
        least = step
    top = counted.filter(F.col("step") >= least).select("unit", codec.unit(F.col("unit")).alias("ids"))
    return {r.unit: np.array(r.ids, "<u4").tobytes() for r in top.collect()}


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text_col: str = "text", ids_col: str = "ids", at_most: int = FREQUENT) -> DataFrame:
    """``docs`` with the ids of each whole text in ``ids_col``.

    A null text counts as empty and has no ids; repeated rows are encoded alike; an empty table gives an empty result.
    A column that is already called ``ids_col`` is replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    merger = _shared(docs.select(text.alias("text")), ranks, pattern, at_most)
    kept = [c for c in docs.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in chunks(batch.column(0), TOGETHER):
                ids, ends = merger.value.all(some)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in batch.columns[1:]), lists], names=[*kept, ids_col])
                at += len(some)

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(text, *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def _shared(texts: DataFrame, ranks: dict[bytes, int], pattern: str, at_most: int):
    """What every task holds: a vocabulary and at most ``at_most`` units with their ids."""
    table = frequent_units(texts, Codec(ranks, pattern), at_most)
    return texts.sparkSession.sparkContext.broadcast(Merger(ranks, pattern, table))


def joined_pieces(ids: list[int], pieces: dict[int, bytes]) -> bytes | None:
    """The bytes that ids stand for, null if one stands for no piece."""
    found = list(map(pieces.get, ids))
    return None if None in found else b"".join(found)


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that ids stand for, their pieces concatenated; null ids, or an id of no piece, give null."""
    pieces = encoded.sparkSession.sparkContext.broadcast({rank: piece for piece, rank in ranks.items()})

    def run(ids: pa.Array) -> pa.Array:
        return pa.array([joined_pieces(row.values.to_numpy(zero_copy_only=False).tolist(), pieces.value) if row.is_valid else None for row in ids], pa.binary())

    return encoded.withColumn(bytes_col, F.arrow_udf(run, "binary")(F.col(f"`{ids_col}`")))


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str, at_most: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row: digests of what ``encode`` gives and of what decoding its
    ids gives, taken in one pass so that no ids travel between the two.

    A null text counts as empty; a null doc_id is carried; repeated rows have equal digests; texts of any length are
    encoded whole, ones without a space too; an empty table gives an empty result. Other columns are not read.
    """
    table = id_and_text(docs)
    merger = _shared(table, ranks, pattern, at_most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            at = 0
            for some in chunks(batch.column(1), TOGETHER):
                ids, ends = merger.value.all(some)
                data, stops = merger.value.decoded(ids, ends)
                starts, begins = [0, *ends[:-1].tolist()], [0, *stops[:-1].tolist()]
                listed = [digest(merger.value.names(ids[a:b])) for a, b in zip(starts, ends.tolist())]
                decoded = [digest(data[a:b]) for a, b in zip(begins, stops.tolist())]
                columns = [batch.column(0).slice(at, len(some)), pa.array(np.diff(ends, prepend=0)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(some)

    return table.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
