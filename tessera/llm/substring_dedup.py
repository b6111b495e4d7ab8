"""Substring dedup: every window of words that also starts in an earlier document is removed, found by suffix automata.

The reference of a document is the whole corpus before it, so the automata are not sent to the documents: each is built in
the task that owns a shard of references, and the stretches of documents that can match a shard are dealt to it. The shard
of a window is its anchor, the least hash among its runs of five words; equal windows have equal anchors, wherever they
stand. Consecutive windows with one anchor travel as one stretch.

1. The stretches of each anchor are counted with partial sums. Anchors of more than one set a bit in a map of fixed size, and
   so do the very frequent ones in a second map. A bit that two anchors share only lets more stretches through, as does an
   anchor that only one document has several times.
2. Stretches whose anchor's bit is set leave their task, equal ones once for many documents with their smallest and largest
   doc_id. Stretches of very frequent anchors are cut into single windows, each its own shard, so that no shard holds more
   than a bounded number of stretches.
3. A task builds a suffix automaton over shards, carries each state's smallest doc_id up its suffix links, and streams the
   stretches through it: where the matching statistic reaches the window's length, the state tells the first document.
4. The windows found to start in a smaller doc_id go back to their documents, which lose the words that they cover. Documents
   that lose words set a bit in a map of fixed size; the others are written as they are read, and only texts whose bit is set
   travel, compressed, to meet their windows.

A stretch travels as its words, joined by one space, so words are compared as they are; only a word of more than 32 bytes goes
as a 128-bit hash. Stretches go back to documents by 64-bit hashes of their shard and their content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, materialize, split_words, utf8
from tessera.llm.pieces import chunks

GRAM = 5
#: Stretches of an anchor beyond which its windows go apart.
HOT = 8000
#: Bytes of text whose equal stretches leave a task once.
TOGETHER = 16_000_000
SHARD_WORDS = 1 << 16
#: Stretches held in a task at most, and handed on at once.
HELD, BLOCK = 3_000_000, 100_000
#: Bytes of a word beyond which its hash, one byte longer than this, stands for it.
LONG = 32
#: Bits of the maps of anchors and of documents, 32 MB each whatever the corpus, and of a slice of one.
BITS, SLICE = 28, 20

_MULTIPLIERS = [pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(GRAM)]
_STEP = 0xD6E8FEB86659FD93


class SuffixAutomaton:
    """A suffix automaton of many sequences; each state knows the smallest document among its occurrences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.least: list[int | None] = [None]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.least.append(None)
        return len(self.link) - 1

    def _clone(self, at: int, symbol: int, old: int) -> int:
        new = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while at >= 0 and self.next[at].get(symbol) == old:
            self.next[at][symbol] = new
            at = self.link[at]
        return new

    def _extend(self, last: int, symbol: int) -> int:
        to = self.next[last].get(symbol)
        if to is not None:
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, symbol, to)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and symbol not in self.next[last]:
            self.next[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            to = self.next[last][symbol]
            self.link[new] = to if self.length[to] == self.length[last] + 1 else self._clone(last, symbol, to)
        return new

    def add(self, symbols: list[int], doc: int) -> None:
        at = 0
        for symbol in symbols:
            at = self._extend(at, symbol)
            if self.least[at] is None or doc < self.least[at]:
                self.least[at] = doc

    def finish(self) -> None:
        """Carry the smallest documents from longer states to the suffixes that they end with."""
        least, link = self.least, self.link
        for state in np.argsort(self.length, kind="stable")[::-1].tolist():
            up = link[state]
            if up >= 0 and least[state] is not None and (least[up] is None or least[state] < least[up]):
                least[up] = least[state]

    def first_docs(self, symbols: list[int], size: int) -> list[int | None]:
        """For each window of ``size`` symbols, the smallest document that holds it, None where the matching statistic is shorter."""
        out, at, matched = [], 0, 0
        edges, link, length, least = self.next, self.link, self.length, self.least
        for place, symbol in enumerate(symbols):
            while at and symbol not in edges[at]:
                at = link[at]
                matched = length[at]
            if symbol in edges[at]:
                at = edges[at][symbol]
                matched += 1
            else:
                matched = 0
            while at and length[link[at]] >= size:
                at = link[at]
                matched = length[at]
            if place >= size - 1:
                out.append(least[at] if matched >= size else None)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(29)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _stretches(texts: pa.Array, size: int) -> tuple:
    """``(text, anchor, first window, first word, words, flat)``: the stretches of windows with one anchor, the last but one
    being their lengths in words and the last the words of all texts end to end."""
    flat, sizes = split_words(texts)
    coded = flat.dictionary_encode()
    listed = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, listed), np.uint64, len(listed))[coded.indices.to_numpy()]
    nothing = np.zeros(0, np.int64)
    if len(hashes) < size:
        return nothing, nothing, nothing, nothing, nothing, flat
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    grams = np.zeros(len(hashes) - GRAM + 1, np.uint64)
    for i, m in enumerate(_MULTIPLIERS):
        grams += hashes[i : len(hashes) - GRAM + 1 + i] * np.uint64(m)
    grams = _mixed(grams)
    windows = len(hashes) - size + 1
    least = np.lib.stride_tricks.sliding_window_view(grams, size - GRAM + 1).argmin(axis=1) + np.arange(windows)
    inside = owner[:windows] == owner[size - 1 :]
    changed = np.ones(windows, bool)
    changed[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(changed & inside)
    breaks = np.append(np.flatnonzero(changed | ~inside), windows)
    ends = breaks[np.searchsorted(breaks, starts, side="right")]
    return owner[starts], grams[least[starts]].view(np.int64), starts - begin[starts], starts, ends - starts + size - 1, flat


def _anchors(table: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch.column(0)):
                anchors, n = np.unique(_stretches(some, size)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(n.astype(np.int32))], names=["anchor", "n"])

    return table.select("text").mapInArrow(run, "anchor long, n int")


def _set(bits: np.ndarray, places: np.ndarray) -> None:
    np.bitwise_or.at(bits, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))


def _is_set(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7) & 1).astype(bool)


def _maps(rows: DataFrame) -> Broadcast:
    """The bit map of the keys in the first column, and one of the keys marked in each further column, compressed and broadcast;
    each task makes its own slices of them."""
    in_slice, n = (1 << SLICE) - 1, len(rows.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            slots = batch.column(0).to_numpy() & ((1 << BITS) - 1)
            marked = [np.ones(len(slots), bool), *(c.to_numpy(zero_copy_only=False).astype(bool) for c in batch.columns[1:])]
            for k in np.unique(slots >> SLICE).tolist():
                mine = slots >> SLICE == k
                bits = held.setdefault(k, np.zeros((n, 1 << SLICE - 3), np.uint8))
                for row, mark in zip(bits, marked):
                    _set(row, slots[mine & mark] & in_slice)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([b.tobytes() for b in held.values()], pa.binary())], names=["k", "bits"])

    slices = 1 << BITS - SLICE
    out = np.zeros((n, slices, 1 << SLICE - 3), np.uint8)
    dealt = rows.repartition(min(64, slices), F.shiftright(F.col(rows.columns[0]).bitwiseAND((1 << BITS) - 1), SLICE))
    found = dealt.mapInArrow(run, "k int, bits binary").toArrow()  # slices of fixed size, a fixed number of them
    for k, bits in zip(found.column("k").to_pylist(), found.column("bits").to_pylist()):
        out[:, k] = np.frombuffer(bits, np.uint8).reshape(n, -1)
    return rows.sparkSession.sparkContext.broadcast([zstandard.compress(row) for row in out.reshape(n, -1)])


def _opened(maps: Broadcast) -> list[np.ndarray]:
    return [np.frombuffer(zstandard.decompress(row), np.uint8) for row in maps.value]


def _spelled(flat: pa.Array, start: np.ndarray, words: np.ndarray) -> Iterator[list[bytes]]:
    """The stretches as bytes, words joined by one space and long ones told by their hashes, so many at once."""
    flat = flat.cast(pa.large_binary())
    long = pc.greater(pc.binary_length(flat), LONG)
    if pc.any(long).as_py():
        hashes = [b"\0" + xxhash.xxh3_128_hexdigest(w).encode() for w in flat.filter(long).to_pylist()]
        flat = pc.replace_with_mask(flat, long, pa.array(hashes, pa.large_binary()))
    spaced = pc.binary_join_element_wise(flat, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)
    data = spaced.buffers()[2].to_pybytes()
    for k in range(0, len(start), BLOCK):
        some, n = start[k : k + BLOCK], words[k : k + BLOCK]
        yield [data[a:b] for a, b in zip(offsets[some].tolist(), (offsets[some + n] - 1).tolist())]


def _content(spelled: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, spelled), np.uint64, len(spelled))


def _shared_stretches(texts: pa.Array, size: int, maps: list[np.ndarray]) -> Iterator[tuple]:
    """``(text, shard, content, first window, spelled)`` of the stretches that other documents may hold, windows of hot anchors
    apart, so many at once."""
    owner, anchor, first, start, words, flat = _stretches(texts, size)
    slots = anchor & ((1 << BITS) - 1)
    kept = np.flatnonzero(_is_set(maps[0], slots))
    if not len(kept):
        return
    owner, anchor, first, start, words, hot = (x[kept] for x in (owner, anchor, first, start, words, _is_set(maps[1], slots)))
    times = np.where(hot, words - size + 1, 1)
    shift = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    owner, anchor, first, start, words, hot = (np.repeat(x, times) for x in (owner, anchor, first, start, words, hot))
    first, start, words = first + shift, start + shift, np.where(hot, size, words)
    for k, spelled in enumerate(_spelled(flat, start, words)):
        these = slice(k * BLOCK, (k + 1) * BLOCK)
        content = _content(spelled)
        apart = _mixed(content * np.uint64(_STEP) + anchor[these].view(np.uint64)).view(np.int64)
        yield owner[these], np.where(hot[these], apart, anchor[these]), content.view(np.int64), first[these], spelled


def _in_chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        at = 0
        for some in chunks(batch.column(column)):
            yield batch.slice(at, len(some)), some
            at += len(some)


def _contents(table: DataFrame, size: int, maps: Broadcast) -> DataFrame:
    """``(shard, words, doc, last_doc)``: stretches that may be shared, equal ones of many documents once."""

    def out(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        shard, content, doc = (np.concatenate([h[i] for h in held]) for i in range(3))
        spelled = [w for h in held for w in h[3]]
        order = np.lexsort((doc, content, shard))
        shard, content, doc = shard[order], content[order], doc[order]
        new = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (content[1:] != content[:-1])))
        last = np.append(new[1:], len(shard)) - 1
        for k in range(0, len(new), BLOCK):
            these, lasts = new[k : k + BLOCK], last[k : k + BLOCK]
            words = pa.array([spelled[i] for i in order[these].tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(shard[these]), words, pa.array(doc[these]), pa.array(doc[lasts])], names=["shard", "words", "doc", "last_doc"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, stretches = [], 0, 0
        opened = _opened(maps)
        for batch, texts in _in_chunks(batches, 1):
            ids = batch.column(0).to_numpy()
            n += texts.nbytes
            for owner, shard, content, _, spelled in _shared_stretches(texts, size, opened):
                held.append((shard, content, ids[owner], spelled))
                stretches += len(spelled)
                if stretches >= HELD:
                    yield from out(held)
                    held, n, stretches = [], 0, 0
            if n >= TOGETHER and held:
                yield from out(held)
                held, n, stretches = [], 0, 0
        if held:
            yield from out(held)

    return table.select("doc_id", "text").mapInArrow(run, "shard long, words binary, doc long, last_doc long")


def _places(table: DataFrame, size: int, maps: Broadcast) -> DataFrame:
    """``(doc_id, version, at, shard, content)`` of the stretches that may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opened(maps)
        for batch, texts in _in_chunks(batches, 1):
            ids, versions = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for owner, shard, content, first, _ in _shared_stretches(texts, size, opened):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[owner], versions[owner], first.astype(np.int32), shard, content)], names=["doc_id", "version", "at", "shard", "content"])

    return table.select("doc_id", "text", "version").mapInArrow(run, "doc_id long, version long, at int, shard long, content long")


def _first_docs(pieces: DataFrame, size: int) -> DataFrame:
    """``(shard, content, firsts)`` for the pieces ``(shard, words, doc, last_doc)`` that some document must lose from."""

    def out(held: list[list]) -> Iterator[pa.RecordBatch]:
        automaton, symbol_of = SuffixAutomaton(), {}
        sequences = [[symbol_of.setdefault(w, len(symbol_of)) for w in words.split(b" ")] for _, words, _, _ in held]
        for symbols, (_, _, doc, _) in zip(sequences, held):
            automaton.add(symbols, doc)
        automaton.finish()
        rows = []
        for symbols, (shard, words, _, last) in zip(sequences, held):
            firsts = automaton.first_docs(symbols, size)
            if any(f is not None and f < last for f in firsts):
                rows.append((shard, words, firsts))
        if rows:
            shards, spelled, firsts = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(_content(spelled).view(np.int64)), pa.array(firsts, pa.list_(pa.int64()))], names=["shard", "content", "firsts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        n = 0
        for batch in batches:
            for shard, words, doc, last in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][0] == shard and held[-1][1] == words:
                    held[-1][2:] = min(doc, held[-1][2]), max(last, held[-1][3])
                    continue
                if n >= SHARD_WORDS and shard != held[-1][0]:
                    yield from out(held)
                    held, n = [], 0
                held.append([shard, words, doc, last])
                n += words.count(b" ") + 1
        if held:
            yield from out(held)

    # equal stretches come one after another, so a window of very many documents is merged as it comes
    dealt = pieces.repartition("shard").sortWithinPartitions("shard", "words")
    return dealt.select("shard", "words", "doc", "last_doc").mapInArrow(run, "shard long, content long, firsts array<long>")


def repeated_windows(table: DataFrame, size: int = 13, hot: int = HOT) -> DataFrame:
    """``(doc_id, version, starts)``: the windows, by the place of their first word, that also start in a smaller doc_id.

    ``table`` has doc_id, text and version (a hash of the text, which tells rows that repeat an id apart).
    """
    table = table.filter("doc_id is not null")
    counted = _anchors(table, size).groupBy("anchor").agg(F.sum("n").alias("n"))
    maps = _maps(counted.filter("n > 1").select("anchor", (F.col("n") > hot).alias("hot")))
    firsts = _first_docs(_contents(table, size, maps), size)
    joined = _places(table, size, maps).join(firsts, ["shard", "content"])
    starts = F.filter(F.transform("firsts", lambda first, t: F.when(first < F.col("doc_id"), F.col("at") + t)), lambda x: x.isNotNull())
    found = joined.select("doc_id", "version", starts.alias("starts")).filter(F.size("starts") > 0)
    return found.groupBy("doc_id", "version").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts")))).alias("starts"))


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words the windows cover."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return np.cumsum(edges[:n]) > 0


def dedup(docs: DataFrame, size: int = 13, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row; kept is what is left, its words joined by one space, as UTF-8.

    A null or empty text has no words. A row with a null doc_id neither loses words nor takes them from others. Rows that
    repeat an id are not smaller than each other. Texts are judged whole and as given. Ties cannot arise, since only a
    smaller doc_id counts. An empty table gives an empty result, and other columns are not read. ``bits`` of the map of
    documents that lose words: a bit that documents share only lets more texts travel.
    """
    table = id_and_text(docs, id_col, text_col).withColumn("version", F.xxhash64("text"))
    found = materialize(repeated_windows(table, size, hot), "windows")
    slot = F.xxhash64("doc_id", "version").bitwiseAND((1 << min(bits, BITS)) - 1).alias("slot")
    marks = _maps(found.select(slot))

    def left(ids: pa.Array, texts: list[bytes], starts: list) -> pa.RecordBatch:
        counts, removed, kept = [], [], []
        for text, places in zip(texts, starts):
            words = text.split()
            stay = [w for w, gone in zip(words, covered(len(words), np.array(places), size).tolist()) if not gone] if places else words
            counts.append(len(words))
            removed.append(len(words) - len(stay))
            kept.append(b" ".join(stay))
        return pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (marked,) = _opened(marks)
        for batch in batches:
            some = batch.filter(pa.array(~_is_set(marked, batch.column(3).to_numpy())))
            yield left(some.column(0), utf8(some.column(1)), [None] * len(some))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor().compress
        (marked,) = _opened(marks)
        for batch in batches:
            some = batch.filter(pa.array(_is_set(marked, batch.column(3).to_numpy())))
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(map(pack, utf8(some.column(1))), pa.binary())], names=["doc_id", "version", "packed"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            yield left(batch.column(0), [unpack(x) for x in batch.column(1).to_pylist()], batch.column(2).to_pylist())

    told = table.select("doc_id", "text", "version", slot)
    schema = "doc_id long, n_words long, n_removed long, kept binary"
    sent = told.mapInArrow(packed, "doc_id long, version long, packed binary")
    met = sent.join(found.hint("merge"), ["doc_id", "version"], "left").select("doc_id", "packed", "starts")
    return told.mapInArrow(whole, schema).unionByName(met.mapInArrow(unpacked, schema))


def digests(docs: DataFrame, size: int = 13) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` for every row: ``dedup`` with the digest of what is kept, and its rules for
    nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""
    return dedup(docs, size).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
