"""Pieces of text that byte-level BPE never joins: whole batches of texts are cut, and each distinct piece is encoded once.

Texts are cut before single spaces, and marks that follow a word are cut off it. Cutting and telling pieces apart are Arrow's
work and putting ids together is numpy's, so Python sees distinct pieces only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in the younger half of a cache; the older half has as many.
CACHED = 300_000
#: Bytes of the texts that are cut at once; a longer text is cut by itself.
TOGETHER = 4_000_000
#: Marks that stand for a match of their own, all together, after a word.
MARKS = ".,;:!?)#$*"

# White space as the tokenizers' patterns have it, and the code points that str.isspace() adds.
_WHITE = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: White space around a space: a cut there could change what is encoded.
_WHITE_RUN = rf"{_WHITE} (?:{_WHITE}|\z)"
# Letters, and not all kinds of them, so that every library takes the last one for a letter.
_WORD_END = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]\z"


def chunks(texts: pa.Array, size: int = TOGETHER) -> Iterator[pa.Array]:
    """Slices of the texts, of about ``size`` bytes, or one text where it is longer."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield texts.slice(first, last - first)
        first = last
        pa.default_memory_pool().release_unused()  # an executor's workers share its memory


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The pieces of each text between spaces, the places where each text's pieces start (and the end), and for each text
    what stands before its first space: all of it where it must not be cut."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    uncut = pc.match_substring_regex(texts, _WHITE_RUN)
    lists = pc.split_pattern(pc.if_else(uncut, "", texts), " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return flat, offsets, pc.if_else(uncut, texts, flat.take(pa.array(offsets[:-1])))


def words_and_marks(pieces: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each piece's word and the marks after it, or the whole piece and nothing where it is not a word with marks."""
    heads = pc.utf8_rtrim(pieces, MARKS)
    parted = pc.and_(pc.utf8_is_alpha(heads), pc.match_substring_regex(heads, _WORD_END))
    words = pc.if_else(parted, heads, pieces)
    sizes = pc.subtract(pc.binary_length(pieces), pc.binary_length(words)).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
    marks = data[spread(offsets[1:] - sizes, sizes, ends)]
    return words, pa.Array.from_buffers(pa.large_string(), len(pieces), [None, pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(marks)])


def spread(starts: np.ndarray, lengths: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places of stretches that start at ``starts``, one stretch after another; ``ends`` are the running sums of ``lengths``."""
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + int(lengths.max(initial=0))) < 1 << 31 else np.int64
    return np.repeat((starts - (ends - lengths)).astype(kind), lengths) + np.arange(total, dtype=kind)


def counts(texts: pa.Array, longest: int) -> tuple[pa.Array, pa.Array]:
    """The pieces of ``longest`` bytes at most that follow a space, words without their marks, and how often each occurs."""
    flat, offsets, _ = cut(texts)
    after = np.ones(len(flat), bool)
    after[offsets[:-1]] = False
    pieces, n = pc.value_counts(flat.filter(pa.array(after))).flatten()
    words, _ = words_and_marks(pieces)
    short = pc.less_equal(pc.binary_length(words), longest)
    coded = words.filter(short).dictionary_encode()
    totals = np.bincount(coded.indices.to_numpy(), weights=n.filter(short).to_numpy(), minlength=len(coded.dictionary))
    return _after_space(coded.dictionary), pa.array(totals.astype(np.int64))


class Cache:
    """What pieces are encoded as. ``encode`` takes distinct pieces that are missing, many at a time, and gives their ids as
    bytes. There is a younger and an older half, so a piece that comes back stays; ``fixed`` pieces always do."""

    def __init__(self, encode: Callable[[list[str]], Iterable[bytes]], fixed: dict[str, bytes] | None = None, at_most: int = CACHED):
        self.encode, self.fixed, self.at_most = encode, fixed or {}, at_most
        self.young, self.old = dict(self.fixed), {}

    def get(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        young, old = self.young, self.old
        found = list(map(young.get, pieces))
        missing = [i for i, x in enumerate(found) if x is None]
        held = [old.get(pieces[i]) for i in missing]
        absent = [i for i, x in zip(missing, held) if x is None]
        made = iter(self.encode([pieces[i] for i in absent]))
        for i, x in zip(missing, held):
            young[pieces[i]] = found[i] = next(made) if x is None else x
        if len(young) > self.at_most + len(self.fixed):
            self.old, self.young = young, dict(self.fixed)
        return found


def distinct_ids(pieces: pa.Array, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct pieces, each after a space, end to end, and how many each one has."""
    words, marks = (x.dictionary_encode() for x in words_and_marks(pieces))
    made = [*cache.get(_listed(_after_space(words.dictionary))), *cache.get(_listed(marks.dictionary))]
    sizes = np.fromiter(map(len, made), np.int64, len(made)) >> 2
    codes = np.stack([words.indices.to_numpy(), marks.indices.to_numpy() + len(words.dictionary)], axis=1)
    lengths = sizes[codes]
    ids = np.frombuffer(b"".join(made), "<u4")
    return ids[spread((np.cumsum(sizes) - sizes)[codes].ravel(), lengths.ravel(), np.cumsum(lengths))], lengths.sum(axis=1)


def encode(texts: pa.Array, cache: Cache, whole: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, and where each text's ids end; ``whole`` encodes what is not cut, without the cache."""
    flat, offsets, firsts = cut(texts)
    n = len(firsts)
    coded = flat.dictionary_encode()
    ids, sizes = distinct_ids(coded.dictionary, cache)
    own = whole(_listed(firsts))
    sizes = np.concatenate((sizes, np.fromiter(map(len, own), np.int64, n) >> 2))
    codes = coded.indices.to_numpy().astype(np.int64)
    # a text's first piece has no space before it: it, or a text that is not cut, goes by itself
    codes[offsets[:-1]] = len(coded.dictionary) + np.arange(n)
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    ids = np.concatenate((ids, np.frombuffer(b"".join(own), "<u4")))[spread((np.cumsum(sizes) - sizes)[codes], lengths, ends)]
    return ids, ends[offsets[1:] - 1] if n else ends


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def _after_space(pieces: pa.Array) -> pa.Array:
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    return pc.binary_join_element_wise(empty, pieces, space)
