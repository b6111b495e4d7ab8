"""BPE encoding by a lexicon of frequent words, and decoding.

The words of the corpus (pieces between spaces, without the marks after them) are counted over whole texts. The most
frequent, a documented number, are encoded once and compiled with their ids into a minimal acyclic transducer. Its file
goes to every machine as one of the job's files and is mapped into memory there. A task cuts its texts into
pieces, looks all distinct ones up in the automaton together, and merges those that are not in it exactly: pairs in the order
in which the tokenizer's file lists them. Pieces other than plain words and ASCII go to the tokenizer itself, whose tables of
letters and special tokens decide how they part. Decoding looks up the bytes of every id and joins them.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import pieces as cutting
from tessera.llm.bpe import NO_RANK, Merger
from tessera.llm.common import id_and_text, materialize, shared_dir, storage
from tessera.llm.pieces import chunks
from tessera.llm.token_files import Encoder
from tessera.llm.transducer import Builder, Transducer

#: Words of the lexicon at most, and bytes of the longest one.
FREQUENT, LONGEST = 100_000, 64
#: Bytes of the texts that are cut and decoded at once.
TOGETHER = 2_000_000

# How byte-level BPE parts ASCII text, and the letters that every library takes for letters.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+")
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: ASCII white space by str.isspace() that is not so in every library.
_DOUBTFUL = re.compile("[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level BPE: printable ones for themselves, the others in order from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


class Pairs:
    """Pairs of numbers that merge, with the number that they make; numbers rise in the order of the merges."""

    def __init__(self, found: dict[int, int]):
        self.one = found.get
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int32)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(left.shape, NO_RANK, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.int32(NO_RANK))


class LexiconEncoder(Merger):
    """Texts to ids and back inside a task. Merges run on numbers, a byte's own or 256 and a merge's place, and each number has an id."""

    def __init__(self, definition: str, lexicon: str | None = None):
        model = json.loads(definition)
        before = model["pre_tokenizer"]
        if model["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level tokenizer")
        letters = byte_letters()
        spelt = {x: bytes(map(letters.__getitem__, x)) for x in model["model"]["vocab"]}
        ids = {spelt[x]: i for x, i in model["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        number = {bytes([b]): b for b in range(256)}
        self.found: dict[int, int] = {}
        self.by_number = np.array([ids[bytes([b])] for b in range(256)] + [0] * len(model["model"]["merges"]), "<u4")
        for i, (a, b) in enumerate(model["model"]["merges"], 256):
            a, b = spelt[a], spelt[b]
            if number.setdefault(a + b, i) != i:
                raise ValueError("two merges make the same token")
            self.found[number[a] << 32 | number[b]] = i
            self.by_number[i] = ids[a + b]
        # the parent's ranks are ids here: they are what is named and decoded
        super().__init__(ids | {k.encode(): v for k, v in special.items()}, "", {})
        self.definition, self.file = definition, lexicon
        self.single = np.arange(256, dtype=np.int32)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")

    def __reduce__(self):
        return LexiconEncoder, (self.definition, self.file)

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.found)

    @cached_property
    def lexicon(self) -> Transducer:
        return Transducer.mapped(SparkFiles.get(self.file))

    @cached_property
    def library(self) -> Encoder:
        return Encoder(self.definition)

    def _words(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct matches, each one's bytes merged."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            most = len(words[order[at]])
            if most > LONGEST:
                for i in order[at:]:
                    out[i] = self.by_number[self._long(words[i])].tobytes()
                break
            end = at
            while end < len(order) and len(words[order[end]]) <= min(LONGEST, most + most // 4) and end - at < 1 << 15:
                end += 1
            some, at = order[at:end], end
            for i, numbers in zip(some, self._merged([words[i] for i in some])):
                out[i] = self.by_number[np.frombuffer(numbers, "<u4")].tobytes()
        return out

    def _parts(self, piece: str) -> list[str] | None:
        """The matches of a piece, None where only the tokenizer itself can tell."""
        if _PLAIN.fullmatch(piece):
            return [piece]
        if piece.isascii() and not self.special.search(piece) and not _DOUBTFUL.search(piece):
            return _ASCII.findall(piece)
        return None

    def _missing(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces that are merged here, or by the tokenizer."""
        parts = [self._parts(p) for p in pieces]
        words = list({w: None for found in parts if found for w in found})
        ids = dict(zip(words, self._words([w.encode() for w in words])))
        odd = [i for i, found in enumerate(parts) if found is None]
        out = [b"".join(map(ids.__getitem__, found)) if found else b"" for found in parts]
        for i, made in zip(odd, self.library.distinct([pieces[i] for i in odd])):
            out[i] = made
        return out

    def get(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces: the automaton's, and merged ones where it has none."""
        found = self.lexicon.get(pa.array(pieces, pa.large_string()))
        rest = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(rest, self.cache.get([pieces[i] for i in rest])):
            found[i] = ids
        return found

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end."""
        return cutting.encode(texts, self, self._missing)


def frequent_words(texts: DataFrame, encoder, at_most: int = FREQUENT) -> list[tuple[str, bytes]]:
    """The corpus's most frequent words, each after a space, with their ids.

    They are counted over whole texts, with sums in each batch before the shuffle. The least count is the lowest of a geometric scale
    that no more than ``at_most`` words reach, so no more than that many are encoded, by Spark's tasks, and come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in chunks(batch.column(0), TOGETHER):
                listed, n = cutting.counts(some, LONGEST)
                yield pa.RecordBatch.from_arrays([listed.cast(pa.string()), n], names=["word", "n"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array(encoder.value._missing(words.to_pylist()), pa.binary())], names=["word", "ids"])

    counted = texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted.filter("n > 1").withColumn("step", F.floor(4 * F.log2("n")).cast("int")), "words")
    least, total = NO_RANK, 0
    for step, n in sorted(counted.groupBy("step").count().collect(), reverse=True):  # at most 256 steps
        total += n
        if total > at_most:
            break
        least = step
    top = counted.filter(F.col("step") >= least).select("word").mapInArrow(encode, "word string, ids binary")
    return [(r.word, bytes(r.ids)) for r in top.collect()]


def compiled(words: list[tuple[str, bytes]]) -> bytes:
    """The transducer's file for distinct words with their ids."""
    builder = Builder()
    for word, ids in sorted((w.encode(), ids) for w, ids in words):
        builder.add(word, tuple(np.frombuffer(ids, "<u4").tolist()))
    return builder.to_bytes()


def _shared(texts: DataFrame, tokenizer_path: str, at_most: int):
    """The encoder that every task holds; its lexicon lies in the shared folder and is one of the job's files."""
    context = texts.sparkSession.sparkContext
    with open(tokenizer_path, encoding="utf-8") as file:  # a vocabulary file: a few MB, whatever the corpus
        definition = file.read()
    data = compiled(frequent_words(texts, context.broadcast(LexiconEncoder(definition)), at_most))
    name = f"lexicon-{uuid.uuid4().hex}"
    uri = f"{shared_dir(texts.sparkSession)}/{name}"
    fs, path = storage(uri)
    with fs.open_output_stream(path) as out:
        out.write(data)
    context.addFile(uri)
    return context.broadcast(LexiconEncoder(definition, name))


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", at_most: int = FREQUENT) -> DataFrame:
    """``docs`` with the ids of each whole text in ``ids_col``.

    A null text counts as empty and has no ids; repeated rows are encoded alike; texts of any length are encoded whole, ones
    without a space too; an empty table gives an empty result. A column that is already called ``ids_col`` is replaced.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    encoder = _shared(docs.select(text.alias("text")), tokenizer_path, at_most)
    kept = [c for c in docs.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in chunks(batch.column(0), TOGETHER):
                ids, ends = encoder.value.all(some)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in batch.columns[1:]), lists], names=[*kept, ids_col])
                at += len(some)

    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(text, *[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with the text that ids stand for, special ones written out; bytes that are no UTF-8 become U+FFFD.

    Null ids, or an id of no token, give null; no ids give the empty text; repeated rows decode alike; an empty table gives
    an empty result. A column that is already called ``text_col`` is replaced.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        encoder = encoded.sparkSession.sparkContext.broadcast(LexiconEncoder(file.read()))

    def text(row: pa.ListScalar) -> str | None:
        ids = row.values.to_numpy(zero_copy_only=False) if row.is_valid else None
        if ids is None or row.values.null_count or (len(ids) and not 0 <= ids.min() <= ids.max() < len(encoder.value._listed[2])):
            return None
        return bytes(encoder.value.decoded(ids, np.array([len(ids)]))[0]).decode("utf-8", "replace")

    return encoded.withColumn(text_col, F.arrow_udf(lambda ids: pa.array(map(text, ids), pa.string()), "string")(F.col(f"`{ids_col}`")))


def digests(docs: DataFrame, tokenizer_path: str, at_most: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for every row: digests of what ``encode`` gives and of the text that decoding
    its ids gives, taken in one pass so that no ids travel between the two.

    A null text counts as empty; a null doc_id is carried; repeated rows have equal digests; texts of any length are
    encoded whole, ones without a space too; an empty table gives an empty result. Other columns are not read.
    """
    table = id_and_text(docs)
    encoder = _shared(table, tokenizer_path, at_most)
    digest = lambda data: hashlib.sha256(data).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in chunks(batch.column(1), TOGETHER):
                ids, ends = encoder.value.all(some)
                data, stops = encoder.value.decoded(ids, ends)
                written = memoryview(ids.astype("<u4", copy=False).tobytes())
                listed = [digest(written[4 * a : 4 * b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                decoded = [digest(bytes(data[a:b]).decode("utf-8", "replace").encode()) for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
                columns = [batch.column(0).slice(at, len(some)), pa.array(np.diff(ends, prepend=0)), pa.array(listed, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(some)

    return table.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
