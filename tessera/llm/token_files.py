"""Token-id files: shards of concatenated ids whose document boundaries are Elias-Fano coded.

A shard holds a range of doc_ids in ascending order. Its file is the ids (16 bits each where the vocabulary allows, else
32), then a footer: the doc_ids and the document ends, both in Elias-Fano form with samples for select, and their
lengths. An end e of n ends up to u costs about 2 + log2(u / n) bits: its low bits lie packed, its high bits are
one set bit each in a bit vector, and select finds the i-th set bit from the nearest sample by counting bits, so
no table of 64-bit offsets is written or read. Shards are written under a task's own name and then renamed, so a task
that runs again replaces its file.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import id_and_text, shared_dir, storage
from tessera.llm.pieces import Cache, chunks, encode

MAGIC = b"TSRIDS01"
END_ID = 0
SAMPLE = 64
#: Pieces in one text for the tokenizer, and in the texts of one call.
TOGETHER, CALL = 400, 20_000


class EliasFano:
    """A rising sequence of n whole numbers up to u in about n * (2 + log2(u / n)) bits, with select by place."""

    def __init__(self, n: int, low_width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_width, self.low, self.high, self.samples = n, low_width, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        low_width = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_width]
        low = np.packbits(bits.ravel(), bitorder="little")
        places = (values >> np.uint64(low_width)).astype(np.int64) + np.arange(n)
        high = np.zeros(-(-(int(places[-1]) + 1) // 64) * 8 if n else 0, np.uint8)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        return cls(n, low_width, low, high, places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value: the place of the i-th set high bit, found from the last sample at or before it, gives its high part."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        words = self.high.view("<u8")
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        word = place >> 6
        bits = int(words[word]) >> (place & 63) << (place & 63)
        while (count := bits.bit_count()) <= left:
            left -= count
            word += 1
            bits = int(words[word])
        for _ in range(left):
            bits &= bits - 1
        high = (word << 6) + (bits & -bits).bit_length() - 1 - i
        return high << self.low_width | self._low(i)

    def values(self) -> np.ndarray:
        """All values, without a select for each."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        bits = np.zeros((self.n, 64), np.uint8)
        bits[:, : self.low_width] = np.unpackbits(self.low, count=self.n * self.low_width, bitorder="little").reshape(self.n, self.low_width)
        return high.astype(np.uint64) << np.uint64(self.low_width) | np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()

    def _low(self, i: int) -> int:
        first = i * self.low_width
        chunk = int.from_bytes(self.low[first >> 3 : (first + self.low_width + 7) >> 3].tobytes(), "little")
        return chunk >> (first & 7) & ((1 << self.low_width) - 1)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_width, len(self.low), len(self.high), len(self.samples)], "<u4").tobytes()
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_width, n_low, n_high, n_samples = np.frombuffer(data[:20], "<u4").tolist()
        low = np.frombuffer(data, np.uint8, n_low, 20)
        high = np.frombuffer(data, np.uint8, n_high, 20 + n_low)
        return cls(n, low_width, low, high, np.frombuffer(data, "<u4", n_samples, 20 + n_low + n_high))


class ShardWriter:
    """Streams ids to a file and keeps only the documents' ends until the footer."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = storage(uri)
        self.width = width
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.ids, self.ends, self.total = [], [], 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray) -> None:
        """Documents whose ids lie end to end; each gets an end id after its own."""
        n = len(doc_ids)
        values = np.full(len(ids) + n, END_ID, "<u2" if self.width == 2 else "<u4")
        sizes = np.diff(ends, prepend=0)
        values[np.arange(len(ids)) + np.repeat(np.arange(n), sizes)] = ids
        self.out.write(values.tobytes())
        self.ids += doc_ids
        self.ends.append(self.total + ends + np.arange(1, n + 1))
        self.total += len(values)

    def close(self) -> None:
        numbers = np.array([i for i in self.ids if i is not None], np.int64)
        least = numbers[:1].sum()
        # the difference of any two longs fits in 64 unsigned bits
        ids = EliasFano.of(numbers.view(np.uint64) - least.view(np.uint64)).to_bytes()
        ends = EliasFano.of(np.concatenate(self.ends)).to_bytes()
        sizes = np.array([len(self.ids), len(self.ids) - len(numbers), len(ids), len(ends), self.width], "<u4").tobytes()
        self.out.write(ids + ends + sizes + least.astype("<i8").tobytes() + MAGIC)
        self.out.close()
        self.fs.move(self.part, self.path)


class Shard:
    """Reads a shard: any document by place, or all of them in order; those with a null doc_id come first."""

    TAIL = 28 + len(MAGIC)

    def __init__(self, uri: str):
        fs, path = storage(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(self.TAIL, size - self.TAIL)
        if tail[28:] != MAGIC:
            raise ValueError(f"not a token-id file: {uri}")
        self.n, self.n_null, n_ids, n_ends, self.width = np.frombuffer(tail[:20], "<u4").tolist()
        self.least = int(np.frombuffer(tail[20:28], "<i8")[0])
        footer = self.file.read_at(n_ids + n_ends, size - self.TAIL - n_ids - n_ends)
        self.numbers = EliasFano.from_bytes(footer[:n_ids])
        self.ends = EliasFano.from_bytes(footer[n_ids:])

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.least + self.numbers.select(i - self.n_null)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.n_null + [self.least + x for x in self.numbers.values().tolist()]

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def tokens(self, i: int) -> np.ndarray:
        first, last = self.bounds(i)
        data = self.file.read_at((last - first) * self.width, first * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")


class Encoder:
    """Encodes whole texts with a tokenizer (the text of its file) of byte-level BPE, through a bounded cache of pieces.

    Byte-level pre-tokens start at a space or hold none, so pieces cut before a space encode as they do in place; only
    white space around a space can differ, and a text with such a run goes to the tokenizer whole. It is sent to tasks by
    its definition alone, and the tasks that a Python worker runs one after another share one encoder and its cache.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.definition = definition
        self.tokenizer = Tokenizer.from_str(definition)
        size = self.tokenizer.get_vocab_size()
        self.width = 2 if size <= 1 << 16 else 4
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        self.cache = Cache(self.distinct)

    def __reduce__(self):
        return Encoder, (self.definition,)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [] if not texts else [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's ids end."""
        return encode(texts, self.cache, self._encode)

    def distinct(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces. Those that start with their only white space are encoded many to a text and told apart by
        the ids that start with a space; the others go to the tokenizer one by one."""
        # sorted, as neighbours share merges that are then at hand
        plain = sorted(p for p in pieces if p[:1] == " " and len(p) > 1 and p[1:].isprintable())
        made = {}
        for i in range(0, len(plain), CALL):
            groups = [plain[k : k + TOGETHER] for k in range(i, min(i + CALL, len(plain)), TOGETHER)]
            for group, held in zip(groups, self._encode(["".join(g) for g in groups])):
                at = np.flatnonzero(self.spaced[np.frombuffer(held, "<u4")]).tolist()
                if len(at) == len(group):
                    cuts = [4 * x for x in at] + [len(held)]
                    made.update(zip(group, [held[a:b] for a, b in zip(cuts, cuts[1:])]))
        other = [p for p in pieces if p not in made]
        made.update(zip(other, self._encode(other)))
        return [made[p] for p in pieces]


def write_shards(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int, int]]:
    """Write ``docs`` to token-id shards in ``folder``; gives ``(shard, uri, first id's place, n ids)`` in ascending order.

    Null texts are empty, documents with a null doc_id come first, rows that repeat an id are kept beside each other, and
    each document ends with id 0. An empty table gives no shards. Only the list of shards comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/part-{shard:06d}.ids"
        for batch in batches:
            if batch.num_rows and writer is None:
                writer = ShardWriter(uri, encoder.value.width)
            at = 0
            for some in chunks(batch.column(1)):
                writer.add(batch.column(0).slice(at, len(some)).to_pylist(), *encoder.value.all(some))
                at += len(some)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([writer.total], pa.int64())], names=["shard", "uri", "n_ids"])

    with open(tokenizer_path, encoding="utf-8") as file:  # a vocabulary file: a few MB, whatever the corpus
        encoder = docs.sparkSession.sparkContext.broadcast(Encoder(file.read()))
    fs, path = storage(folder)
    fs.create_dir(path, recursive=True)
    table = id_and_text(docs, id_col, text_col)
    dealt = table.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    listed = dealt.mapInArrow(run, "shard int, uri string, n_ids long").collect()
    out, start = [], 0
    for row in sorted(listed):
        out.append((row.shard, row.uri, start, row.n_ids))
        start += row.n_ids
    return out


def read_shards(docs: DataFrame, shards: list[tuple[int, str, int, int]]) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of the shards, read from the files; ``docs`` gives the session."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(uri)
                starts, sizes, sums = [], [], []
                for i in range(shard.n):
                    first, last = shard.bounds(i)
                    starts.append(base + first)
                    sizes.append(last - first)
                    sums.append(zlib.crc32(shard.tokens(i).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(), pa.int64()), *(pa.array(x, pa.int64()) for x in (starts, sizes, sums))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = docs.sparkSession
    listed = spark.createDataFrame([(uri, start) for _, uri, start, _ in shards], "uri string, start long")
    return listed.repartition(max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to token-id files (in a new folder of the shared one unless named) and read their index back."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    return read_shards(docs, write_shards(docs, tokenizer_path, folder))
