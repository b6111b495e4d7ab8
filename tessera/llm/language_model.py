"""Language-model scores of whole texts by a causal self-attention model over subwords, beside the base score by word counts.

Words are lower-cased (A-Z) and parted at ASCII white space; each goes to the model as its subwords with the space before it,
and the end of a text is a subword of its own. The model's score is the sum of the log probabilities of all of them, each one
scored once, in a window with at least half a window of context where the text has it.

Words, subwords and their neighbours are counted over all training rows, and the counts set the model's classes, biases and
shares. The weights are learnt on all windows of all training rows, a part of them in each round: every partition of
windows starts from the last round's weights, learns from its own, and the weights are averaged by sums in Spark. A documented number of the most frequent words goes to every task with their counts; the other words of a text
are joined to the counts by a shuffle, so memory stays bounded and every word gets its own count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.attention import BATCH, START, WINDOW, Attention, Vocabulary
from tessera.llm.common import id_and_text, materialize, split_words
from tessera.llm.pieces import chunks, distinct_ids, spread
from tessera.llm.token_files import Encoder

FREQUENT = 500_000
#: Rounds of averaging; batches in all, where there are few windows; windows of a partition, and partitions at most.
ROUNDS, LEAST_BATCHES, PART_WINDOWS, MOST_PARTS = 4, 800, 20_000, 4096
RATE = 0.01
#: Subwords and neighbours from which the classes of subwords are made, and the rows of their counts that are summed together.
LIKENESS_IDS, NEIGHBOURS, AXES, BLOCK = 8192, 128, 6, 128
END = ""


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == fold


def word_counts(texts: DataFrame) -> DataFrame:
    """``(word, c)`` over whole texts, the end of a text being the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for batch in batches:
            ends += batch.num_rows
            for some in chunks(batch.column(0)):
                listed, n = pc.value_counts(split_words(some, lower=True)[0]).flatten()
                yield pa.RecordBatch.from_arrays([listed.cast(pa.string()), n], names=["word", "c"])
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], names=["word", "c"])

    return texts.select("text").mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")).filter("c > 0")


def frequent_words(counts: DataFrame, at_most: int) -> tuple[pa.Array, np.ndarray]:
    """No more than ``at_most`` of the most frequent words (those that reach a step of a geometric scale) and their counts."""
    stepped = counts.filter(F.col("word") != END).withColumn("step", F.floor(8 * F.log2("c")).cast("int"))
    least, total = 1 << 30, 0
    for step, n in sorted(stepped.groupBy("step").count().collect(), reverse=True):
        total += n
        if total > at_most:
            break
        least = step
    found = stepped.filter(F.col("step") >= least).select("word", "c").toArrow().combine_chunks()
    listed, c = found.column("word"), found.column("c")
    return pc.cast(listed.combine_chunks(), pa.large_string()), c.to_numpy()


def subword_counts(counts: DataFrame, encoder, size: int) -> np.ndarray:
    """How often each subword occurs in the counted words, the end's last; every distinct word is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1)
        for batch in batches:
            listed, c = batch.column(0), batch.column(1).to_numpy()
            ends = pc.equal(listed, END).to_numpy(zero_copy_only=False)
            total[size] += c[ends].sum()
            for at in range(0, len(listed), 50_000):
                some = listed.slice(at, 50_000).cast(pa.large_string()).to_pylist()
                made = [b"" if w == END else x for w, x in zip(some, encoder.value.distinct([" " + w for w in some]))]
                lengths = np.fromiter(map(len, made), np.int64, len(made)) >> 2
                total[:size] += np.bincount(np.frombuffer(b"".join(made), "<u4"), weights=np.repeat(c[at : at + 50_000], lengths), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["id", "n"])

    out = np.zeros(size + 1)
    found = counts.select("word", "c").mapInArrow(run, "id int, n double").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("id").to_numpy()] = found.column("n").to_numpy()
    return out


def subwords(listed: pa.Array, codes: np.ndarray, encoder: Encoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The subwords of coded words of ``listed``, ``len(listed)`` standing for the end, and where each word's subwords end."""
    ids, sizes = distinct_ids(listed, encoder.cache)
    ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    return ids[spread((np.cumsum(sizes) - sizes)[codes], lengths, ends)].astype(np.int64), ends


def coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, each text's words by their places in that list and then the end, and where each text ends."""
    flat, n = split_words(texts, lower=True)
    made = flat.dictionary_encode()
    codes = np.full(len(flat) + len(n), len(made.dictionary), np.int64)
    codes[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = made.indices.to_numpy()
    return made.dictionary, codes, np.cumsum(n + 1)


def training_windows(train: DataFrame, encoder, size: int) -> DataFrame:
    """``(part, ids)``: every window of every row, parted by hash: the subword before, the largest number at a start, then the window's, that number
    after the end, as two bytes each, or four where there are too many subwords for that."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in chunks(batch.column(0)):
                keys = batch.column(1).slice(at, len(some)).to_numpy().view(np.uint64)
                at += len(some)
                listed, codes, text_ends = coded(some)
                ids, ends = subwords(listed, codes, encoder.value, size)
                lengths = np.diff(ends[text_ends - 1], prepend=0)
                n = -(-lengths // WINDOW)
                of_text = np.repeat(np.arange(len(some)), n)
                nth = np.arange(len(of_text)) - np.repeat(np.cumsum(n) - n, n)
                mixed = (keys[of_text] + nth.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
                mixed ^= mixed >> np.uint64(29)
                # each text starts a window of its own: its subwords move up by what the windows before leave empty
                firsts = np.cumsum(n) - n
                held = np.full((len(of_text), WINDOW), np.iinfo(kind).max, kind)
                held.reshape(-1)[np.arange(len(ids)) + np.repeat(firsts * WINDOW - (ends[text_ends - 1] - lengths), lengths)] = ids
                made = np.empty((len(held), WINDOW + 1), kind)
                made[:, 1:], made[1:, 0] = held, held[:-1, -1]
                made[firsts, 0] = np.iinfo(kind).max
                offsets = np.arange(len(made) + 1, dtype=np.int32) * made.shape[1] * made.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(made), [None, pa.py_buffer(offsets), pa.py_buffer(made)])
                yield pa.RecordBatch.from_arrays([pa.array((mixed % np.uint64(ROUNDS)).astype(np.int32)), held], names=["part", "ids"])

    return train.select("text", F.xxhash64("doc_id", "text").alias("key")).mapInArrow(run, "part int, ids binary")


def _kind(size: int) -> np.dtype:
    """What a window's subwords are held as; its largest value stands for no subword."""
    return np.dtype("<u2" if size < 0xFFFF else "<u4")


def _matrix(held: pa.Array, size: int) -> np.ndarray:
    """Windows' subwords, -1 for none."""
    kind = _kind(size)
    if isinstance(held, pa.ChunkedArray):
        held = held.combine_chunks()
    held = held.cast(pa.large_binary())
    row = (WINDOW + 1) * kind.itemsize
    start = int(np.frombuffer(held.buffers()[1], np.int64)[held.offset]) if len(held) else 0
    found = np.frombuffer(held.buffers()[2] or b"", np.uint8)[start : start + len(held) * row].view(kind).reshape(-1, WINDOW + 1).astype(np.int32)
    found[found == np.int64(np.iinfo(kind).max).astype(np.int32)] = -1
    return found


def _ordered(found: np.ndarray, size: int) -> np.ndarray:
    """The order of windows by their last subword, then the one before it and so on, a few subwords to a key."""
    bits = 8 * _kind(size).itemsize
    each = 64 // bits
    found = np.pad(found + 1, ((0, 0), (-found.shape[1] % each, 0))).astype(np.uint64)
    return np.lexsort(sum(found[:, i::each].T << np.uint64(i * bits) for i in range(each)))


def neighbours(found: DataFrame, counts: np.ndarray) -> list[np.ndarray]:
    """Over all windows, how often each of the most frequent subwords has each of the very frequent ones right before it, right after it,
    and within a dozen places of it: sums of a fixed size, whatever the table's."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    n, k, size = min(LIKENESS_IDS, len(counts)), min(NEIGHBOURS, len(counts)), len(counts) - 1
    # -1, no subword, is the last; a row and a column more take what is not counted, so that no pair has to be left out
    places = [np.full(len(counts) + 1, most) for most in (n, k)]
    for place, most in zip(places, (n, k)):
        place[order[:most]] = np.arange(most)
    places = found.sparkSession.sparkContext.broadcast((places[0] * (k + 1), places[1]))

    def blocks(total: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for b, held in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([held.astype("<i8").tobytes()], pa.binary())], names=["block", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, (n + 1) * (k + 1)), np.int64)
        row, column = places.value
        for batch in batches:
            ids = _matrix(batch.column(0), size)
            left, right = row[ids], column[ids]
            near = np.empty(2 * sum(left[:, o:].size for o in range(2, 12)), np.int64)
            at = 0
            for o in range(2, 12):
                for a, b in ((left[:, :-o], right[:, o:]), (left[:, o:], right[:, :-o])):
                    np.add(a, b, out=near[at : at + a.size].reshape(a.shape))
                    at += a.size
            for i, some in enumerate(((left[:, 1:] + right[:, :-1]).ravel(), (left[:, :-1] + right[:, 1:]).ravel(), near)):
                total[i] += np.bincount(some, minlength=total.shape[1])
        total = np.ascontiguousarray(total.reshape(3, n + 1, k + 1)[:, :n, :k])
        yield from blocks({b: total[:, b : b + BLOCK] for b in range(0, n, BLOCK) if total[:, b : b + BLOCK].any()})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[b] = total.get(b, 0) + np.frombuffer(held, "<i8")
        yield from blocks(total)

    out = np.zeros((3, n, k))
    schema = "block int, held binary"
    for row in found.select("ids").mapInArrow(run, schema).repartition(16, "block").mapInArrow(summed, schema).collect():
        out[:, row.block : row.block + BLOCK] = np.frombuffer(bytes(row.held), "<i8").reshape(3, -1, k)
    return list(out)


def likeness(parts: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
    """A row for each subword: the main axes of its ``neighbours``, for the most frequent subwords; zeros for the others."""
    out = np.zeros((len(counts), AXES))
    order = np.lexsort((np.arange(len(counts)), -counts))
    n = len(parts[0])
    weights = counts[order[:n]] + 1
    shares = [np.sqrt((x + 2 * x.sum(axis=0) / max(1.0, x.sum())) / (x.sum(axis=1, keepdims=True) + 2)) for x in parts]
    made = np.concatenate(shares, axis=1)
    made -= np.average(made, axis=0, weights=weights)
    scaled = made * np.sqrt(weights)[:, None]
    axes = np.linalg.eigh(scaled.T @ scaled)[1][:, ::-1][:, :AXES]
    out[order[:n], : axes.shape[1]] = made @ (axes * np.where(axes.sum(axis=0) < 0, -1, 1))
    return out


def batches_of(found: np.ndarray, cell_of: np.ndarray, passes: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    cells = np.append(cell_of, START).astype(np.int64)[found]
    draw = np.random.default_rng(seed)
    for _ in range(passes):
        order = draw.permutation(len(found))
        for at in range(0, len(order), BATCH):
            some = cells[order[at : at + BATCH]]
            yield some[:, :-1], np.where(some[:, 1:] == START, 0, some[:, 1:]), some[:, 1:] != START


def train(found: DataFrame, n: int, vocabulary: Vocabulary, counts: np.ndarray, least_batches: int) -> Attention:
    """Rounds of learning from ``found``, the table of ``n`` windows: partitions learn apart and their weights are averaged,
    weighted by their windows. A round takes one part of the windows; where windows are few it goes over them several times."""
    spark = found.sparkSession
    model = Attention.fresh(vocabulary.cell_counts(counts))
    names = sorted(model.p)
    shapes = [model.p[x].shape for x in names]
    passes = min(50, max(1, -(-least_batches * BATCH // max(1, n))))
    parts = max(1, min(MOST_PARTS, n // ROUNDS // PART_WINDOWS))
    size = len(counts) - 1
    cell_of = spark.sparkContext.broadcast(vocabulary.cell_of)

    def flat(p: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[x].ravel() for x in names])

    def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return {x: a.reshape(s).astype(np.float32) for x, s, a in zip(names, shapes, np.split(values, cuts))}

    def row(group: int, n: float, weights: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([n], pa.float64()), pa.array([weights.astype("<f8").tobytes()], pa.binary())], names=["group", "n", "weights"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weights = 0.0, 0.0
        for batch in batches:
            for n, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total, weights = total + n, weights + np.frombuffer(held, "<f8")
        if total:
            yield row(0, total, weights)

    for r in range(ROUNDS if n else 0):
        start, rate = spark.sparkContext.broadcast(flat(model.p)), RATE * (1 - r / (ROUNDS + 1))

        def learn(batches: Iterator[pa.RecordBatch], start=start, rate=rate, r=r) -> Iterator[pa.RecordBatch]:
            held = [_matrix(batch.column(0), size) for batch in batches if batch.num_rows]
            if held:
                mine = np.concatenate(held)
                own = Attention(unflat(start.value))
                own.learn(batches_of(mine[_ordered(mine, size)], cell_of.value, passes, r), rate)
                yield row(TaskContext.get().partitionId() % 16, float(len(mine)), flat(own.p) * len(mine))

        kinds = "group int, n double, weights binary"
        mine = found.filter(F.col("part") == r).select("ids").repartition(parts, F.xxhash64("ids"))
        rows = mine.mapInArrow(learn, kinds).repartition(min(16, parts), "group").mapInArrow(summed, kinds).collect()
        if rows:  # no more than 16 sums of weights
            model.p = unflat(sum(np.frombuffer(bytes(x.weights), "<f8") for x in sorted(rows, key=lambda x: (x.n, bytes(x.weights)))) / sum(x.n for x in rows))
        start.unpersist()
    return model


class Scorer:
    """What a task scores texts with; the tasks that a Python worker runs one after another share one and its cache."""

    def __init__(self, encoder: Encoder, model: Attention, vocabulary: Vocabulary, known: tuple[pa.Array, np.ndarray], n_end: int, whole: float):
        self.encoder, self.model, self.vocabulary, self.n_end, self.whole = encoder, model, vocabulary, n_end, whole
        self.known, self.counts = known

    def score(self, texts: pa.Array) -> list[pa.Array]:
        """Columns n_tokens, n_known, base and score, known and base over the end and the words that are at hand, and the other
        words with how often each occurs."""
        listed, codes, text_ends = coded(texts)
        n, end = len(texts), len(listed)
        starts = np.concatenate(([0], text_ends[:-1])).astype(np.int64)
        at = pc.fill_null(pc.index_in(listed, value_set=self.known), -1).to_numpy()
        c = np.append(np.where(at >= 0, self.counts[at], 0) if len(self.counts) else np.zeros(end), self.n_end)
        here = c > 0
        here[end] = True
        base = np.where(here, np.log10((c + 1) / self.whole), 0.0)
        ids, ends = subwords(listed, codes, self.encoder, len(self.vocabulary.cell_of) - 1)
        lengths = np.diff(ends[text_ends - 1], prepend=0)
        chosen = self.model.place_scores(self.vocabulary.cell_of[ids].astype(np.int64), lengths) + self.vocabulary.share[ids]
        first = ends[text_ends - 1] - lengths
        of_text = np.repeat(np.arange(n), text_ends - starts)
        away = np.flatnonzero(~here[codes])
        pairs, times = np.unique(of_text[away] * (end + 1) + codes[away], return_counts=True)
        rare = pa.StructArray.from_arrays([listed.take(pa.array(pairs % (end + 1))).cast(pa.string()), pa.array(times.astype(np.int32))], names=["word", "n"])
        offsets = np.searchsorted(pairs, np.arange(n + 1) * (end + 1)).astype(np.int32)
        total = lambda x, at: np.add.reduceat(x, at) if n else x[:0]
        return [
            pa.array(text_ends - starts),
            pa.array(total((c > 0).astype(np.int64)[codes], starts)),
            pa.array(total(base[codes], starts)),
            pa.array(total(chosen / np.log(10), first)),
            pa.ListArray.from_arrays(pa.array(offsets), rare),
        ]


def score(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", least_batches: int = LEAST_BATCHES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row.

    A null or empty text is the end alone; a row with a null doc_id is scored but not learnt from, and has a null
    held_out; repeated rows count each in training and score alike. Ties among words do not matter. An empty table gives
    an empty result. Texts are scored whole; other columns are not read.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:  # a vocabulary file: a few MB, whatever the corpus
        own = Encoder(file.read())
    encoder = spark.sparkContext.broadcast(own)
    size = own.tokenizer.get_vocab_size()
    table = id_and_text(docs, id_col, text_col)
    learnt = table.filter(~held_out(F.col("doc_id")))
    counts = materialize(word_counts(learnt), "word-counts")
    n, v, n_end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0))).first()
    by_subword = subword_counts(counts, encoder, size)
    found = materialize(training_windows(learnt, encoder, size), "windows")
    n_windows = found.count()
    vocabulary = Vocabulary.of(by_subword, likeness(neighbours(found, by_subword), by_subword))
    model = train(found, n_windows, vocabulary, by_subword, least_batches)
    whole = float(n + v + 1)
    scorer = spark.sparkContext.broadcast(Scorer(own, model, vocabulary, frequent_words(counts, FREQUENT), n_end, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            at = 0
            for some in chunks(batch.column(1)):
                columns = [pa.array(row + np.arange(len(some))), batch.column(0).slice(at, len(some)), *scorer.value.score(some)]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"])
                at, row = at + len(some), row + len(some)

    kinds = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word: string, n: int>>"
    scored = materialize(table.mapInArrow(run, kinds), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((c + 1) / F.lit(whole))).alias("more_base"))
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
