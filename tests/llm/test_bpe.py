import hashlib
import random
import time

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import bpe, pieces

TEXTS = ["The quick brown fox's 123 jumps!!", "  two  spaces   three \n\n new\tline ", "Été à la plage, ñandú 日本語  x", "x", "don't we'll\r\n  end  ", "Ciónes ue ñga.\nErti Erti", " lead", "a \n b", "trailing   "]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trip_against_the_library(make, odd_rows, ranks, library):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS * 2)] + odd_rows
    got = bpe.digests(make(rows), ranks, P.PATTERN).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got):
        ids = library.encode_ordinary(text or "")
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_fold_equals_the_library(spark, ranks, library):
    words = sorted({w for t in TEXTS for w in t.split(" ")} | {" thndeaing", " plage", "antidisestablishmentarianism"})
    codec = bpe.Codec(ranks, P.PATTERN)
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", codec.unit(F.col("w")).alias("ids")).collect()
    assert {r.w: r.ids for r in got} == {w: library.encode_ordinary(w) for w in words}


def test_encode_and_decode(make, ranks, library):
    docs = make([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)])
    encoded = bpe.encode(docs, ranks, P.PATTERN)
    assert encoded.columns == [*docs.columns, "ids"]
    done = bpe.decode(encoded, ranks).collect()
    assert [r.ids for r in done] == [library.encode_ordinary(t) for t in TEXTS] + [[]]
    assert [bytes(r.decoded).decode() for r in done] == TEXTS + [""]
    unknown = docs.limit(1).select(F.array(F.lit(1), F.lit(99_999)).alias("ids"))
    assert bpe.decode(unknown, ranks).first().decoded is None
    assert bpe.encode(make([]), ranks, P.PATTERN).count() == 0


def test_merges_equal_the_library(ranks, library):
    draw = random.Random(3)
    letters = "ab éÉß日.,;:!?)#$*'s \n\t  1²ⅷǅᲉ-\x1c\x85\u3000\0the ing"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(3000)] + ["theinging" * 40, "x" * 1000, " word...", "word. Été, "]
    merger = bpe.Merger(ranks, P.PATTERN, {})
    ids, ends = merger.all(pa.array(texts))
    data, stops = merger.decoded(ids, ends)
    starts, begins = [0, *ends[:-1].tolist()], [0, *stops[:-1].tolist()]
    for text, a, b, first, last in zip(texts, starts, ends.tolist(), begins, stops.tolist()):
        assert ids[a:b].tolist() == library.encode_ordinary(text)
        assert merger.names(ids[a:b]).decode() == " ".join(map(str, ids[a:b]))
        assert bytes(data[first:last]) == text.encode()


def test_a_very_long_unbroken_word(ranks, library):
    draw = random.Random(4)
    text = "".join(draw.choice("abcdefgh") for _ in range(1_000_000))
    began = time.time()
    ids, _ = bpe.Merger(ranks, P.PATTERN, {}).all(pa.array([text]))
    assert time.time() - began < 60 and bpe.Merger(ranks, P.PATTERN, {}).decoded(ids, np.array([len(ids)]))[0].tobytes() == text.encode()
    part = text[:20_000]
    assert bpe.Merger(ranks, P.PATTERN, {}).all(pa.array([part]))[0].tolist() == library.encode_ordinary(part)


def test_counts_leave_marks_off():
    words, n = pieces.counts(pa.array(["one two, two. three", None, "a two\n  b", " x two"]), 64)
    assert dict(zip(words.to_pylist(), n.to_pylist())) == {" two": 3, " three": 1, " x": 1}
