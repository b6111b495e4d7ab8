import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import lexicon
from tessera.llm.transducer import Builder, Transducer

PATH = P.path("byte_bpe_50k.json")
TEXTS = ["The quick brown fox's 123 jumps!!", "  two  spaces   three \n\n new\tline ", "Été à la plage, ñandú 日本語  x", "a <|endoftext|> b<|endoftext|>", "don't we'll\r\n  end  ", " lead", "a \n b", "trailing   ", "ab\x1ccd e\x85f", "word, word. (word)"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def definition():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def built(entries):
    builder = Builder()
    for word, numbers in sorted(entries.items()):
        builder.add(word, tuple(numbers))
    return Transducer(builder.to_bytes())


@settings(deadline=None)
@given(st.dictionaries(st.text("abc", max_size=6).map(str.encode), st.lists(st.integers(0, 3), max_size=4), max_size=60), st.lists(st.text("abcd", max_size=7), max_size=30))
def test_transducer_is_a_map(entries, others):
    made = built(entries)
    asked = [*entries, *(x.encode() for x in others)]
    got = made.get(pa.array(asked, pa.binary()))
    assert [None if x is None else np.frombuffer(x, "<u4").tolist() for x in got] == [entries.get(w) for w in asked]


def test_transducer_is_minimal():
    """The states are as many as there are different maps from endings to what is left to put out."""
    entries = {w.encode(): [i % 2, 7, 7] for i, w in enumerate(["driving", "riding", "rid", "driven", "ridden", "reading", "writing", "written"])}

    def left(prefix):
        held = {w[len(prefix) :]: n for w, n in entries.items() if w.startswith(prefix)}
        whole = list(held.values())
        n = 0
        while prefix and all(len(x) > n and x[n] == whole[0][n] for x in whole):
            n += 1
        return tuple(sorted((w, tuple(x[n:])) for w, x in held.items()))

    want = {left(w[:k]) for w in entries for k in range(len(w) + 1)}
    made = built(entries)
    assert made.n_states == len(want) < sum(map(len, entries))


def test_words_must_rise():
    builder = Builder()
    builder.add(b"b", (1,))
    for word in (b"a", b"b"):
        with pytest.raises(ValueError):
            builder.add(word, (1,))


def test_a_mapped_file(tmp_path):
    words = [f" w{i}" for i in range(5000)]
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compiled([(w, np.array([i % 7, i], "<u4").tobytes()) for i, w in enumerate(words)]))
    got = Transducer.mapped(str(path)).get(pa.array([*words, " w", "", " w50000"], pa.large_string()))
    assert [np.frombuffer(x, "<u4").tolist() for x in got[:5000]] == [[i % 7, i] for i in range(5000)] and got[5000:] == [None] * 3


def test_merges_equal_the_library(definition, library):
    encoder = lexicon.LexiconEncoder(definition)
    draw = random.Random(3)
    letters = "ab éÉß日.,;:!?)#$*'s \n\t  1²ⅷǅᲉ-\x1c\x85　\0the ing<|endoftext|>"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(80))) for _ in range(2000)] + ["theinging" * 40, "x" * 1000, "antidisestablishmentarianism " * 3, *TEXTS]
    for text, ids in zip(texts, encoder._missing(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_every_token_of_the_vocabulary(definition, library):
    encoder = lexicon.LexiconEncoder(definition)
    words = sorted({p for i in range(library.get_vocab_size()) if lexicon._PLAIN.fullmatch(p := library.decode([i]))})
    assert len(words) > 30_000
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder._missing(words)] == [e.ids for e in library.encode_batch(words, add_special_tokens=False)]


def test_round_trip_against_the_library(make, odd_rows, library):
    rows = [(100 + i, t) for i, t in enumerate(TEXTS * 3)] + odd_rows
    got = lexicon.digests(make(rows), PATH, at_most=20).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens) == (i, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert lexicon.digests(make([]), PATH).count() == 0


def test_encode_and_decode(make, library):
    docs = make([(i, t) for i, t in enumerate(TEXTS)] + [(99, None)])
    encoded = lexicon.encode(docs, PATH)
    assert encoded.columns == [*docs.columns, "ids"]
    done = lexicon.decode(encoded, PATH).collect()
    assert [r.ids for r in done] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS] + [[]]
    assert [r.decoded for r in done] == TEXTS + [""]
    odd = docs.limit(1).select(F.explode(F.array(F.array(F.lit(1), F.lit(99_999)), F.array(F.lit(-1)), F.array(F.lit(161)), F.lit(None).cast("array<int>"))).alias("ids"))
    assert [r.decoded for r in lexicon.decode(odd, PATH).collect()] == [None, None, library.decode([161], skip_special_tokens=False), None]


def test_the_lexicon_is_used(make, spark):
    rows = [(i, "common words common words rare%d" % i) for i in range(50)]
    with open(PATH, encoding="utf-8") as file:
        encoder = spark.sparkContext.broadcast(lexicon.LexiconEncoder(file.read()))
    words = lexicon.frequent_words(make(rows), encoder, 10)
    assert {w for w, _ in words} == {" common", " words"}
