import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import token_files as tf

PATH = P.path("byte_bpe_50k.json")


@given(st.lists(st.integers(0, 5000), max_size=300))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64))
    made = tf.EliasFano.from_bytes(tf.EliasFano.of(values).to_bytes())
    assert [made.select(i) for i in range(len(values))] == made.values().tolist() == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1600, 10_000))
    assert 8 * len(tf.EliasFano.of(values).to_bytes()) / 10_000 < 2 + np.log2(values[-1] / 10_000) + 1.5


def test_files_against_the_library(make, odd_rows):
    rows = [(50 - i, t) for i, t in enumerate(["a b", "  two  \n x", "Été <|endoftext|> 日本 ", "don't", "tail  "])] + odd_rows
    got = [tuple(r) for r in tf.token_files(make(rows), PATH).collect()]
    library = Tokenizer.from_file(PATH)
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tf.token_files(make([]), PATH).count() == 0


def test_random_access(make, tmp_path):
    shards = tf.write_shards(make([(1, "one two"), (2, ""), (3, "three")]), PATH, str(tmp_path))
    library = Tokenizer.from_file(PATH)
    read = {}
    for _, uri, _, _ in shards:
        shard = tf.Shard(uri)
        read |= {shard.doc_id(i): shard.tokens(i).tolist() for i in reversed(range(shard.n))}
    assert read == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in ((1, "one two"), (2, ""), (3, "three"))}


def test_far_ids_and_marks(make, tmp_path):
    rows = [(-(1 << 63), "word, word. word"), (-5, "naïve... Ünter!? $5*"), (0, " Été) été) x's. ,"), ((1 << 63) - 1, "a" * 100_000), (None, "word.")]
    shards = tf.write_shards(make(rows).repartition(1), PATH, str(tmp_path))
    library = Tokenizer.from_file(PATH)
    got = {}
    for _, uri, _, _ in shards:
        shard = tf.Shard(uri)
        assert [shard.doc_id(i) for i in range(shard.n)] == shard.doc_ids()
        got |= {k: shard.tokens(i).tolist() for i, k in enumerate(shard.doc_ids())}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
