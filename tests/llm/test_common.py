import random

import pyarrow as pa

from tessera.llm.common import split_words


def test_words_of_every_kind_of_space_and_letter():
    draw = random.Random(1)
    letters = "aB \t\n\v\f\r\x1c\x85 　é日ÀÅ\U0001f600\0Éà"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randrange(30))) for _ in range(500)] + [None, "", " ", "x"]
    for some in (pa.array(texts), pa.array(texts).slice(7, 300), pa.array([], pa.string())):
        for lower in (False, True):
            words, n = split_words(some, lower)
            want = [[w.decode() for w in ((t or "").encode().lower() if lower else (t or "").encode()).split()] for t in some.to_pylist()]
            assert words.to_pylist() == [w for x in want for w in x] and n.tolist() == list(map(len, want))
