import hashlib
import random
import re

import pytest
import xxhash

from tessera.llm import substring_dedup as sd


def plain(rows, size=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - size + 1) if i is not None else ():
            key = tuple(w[k : k + size])
            first[key] = min(i, first.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("hot", [1, 1000])
def test_against_brute_force(make, odd_rows, hot):
    draw = random.Random(hot)
    words = ["w%d" % i for i in range(60)]
    passages = [[draw.choice(words) for _ in range(draw.randrange(10, 60))] for _ in range(6)]
    rows = list(odd_rows)
    for i in range(10, 60):
        text = []
        for _ in range(draw.randrange(1, 6)):
            p = draw.choice(passages)
            a = draw.randrange(len(p))
            text += p[a : a + draw.randrange(5, 50)] if draw.random() < 0.7 else [draw.choice("ab") for _ in range(20)]
        rows.append((i, " ".join(text)))
    lengthy = ["x" * 33, "y" * 40, "\0" + xxhash.xxh3_128_hexdigest(b"x" * 33), "z" * 32] + ["u%d" % i for i in range(12)]
    rows += [(70, " ".join(lengthy)), (71, " ".join(lengthy)), (72, " ".join([lengthy[2], *lengthy[1:]]))]
    rows += [(12, "a second text of one id " * 9), (4, odd_rows[5][1]), (80, odd_rows[5][1])]
    made = sd.dedup(make(rows), hot=hot, bits=2 if hot == 1 else 28).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("hot", [1, 1000])
def test_words_whose_hashes_share_their_upper_half(make, hot):
    seen = {}
    for word in ("n%d" % i for i in range(1_000_000)):
        other = seen.setdefault(xxhash.xxh3_64_intdigest(word.encode()) >> 32, word)
        if other != word:
            break
    else:
        pytest.fail("no such words")
    text = " ".join("t%d" % i for i in range(12))
    rows = [(1, f"{text} {other}"), (2, f"{text} {word}"), (3, f"{text} {word}")]
    got = sd.dedup(make(rows), hot=hot).selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_empty(make):
    assert sd.digests(make([])).count() == 0
    assert [tuple(r)[:3] for r in sd.digests(make([(1, "a " * 30), (2, "a " * 30)])).orderBy("doc_id").collect()] == [(1, 30, 0), (2, 30, 30)]


def test_automaton_against_every_substring():
    draw = random.Random(3)
    for _ in range(100):
        sequences = [[draw.randrange(3) for _ in range(draw.randrange(1, 20))] for _ in range(6)]
        docs = [draw.randrange(20) for _ in sequences]
        automaton = sd.SuffixAutomaton()
        for s, d in zip(sequences, docs):
            automaton.add(s, d)
        automaton.finish()
        other = [draw.randrange(3) for _ in range(15)]
        for s in (*sequences, other):
            want = [min((d for t, d in zip(sequences, docs) if any(t[j : j + 4] == s[i : i + 4] for j in range(len(t) - 3))), default=None) for i in range(len(s) - 3)]
            assert automaton.first_docs(s, 4) == want
