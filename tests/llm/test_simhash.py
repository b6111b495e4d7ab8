import random

import numpy as np
import xxhash

from tessera.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    fps = {f for _, f in rows}
    group = {}
    for f in fps:
        if f in group:
            continue
        stack, seen = [f], {f}
        while stack:
            g = stack.pop()
            for h in fps:
                if h not in seen and (g ^ h).bit_count() <= 4:
                    seen.add(h)
                    stack.append(h)
        least = min((i for i, f2 in rows if f2 in seen and i is not None), default=None)
        group.update(dict.fromkeys(seen, least))
    return [(i, f"{f:016x}", group[f]) for i, f in rows]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_against_brute_force(make, odd_rows):
    draw = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    rows = list(odd_rows)
    for i in range(10, 40):
        text = [draw.choice(words) for _ in range(draw.randrange(1, 120))]
        for j in range(draw.randrange(1, 5)):
            rows.append((100 * i + j, " ".join(text)))
            text[draw.randrange(len(text))] = draw.choice(words)
    got = sorted((tuple(r) for r in simhash.near_duplicates(make(rows)).collect()), key=key)
    assert got == sorted(plain_components([(i, plain_fingerprint(t)) for i, t in rows]), key=key)


def test_index_finds_every_pair():
    draw = np.random.default_rng(3)
    fps = draw.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = fps[:100, None] ^ (np.uint64(1) << draw.integers(0, 64, (100, 5), dtype=np.uint64))
    fps = np.unique(np.concatenate((fps, near.ravel())))
    index = simhash.GrayIndex(fps)
    i, j = index.search(0, len(fps), 4)
    apart = np.bitwise_count(index.leaves[:, None] ^ index.leaves[None, :])
    want = np.argwhere(np.triu(apart <= 4, 1))
    assert set(zip(i.tolist(), j.tolist())) == set(map(tuple, want.tolist()))
    assert (np.diff(simhash.gray_rank(index.leaves).astype(object)) > 0).all()


def test_split_buckets_lose_no_link(spark):
    draw = random.Random(4)
    base = draw.getrandbits(64)
    rows = {base}
    while len(rows) < 60:
        f = draw.choice(sorted(rows)) ^ (1 << draw.randrange(40)) ^ (1 << draw.randrange(40))
        rows.add(f)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, n) for n, f in enumerate(sorted(rows))], "fp long, rep long")
    for bucket in (4, 1000):
        roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, 4, bucket)).collect()}
        want = {i: c for i, _, c in plain_components([(n, f) for n, f in enumerate(sorted(rows))])}
        assert {n: roots.get(n, n) for n in range(60)} == want


def test_long_chain_settles(spark):
    chain = spark.range(1, 400).selectExpr("id as u", "id - 1 as v")
    assert {r.root for r in simhash.components(chain).collect()} == {0}


def test_one_of_each(make, odd_rows):
    rows = [(7, "a b c d e f"), (8, "a b c d e f"), (9, "quite another text here")]
    kept = simhash.one_of_each(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [7, 9] and kept.columns == make(rows).columns
    assert simhash.one_of_each(make([])).count() == 0
