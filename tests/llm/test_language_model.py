import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import language_model as lm
from tessera.llm.attention import CELLS, CLASSES, START, WINDOW, Attention, Vocabulary, windows
from tessera.llm.token_files import Encoder

PATH = P.path("byte_bpe_50k.json")


def in_fold(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def plain_words(text):
    return (text or "").encode().lower().split()


def test_against_brute_force(make, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 12)
    draw = random.Random(5)
    left, right = ["red", "Green", "blue", "dark"], ["eins", "zwei", "drei", "vier"]
    rows = [(i, " ".join(draw.choice(draw.choice([left] * 19 + [right]) if i % 2 else right) for _ in range(40))) for i in range(20, 120)] + odd_rows
    got = lm.score(make(rows), PATH, least_batches=150).collect()
    train = Counter(w for i, t in rows if i is not None and not in_fold(i) for w in (*plain_words(t), b""))
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        w = (*plain_words(t), b"")
        want.append((i, None if i is None else in_fold(i), len(w), sum(train[x] > 0 for x in w), n, sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert tuple(a)[:5] == b[:5] and abs(a.base_score - b[5]) < 1e-6 * max(1, abs(b[5]))
        assert a.score < 0
    held = [r for r in got if r.held_out and r.doc_id >= 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert len({r.score for r in got if r.doc_id == 1}) == 1
    assert lm.score(make([]), PATH, least_batches=1).count() == 0


def made_model(seed=3):
    draw = np.random.default_rng(seed)
    counts = draw.integers(0, 50, Tokenizer.from_file(PATH).get_vocab_size() + 1).astype(float)
    vocabulary = Vocabulary.of(counts, draw.standard_normal((len(counts), 3)))
    return vocabulary, Attention.fresh(vocabulary.cell_counts(counts))


def test_score_is_the_sum_over_plain_loops():
    """One window at a time and one place at a time, from the weights, as the module's text says it."""
    vocabulary, model = made_model()
    encoder, library = Encoder(open(PATH).read()), Tokenizer.from_file(PATH)
    texts = ["One two, THREE.", "", None, " ".join(f"word{i % 7}x{i}" for i in range(60))]
    got = lm.Scorer(encoder, model, vocabulary, (pa.array([], pa.large_string()), np.zeros(0)), 4, 100.0).score(pa.array(texts))[3].to_pylist()
    p = model.p
    for text, score in zip(texts, got):
        ids = [x for w in plain_words(text) for x in library.encode(" " + w.decode(), add_special_tokens=False).ids] + [len(vocabulary.cell_of) - 1]
        cells = vocabulary.cell_of[ids].tolist()
        before, total, done, first = [START, *cells[:-1]], 0.0, 0, 0
        while done < len(cells):
            stop = min(first + WINDOW, len(cells))
            x = [p["embed"][before[i]] + p["place"][i - first] for i in range(first, stop)]
            for i in range(done, stop):
                own = x[i - first]
                scores = np.exp([own @ p["q"] @ (p["k"].T @ y) / 4 for y in x[: i - first + 1]])
                seen = np.tanh(own @ p["last"] + sum(s * (y @ p["v"]) for s, y in zip(scores / scores.sum(), x)))
                seen[-1] = 1
                c, g = divmod(cells[i], CELLS)
                outer, inner = np.exp(seen @ p["out"]), np.exp(seen @ p["within"][c])
                total += np.log10(outer[c] / outer.sum()) + np.log10(inner[g] / inner.sum()) + vocabulary.share[ids[i]] / np.log(10)
            done, first = stop, first + WINDOW // 2
        assert abs(score - total) < 1e-3 * abs(total)


def test_every_place_is_scored_once():
    for lengths in ([0, 1, WINDOW, WINDOW + 1, 5 * WINDOW + 3],):
        sequence, first, fresh = windows(np.array(lengths))
        scored = Counter()
        for s, f, g in zip(sequence.tolist(), first.tolist(), fresh.tolist()):
            assert g in (0, WINDOW // 2)
            scored.update((s, p) for p in range(f + g, min(f + WINDOW, lengths[s])))
        assert scored == Counter({(s, p): 1 for s, n in enumerate(lengths) for p in range(n)})


def test_attention_is_causal_and_a_distribution():
    _, model = made_model()
    draw = np.random.default_rng(1)
    inputs = draw.integers(0, START, (2, 9))
    each = np.stack([model.log_probabilities(inputs, np.full((2, 9), c), 0) for c in range(START)])
    assert np.allclose(np.exp(each).sum(axis=0), 1, atol=1e-4)
    changed = inputs.copy()
    changed[:, 6:] = START
    a, b = (model.log_probabilities(x, inputs, 0) for x in (inputs, changed))
    assert np.allclose(a[:, :6], b[:, :6], atol=1e-6) and not np.allclose(a[:, 6:], b[:, 6:])


def test_gradient():
    _, model = made_model()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    draw = np.random.default_rng(0)
    inputs, targets = draw.integers(0, START, (2, 6)), draw.integers(0, START, (2, 6))
    counted = np.ones((2, 6))
    counted[1, 4:] = 0
    loss = lambda: -(model.log_probabilities(inputs, targets, 0) * counted).sum() / counted.sum()
    slope = model.gradient(inputs, targets, counted)
    places = {"embed": (int(inputs[0, 1]), 2), "place": (2, 1), "q": (1, 2), "k": (3, 4), "v": (0, 1), "last": (2, 2), "out": (1, 7), "within": (int(targets[0, 2]) // CELLS, 3, 5)}
    for name, at in places.items():
        held = model.p[name][at]
        model.p[name][at] = held + 1e-5
        up = loss()
        model.p[name][at] = held - 1e-5
        assert abs((up - loss()) / 2e-5 - slope[name][at]) < 1e-6, name
        model.p[name][at] = held


def test_every_subword_has_a_share():
    counts = np.random.default_rng(2).integers(0, 50, 5000).astype(float)
    made = Vocabulary.of(counts, np.random.default_rng(1).standard_normal((5000, 2)))
    assert np.allclose(np.bincount(made.cell_of, weights=np.exp(made.share))[np.unique(made.cell_of)], 1)
    assert len(np.unique(made.cell_of // CELLS)) == CLASSES and made.cell_counts(counts).sum() == counts.sum() + 5000


def test_scores_far_below_zero_stay_finite():
    """With queries and keys that point away from each other every allowed score of a row may lie far below zero."""
    _, model = made_model()
    for name in ("q", "k"):
        model.p[name] = model.p[name] * np.float32(60)
    inputs = np.random.default_rng(4).integers(0, START, (200, 3))
    assert np.isfinite(model.log_probabilities(inputs, inputs, 0)).all()


def test_every_training_window_is_learnt_from(spark, make):
    """Whatever the table's size: all windows of all rows, each in one round, and their neighbours counted over all of them."""
    encoder = Encoder(open(PATH).read())
    size = encoder.tokenizer.get_vocab_size()
    rows = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 5 * 60))) for i in range(400)]
    found = lm.training_windows(make(rows), spark.sparkContext.broadcast(encoder), size)
    got = Counter(tuple(x) for x in lm._matrix(found.select("ids").toArrow().column("ids"), size).tolist())
    want = Counter()
    for _, text in rows:
        ids = [-1, *[x for w in plain_words(text) for x in encoder.tokenizer.encode(" " + w.decode(), add_special_tokens=False).ids], size]
        want.update(tuple((ids[at : at + WINDOW + 1] + [-1] * WINDOW)[: WINDOW + 1]) for at in range(0, len(ids) - 1, WINDOW))
    assert got == want and {r.part for r in found.select("part").distinct().collect()} == set(range(lm.ROUNDS))
    counts = np.zeros(size + 1)
    for window, times in want.items():
        np.add.at(counts, [x for x in window[1:] if x >= 0], times)
    before, after, _ = lm.neighbours(found, counts)
    pairs = sum(t for w, t in want.items() for a, b in zip(w, w[1:]) if a >= 0 and b >= 0)
    assert before.sum() == after.sum() == pairs  # no more than NEIGHBOURS subwords occur


def test_a_step_of_learning_is_adam_in_place():
    """Slopes go into the arrays that are given, and steps from them are those of Adam as it is written."""
    _, model = made_model()
    draw = np.random.default_rng(8)
    batches = []
    for _ in range(12):
        inputs, targets = draw.integers(0, START, (2, 64, WINDOW))
        batches.append((inputs, targets, draw.random((64, WINDOW)) < 0.9))
    p = {k: a.copy() for k, a in model.p.items()}
    m, v = ({k: np.zeros(a.shape) for k, a in p.items()} for _ in range(2))
    for step, batch in enumerate(batches, 1):
        held = {k: np.full_like(a, np.nan) for k, a in p.items()}
        given = Attention(p).gradient(*batch, out=held)
        assert all(given[k] is held[k] and np.isfinite(held[k]).all() for k in p)
        for k, g in given.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g.astype(float) ** 2
            rate = 0.01 * min(1.0, step / 10)
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    before = {k: a.copy() for k, a in model.p.items()}
    assert model.learn(iter(batches), 0.01) == 12
    for k, a in model.p.items():
        moved = np.abs(p[k] - before[k])
        assert moved.max() > 0.01 and np.abs(a - p[k]).mean() < 0.02 * moved.mean(), k
    assert len({id(a.base) for a in model.p.values()}) == 1


def test_slopes_stay_finite_where_scores_lie_far_below_zero():
    """Sums of exponentials that are small but not zero: their slopes are quotients of very small numbers."""
    _, model = made_model()
    for far in (75, 85, 95, 101):
        p = {k: a.copy() for k, a in model.p.items()}
        p["embed"][:, 0], p["place"][:, 0], p["q"][:], p["k"][:] = 1, 0, 0, 0
        p["q"][0, 0], p["k"][0, 0] = -4 * far, 1
        inputs = np.random.default_rng(4).integers(0, START, (20, 5))
        slope = Attention(p).gradient(inputs, inputs, np.ones((20, 5)))
        p["q"][0, 0] = 0  # all scores alike, which is the same attention
        want = Attention(p).gradient(inputs, inputs, np.ones((20, 5)))
        for name in ("v", "last", "embed", "out"):
            at = slice(1, None) if name == "embed" else slice(None)
            assert np.isfinite(slope[name]).all() and np.allclose(slope[name][..., at], want[name][..., at], atol=1e-4), (far, name)


def test_neighbours_and_order_over_plain_loops(spark, make):
    encoder = Encoder(open(PATH).read())
    size = encoder.tokenizer.get_vocab_size()
    rows = [(i, " ".join(f"{(i * j) % 1009}xyz" for j in range(i % 4 * 30))) for i in range(60)]
    found = lm.training_windows(make(rows), spark.sparkContext.broadcast(encoder), size)
    held = found.select("ids").toArrow().column("ids")
    each = lm._matrix(held, size)
    assert (lm._matrix(held.slice(3, 9), size) == each[3:12]).all() and len(lm._matrix(held.slice(0, 0), size)) == 0
    assert (lm._ordered(each, size) == np.lexsort(each.T)).all()
    counts = np.bincount(each[:, 1:][each[:, 1:] >= 0], minlength=size + 1).astype(float)
    rank = {x: i for i, x in enumerate(sorted(range(size + 1), key=lambda x: (-counts[x], x)))}
    want = Counter()
    for window in each.tolist():
        for i, a in enumerate(window):
            for j, b in enumerate(window):
                if a >= 0 and b >= 0 and i != j and abs(i - j) < 12:
                    kind = 2 if abs(i - j) > 1 else int(j > i)
                    want[kind, rank[a], rank[b]] += 1
    got = np.stack(lm.neighbours(found, counts))
    at = np.nonzero(got)
    assert Counter(dict(zip(zip(*map(np.ndarray.tolist, at)), got[at].tolist()))) == Counter({x: n for x, n in want.items() if x[1] < lm.LIKENESS_IDS and x[2] < lm.NEIGHBOURS})
