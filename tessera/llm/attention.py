"""A small causal self-attention model over subword ids, in numpy.

The output is factored: a subword's probability is that of its class, of its cell within the class, and its share of the cell.
Each of the most frequent subwords has a cell of its own, so its share is 1; the other ids of a class are dealt to the
class's last cells, within which smoothed counts over the whole corpus decide. So every subword id has an output of its own
and every sequence of subwords a proper probability. One masked attention layer looks at the window before a subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CLASSES, CELLS, OWN = 64, 32, 28
WIDTH, HIDDEN = 16, 32
#: A window's subwords, and how many of them are scored: the rest are context that the window before has scored.
WINDOW, STRIDE = 32, 16
START = CLASSES * CELLS
#: Scores and logits stop here, so that their exponentials stay finite without a search for the largest.
LARGEST = np.float32(60)
#: Sums of exponentials below this are worked out again.
FAINT = np.float32(1e-30)
#: What each place of a window may look at.
SEEN = np.tri(WINDOW, dtype=np.float32)
#: Windows that are scored, or learnt from, together.
ROWS, BATCH = 256, 64
#: Weights that a step of Adam goes over together.
ADAM = 16_384


@dataclass
class Vocabulary:
    """The cell of each subword id (its class times ``CELLS`` and its place there), and the natural log of its share of the cell;
    the end of a text is the last id."""

    cell_of: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, likeness: np.ndarray) -> Vocabulary:
        """From the counts of each id, the end's last, and a row for each id whose nearness makes classes.

        Classes are equal shares of the text along the first axis of likeness, each cut by the next axes in turn; ties by id.
        """
        mass = counts + 1.0
        classes = np.zeros(len(counts), np.int64)
        for axis in range(CLASSES.bit_length() - 1):
            order = np.lexsort((np.arange(len(counts)), likeness[:, axis % likeness.shape[1]], classes))
            running = np.cumsum(mass[order])
            low = np.zeros(1 << axis)
            np.add.at(low, classes, mass)
            ends = np.cumsum(low)
            middle = running - mass[order] / 2 - (ends - low)[classes[order]]
            classes[order] = 2 * classes[order] + (2 * middle > low[classes[order]])
        order = np.lexsort((np.arange(len(counts)), -counts, classes))
        first = np.searchsorted(classes[order], np.arange(CLASSES))
        nth = np.arange(len(counts)) - first[classes[order]]
        place = np.where(nth < OWN, nth, OWN + (nth - OWN) % (CELLS - OWN))
        cell_of = np.empty(len(counts), np.int32)
        cell_of[order] = classes[order] * CELLS + place
        totals = np.bincount(cell_of, weights=mass, minlength=CLASSES * CELLS)
        return cls(cell_of, np.log(mass / totals[cell_of]))

    def cell_counts(self, counts: np.ndarray) -> np.ndarray:
        return np.bincount(self.cell_of, weights=counts + 1.0, minlength=CLASSES * CELLS).reshape(CLASSES, CELLS)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(sequence, first, fresh)`` for each window over sequences of these lengths: windows overlap so that all but a
    sequence's first start with context, and fresh is the first place in the window that no window before has scored."""
    more = np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    sequence = np.repeat(np.arange(len(lengths)), 1 + more)
    nth = np.arange(len(sequence)) - np.repeat(np.cumsum(np.concatenate(([0], (1 + more)[:-1]))), 1 + more)
    return sequence, nth * STRIDE, np.where(nth > 0, WINDOW - STRIDE, 0)


def _flat(a: np.ndarray) -> np.ndarray:
    return a.reshape(-1, a.shape[-1])


class Attention:
    """One layer of causal self-attention: embeddings and places in, a gated mix of the last subword and what is attended to, cells out."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def fresh(cls, cell_counts: np.ndarray, seed: int = 7) -> Attention:
        """Random weights; the biases give each cell its share of the counts."""
        draw = np.random.default_rng(seed)
        shape = {"embed": (START + 1, WIDTH), "place": (WINDOW, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, HIDDEN), "last": (WIDTH, HIDDEN), "out": (HIDDEN, CLASSES), "within": (CLASSES, HIDDEN, CELLS)}
        scale = {"embed": 0.3, "place": 0.1, "out": 0.1, "within": 0.02}
        p = {n: (draw.standard_normal(s) * scale.get(n, 1 / np.sqrt(WIDTH))).astype(np.float32) for n, s in shape.items()}
        counts = cell_counts + 1e-3
        # what the output sees ends with a 1, so the last rows are biases
        p["out"][-1] = np.log(counts.sum(axis=1) / counts.sum())
        p["within"][:, -1] = np.log(counts / counts.sum(axis=1, keepdims=True))
        return cls(p)

    def _projections(self) -> np.ndarray:
        """What turns an embedded subword into its query (scaled), its key, its value and its own part, side by side."""
        p = self.p
        return np.concatenate([p["q"] / np.float32(np.sqrt(WIDTH)), p["k"], p["v"], p["last"]], axis=1)

    def _attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray, own: np.ndarray, first: int) -> tuple:
        """Exponentials of the scores of places from ``first`` on, their sums, what is attended to, and what the output sees.

        What the output sees ends with a 1, so the last column of the values is free: it is all ones, and gives the sums.
        """
        width = k.shape[1]
        scores = q @ k.transpose(0, 2, 1)
        if scores.size and scores.max() > LARGEST:
            np.minimum(scores, LARGEST, out=scores)
        np.exp(scores, out=scores)
        scores *= SEEN[first:width, :width]
        seen = scores @ v
        total = seen[:, :, -1:].copy()
        faint = total[:, :, 0] < FAINT
        if faint.any():
            # all that these rows may see lies far below zero: once more, from the largest of it
            at, place = np.nonzero(faint)
            again = np.einsum("nd,nwd->nw", q[at, place], k[at])
            again[np.arange(width) > (place + first)[:, None]] = -np.inf
            scores[at, place] = np.exp(again - again.max(axis=1, keepdims=True))
            seen[at, place] = np.einsum("nw,nwd->nd", scores[at, place], v[at])
            total[at, place] = seen[at, place, -1:]
        seen /= total
        hidden = seen + own
        np.tanh(hidden, out=hidden)
        hidden[:, :, -1] = 1
        return scores, total, seen, hidden

    def bounded(self) -> bool:
        """Whether no logit can pass ``LARGEST``, as what the output sees lies between -1 and 1."""
        return max(np.abs(self.p[n]).sum(axis=-2).max() for n in ("out", "within")) < LARGEST

    def _by_class(self, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of places by class, and ``(class, from, to)`` of each class in it."""
        order = np.argsort(classes.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(classes, minlength=CLASSES))
        return order, [(c, int(a), int(b)) for c, (a, b) in enumerate(zip((0, *ends[:-1]), ends)) if a < b]

    def tables(self) -> tuple[np.ndarray, ...]:
        """Keys and values, and queries and own parts, of each cell and of each place in a window; a subword's are the sums of both."""
        projections = self._projections()
        cells, places = self.p["embed"] @ projections, self.p["place"] @ projections
        keys, own = slice(WIDTH, 2 * WIDTH + HIDDEN), [*range(WIDTH), *range(2 * WIDTH + HIDDEN, 2 * WIDTH + 2 * HIDDEN)]
        cells[:, 2 * WIDTH + HIDDEN - 1], places[:, 2 * WIDTH + HIDDEN - 1] = 1, 0
        return tuple(np.ascontiguousarray(a[:, c]) for c in (keys, own) for a in (cells, places))

    def log_probabilities(self, inputs: np.ndarray, targets: np.ndarray, first: int, bounded: bool = False, tables: tuple[np.ndarray, ...] | None = None) -> np.ndarray:
        """Natural log probabilities of the targets (cells), from place ``first`` on; inputs are the cells before the targets."""
        p, width = self.p, inputs.shape[1]
        key_of, key_at, own_of, own_at = self.tables() if tables is None else tables
        keys, own = key_of.take(inputs, axis=0), own_of.take(inputs[:, first:], axis=0)
        keys += key_at[:width]
        own += own_at[first:width]
        hidden = _flat(self._attend(own[:, :, :WIDTH], keys[:, :, :WIDTH], keys[:, :, WIDTH:], own[:, :, WIDTH:], first)[-1])
        wanted = targets[:, first:].ravel()
        order, runs = self._by_class(wanted // CELLS)
        wanted, at = wanted[order], np.arange(len(wanted))
        hidden = hidden.take(order, axis=0)

        def chosen(logits: np.ndarray, which: np.ndarray) -> np.ndarray:
            if not bounded:
                np.minimum(logits, LARGEST, out=logits)
            out = logits[at, which]
            np.exp(logits, out=logits)
            return out - np.log(logits @ np.ones(logits.shape[1], logits.dtype))

        found = chosen(hidden @ p["out"], wanted // CELLS)
        within = np.empty((len(wanted), CELLS), hidden.dtype)
        for c, a, b in runs:
            np.dot(hidden[a:b], p["within"][c], out=within[a:b])
        found += chosen(within, wanted % CELLS)
        out = np.empty_like(found)
        out[order] = found
        return out.reshape(targets[:, first:].shape)

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, counted: np.ndarray, out: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """The slope of the mean loss over the counted places, in the arrays of ``out`` if it is given."""
        p = self.p
        g = {n: np.empty_like(a) for n, a in p.items()} if out is None else out
        n, width = inputs.shape
        projections = self._projections()
        x = p["embed"].take(inputs, axis=0)
        x += p["place"][:width]
        flat_x = _flat(x)
        made = flat_x @ projections
        cuts = [slice(0, WIDTH), slice(WIDTH, 2 * WIDTH), slice(2 * WIDTH, 2 * WIDTH + HIDDEN), slice(2 * WIDTH + HIDDEN, None)]
        made[:, 2 * WIDTH + HIDDEN - 1] = 1
        q, k, v, own = (made.reshape(n, width, -1)[:, :, c] for c in cuts)
        scores, total, seen, hidden = self._attend(q, k, v, own, 0)
        flat = _flat(hidden)

        wanted, share = targets.ravel(), (counted / max(1, counted.sum())).astype(np.float32).ravel()
        order, runs = self._by_class(wanted // CELLS)
        wanted, share, at = wanted[order], share[order], np.arange(len(wanted))
        ordered = flat.take(order, axis=0)

        def slope(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
            if logits.size and logits.max() > LARGEST:
                np.minimum(logits, LARGEST, out=logits)
            np.exp(logits, out=logits)
            logits *= (share / (logits @ np.ones(logits.shape[1], logits.dtype)))[:, None]
            logits[at, chosen] -= share
            return logits

        d_class = slope(ordered @ p["out"], wanted // CELLS)
        np.matmul(ordered.T, d_class, out=g["out"])
        within = np.empty((len(wanted), CELLS), flat.dtype)
        for c, a, b in runs:
            np.dot(ordered[a:b], p["within"][c], out=within[a:b])
        d_within = slope(within, wanted % CELLS)
        d_ordered, d_own = d_class @ p["out"].T, np.empty_like(ordered)
        if len(runs) < CLASSES:
            g["within"][:] = 0
        for c, a, b in runs:
            np.dot(ordered[a:b].T, d_within[a:b], out=g["within"][c])
            np.dot(d_within[a:b], p["within"][c].T, out=d_own[a:b])
        d_ordered += d_own
        np.multiply(ordered, ordered, out=ordered)
        np.subtract(1, ordered, out=ordered)
        d_ordered *= ordered  # the last column is zero, as the output sees a 1 there

        d_made = np.empty_like(made)
        d_q, d_k, d_v, d_pre = (d_made.reshape(n, width, -1)[:, :, c] for c in cuts)
        d_made[:, cuts[3]][order] = d_ordered
        # over the sums, and with what the sums' slope takes off in the free last column
        d_seen = d_pre / total
        d_seen[:, :, -1] = -np.einsum("nwd,nwd->nw", d_seen, seen)
        d_scores = d_seen @ v.transpose(0, 2, 1)
        d_scores *= scores
        np.matmul(d_scores, k, out=d_q)
        np.matmul(d_scores.transpose(0, 2, 1), q, out=d_k)
        np.matmul(scores.transpose(0, 2, 1), d_seen, out=d_v)
        d_v[:, :, -1] = 0
        slopes, d_x = flat_x.T @ d_made, d_made @ projections.T
        for name, c in zip(("q", "k", "v", "last"), cuts):
            g[name][:] = slopes[:, c]
        g["q"] /= np.float32(np.sqrt(WIDTH))
        g["place"][:] = 0
        d_x.reshape(n, -1).sum(axis=0, out=g["place"][:width].reshape(-1))
        g["embed"][:] = 0
        order = np.argsort(inputs.ravel().astype(np.int16), kind="stable")
        listed = inputs.ravel()[order]
        starts = np.flatnonzero(np.diff(listed, prepend=-1))
        g["embed"][listed[starts]] = np.add.reduceat(d_x.take(order, axis=0), starts, axis=0)
        return g

    def learn(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float) -> int:
        """Adam over batches of ``(inputs, targets, counted)``; gives how many there were. All weights lie in one array, and its
        means are held as sums (ten and a hundred times the means)."""
        ends = np.cumsum([a.size for a in self.p.values()])
        weights = np.concatenate([a.ravel() for a in self.p.values()])
        views = lambda flat: {n: flat[e - a.size : e].reshape(a.shape) for (n, a), e in zip(self.p.items(), ends)}
        slopes, m, v = (np.zeros_like(weights) for _ in range(3))
        self.p, g = views(weights), views(slopes)
        parts = [slice(a, a + ADAM) for a in range(0, len(weights), ADAM)]
        held, step = np.empty(ADAM, weights.dtype), 0
        for step, batch in enumerate(batches, 1):
            slow = np.float32(rate * min(1.0, step / 10) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            self.gradient(*batch, out=g)
            for part in parts:
                a, b, c = slopes[part], m[part], v[part]
                t = held[: len(a)]
                b *= np.float32(0.9)
                b += a
                np.multiply(a, a, out=t)
                c *= np.float32(0.99)
                c += t
                np.sqrt(c, out=t)
                t += np.float32(1e-7)
                np.divide(b, t, out=t)
                t *= slow
                weights[part] -= t
        return step

    def place_scores(self, cells: np.ndarray, lengths: np.ndarray, rows: int = ROWS) -> np.ndarray:
        """For sequences that lie end to end in ``cells``, the log probability of each place's cell. Every place is scored
        once, in a window where what comes before it is its context."""
        out, bounded, tables = np.zeros(len(cells), np.float32), self.bounded(), self.tables()
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
        before = np.concatenate(([START], cells[:-1]))
        before[starts[lengths > 0]] = START
        sequence, first, fresh = windows(lengths)
        size = np.minimum(lengths[sequence] - first, WINDOW)
        for kind in (0, WINDOW - STRIDE):
            mine = np.flatnonzero((fresh == kind) & (size > kind))
            mine = mine[np.argsort(size[mine], kind="stable")]
            for at in range(0, len(mine), rows):
                some = mine[at : at + rows]
                width = int(size[some].max())
                reach = (starts[sequence[some]] + first[some])[:, None] + np.arange(width)
                inside = np.arange(width)[None, :] < size[some][:, None]
                if not inside.all():
                    reach = np.where(inside, reach, reach[:, :1])
                scores = self.log_probabilities(before[reach], cells[reach], kind, bounded, tables)
                fresh_inside = inside[:, kind:]
                out[reach[:, kind:][fresh_inside]] = scores[fresh_inside]
        return out
