"""A minimal acyclic transducer: words that share beginnings and endings in one automaton, whose arcs put out numbers.

Words are added in rising byte order. What a word's numbers have in common with those of words of the same beginning stands as
early as it can; states behind the last word's common beginning are finished, and one that equals an earlier finished state
(the same arcs, outputs and end) is that state. The automaton is written as flat sorted arrays, which readers map into memory:
all tasks of a machine share one copy, and only what they touch is read. A batch of words is looked up together,
a byte of every word at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tessera.llm.pieces import spread

MAGIC = b"TSRLEX01"
Numbers = tuple[int, ...]
#: Words that are looked up together.
TOGETHER = 32_768


def _shared(a: Numbers, b: Numbers) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Open:
    """A state on the path of the last word, which may still change. ``end`` is what a word that ends here puts out last, None if none does."""

    __slots__ = ("arcs", "end")

    def __init__(self):
        self.arcs: list[list] = []
        self.end: Numbers | None = None

    def put_before(self, numbers: Numbers) -> None:
        for arc in self.arcs:
            arc[1] = numbers + arc[1]
        if self.end is not None:
            self.end = numbers + self.end


class Builder:
    """Takes ``add(word, numbers)`` in rising order of distinct words, then gives the file's bytes."""

    def __init__(self):
        self.path, self.last = [_Open()], None
        self.finished: dict[tuple, int] = {}

    def _finish(self, state: _Open) -> int:
        """The number of a finished state: that of an equal one, where there is one. States are numbered as they are finished, so arcs lead to smaller numbers."""
        name = (state.end, tuple(map(tuple, state.arcs)))
        return self.finished.setdefault(name, len(self.finished))

    def _close(self, depth: int) -> None:
        while len(self.path) > depth + 1:
            done = self.path.pop()
            self.path[-1].arcs[-1][2] = self._finish(done)

    def add(self, word: bytes, numbers: Numbers) -> None:
        if self.last is not None and word <= self.last:
            raise ValueError("words must come in rising order")
        common = _shared(word, self.last or b"")
        self._close(common)
        for i in range(common):
            arc = self.path[i].arcs[-1]
            n = _shared(arc[1], numbers)
            if n < len(arc[1]):
                self.path[i + 1].put_before(arc[1][n:])
                arc[1] = arc[1][:n]
            numbers = numbers[n:]
        for byte in word[common:]:
            self.path[-1].arcs.append([byte, numbers, -1])
            self.path.append(_Open())
            numbers = ()
        self.path[-1].end = numbers
        self.last = word

    def to_bytes(self) -> bytes:
        self._close(0)
        start = self._finish(self.path[0])
        pool: dict[Numbers, int] = {(): 0}
        flat: list[int] = []

        def placed(numbers: Numbers) -> tuple[int, int]:
            if numbers not in pool:
                pool[numbers] = len(flat)
                flat.extend(numbers)
            return pool[numbers], len(numbers)

        arcs, ends = [], []
        for number, (end, out) in enumerate(self.finished):
            ends.append((-1, 0) if end is None else placed(end))
            arcs += [(number << 8 | byte, target, *placed(numbers)) for byte, numbers, target in out]
        keys = np.array([a[0] for a in arcs], "<i8")  # states in order and each one's arcs by byte, so sorted
        rest = np.array([a[1:] for a in arcs], "<i4").reshape(len(arcs), 3)
        sections = [keys, *(np.ascontiguousarray(rest[:, i]) for i in range(3)), *(np.array([e[i] for e in ends], "<i4") for i in range(2)), np.array(flat, "<u4")]
        head = np.array([len(arcs), len(ends), len(flat), start], "<i8")
        return MAGIC + head.tobytes() + b"".join(x.tobytes() for x in sections)


class Transducer:
    """Reads what ``Builder`` gives: bytes, or a file that is mapped into memory."""

    def __init__(self, data: bytes | np.ndarray):
        data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        if data[:8].tobytes() != MAGIC:
            raise ValueError("not a transducer")
        self.n_arcs, self.n_states, n_flat, self.start = data[8:40].view("<i8").tolist()
        at = 40

        def section(n: int, kind: str) -> np.ndarray:
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return data[at - size : at].view(kind)

        self.keys = section(self.n_arcs, "<i8")
        self.target, self.out_at, self.out_n = (section(self.n_arcs, "<i4") for _ in range(3))
        self.end_at, self.end_n = (section(self.n_states, "<i4") for _ in range(2))
        self.flat = section(n_flat, "<u4")

    @classmethod
    def mapped(cls, path: str) -> Transducer:
        return cls(np.asarray(np.memmap(path, np.uint8, "r")))

    def get(self, words: pa.Array) -> list[bytes | None]:
        """The numbers of each word as little-endian unsigned 32-bit integers, None for a word that is not in the automaton."""
        words = words.cast(pa.large_binary())
        return [x for i in range(0, len(words), TOGETHER) for x in self._some(words.slice(i, TOGETHER))]

    def _some(self, words: pa.Array) -> list[bytes | None]:
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        places: list[tuple[np.ndarray, np.ndarray]] = []  # the words that have an arc at each depth, and the arc
        out: list[bytes | None] = [None] * len(words)
        live, state = np.arange(len(words)), np.full(len(words), self.start, np.int64)
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        depth = 0
        while len(live):
            over = sizes[live] == depth
            ended.append((live[over], state[over]))
            live, state = live[~over], state[~over]
            if not self.n_arcs:
                break
            keys = state << 8 | data[starts[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, keys), self.n_arcs - 1)
            hit = self.keys[arc] == keys
            live, arc = live[hit], arc[hit]
            state = self.target[arc].astype(np.int64)
            places.append((live, arc))
            depth += 1
        last, final = (np.concatenate(x) for x in zip(*ended))
        whole = self.end_at[final] >= 0
        last, final = last[whole], final[whole]
        known = np.zeros(len(words), bool)
        known[last] = True
        kept = [(w[k], a[k]) for w, a in places for k in [known[w]]]
        word = np.concatenate([*(w for w, _ in kept), last])
        at = np.concatenate([*(self.out_at[a] for _, a in kept), self.end_at[final]]).astype(np.int64)
        n = np.concatenate([*(self.out_n[a] for _, a in kept), self.end_n[final]]).astype(np.int64)
        # depths come in order, so a stable order by word puts each word's outputs one after another
        order = np.argsort(word, kind="stable")
        order = order[n[order] > 0]
        numbers = self.flat[spread(at[order], n[order], np.cumsum(n[order]))].tobytes()
        totals = np.bincount(word, weights=n, minlength=len(words)).astype(np.int64) * 4
        upto = np.cumsum(totals)
        for i, a, b in zip(last.tolist(), (upto - totals)[last].tolist(), upto[last].tolist()):
            out[i] = numbers[a:b]
        return out
