"""Secret scan with multipart linking.

Strong kinds stand alone: an assigned secret, an access identifier, a long hexadecimal run. Weak candidates are parts that
prove nothing by themselves: a short access identifier, a bare 40-character key, a short assigned value, an endpoint. A
weak part is reported only where a complementary part lies within its scope, a span of characters around it in the same
document. Parts are sorted by start and each one's scope is looked up among the complementary parts with their running
largest end, an interval join that takes a search for each part and role; scopes never leave a document, so no row moves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = 200

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "weak_access", "weak_key", "weak_assign", "endpoint")

#: The role that each kind plays in a credential.
ROLE = {"assign": "secret", "hex": "secret", "weak_key": "secret", "weak_assign": "secret", "access": "id", "weak_access": "id", "endpoint": "place"}
#: What must be near a weak part of a kind; only strong parts and weak parts of another role count.
NEEDS = {"weak_access": ("secret",), "weak_key": ("id",), "weak_assign": ("id", "place"), "endpoint": ("id", "secret")}

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_WEAK_ACCESS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AROA)[A-Z0-9]{8,}")
# What parts a name from its value (=, ., -, _) may stand before a key.
_WEAK_KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_LONG = re.compile(r"[^\s]{40,}")
_ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?|s3|ftp)://[^\s\"'<>]+")


class Part(NamedTuple):
    start: int
    order: int
    end: int
    kind: str


def base_parts(text: str) -> list[Part]:
    """The strong parts of a text, ordered by start and kind; places are code points, ends exclusive."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [Part(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [Part(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [Part(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[Part]:
    """Parts that prove nothing by themselves, ordered by start and kind."""
    found = []
    low = text.lower()
    if "AKIA" in text or "ASIA" in text or "AROA" in text:
        found += [Part(m.start(), 3, m.end(), "weak_access") for m in _WEAK_ACCESS.finditer(text)]
    for run in _LONG.finditer(text):
        for m in _WEAK_KEY.finditer(text, run.start(), run.end()):
            key = m.group()
            if any(c.isdigit() for c in key) and any(c.islower() for c in key) and any(c.isupper() for c in key):
                found.append(Part(m.start(), 4, m.end(), "weak_key"))
    if any(w in low for w in _WORDS):
        found += [Part(m.start(), 5, m.end(), "weak_assign") for m in ASSIGN.finditer(text) if 6 <= m.end(2) - m.start(2) < MIN_ASSIGN and any(c.isdigit() for c in m.group(2))]
    if "://" in text:
        found += [Part(m.start(), 6, m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    return sorted(found)


def weak_parts(text: str, base: list[Part]) -> list[Part]:
    """``candidates`` that count in company. One inside a strong part of its own role says nothing more and is dropped; one that plays
    another role, as an endpoint around a secret does, stays."""
    found = candidates(text)
    if not found or not base:
        return found
    out = []
    for role in {ROLE[p.kind] for p in found}:
        mine = [p for p in base if ROLE[p.kind] == role]
        starts = np.array([p.start for p in mine], np.int64)
        reach = np.maximum.accumulate(np.array([p.end for p in mine], np.int64))
        asked = [p for p in found if ROLE[p.kind] == role]
        before = np.searchsorted(starts, [p.start for p in asked], side="right")
        out += [p for p, k in zip(asked, before.tolist()) if not k or reach[k - 1] < p.end]
    return sorted(out)


def linked(base: list[Part], weak: list[Part], scope: int = SCOPE) -> list[Part]:
    """The weak parts whose scope, the part and ``scope`` characters on either side, touches a part of a role that they need."""
    if not weak:
        return []
    near: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for role in ("id", "secret", "place"):
        mine = sorted(p for p in (*base, *weak) if ROLE[p.kind] == role)
        near[role] = np.array([p.start for p in mine], np.int64), np.maximum.accumulate(np.array([p.end for p in mine], np.int64))
    out = []
    for p in weak:
        for role in NEEDS[p.kind]:
            starts, reach = near[role]
            k = int(np.searchsorted(starts, p.end + scope, side="right"))
            if k and reach[k - 1] >= p.start - scope:
                out.append(p)
                break
    return out


def find(text: str, scope: int = SCOPE) -> tuple[list[Part], list[Part]]:
    """The base parts of a text, and all its parts with the linked ones."""
    base = base_parts(text)
    weak = linked(base, weak_parts(text, base), scope)
    return base, sorted([*base, *weak]) if weak else base


def written(parts: list[Part]) -> str:
    return ",".join(f"{p.kind}:{p.start}:{p.end}" for p in parts)


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row of ``docs``, over whole texts.

    A null or empty text has no parts (an empty spans, the digest of nothing); null ids, repeated rows and long texts give a
    row each; an empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for text in batch.column(1).to_pylist():
                base, every = find(text, scope)
                for kind, n in zip(KINDS, counts):
                    n.append(sum(p.kind == kind for p in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    table = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return table.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, scope: int = SCOPE, text_col: str = "text") -> DataFrame:
    """``docs`` with every found part, linked ones too, replaced by <kind>; texts without parts stay as they are, null stays null.

    Of parts that overlap, the first counts, and the longer one of two that start together as listed in ``KINDS``. Repeated
    rows and null ids are redacted like any other; texts are read whole; an empty table gives an empty result; the other
    columns, whatever their names, stay as they are and where they are.
    """

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            if text:
                _, parts = find(text, scope)
                pieces, at = [], 0
                for p in parts:
                    if p.end > at:
                        pieces += [text[at : p.start], f"<{p.kind}>"] if p.start >= at else []
                        at = p.end
                text = "".join([*pieces, text[at:]]) if parts else text
            out.append(text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(f"`{text_col}`")))
