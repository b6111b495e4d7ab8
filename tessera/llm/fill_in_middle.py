"""Fill-in-the-middle: texts rearranged so that a model learns to fill a gap from both sides.

A text's units are matches of a pattern over code points, cut without storing them: a first pass over a lazy match iterator
counts them, a second one advances another iterator to the two ranks where the middle begins and ends and reads off their
places. So whatever the number of units, a text needs memory for itself and two places only. Which form a text
takes and where it is cut follow from a digest of a seed and its doc_id, so a task that runs again gives the same row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text

# A unit's pattern, the three marks and the seed.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Texts of a hundred that are rearranged, and of a hundred of these that put the suffix first.
RATE, SPM_RATE = 50, 80

_UNIT = re.compile(UNIT)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers below 2^32 from a digest of the seed and the decimal doc_id (nothing for a null one)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4))


def count_units(text: str) -> int:
    """The first pass: how many units there are."""
    return sum(1 for _ in _UNIT.finditer(text))


def places(text: str, first: int, last: int) -> tuple[int, int]:
    """The second pass: where ``first`` and ``last`` units end, ``first`` not being larger; one iterator goes to both."""
    units = _UNIT.finditer(text)

    def end_of(n: int, before: int) -> int:
        at = next(islice(units, n - 1, n), None) if n else None
        return before if at is None else at.end()

    begin = end_of(first, 0)
    return begin, end_of(last - first, begin)


def rearranged(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """``(n, form, prefix_chars, middle_chars, output)`` of one text."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    a, b = places(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``: its units, form, cuts and rearranged text.

    A null or empty text has no units and stays plain; one that holds a mark, or whose draw says so, stays as it is. A null
    doc_id draws from the seed alone; repeated rows give equal rows; texts of any length are cut whole; an empty table
    gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [rearranged(text, i, seed, rate, spm_rate) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            n, form, prefix, middle, output = zip(*rows) if rows else ((),) * 5
            long, text = pa.int64(), batch.column(1).type
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, long), pa.array(form, pa.string()), pa.array(prefix, long), pa.array(middle, long), pa.array(output, text)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output and its form came from. A rearranged text holds each mark once, so the marks part it again."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == PSM, F.concat(part(1), part(3), part(2))).when(form == SPM, F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """``transform`` with the output as its digest, and the digest of the text that is restored from it; odd rows as there."""
    digest = lambda text, name: F.sha2(text, 256).alias(name)
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"), digest(restored(F.col("output"), F.col("form")), "restored_sha256")
    )
