import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_in_middle as fim

TEXTS = ["one two three", "  lead and trail  ", " \t\n", "x", "été　日本 𝒳y  \n z", "holds <P> a mark", "<S", "a <M", "P> <S M>", "<M>"]


def plain(doc_id, text):
    """The units as a list, cut by slicing it."""
    units = re.findall(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted(x % (n + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_a_list_of_units(make, odd_rows):
    draw = random.Random(5)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(80)]
    rows += [(1000 + i, "".join(draw.choice(" \tab<PSM>é\n　") for _ in range(draw.randrange(40)))) for i in range(300)] + odd_rows
    got = fim.transform(make(rows)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for (i, text), r in zip(rows, got):
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (i, *plain(i, text or ""))
        assert r.back == (text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(make([])).count() == 0


def test_digests(make, odd_rows):
    for (i, text), r in zip(odd_rows, fim.digests(make(odd_rows)).collect()):
        assert r.output_sha256 == hashlib.sha256(plain(i, text or "")[-1].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("rate,spm_rate,form", [(0, 0, "plain"), (100, 0, "psm"), (100, 100, "spm")])
def test_rates(make, rate, spm_rate, form):
    assert {r.form for r in fim.transform(make([(i, "a b c") for i in range(9)]), rate=rate, spm_rate=spm_rate).collect()} == {form}


def test_every_cut():
    text = " a bb\tc  "
    units = re.findall(fim.UNIT, text)
    for first in range(len(units) + 1):
        for last in range(first, len(units) + 1):
            assert fim.places(text, first, last) == (len("".join(units[:first])), len("".join(units[:last])))
