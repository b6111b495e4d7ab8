import re
from collections import Counter
from itertools import permutations

from tessera.llm import filter_audit as fa

LABELS = "doc_id long, quality int, toxic int, part string, A boolean, held long"


def fails(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    w = re.findall(r"[^ \t-\r]+", text)
    out = {"A"} if len(w) < 200 else set()
    out |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    earlier = [r[0] for r in rows if (r[1] or "") == text and r[0] is not None]
    return out | ({"E"} if doc_id is not None and min(earlier) < doc_id else set())


def plain(rows, labels):
    """Every order applied to every document."""
    good, toxic = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    failing = [fails(rows, i) for i in range(len(rows))]
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in failing[i]]
                left = [i for i in left if f not in failing[i]]
                shapley[f] += len(gone)
                total = sum(f in failing[i] for i in mine)
                lost = [sum(rows[i][0] in held for i in gone) for held in (good, toxic)]
                out[part, order, step] = [len(left), len(gone), total - len(gone), sum(failing[i] == {f} for i in mine), *lost]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "'x' AS part", "true AS A", "1 AS digest", "'f' AS filter", "3 AS `first`")
    marks = spark.createDataFrame([(*r, "p", False, 1) for r in labels], LABELS)
    found = fa.audit(docs, marks).collect()
    return found, {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in found}


def test_against_every_order(spark):
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:50]), "a b " * 150, " ".join(words) + " #", "ABC " * 300, "", None, "Very Long Text " * 20_000, " ".join(w.upper() for w in words), "  x\t\n"]
    rows = [(i, texts[i * 7 % len(texts)], ["s", "t", None, ""][i % 4]) for i in range(40)]
    rows += [(3, texts[0], "s"), (3, texts[0], "s"), (None, texts[0], "t"), (None, "only without an id", "u"), (50, "only without an id", "u")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 40, 2)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (99, 1, 1)]
    labels = [(a, b, None if c is None else int(c)) for a, b, c in labels]
    found, got = audited(spark, rows, labels)
    assert len(found) == len(got) == 3 * 600 + 600 and got == plain(rows, labels)


def test_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(fa, "HOT_SHARE", 0.2)
    rows = [(i, "the same" if i % 3 else f"text {i % 9}", "s") for i in range(60)]
    assert audited(spark, rows, [])[1] == plain(rows, [])


def test_sets_are_visited_once(spark):
    root = fa.judged(spark.createDataFrame([(1, "a #", "s")], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS))
    edges = fa.walk(root).collect()
    assert len({(r.state, r["filter"]) for r in edges}) == len(edges) <= 80
    assert {r["filter"] for r in edges if r.state == ""} == set("ABCDE")


def test_empty_table(spark):
    assert audited(spark, [], [])[0] == []
