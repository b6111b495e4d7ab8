"""What filters take from a corpus in every order: an audit of how they overlap.

The orders of the filters form a trie. It is walked depth first: a node holds the documents that are left after its filters,
persisted, and one aggregation over them counts what each further filter removes, the edges that lead on. What is
left depends on which filters were applied and not on their order, so a set of filters is worked out once and remembered by
its name, and a walk that reaches it by another order uses the counts that lie in the shared folder. Only the survivors along
the path are persisted, five tables at most; they come from a written table, so a lost executor's part is worked out again.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from operator import add

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir

# The five filters' limits and marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SPACE, MARKS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
FILTERS = "ABCDE"
#: A text with more copies than this share of all documents, of which there are fewer than its inverse, is looked up by broadcast.
HOT_SHARE = 1 / 1000
#: Parts in a file of counts.
PARTS_A_FILE = 50_000
EDGE = "state string, part string, held long, filter string, removed long, good_lost long, toxic_lost long"


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """For each filter that looks at one text, whether the text with these words fails it."""
    letters = F.length(text)
    capitals = letters - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * letters,
        "D": text.rlike(MARKS),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """``rows (doc_id, digest, ...)`` with ``E``: whether a row of a smaller doc_id has the same digest.

    The smallest doc_id of each text comes from partial minima. Texts with very many copies, whose number is bounded by
    ``HOT_SHARE``, meet theirs by broadcast; the others by a shuffle in which no key has a larger share.
    """
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    firsts = materialize(firsts, "firsts")
    least = max(1, math.ceil(rows.count() * HOT_SHARE))
    hot = F.broadcast(firsts.filter(F.col("copies") > least).select("digest", "first"))
    many = rows.join(hot, "digest")
    few = rows.join(hot, "digest", "left_anti").join(firsts.filter(F.col("copies") <= least).select("digest", "first"), "digest", "left")
    return many.union(few).withColumn("E", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("digest", "first")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, A, B, C, D, E, good, toxic)``, a row for each document: its source, the filters that it fails and its labels, written."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    failures = text_failures(F.col("text"), F.col("words"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(f) for f, c in failures.items()])
    rows = later_copies(materialize(rows, "judged"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(None).cast("boolean")
    # rows without a doc_id have no label, and as one key of a join would all go to one task
    marked = rows.filter("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.filter("doc_id is null").withColumns({"good": no, "toxic": no}))
    return materialize(marked.select("part", *FILTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]), "marked")


def _counts(survivors: DataFrame, left: str) -> DataFrame:
    """For each part, how many documents there are and what each filter of ``left`` would remove: the edges out of a node."""
    removed = [
        F.struct(
            F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost")
        )
        for f in left
    ]
    return survivors.groupBy("part").agg(F.count("*").alias("held"), F.array(*removed).alias("edges"))


def walk(root: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``(state, part, held, filter, removed, good_lost, toxic_lost)``: the edges of the trie of all orders, each set of filters once.

    ``root`` has a boolean column for each filter. ``state`` is the set of the filters applied before, as sorted letters. A part
    has no row for a state that leaves nothing of it.
    """
    folder = f"{shared_dir(root.sparkSession)}/edges-{uuid.uuid4().hex}"
    files = 1 + root.select("part").distinct().count() // PARTS_A_FILE
    known: set[str] = set()

    def visit(state: str, survivors: DataFrame) -> None:
        known.add(state)
        left = [f for f in filters if f not in state]
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            made = _counts(survivors, "".join(left)).withColumn("state", F.lit(state))
            made.select("state", "part", "held", F.explode("edges").alias("e")).select("state", "part", "held", "e.*").coalesce(files).write.mode("append").parquet(folder)
            for f in left:
                below = "".join(sorted(state + f))
                if below not in known:
                    visit(below, survivors.filter(~F.col(f)).drop(f))
        finally:
            survivors.unpersist()

    visit("", root)
    return root.sparkSession.read.schema(EDGE).parquet(folder)


def steps(filters: str = FILTERS) -> Iterator[tuple[str, int, str, str]]:
    """``(filter_order, step, filter, state before it)`` of every order."""
    for order in permutations(filters):
        for i, f in enumerate(order):
            yield "".join(order), i + 1, f, "".join(sorted(order[:i]))


def orders_through(state: str, filters: str = FILTERS) -> int:
    """How many orders take the edge from ``state`` by one given filter."""
    return math.factorial(len(state)) * math.factorial(len(filters) - len(state) - 1)


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part (source), order of the filters and step; the counts are the part's documents.

    ``kept`` after the step and ``removed`` by it, ``redundant`` (failing its filter, removed earlier), ``unique_fails`` (failing its
    filter only), ``good_lost`` and ``toxic_lost`` among the removed, ``shapley``: the filter's removals over all orders.

    A null text is empty and a null source the empty string; a row with a null doc_id is nobody's later copy and has no label;
    of rows that repeat a doc_id none is the other's copy; several labels of a doc_id count if one of them is 1; texts are
    judged whole; an empty table gives no rows. Other columns are not read.
    """
    root = judged(docs, labels)
    edges = walk(root, filters)
    fails = reduce(add, [F.col(f).cast("int") for f in filters])
    whole = root.groupBy("part").agg(F.array(*[F.struct(F.lit(f).alias("filter"), F.count_if(F.col(f)).alias("fails"), F.count_if(F.col(f) & (fails == 1)).alias("unique_fails")) for f in filters]).alias("of"))
    whole = whole.select("part", F.explode("of").alias("o")).select("part", "o.*")
    through = F.element_at(F.create_map(*[F.lit(x) for n in range(len(filters)) for x in (n, orders_through(filters[:n], filters))]), F.length("state"))
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * through).cast("long").alias("shapley"))
    # five filters have 600 steps, whatever the corpus
    listed = root.sparkSession.createDataFrame(list(steps(filters)), "filter_order string, step int, filter string, state string")
    rows = whole.join(shapley, ["part", "filter"]).join(F.broadcast(listed), "filter")
    met = rows.join(edges, ["part", "filter", "state"], "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = none("removed")
    return met.select(
        "part", "filter_order", "step", none(F.col("held") - F.col("removed")).alias("kept"), removed.alias("removed"), (F.col("fails") - removed).alias("redundant"), "unique_fails",
        none("good_lost").alias("good_lost"), none("toxic_lost").alias("toxic_lost"), "shapley",
    )
