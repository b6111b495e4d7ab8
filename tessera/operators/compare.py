"""Differences between two versions of a table, and checks across tables."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that one task groups, about, where their number is known.
ROWS_A_TASK = 1_000_000


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with ``change``: added, removed or changed; rows that are the same in both do not appear."""
    # maps have no equality, and so are compared as their entries by key
    values = [F.array_sort(F.map_entries(c)).alias(c) if t.startswith("map") else F.col(c) for c, t in old.dtypes if c not in keys]
    a = old.select(*keys, F.struct(*values).alias("old"), F.lit(True).alias("was"))
    b = new.select(*keys, F.struct(*values).alias("new"), F.lit(True).alias("is"))
    met = a.join(b, keys, "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return met.select(*keys, change.alias("change")).filter("change is not null")


def unequal_ranges(old: DataFrame, new: DataFrame, key: str, ranges: int = 64) -> list[tuple[int | None, int | None]]:
    """Ranges of a long key, from (included) and up to (excluded, None: open), in which two versions of a table are not the same.

    The key's quantiles in the old version cut the ranges, and of each range a digest is compared: the rows' number and the sums of two
    hashes of them. So what comes to the driver is a line a range, and each version is read once and not shuffled.
    """
    cuts = sorted(set(old.select(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 1000).alias("q")).first().q or []))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= F.col(key)))
    columns = [F.array_sort(F.map_entries(c)) if t.startswith("map") else F.col(c) for c, t in sorted(old.dtypes)]

    def digests(table: DataFrame) -> DataFrame:
        hashes = [F.xxhash64(F.lit(i), *columns).cast("decimal(38,0)") for i in (1, 2)]
        return table.groupBy(place.alias("range")).agg(F.count("*").alias("n"), *[F.sum(h).alias(f"h{i}") for i, h in enumerate(hashes)])

    met = digests(old).union(digests(new)).groupBy("range").agg(F.count("*").alias("sides"), *[F.count_distinct(c).alias(c) for c in ("n", "h0", "h1")])
    ends = [None, *cuts, None]
    found = met.filter("sides < 2 or n > 1 or h0 > 1 or h1 > 1").select("range").collect()
    return [(ends[r.range], ends[r.range + 1]) for r in sorted(found)]


def diff_by_ranges(old: DataFrame, new: DataFrame, keys: list[str], ranges: int = 64) -> DataFrame:
    """``diff`` of two versions of a table that are laid out by the first of the keys, a long: only ranges that are not the same are joined."""
    key = F.col(keys[0])
    within = [(F.lit(True) if a is None else key >= a) & (F.lit(True) if b is None else key < b) for a, b in unequal_ranges(old, new, keys[0], ranges)]
    near = reduce(or_, within, F.lit(False))
    return diff(old.filter(near), new.filter(near), keys)


def tile_patch(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What to do to each tile entry: ``keys`` with ``action`` add, replace or delete; both tables have a json column, which may be null."""
    was, now = old.select(*keys, F.col("json").alias("before"), F.lit(True).alias("was")), new.select(*keys, F.col("json").alias("after"), F.lit(True).alias("is"))
    met = was.join(now, keys, "full_outer")
    action = F.when(F.col("was").isNull(), "add").when(F.col("is").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "replace")
    return met.select(*keys, action.alias("action"), "after").filter("action is not null")


def apply_patch(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    kept = old.join(patch.select(*keys), keys, "left_anti").select(*keys, "json")
    return kept.union(patch.filter("action <> 'delete'").select(*keys, F.col("after").alias("json")))


def missing_references(edges: DataFrame, held: DataFrame, rows: int | None = None) -> DataFrame:
    """References that should be listed and are not; both tables are ``(ref, referrer)``.

    Both meet in one grouping, dealt by reference and referrer before it, so that a task groups what it was dealt and nothing more;
    ``rows``, how many both tables have together where that is known, keeps that to some ``ROWS_A_TASK`` whatever their size.
    """
    keys = ["ref", "referrer"]
    both = edges.select(*keys, F.lit(False).alias("listed")).union(held.dropna(subset=keys).select(*keys, F.lit(True)))
    tasks = [] if rows is None else [max(1, -(-rows // ROWS_A_TASK))]
    return both.repartition(*tasks, *keys).groupBy(*keys).agg(F.bool_or("listed").alias("listed")).filter("not listed").select(*keys)


def stale(source: DataFrame, store: DataFrame, key: str = "id") -> DataFrame:
    """Elements of a source that the store lacks, has in an older version, or has otherwise in the same version."""
    values = [c for c in source.columns if c not in (key, "version")]
    a, b = source.alias("a"), store.alias("b")
    same = reduce(and_, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in values), F.lit(True))
    problem = F.when(F.col(f"b.{key}").isNull(), "missing").when(F.col("b.version") < F.col("a.version"), "older").when((F.col("b.version") == F.col("a.version")) & ~same, "different")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "left").select(F.col(f"a.{key}").alias(key), problem.alias("problem")).filter("problem is not null")
