"""Associative keyed updates: set deltas, map deltas and counters, as aggregations over the operands in their order.

What counts for a pair of key and element is the last operand that names it, so operands may be merged in any grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import ids


def set_operands(deltas: DataFrame) -> DataFrame:
    """``(key, op_seq, adds, dels)`` as one row for each element, ``(key, value, op_seq, added)``."""
    adds = deltas.select("key", F.explode("adds").alias("value"), "op_seq", F.lit(True).alias("added"))
    return adds.union(deltas.select("key", F.explode("dels").alias("value"), "op_seq", F.lit(False).alias("added")))


def merge_sets(operands: DataFrame) -> DataFrame:
    """``(key, value, op_seq, added)`` with the last operand of each pair; inside one operand an addition wins. Partial merges
    keep removals, so their results can be merged again."""
    last = operands.groupBy("key", "value").agg(F.max(F.struct("op_seq", "added")).alias("last"))
    return last.select("key", "value", "last.op_seq", "last.added")


def set_state(operands: DataFrame) -> DataFrame:
    """``(key, value)`` that are in the sets after all operands."""
    return merge_sets(operands).filter("added").select("key", "value")


def set_arrays(state: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(ids.unsigned_struct(F.col("value"))))
    return state.groupBy("key").agg(held.alias("held")).select("key", F.col("held.combined_id").alias("state"))


def merge_maps(operands: DataFrame) -> DataFrame:
    """``(key, id, op_seq, value)`` with the last write of each entry; a null value is a removal and is kept for later merges."""
    last = operands.groupBy("key", "id").agg(F.max_by(F.struct("op_seq", "value"), "op_seq").alias("last"))
    return last.select("key", "id", "last.op_seq", "last.value")


def map_state(operands: DataFrame) -> DataFrame:
    return merge_maps(operands).filter("value is not null").select("key", "id", "value")


def add_counters(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """``(key, value)``: each counter with its deltas added, wherever it first appears."""
    return base.select("key", "value").union(deltas.select("key", "value")).groupBy("key").agg(F.sum("value").alias("value"))
