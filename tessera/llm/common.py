"""What the operators of this subpackage share: the shared folder, tables cut from their lineage, and byte columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import materialize, shared_dir, storage

__all__ = ["columns_of", "id_and_text", "materialize", "read_table", "shared_dir", "small_side", "split_words", "storage", "utf8"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, with a null text as an empty one."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def columns_of(table: DataFrame) -> list[Column]:
    """All columns of a table, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in table.columns]


def utf8(column: pa.Array) -> list[bytes]:
    """A text column of an Arrow batch as UTF-8 bytes."""
    if pa.types.is_large_string(column.type):
        return pc.cast(column, pa.large_binary()).to_pylist()
    return pc.cast(column, pa.binary()).to_pylist()


_SPACED = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_SPACED_LOWER = _SPACED.lower()


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of all texts end to end, and how many each text has; nulls have none. ``lower`` lowers A-Z."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = bytes(memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]).translate(_SPACED_LOWER if lower else _SPACED)
    texts = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data)])
    lists = pc.split_pattern(texts, " ")
    flat = lists.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    of_text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    return flat.filter(filled), np.bincount(of_text[filled.to_numpy(zero_copy_only=False)], minlength=len(texts))


def small_side(table: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if its counted rows are few; a larger one is left to a shuffle join."""
    return F.broadcast(table) if table.count() <= max_rows else table
