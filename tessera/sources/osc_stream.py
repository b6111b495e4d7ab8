"""A replication folder as a streaming source: the changeset files of a feed, numbered from some point on, as rows of changes.

A changeset is one file ``NNN/NNN/NNN.osc.gz`` under the folder, and ``state.txt`` there tells the last number that is complete. The
offset of the stream is a sequence number, so a micro-batch is a range of whole changesets, and one that runs again reads the
same files. Each changeset is a partition of its own, read and parsed by the task that owns it, element by element, so a
batch of any number of changesets needs memory for some thousand rows a task.
"""

from __future__ import annotations

import gzip
import io
import re
from collections.abc import Iterator
from datetime import datetime
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.functions.coords import PER_DEGREE
from tessera.functions.ids import TYPE_NAMES
from tessera.operators.changes import FEED
from tessera.sources.shared import located, storage

NAME = "osmchange"
#: Rows of an Arrow batch.
ROWS = 5_000
_OPS = ("create", "modify", "delete")
_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?")


def changeset_path(sequence: int) -> str:
    return f"{sequence // 1_000_000:03d}/{sequence // 1000 % 1000:03d}/{sequence % 1000:03d}.osc.gz"


def state_of(text: str) -> int | None:
    """The sequence number of a state file."""
    found = re.search(r"(?m)^sequenceNumber=(\d+)", text)
    return int(found[1]) if found else None


def fixed(text: str | None) -> int | None:
    """Decimal text as fixed point; further decimals are cut."""
    if text is None:
        return None
    found = _NUMBER.fullmatch(text)
    if not found:
        raise ValueError(f"not a coordinate: {text}")
    size = int(found[2]) * PER_DEGREE + int((found[3] or "")[:7].ljust(7, "0"))
    return -size if found[1] else size


def combined(kind: int, number: int) -> int:
    value = kind << 62 | number
    return value - (1 << 64) if value >> 63 else value


def rows_of(file, sequence: int) -> Iterator[tuple]:
    """The changes of an osmChange document in their order, as ``changes.FEED``; an element is let go of as soon as it is read."""
    op, place, path = None, 0, []
    for event, node in ElementTree.iterparse(file, events=("start", "end")):
        if event == "start":
            path.append(node)
            if node.tag in _OPS and len(path) == 2:
                op = node.tag
            continue
        path.pop()
        if node.tag in TYPE_NAMES[:3] and len(path) == 2 and op is not None:
            kind = TYPE_NAMES.index(node.tag)
            refs, roles = [], []
            for child in node:
                if child.tag == "nd":
                    refs.append(int(child.get("ref")))
                elif child.tag == "member":
                    refs.append(combined(TYPE_NAMES.index(child.get("type")), int(child.get("ref"))))
                    roles.append(child.get("role"))
            tags = {child.get("k"): child.get("v") for child in node if child.tag == "tag"}
            at = datetime.fromisoformat(node.get("timestamp")) if node.get("timestamp") else None
            x, y = (fixed(node.get(c)) for c in ("lon", "lat")) if kind == 0 else (None, None)
            yield sequence, place, op, kind, int(node.get("id")), int(node.get("version")), at, tags, refs, x, y, roles
            place += 1
        if len(path) in (1, 2):
            path[-1].remove(node)


class Changeset(InputPartition):
    def __init__(self, sequence: int):
        self.sequence = sequence


class ChangesetStream(DataSourceStreamReader):
    def __init__(self, schema: StructType, folder: str, after: int):
        self.schema, self.folder, self.after = schema, folder, after

    def initialOffset(self) -> dict:
        return {"sequence": self.after}

    def _there(self) -> int:
        """The last complete changeset: what state.txt says, or where there is none the last file in a row without gaps."""
        fs, path = storage(self.folder)
        if fs.get_file_info(f"{path}/state.txt").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/state.txt") as file:
                return max(self.after, state_of(file.read().decode()) or self.after)
        last = self.after
        while fs.get_file_info(f"{path}/{changeset_path(last + 1)}").type == pafs.FileType.File:
            last += 1
        return last

    def latestOffset(self) -> dict:
        return {"sequence": self._there()}

    def partitions(self, start: dict, end: dict) -> list[Changeset]:
        return [Changeset(i) for i in range(start["sequence"] + 1, end["sequence"] + 1)]

    def commit(self, end: dict) -> None:
        """Nothing is kept between batches."""

    def read(self, partition: Changeset) -> Iterator[pa.RecordBatch]:
        """A changeset's rows; a file that is missing or broken fails the batch, and nothing of it is passed over."""
        fs, path = storage(f"{self.folder}/{changeset_path(partition.sequence)}")
        schema = to_arrow_schema(self.schema, timestamp_utc=True)
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = zip(*held)
            values = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(columns, schema)]
            return pa.RecordBatch.from_arrays(values, schema=schema)

        with fs.open_input_stream(path, compression=None) as raw, gzip.open(io.BufferedReader(_Readable(raw))) as file:
            for row in rows_of(file, partition.sequence):
                held.append(row)
                if len(held) == ROWS:
                    yield batch()
                    held.clear()
        if held:
            yield batch()


class _Readable(io.RawIOBase):
    """An Arrow stream as Python's raw one."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


class Changesets(DataSource):
    """``spark.readStream.format("osmchange").option("after", n).load(folder)``: the changesets after number n."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema: StructType) -> ChangesetStream:
        return ChangesetStream(schema, self.options["path"], int(self.options.get("after", -1)))


def stream(spark: SparkSession, folder: str, after: int = -1) -> DataFrame:
    """Changes after a sequence number as a streaming table ``changes.FEED``."""
    spark.dataSource.register(Changesets)
    return spark.readStream.format(NAME).option("after", after).load(located(spark, folder))
