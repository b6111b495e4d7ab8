"""A store of immutable, versioned Parquet tables under one manifest.

A commit writes new table folders and then one manifest file, moved into place in one step; readers see the tables of the
manifest they opened. Savepoints, rollback and snapshots are moves of manifests and never touch data.

A small change of a large table is written as a delta, the keys that it replaces and the rows that come instead, and the table
is read as its base with its deltas. After a number of them the deltas are made one, and when they hold a share of the
base's bytes the table is written anew, in the layout that the manifest keeps for it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import located, storage

FORMAT = 4
#: Deltas of a table before they are made one, and their bytes for one byte of the base before it is written anew.
DELTAS, SHARE = 8, 0.25


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, located(spark, root.rstrip("/"))
        self.fs, self.path = storage(self.root)
        self.fs.create_dir(self.path, recursive=True)

    def _file(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _exists(self, name: str) -> bool:
        return self.fs.get_file_info(self._file(name)).type == pafs.FileType.File

    def manifest(self) -> dict:
        if not self._exists("manifest.json"):
            return {"format": FORMAT, "version": 0, "tables": {}, "properties": {}, "savepoints": []}
        with self.fs.open_input_stream(self._file("manifest.json")) as file:
            found = json.loads(file.read())
        if found["format"] != FORMAT:
            raise ValueError(f"store format {found['format']}, not {FORMAT}")
        return found

    def _put(self, manifest: dict, name: str = "manifest.json") -> None:
        part = self._file(f".{uuid.uuid4().hex}")
        with self.fs.open_output_stream(part) as file:
            file.write(json.dumps(manifest, indent=1).encode())
        self.fs.move(part, self._file(name))

    def read(self, table: str) -> DataFrame:
        return self._merged(self.manifest()["tables"][table])

    def _merged(self, parts: list) -> DataFrame:
        """A table's base and, for each delta ``(keys, folder of keys, folder of rows)``, the rows that are not replaced and those that come."""
        out = self.spark.read.parquet(parts[0])
        for keys, gone, rows in parts[1:]:
            out = out.join(self.spark.read.parquet(gone), keys, "left_anti").unionByName(self.spark.read.parquet(rows))
        return out

    def _is_empty(self, delta: list) -> bool:
        """By the files' footers, without a job."""
        for folder in delta[1:]:
            fs, _ = storage(folder)
            if any(pq.read_metadata(f.path, filesystem=fs).num_rows for f in self._files(folder)):
                return False
        return True

    def _one_delta(self, deltas: list, write) -> list[list]:
        """One delta in place of several with the same keys: all keys that they replace, and the rows that are left of what came."""
        if any(keys != deltas[0][0] for keys, _, _ in deltas):
            return deltas
        gone = reduce(DataFrame.union, [self.spark.read.parquet(g) for _, g, _ in deltas]).distinct()
        rows = self._merged([deltas[0][2], *deltas[1:]])
        return [[deltas[0][0], write(gone), write(rows)]]

    def _files(self, folder: str) -> list:
        fs, path = storage(folder)
        return [f for f in fs.get_file_info(pafs.FileSelector(path)) if f.base_name.startswith("part-")]

    def _bytes(self, folder: str) -> int:
        return sum(f.size for f in self._files(folder))

    def tables(self) -> list[str]:
        return sorted(self.manifest()["tables"])

    def commit(self, tables: dict[str, DataFrame], sort: dict[str, str | list[str]] | None = None, deltas: dict[str, tuple[DataFrame, DataFrame]] | None = None, **properties) -> int:
        """Write new versions of some tables; the others stay. A table named in ``sort`` is laid out in ranges of its columns, now and
        whenever it is written again.

        ``deltas`` gives for a table the keys to replace (a table of the key columns) and the rows that come instead.
        """
        found = self.manifest()
        version = found["version"] + 1

        def write(name: str, df: DataFrame) -> str:
            folder = f"{self.root}/{name}/v={version}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(folder)
            return folder

        def write_base(name: str, df: DataFrame) -> None:
            columns = layout.get(name)
            found["tables"][name] = [write(name, df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df)]

        layout = found["sort"] = found.get("sort", {}) | {name: [c] if isinstance(c, str) else c for name, c in (sort or {}).items()}
        for name, df in tables.items():
            write_base(name, df)
        for name, (gone, rows) in (deltas or {}).items():
            delta = [gone.columns, write(name, gone.distinct()), write(name, rows)]
            if self._is_empty(delta):
                continue
            parts = [*found["tables"][name], delta]
            if sum(self._bytes(f) for _, *folders in parts[1:] for f in folders) > SHARE * self._bytes(parts[0]):
                write_base(name, self._merged(parts))
            elif len(parts) > DELTAS:
                found["tables"][name] = [parts[0], *self._one_delta(parts[1:], lambda df, name=name: write(name, df))]
            else:
                found["tables"][name] = parts
        found["version"] = version
        found["properties"] |= properties
        self._put(found)
        return version

    def set_properties(self, **properties) -> None:
        found = self.manifest()
        found["properties"] = {k: v for k, v in (found["properties"] | properties).items() if v is not None}
        self._put(found)

    def properties(self) -> dict:
        return self.manifest()["properties"]

    def savepoint(self) -> None:
        found = self.manifest()
        kept = {k: found[k] for k in ("tables", "properties")}
        self._put(found | {"savepoints": [*found["savepoints"], kept]})

    def rollback(self) -> None:
        """Back to the last savepoint, which is used up."""
        found = self.manifest()
        if not found["savepoints"]:
            raise ValueError("there is no savepoint to go back to")
        *rest, last = found["savepoints"]
        self._put(found | last | {"savepoints": rest, "version": found["version"] + 1})

    def forget(self) -> None:
        """Drop the last savepoint; the store stays as it is."""
        found = self.manifest()
        self._put(found | {"savepoints": found["savepoints"][:-1]})

    def release(self) -> None:
        """Forget the savepoints: what has happened since stays."""
        self._put(self.manifest() | {"savepoints": []})

    def snapshot(self, target: str) -> Store:
        """A store of its own that shares the table folders, which never change."""
        other = Store(self.spark, target)
        other._put(self.manifest() | {"savepoints": []})
        return other

    def purge(self, *tables: str, properties: tuple[str, ...] = ()) -> None:
        found = self.manifest()
        found["tables"] = {k: v for k, v in found["tables"].items() if k not in tables}
        found["properties"] = {k: v for k, v in found["properties"].items() if k not in properties}
        self._put(found | {"version": found["version"] + 1})

    def compact(self, table: str, key: str | None = None) -> None:
        """Rewrite a table in ranges of a key, or as it was laid out before (else by its first column), with few files."""
        known = self.manifest().get("sort", {}).get(table)
        self.commit({table: self.read(table)}, sort={table: key or known or self.read(table).columns[0]})

    def stats(self) -> DataFrame:
        """``(table_name, n_files, n_bytes, n_rows)`` by name."""
        rows = []
        for name, parts in sorted(self.manifest()["tables"].items()):
            files = [f for folder in (parts[0], *(f for _, *folders in parts[1:] for f in folders)) for f in self._files(folder)]
            rows.append((name, len(files), sum(f.size for f in files), self._merged(parts).count()))
        return self.spark.createDataFrame(rows, "table_name string, n_files long, n_bytes long, n_rows long")

    def delete_range(self, table: str, column: str, first: int, end: int) -> None:
        """Drop the rows whose column lies from ``first`` up to but not including ``end``."""
        inside = (F.col(column) >= first) & (F.col(column) < end)
        self.commit({table: self.read(table).filter(~F.coalesce(inside, F.lit(False)))})
