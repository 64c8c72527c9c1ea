"""Result archives (.npz) as a data source: one file for each run, one row for each of its trees.

Reading: one partition a file; of a file only the arrays of the asked columns are opened. Writing: a task writes its runs under
names that no reader looks at, and the commit gives them their own; an abort deletes them.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from arbora.sources.formats import InvalidInput

#: Column -> (key in the file, type, whether it has a value for each tree). The keys of the format.
COLUMNS = {
    "parents": ("struct", "array<int>", True), "phi": ("phi", "array<array<double>>", True), "eta": ("eta", "array<array<double>>", True),
    "count": ("count", "bigint", True), "llh": ("llh", "double", True), "prob": ("prob", "double", True), "newick": ("newick", "string", True), "actions": ("action_info", "array<array<int>>", True),
    "clusters": ("clusters", "array<array<string>>", False), "samples": ("sampnames", "array<string>", False), "garbage": ("garbage", "array<string>", False), "seed": ("seed", "bigint", False),
    "explored": ("branches_explored", "bigint", False), "cut": ("branches_cut", "bigint", False),
    "rel_ids": ("clustrel_posterior_vids", "array<string>", False), "rels": ("clustrel_posterior_rels", "array<array<array<double>>>", False),
}
OWN = {"path": "string", "run": "string", "tree_idx": "int"}
SUFFIX = ".npz"


def schema_of(columns: list[str]) -> str:
    return ", ".join(f"{c} {OWN.get(c) or COLUMNS[c][1]}" for c in columns)


def _plain(x: Any) -> Any:
    """Rows and tuples as lists, so that they can be written."""
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def packed(rows: list[dict]) -> bytes:
    """The file of one run from its rows, in the order of tree_idx. Numbers are arrays, all else is JSON; nulls are left out."""
    arrays: dict[str, Any] = {}
    for column, (key, kind, by_tree) in COLUMNS.items():
        values = [_plain(r.get(column)) for r in rows]
        if all(v is None for v in values):
            continue
        value = values if by_tree else values[0]
        if kind in ("bigint", "double"):
            arrays[key] = np.array(value)
        else:
            same = len({json.dumps(np.shape(v)) for v in values}) == 1 if by_tree and "string" not in kind and not any(_ragged(v) for v in values) else False
            if same:
                arrays[key] = np.array(value)
            else:
                arrays[f"{key}.json"] = np.array(json.dumps(value))
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _ragged(v: Any) -> bool:
    return v is None or isinstance(v, list) and any(isinstance(x, list) for x in v) and len({len(x) if isinstance(x, list) else -1 for x in v}) > 1


def unpacked(data: Any, path: str, columns: list[str]) -> list[dict]:
    """Rows of a file (anything seekable) with the asked columns. Missing keys give nulls, files of pickled objects are refused."""
    with np.load(data, allow_pickle=False) as z:
        names = set(z.files)

        def get(column: str) -> Any:
            key = COLUMNS[column][0]
            if f"{key}.json" in names:
                return json.loads(str(z[f"{key}.json"]))
            return z[key].tolist() if key in names else None

        try:
            shape = get("parents") or []
            got = {c: get(c) if c != "parents" else shape for c in columns if c in COLUMNS}
        except ValueError as e:
            raise InvalidInput(f"{path}: {e}") from e
    run = path.rsplit("/", 1)[-1].split(".")[0]
    for c, v in got.items():
        if COLUMNS[c][2] and v and len(v) != len(shape):
            raise InvalidInput(f"{path}: lists of different lengths")
    own = lambda i: {"path": path, "run": run, "tree_idx": i}
    return [own(i) | {c: (v[i] if v else None) if COLUMNS[c][2] else v for c, v in got.items()} for i in range(len(shape))]


@dataclass
class ArchiveFile(InputPartition):
    path: str
    value: Any = None


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)  # where a file is, and where it belongs


class ArchiveSource(DataSource):
    """``spark.read.format("arbora_archive").load(path)``: all .npz files below a path that pyarrow's file systems can open."""

    @classmethod
    def name(cls) -> str:
        return "arbora_archive"

    def schema(self) -> str:
        return schema_of([*OWN, *COLUMNS])

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options["path"], schema.names, overwrite)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.columns = path, schema, schema.names
        if unknown := set(self.columns) - set(OWN) - set(COLUMNS):
            raise ValueError(f"archives have no columns {sorted(unknown)}")

    def partitions(self) -> list[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        one = system.get_file_info(root)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [ArchiveFile(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(SUFFIX) and "/_" not in f.path[len(root) - 1 :]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        system, _ = fs.FileSystem.from_uri(self.path)
        with system.open_input_file(partition.path) as f:
            rows = unpacked(f, partition.path, self.columns)
        if rows:
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in self.columns} for r in rows], to_arrow_schema(self.schema))


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.job, self.overwrite = path, columns, uuid.uuid4().hex, overwrite

    def _root(self) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = self._root()
        system.create_dir(f"{root}/_{self.job}", recursive=True)
        done = Written()
        for run, rows in groupby((r.asDict() for r in iterator), key=lambda r: r["run"]):
            if not run or "/" in run or any(run == name.rsplit("/", 1)[-1][: -len(SUFFIX)] for _, name in done.files):
                raise ValueError(f"runs need plain names, and their rows one after the other: {run!r}")
            at = f"{root}/_{self.job}/{uuid.uuid4().hex}"
            with system.open_output_stream(at) as f:
                f.write(packed(sorted(rows, key=lambda r: r["tree_idx"])))
            done.files.append((at, f"{root}/{run}{SUFFIX}"))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, root = self._root()
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(root)):
                if f.path.endswith(SUFFIX):
                    system.delete_file(f.path)
        for message in messages:
            for at, name in message.files if message else ():
                system.move(at, name)
        self._clean(system, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._root())

    def _clean(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.job}")


def read_archives(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """path, run (the file's name up to its first dot), tree_idx and the asked columns (see ``COLUMNS``; all, if not given)."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format(ArchiveSource.name()).schema(schema_of([*OWN, *(columns or COLUMNS)])).load(path)


def write_archives(trees: DataFrame, path: str, mode: str = "append") -> None:
    """One file for each ``run`` of ``trees`` (run, tree_idx, and any of ``COLUMNS``). A run's trees (its beam width times its
    instances at most) meet in one task; runs are dealt over all tasks."""
    trees.sparkSession.dataSource.register(ArchiveSource)
    known = [c for c in ("run", "tree_idx", *COLUMNS) if c in trees.columns]
    trees.select(*known).repartition("run").sortWithinPartitions("run", "tree_idx").write.format(ArchiveSource.name()).mode(mode).save(path)
