"""Cut lineage by writing a DataFrame to the cluster's shared folder and reading it back."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_local_dirs: dict[str, str] = {}
_scopes: list[list[str]] = []
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a single-machine session (``local[...]``) may run without the setting: it gets a fresh temporary folder.
    Anywhere else a folder of one machine would not be seen by the others, so the missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="spark-")
    return _local_dirs[app]


def save(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet below the shared folder and return the path."""
    path = f"{shared_dir(df.sparkSession)}/arbora/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    for paths in _scopes:
        paths.append(path)
    return path


def load(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    """Saved tables of one schema as one scan, however many there are."""
    return spark.read.schema(schema).parquet(*paths)


def stash(df: DataFrame, name: str, release: bool = True) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and return the table that was written.

    The result has no lineage: a lost executor costs a reread, never a recomputation. The shuffles that made ``df`` are no
    longer referenced; with ``release`` a garbage collection lets Spark's context cleaner free their files before the next step
    adds its own (where the session has a JVM beside it; else the cleaner does so in its own time). Loops over small tables go
    without it. The table stays until ``drop`` or the end of a ``temporary`` block.
    """
    spark, schema = df.sparkSession, df.schema
    path = save(df, name)
    del df
    if release:
        gc.collect()
        if jvm := getattr(spark, "_jvm", None):
            jvm.System.gc()
    table = load(spark, schema, path)
    _paths[table] = path
    return table


def _delete(spark: SparkSession, folder: str) -> None:
    if jvm := getattr(spark, "_jvm", None):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    else:
        system, at = fs.FileSystem.from_uri(folder)
        system.delete_dir(at)


def drop(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete tables of ``stash``, or saved ones by their paths, that nothing will read again: by the file access of the session
    where it has a JVM beside it, else by that of Arrow, which knows local folders and the common object stores."""
    for path in (t if isinstance(t, str) else _paths.pop(t) for t in tables):
        _delete(spark, path.rsplit("/", 1)[0])  # its own folder, named by a uuid


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end: use what they lead to, such as a written result, inside."""
    _scopes.append(paths := [])
    try:
        yield
    finally:
        _scopes.pop()
        drop(spark, *paths)
