"""Tables and files in the folder that the cluster shares."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.storage import Scratch, dropped, new_path, shared_dir, written

__all__ = ["Scratch", "aside", "columns", "dropped", "file_system", "free", "new_path", "shared_dir", "small_batches", "written"]


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """While the block runs its jobs, Arrow batches hold so many bytes: a batch is in memory several times over, in the
    JVM and in Python. Afterwards the session has its own bound again."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column of those taken has it, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame, *without: str) -> list[Column]:
    """All columns by their names as they are written, dots included, but for those."""
    gone = {c.lower() for c in without}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def aside(df: DataFrame) -> DataFrame:
    """The frame with its columns named c0, c1, ...: Arrow functions can't be given columns with dots in their names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def file_system(uri: str):
    """(pyarrow file system, path) of a URI; executors use it to write and read plain files."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)
