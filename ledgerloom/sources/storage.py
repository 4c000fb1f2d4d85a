"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table's files for each partition of a shuffle, and the most partitions that this asks for.
PARTITION, PARTITIONS = 4 << 20, 4_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset a local master, as in tests, gets a temporary one that
    is then set; on a cluster, where no machine would see the files of another, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        folder = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_partitions(spark: SparkSession, df: DataFrame) -> Iterator[None]:
    """Shuffles of what runs in the block have a partition for every PARTITION bytes of the largest table read, where that
    is more than the session's number, and are put together to no more than twice that: what a task sorts stays of one
    size, and in memory, as tables grow."""
    number = partitions_for(spark, df)
    new = {"spark.sql.shuffle.partitions": str(number), "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(2 * PARTITION)}
    old = {k: spark.conf.get(k, None) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def partitions_for(spark: SparkSession, df: DataFrame) -> int:
    """A partition for every PARTITION bytes of the largest table read, the session's number at least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    most = max([n for n in sizes if n < 1 << 60], default=0)  # where Spark knows no size, it says the largest long
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-most // PARTITION), PARTITIONS))


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors. small: by shuffles of
    small_partitions()."""
    path = new_path(df.sparkSession, name)
    with small_partitions(df.sparkSession, df) if small else nullcontext():
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """written(), small, as a table that lies by key: what groups or joins by it later finds its rows together."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    entry = path.rsplit("/", 1)[1].replace("-", "_")
    with small_partitions(spark, df):
        number = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(number, key).sortBy(key).format("parquet").option("path", path).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"drop table {entry}")  # the catalog's entry alone: files of a table with a path stay
    out.written_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Scratch:
    """Tables that are removed together: what is written() in the block goes at its end, but for what kept() is given.

    Results that are read later must be kept, or not depend on these tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        return self.owns(written(df, name))

    def owns(self, table: DataFrame) -> DataFrame:
        """A table that another function wrote goes with these."""
        if path := getattr(table, "written_at", None):
            self.paths.append(path)
        return table

    @staticmethod
    def kept(df: DataFrame, name: str) -> DataFrame:
        return written(df, name)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Removes tables of written() that nothing will read any more."""
    for table in tables:
        delete(spark, table.written_at)
