from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str) -> None:
    """Write a frame as Parquet, replacing what is at ``path``."""
    df.write.mode("overwrite").parquet(path)


def save_external(
    df: DataFrame,
    name: str,
    path: str,
    files: int | None = None,
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
) -> None:
    """Write a frame as a catalog table whose data lives at ``path``.

    ``partition_by`` names columns that become folders. ``rebalance`` deals rows out so that files come
    near the advisory size of the session, whatever the work above produced: AQE joins small pieces and
    splits a folder that holds most of the rows. ``files`` asks for that many output files instead. Both
    cost a shuffle of the result, so that the work above it keeps its own parallelism.
    """
    if files is not None and rebalance:
        raise ValueError("files asks for a number, rebalance for a size: choose one")
    out = df.hint("rebalance", *partition_by) if rebalance else df if files is None else df.repartition(files)
    writer = out.write.mode("overwrite").option("path", path)
    (writer.partitionBy(*partition_by) if partition_by else writer).saveAsTable(name)


@contextmanager
def persisted(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[DataFrame]:
    """Keep a frame that is used several times, and release it at the end of the block.

    Lost blocks are recomputed from lineage. A frame that is dear to recompute is better ``staged``.
    """
    kept = df.persist(level)
    try:
        yield kept
    finally:
        kept.unpersist()


def staging_folder(spark: SparkSession) -> str | None:
    """The shared folder for written intermediate results: ``spark.checkpoint.dir``, if it is set."""
    return spark.conf.get("spark.checkpoint.dir", None) or None


def _comes_back(spark: SparkSession, folder: str) -> bool:
    """Does a small frame written to a folder come back whole, written and read as any staged frame is?

    It has so many tasks that every executor at work gets some. What was written goes again.
    """
    context = spark.sparkContext
    mark = context._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/seen-{uuid.uuid4()}")
    files = mark.getFileSystem(context._jsc.hadoopConfiguration())
    n = 4 * context.defaultParallelism
    try:
        spark.range(0, n, 1, n).write.parquet(mark.toString())
        back = spark.read.schema("id bigint").parquet(mark.toString()).agg(F.count("*"), F.sum("id")).first()
    except (Py4JJavaError, PySparkException):
        return False  # some machine does not find what another one wrote
    finally:
        files.delete(mark, True)
    return tuple(back) == (n, n * (n - 1) // 2)


def _seen_by_executors(spark: SparkSession, folder: str) -> bool:
    """Does what executors write to a local folder come back whole? No executor, no answer."""
    # the driver is one of those in the status
    return _comes_back(spark, folder) and spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() > 1


#: Local folders that the executors of an application have been found to share with its driver.
_SHARED: set[tuple[str, str]] = set()


def _on_one_machine(spark: SparkSession, folder: str) -> bool:
    """Does a path without or with the scheme ``file`` mean a folder of each machine by itself?

    It does not where it is mounted on all machines; the executors are asked, once in an application."""
    if spark.sparkContext.master.startswith("local"):
        return False
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getScheme() != "file":
        return False
    asked = spark.sparkContext.applicationId, folder
    if asked not in _SHARED and _seen_by_executors(spark, folder):
        _SHARED.add(asked)
    return asked not in _SHARED


class Staging:
    """Frames that later steps read several times, written once to the shared checkpoint folder.

    Calling it with a frame runs that frame's job at once and returns it read back from Parquet: each
    later use reads only its own columns, an executor lost later costs no recomputation, and
    Catalyst knows the size, so it broadcasts what turned out small and only that. Where the session
    names no folder the frame comes back as it is, lazy.

    The folder has to be one that all executors share. A folder of the local file system is refused
    on a cluster, where each executor would keep its own part, unless what the executors write there comes
    back whole, or ``shared`` says that it is mounted on all machines. ``folder`` names another folder than the session's. ``clear``, or the end of a ``with`` block, removes what was written:
    only then, as frames built on it read it when they run. What nobody cleared goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, shared: bool = False, folder: str | None = None):
        self.spark = spark
        self.folder = folder or staging_folder(spark)
        self.paths: list[str] = []
        self.tables: list[str] = []
        if self.folder and not shared and _on_one_machine(spark, self.folder):
            raise ValueError(f"spark.checkpoint.dir is a folder of one machine: {self.folder}")

    def new_path(self) -> str:
        """A path of its own below the folder, where nothing is yet; it is removed with the rest."""
        path = f"{self.folder.rstrip('/')}/staged-{uuid.uuid4()}"
        target, files = self._at(path)
        files.mkdirs(target)  # only what is there can be marked to go
        files.deleteOnExit(target)
        self.paths.append(path)
        return f"{path}/data"

    def _at(self, path: str) -> tuple:
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(context._jsc.hadoopConfiguration())

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.folder is None:
            return df
        path = self.new_path()
        write_parquet(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
        """The frame written with its rows dealt to ``buckets`` by the hash of ``keys`` (as many as the
        session has shuffle partitions). A later join or aggregate on these keys, or on more columns
        beside them, reads it without an exchange. It costs one exchange here, so it pays for a frame
        that meets others on its keys more than once. Without a folder the frame stays as it is, lazy.
        """
        if self.folder is None:
            return df
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, name = self.new_path(), f"staged_{uuid.uuid4().hex}"
        dealt = df.repartition(n, *keys)  # as the buckets are, so each is one file
        dealt.write.bucketBy(n, *keys).option("path", path).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def clear(self) -> None:
        """Remove the written frames."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in self.paths:
            target, files = self._at(path)
            files.delete(target, True)
            files.cancelDeleteOnExit(target)
        self.paths, self.tables = [], []

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *error) -> None:
        self.clear()


def staged(df: DataFrame) -> DataFrame:
    """One frame staged (see ``Staging``); the owner of the folder removes it."""
    return Staging(df.sparkSession)(df)


def as_it_is(df: DataFrame) -> DataFrame:
    """Instead of staging: the frame stays lazy."""
    return df
