"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch: texts of a few kilobytes make batches of a few megabytes.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, whole."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are longer than the numbers Spark's default batch of 10,000 rows is meant for."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset (tests on one
    machine) a folder of this machine takes its place; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = _own_folder()
    return folder.rstrip("/")


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="llm-")


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder. What stands there goes when the driver ends. A folder
    that is another one on each machine of a cluster is refused."""
    from ..sources import Staging  # not needed, and not read, where tasks run

    return Staging(spark, folder=shared_folder(spark)).new_path()


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there, a lost executor
    costs nothing that was written, and later steps read only the columns they need."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *more: Column) -> DataFrame:
    """The whole row in one struct column ``row``, next to working columns: no column of the
    input can clash with a working column."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *more)


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows as they came, in the columns of ``docs``."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def least_id(id_col: str = "doc_id") -> list[Column]:
    """Sort keys under which the smallest id wins and a null id loses to any other."""
    return [F.col(id_col).isNull(), F.col(id_col)]
