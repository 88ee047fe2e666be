"""Session settings the plans in this package are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# A join on a hot key (one gender, one wiki) is split by AQE at run time. Spark gives up that
# split when an aggregate on the same key sits directly above the join, unless it is told that
# one more exchange is worth it.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows at the Python boundary are images: keep Arrow batches small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
}

# AQE joins shuffled pieces up to this size, compressed. What repeats packs well: 64 MB, Spark's own
# value, of a page history are three million rows, and a join with the fold above it holds them as
# sorts and hash tables, a gigabyte in one task. Pieces of a quarter hold a quarter, however many.
PIECE = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
PIECE_SIZE = "16m"


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time SQL settings above on a session and return it.

    Cluster sizing, the checkpoint folder and ``spark.sql.shuffle.partitions`` stay with the
    deployment, and so does the size of shuffled pieces where it names one.
    """
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if spark.conf.get(PIECE, None) is None:
        spark.conf.set(PIECE, PIECE_SIZE)
    return spark
