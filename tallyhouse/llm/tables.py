"""Small helpers that the text operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a batch that goes to Python: texts are long, and a batch is held several times over.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def long_rows(spark: SparkSession) -> None:
    """Tells the session that rows are long, for what it runs from here on; a smaller batch that was set already stays."""
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    long_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a session in one process (as in tests) gets a temporary folder of its own; on
    a cluster that would scatter tables over the executors' disks, so it is an error there.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def materialised(df: DataFrame) -> DataFrame:
    """The rows of ``df``, computed once and kept where a lost executor does not lose them."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like :func:`materialised`, as a Parquet table: columnar, compressed, its columns pruned when read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """How many parts the cluster's owner deals a shuffle into; all bucket counts follow it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unsigned_crc32(column):
    """CRC-32 of a string's UTF-8 bytes, 0 to 2**32 - 1; of null as of the empty text."""
    return F.crc32(F.coalesce(column, F.lit("")).cast("binary"))
