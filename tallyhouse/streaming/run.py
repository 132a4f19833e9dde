"""Running a stream over what is there now, into a table."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share (``spark.checkpoint.dir``).

    Where it is unset, a session in one process (as in tests) gets a temporary folder; on a cluster it is an error.
    """
    base, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not base:
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-streams-")
    return f"{base.rstrip('/')}/streams/{uuid.uuid4().hex}"


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """State with timers needs the RocksDB store; the session's own comes back afterwards."""
    old = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, old)


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet table, with the table's own schema.

    The table may be one file: a stream takes a single file only by a pattern, here its last letter.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def appended(result: DataFrame) -> DataFrame:
    """All rows that an append-mode result has emitted once the input that is there has been read."""
    spark, folder = result.sparkSession, shared_folder(result.sparkSession)
    query = result.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def upserted(result: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key of an update-mode result: batches are kept with their number, the last one counts."""
    spark, folder = result.sparkSession, shared_folder(result.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch_number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/{number:012d}")

    query = result.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*result.schema, T.StructField("batch_number", T.LongType())])).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    rest = [c for c in result.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_number").alias("r"))
    return latest.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])
