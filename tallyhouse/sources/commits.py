"""Events in a catalog table that batches are committed to once, laid out so that duplicates are found without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.rating import dedupe_events
from tallyhouse.sources.sinks import EVENT_COLUMNS
from tallyhouse.sources.upserts import removed

_COLUMNS = "transaction_id string, external_subscription_id string, code string, `timestamp` bigint, properties string"


@dataclass(frozen=True)
class EventTable:
    """Usage events by date and batch, bucketed by transaction id.

    A batch that is committed again replaces itself, whatever dates it had before.  All events of a transaction id are in one bucket, so
    :meth:`deduped` needs no exchange; the number of buckets is fixed when the table is made (some hundred MB a bucket and date).
    """

    name: str
    buckets: int = 64
    location: str | None = None

    def create(self, spark: SparkSession) -> None:
        where = f"LOCATION '{self.location}'" if self.location else ""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({_COLUMNS}, batch_id bigint, event_date date) USING parquet "
            f"PARTITIONED BY (batch_id, event_date) CLUSTERED BY (transaction_id) SORTED BY (transaction_id) INTO {self.buckets} BUCKETS {where}"
        )

    def commit(self, events: DataFrame, batch_id: int) -> None:
        """Writes a batch.  Each bucket of it is put together in one task, so a date gets one file a bucket."""
        spark = events.sparkSession
        dated = events.select(*EVENT_COLUMNS, F.lit(batch_id).cast("bigint").alias("batch_id"), F.to_date(F.timestamp_seconds("timestamp")).alias("event_date"))
        self.rollback(spark, batch_id)
        old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            dated.repartition(self.buckets, "transaction_id").write.insertInto(self.name, overwrite=True)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)

    def rollback(self, spark: SparkSession, batch_id: int) -> None:
        """Takes a batch out, if it is there."""
        spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch_id = {int(batch_id)})")
        # files of a table with a location of its own stay when its partitions go
        removed(spark, f"{self._location(spark)}/batch_id={int(batch_id)}")
        spark.catalog.refreshTable(self.name)

    def _location(self, spark: SparkSession) -> str:
        return self.location or spark.sql(f"DESCRIBE FORMATTED {self.name}").where("col_name = 'Location'").first()["data_type"]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name)

    def deduped(self, spark: SparkSession) -> DataFrame:
        """One event for each transaction id, from any number of batches (see :func:`dedupe_events`)."""
        return dedupe_events(self.rows(spark).select(*EVENT_COLUMNS, "event_date"))
