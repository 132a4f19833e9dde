"""Rows that come after the watermark: kept aside, and their ticks computed again.

A stream drops what is later than its watermark.  Here every batch is split by the same rule before it is metered: late rows
are spilled with their batch number, and ``recompute`` rebuilds the partitions of the result that they touch,
from the history of all samples, by dynamic partition overwrite.  All writes are named by batch number and partition, so repeating one changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.sources.upserts import folders, only_parts, overwrite_parts, removed

#: Column that history and results are partitioned by.
PART = "tick_part"
_FORMATS = {"day": "yyyy-MM-dd", "hour": "yyyy-MM-dd-HH", "minute": "yyyy-MM-dd-HH-mm"}


def tick_part(at: Column, unit: str = "hour") -> Column:
    """The partition of a time: its day, hour or minute as text."""
    return F.date_format(at, _FORMATS[unit])


@dataclass(frozen=True)
class LateTable:
    """Samples by arrival, and a result that is computed from them by partitions of time.

    ``build`` makes result rows, with their ``tick_ts``, of samples; it must make the rows of a partition from that partition's samples alone.
    ``schema`` is the samples', ``at`` their time, ``window_s`` the length of a tick and ``delay_s`` the watermark's delay.
    """

    path: str
    schema: str
    build: Callable[[DataFrame], DataFrame]
    result: str
    at: str = "ts"
    window_s: int = 60
    delay_s: int = 600
    unit: str = "hour"

    def _read(self, spark: SparkSession, kind: str, schema: str) -> DataFrame:
        root = f"{self.path}/{kind}"
        if not folders(spark, root, complete=False):
            return spark.createDataFrame([], f"{schema}, {PART} string")
        return spark.read.schema(f"{schema}, {PART} string").parquet(root)

    def history(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "history", f"{self.schema}, batch_number long")

    def late(self, spark: SparkSession) -> DataFrame:
        """Late rows that no recomputation has taken up yet."""
        return self._read(spark, "late", f"{self.schema}, batch_number long")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The result, with the partition of each row."""
        return self._read(spark, "result", self.result)

    def _limit(self, spark: SparkSession, number: int) -> int | None:
        """Microseconds that the batches before have closed: the latest time among them less the delay."""
        before = [n for n in folders(spark, f"{self.path}/seen") if int(n.split("=")[1]) < number]
        if not before:
            return None
        newest = max(before, key=lambda n: int(n.split("=")[1]))
        found = spark.read.schema("latest_us long").parquet(f"{self.path}/seen/{newest}").first()
        return None if found is None or found["latest_us"] is None else found["latest_us"] - self.delay_s * 1_000_000

    def _parted(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, tick_part(F.col(self.at), self.unit))

    def take(self, batch: DataFrame, number: int) -> None:
        """A ``foreachBatch`` function: samples go to the history, late ones are spilled, and ticks of the others are computed.

        A sample is late if its whole tick lies before what earlier batches have closed.  Should its partition be
        computed again for others that are on time, it is counted then already.  Samples without a time are dropped.
        """
        spark, width = batch.sparkSession, self.window_s * 1_000_000
        limit = self._limit(spark, number)
        rows = self._parted(batch.where(F.col(self.at).isNotNull())).withColumn("batch_number", F.lit(number).cast("bigint"))
        overwrite_parts(rows, f"{self.path}/history", PART, "batch_number")
        mine = self.history(spark).where(F.col("batch_number") == number)
        micros = F.unix_micros(self.at)
        ends = micros - F.pmod(micros, F.lit(width)) + width
        is_late = F.lit(False) if limit is None else ends <= F.lit(limit)
        overwrite_parts(mine.where(is_late), f"{self.path}/late", PART, "batch_number")
        self._rebuild(spark, mine.where(~is_late).select(PART).distinct())
        # the latest time so far: this batch's or the one before
        latest = F.max(micros) if limit is None else F.greatest(F.max(micros), F.lit(limit + self.delay_s * 1_000_000))
        mine.agg(latest.alias("latest_us")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/seen/batch={number}")

    def _rebuild(self, spark: SparkSession, parts: DataFrame) -> None:
        source = only_parts(self.history(spark), PART, parts)
        rows = self.build(source.drop(PART, "batch_number"))
        overwrite_parts(rows.withColumn(PART, tick_part(F.col("tick_ts"), self.unit)), f"{self.path}/result", PART)

    def recompute(self, spark: SparkSession) -> list[str]:
        """Computes the partitions that late rows touch again, with them, and empties the spill; gives those partitions' names.

        If it fails on the way the spill is still there, and running it again gives the same table.
        """
        root = f"{self.path}/late"
        parts = [n for n in folders(spark, root, complete=False) if n.startswith(f"{PART}=")]
        if parts:
            touched = self.late(spark).select(PART).distinct()
            self._rebuild(spark, touched)
            for n in parts:
                removed(spark, f"{root}/{n}")
        return [n.split("=", 1)[1] for n in parts]
