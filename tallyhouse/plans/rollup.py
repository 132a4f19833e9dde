"""Usage kept in tiers of partial sums: hours, days, months, of which only changed ones are built again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.operators.rating import USAGE_KEY, period_usage
from tallyhouse.sources.upserts import folders, only_parts, overwrite_parts

_SERIES = [c for c in USAGE_KEY if c != "period"]
_PARTIAL = "external_subscription_id string, code string, gpu_type string, period timestamp, units_micro long, events long"


def merged_partials(partials: DataFrame, unit: str) -> DataFrame:
    """Partial sums of shorter periods to sums of longer ones; sums and counts merge in any order, exactly."""
    longer = partials.withColumn("period", F.date_trunc(unit, F.col("period")))
    return longer.groupBy(*USAGE_KEY).agg(F.sum("units_micro").alias("units_micro"), F.sum("events").alias("events"))


def _part(period: Column, unit: str) -> Column:
    return F.date_format(period, "yyyy-MM-dd" if unit == "day" else "yyyy-MM")


#: Each tier, the one that it is summed up from, and the time that its partitions cover.
_TIERS = {"hour": (None, "day"), "day": ("hour", "day"), "month": ("day", "month")}


@dataclass(frozen=True)
class UsageTiers:
    """Hour and day partials in partitions of a day, months in partitions of a month.

    ``refresh`` takes the days that changed.  Hours of those days are summed from their events, days from their hours, and the months
    that they belong to from the days: a late or deleted event costs one day of events and one month of day partials.
    A partition that has nothing left is replaced by a row of no events, which readers do not see.
    """

    path: str

    def _stored(self, spark: SparkSession, tier: str) -> DataFrame:
        root, schema = f"{self.path}/{tier}", f"{_PARTIAL}, part string"
        return spark.read.schema(schema).parquet(root) if folders(spark, root, complete=False) else spark.createDataFrame([], schema)

    def usage(self, spark: SparkSession, unit: str) -> DataFrame:
        """Usage by hour, day or month, as :func:`period_usage` would sum it from all events."""
        return self._stored(spark, unit).where("events > 0").drop("part")

    def _put(self, rows: DataFrame, tier: str, parts: DataFrame) -> None:
        """Replaces the given partitions by their rows, also those that have none."""
        parted = rows.withColumn("part", _part(F.col("period"), _TIERS[tier][1]))
        none = parts.select(*[F.lit(None).cast(t).alias(c) for c, t in (("external_subscription_id", "string"), ("code", "string"), ("gpu_type", "string"), ("period", "timestamp"))], F.lit(0).cast("long").alias("units_micro"), F.lit(0).cast("long").alias("events"), "part")
        overwrite_parts(parted.select(*none.columns).unionByName(none), f"{self.path}/{tier}", "part")

    def refresh(self, events: DataFrame, changed: DataFrame) -> None:
        """Builds the tiers again for the days in ``changed(day)``; ``events`` are all events as they are now.

        Events have ``quantity_micro`` and ``gpu_type`` and are deduplicated.  Where they are a table that is partitioned by a column ``event_date``, only the changed days of it are read.
        """
        spark = events.sparkSession
        days = changed.select(F.to_date("day").alias("day")).where("day is not null").distinct()
        if "event_date" in events.columns:
            touched = only_parts(events, "event_date", days.select(F.col("day").alias("event_date")))
        else:
            touched = events.withColumn("day", F.to_date(F.timestamp_seconds("timestamp"))).join(days, "day", "left_semi")
        day_parts = days.select(_part(F.col("day"), "day").alias("part"))
        self._put(period_usage(touched, "hour"), "hour", day_parts)
        for tier in ("day", "month"):
            source, span = _TIERS[tier]
            parts = days.select(_part(F.col("day"), span).alias("part")).distinct()
            stored = self._stored(spark, source)
            if span == "day":
                wanted = only_parts(stored, "part", parts)
            else:
                known = stored.select("part").distinct()
                of_months = known.join(parts.select(F.col("part").alias("span")), F.substring("part", 1, 7) == F.col("span"), "left_semi")
                wanted = only_parts(stored, "part", of_months)
            wanted = wanted.where("events > 0").drop("part")
            self._put(merged_partials(wanted, tier), tier, parts)


def changed_days(*events: DataFrame) -> DataFrame:
    """(day): the days of events that came, went or changed."""
    days = [e.select(F.to_date(F.timestamp_seconds("timestamp")).alias("day")) for e in events]
    first, *rest = days
    for other in rest:
        first = first.unionByName(other)
    return first.distinct()
