"""Metering as one stream: tenants from reconciles, measures from samples, joined while both run.

The batch operators look up the latest reconcile of every tick and join the measures of the tick's namespaces.  Here a reconcile is
laid out to the ticks that it is current for, so "the reconcile at or before the tick" becomes an equality of
windows; the join keeps a window until the watermark has passed it on both sides, and tenants without measures come out then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.settings import DEFAULT_NAMING, Naming
from tallyhouse.operators import convert
from tallyhouse.streaming.jobs import WATERMARK

#: Kinds of samples and the measures that they add up to.
MEASURES = ("cpu_milli", "memory_bytes", "storage_bytes", "lb_count")


def _micros(seconds: int):
    return F.lit(seconds * 1_000_000).cast("bigint")


def stream_tenant_ticks(reconciles: DataFrame, interval_s: int = 60, hold_s: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """``reconciles(tick_ts, …)``, one row for each tenant that a reconcile found, to a row for each tick that the reconcile is current for.

    A reconcile is current from its time until ``hold_s`` later, the distance of reconciles; ticks are multiples of ``interval_s``.  The
    tick's window ends with the tick.  A reconcile that no tick falls to gives no row.
    """
    at, step = F.unix_micros("tick_ts"), _micros(interval_s)
    first = at + F.pmod(-at, step)
    ticks = F.when(first < at + _micros(hold_s), F.sequence(first, at + _micros(hold_s) - 1, step))
    laid = reconciles.select(*[c for c in reconciles.columns if c != "tick_ts"], F.explode(ticks).alias("tick_us"))
    # a time inside the window that ends with the tick
    timed = laid.select("*", F.timestamp_micros(F.col("tick_us") - 1).alias("inside")).drop("tick_us").withWatermark("inside", watermark)
    return timed.select(F.window("inside", f"{interval_s} seconds").alias("window"), *[c for c in timed.columns if c != "inside"])


def stream_measures(samples: DataFrame, interval_s: int = 60, watermark: str = WATERMARK, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """``samples(ts, namespace, kind, object, value)`` to (window, namespace, a column for each measure).

    Of each object and kind the last sample in the window counts, and they are added up; one state for all kinds.
    """
    last = samples.withWatermark("ts", watermark).groupBy(F.window("ts", f"{interval_s} seconds"), "namespace", "kind", "object").agg(F.max(F.struct("ts", "value")).alias("s"))
    timed = last.select(F.window_time("window").alias("at"), "namespace", "kind", F.col("s.value").alias("value"))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == m, F.col("value"))), F.lit(0)).cast("bigint").alias(m) for m in measures]
    return timed.groupBy(F.window("at", f"{interval_s} seconds").alias("window"), "namespace").agg(*sums)


def stream_meter_tenants(tenant_ticks: DataFrame, measures: DataFrame) -> DataFrame:
    """Every tenant at every tick with its namespace's measures, 0 where there are none; a stream-stream left outer join.

    Tenants that share a namespace each get all of its usage, as in the batch operator.
    """
    names = [c for c in measures.columns if c not in ("window", "namespace")]
    joined = tenant_ticks.join(measures, ["window", "namespace"], "left_outer")
    return joined.select(F.col("window.end").alias("tick_ts"), *[c for c in tenant_ticks.columns if c != "window"], *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def stream_meter_events(reconciles: DataFrame, samples: DataFrame, hours: float, interval_s: int = 60, hold_s: int = 30, watermark: str = WATERMARK, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Usage events of all tenants while they happen, in append mode.

    ``reconciles(tick_ts, uid, name, namespace, subscription_id)`` and ``samples(ts, namespace, kind, object, value)``.
    """
    ticks = stream_tenant_ticks(reconciles, interval_s, hold_s, watermark)
    return convert.meter_events(stream_meter_tenants(ticks, stream_measures(samples, interval_s, watermark)), hours, naming)
