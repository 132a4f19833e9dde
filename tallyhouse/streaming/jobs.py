"""Metering as streams.  Late rows beyond the watermark are left to the next batch recompute."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.rating import event_period
from tallyhouse.functions.settings import RATE_WINDOW_SECONDS

WATERMARK = "10 minutes"


def stream_meter(samples: DataFrame, interval: str = "60 seconds", watermark: str = WATERMARK) -> DataFrame:
    """CPU and memory by window and namespace, from the last sample of each container in the window.

    ``samples(ts, namespace, pod, container, cpu_milli, memory_bytes)``; two chained aggregations, append mode.
    """
    last = F.max_by(F.struct("cpu_milli", "memory_bytes"), F.struct("ts", "cpu_milli", "memory_bytes"))
    each = samples.withWatermark("ts", watermark).groupBy(F.window("ts", interval), "namespace", "pod", "container").agg(last.alias("s"))
    timed = each.select(F.window_time("window").alias("at"), "namespace", "s")
    return timed.groupBy(F.window("at", interval).alias("window"), "namespace").agg(F.sum("s.cpu_milli").alias("cpu_milli"), F.sum("s.memory_bytes").alias("memory_bytes"))


def stream_network(samples: DataFrame, series: list[str], window_s: int = RATE_WINDOW_SECONDS, step: str = "60 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Rate of each counter series in sliding windows; restarts handled by a fold over the window's ordered samples."""
    grouped = samples.withWatermark("ts", watermark).groupBy(F.window("ts", f"{window_s} seconds", step), *series).agg(F.sort_array(F.collect_list(F.struct("ts", "value"))).alias("s"))
    increase = F.aggregate(
        F.slice("s", F.lit(2), F.greatest(F.size("s") - 1, F.lit(0))),
        F.struct(F.get(F.col("s"), F.lit(0))["value"].alias("last"), F.lit(0.0).cast("double").alias("sum")),
        lambda a, x: F.struct(x["value"].alias("last"), (a["sum"] + F.when(x["value"] >= a["last"], x["value"] - a["last"]).otherwise(x["value"])).alias("sum")),
    )["sum"]
    covered = F.unix_micros(F.element_at("s", -1)["ts"]) - F.unix_micros(F.get(F.col("s"), F.lit(0))["ts"])
    found = grouped.select("window", *series, increase.alias("increase"), covered.alias("covered_us"), F.size("s").alias("samples"))
    return found.where("samples >= 2 and covered_us > 0").withColumn("rate", F.col("increase") / (F.col("covered_us") / 1e6))


_LIFECYCLE = "external_id string, event string, at timestamp"


def lifecycle_handler(gap_seconds: int):
    """The state handler of :func:`stream_lifecycle`: a tenant that misses ``gap_seconds`` of reconciles is gone."""
    from pyspark.sql.streaming import StatefulProcessor

    class Lifecycle(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.seen = handle.getValueState("seen", "last_ms long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            times = sorted(t.value // 1_000_000 for frame in rows for t in frame["tick_ts"])
            last = self.seen.get()[0] if self.seen.exists() else None
            out = []
            for t in times:
                if last is not None and t - last > gap_seconds * 1000:
                    out.append(("terminated", last + gap_seconds * 1000))
                    last = None
                if last is None:
                    out.append(("created", t))
                last = t if last is None else max(last, t)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last is not None:
                self.seen.update((last,))
                self.handle.registerTimer(last + gap_seconds * 1000)
            yield self._rows(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.seen.clear()
            yield self._rows(key, [("terminated", expiredTimerInfo.getExpiryTimeInMs())])

        @staticmethod
        def _rows(key, events) -> pd.DataFrame:
            return pd.DataFrame({"external_id": [key[0]] * len(events), "event": [e for e, _ in events], "at": pd.to_datetime([t for _, t in events], unit="ms")})

        def close(self) -> None:
            pass

    return Lifecycle()


def stream_lifecycle(reconciles: DataFrame, gap_seconds: int = 30, watermark: str = WATERMARK) -> DataFrame:
    """``created`` and ``terminated`` rows from reconciles(external_id, tick_ts), with event-time timers on RocksDB state."""
    return reconciles.withWatermark("tick_ts", watermark).groupBy("external_id").transformWithStateInPandas(lifecycle_handler(gap_seconds), outputStructType=_LIFECYCLE, outputMode="Append", timeMode="EventTime")


def stream_liveness(reconciles: DataFrame, gap: str = "45 seconds", watermark: str = WATERMARK) -> DataFrame:
    """Presence sessions of each tenant; enough where only intervals matter."""
    return reconciles.withWatermark("tick_ts", watermark).groupBy(F.session_window("tick_ts", gap).alias("session"), "external_id").agg(F.count("*").alias("reconciles"))


def stream_dedupe(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Each transaction id once; ``event_ts`` is the event's time."""
    timed = events.withColumn("event_ts", F.timestamp_seconds("timestamp"))
    return timed.withWatermark("event_ts", watermark).dropDuplicatesWithinWatermark(["transaction_id"])


def stream_period_usage(events: DataFrame) -> DataFrame:
    """Running usage by subscription, code, GPU model and month; update mode, to be upserted by ``foreachBatch``."""
    return events.groupBy("external_subscription_id", "code", "gpu_type", event_period(F.col("timestamp")).alias("period")).agg(F.sum("quantity_micro").alias("units_micro"))
