"""Usage of billing periods as a stream: running sums while a period is open, a last one when it closes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.operators.rating import USAGE_KEY, event_period
from tallyhouse.streaming.jobs import WATERMARK

CLOSING_USAGE = "external_subscription_id string, code string, gpu_type string, period timestamp, units_micro long, events long, closed boolean"
_NAMES = ["external_subscription_id", "code", "gpu_type"]
#: Parts that the keys of a period are dealt to; each has one state and one timer.
SHARDS = 64


def closing_handler():
    """The state handler of :func:`stream_closing_usage`: the sums of a shard's keys, and a timer at the end of its period."""
    from pyspark.sql.streaming import StatefulProcessor

    class Closing(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.total = handle.getValueState("total", ", ".join([*(f"{n} array<string>" for n in _NAMES), "units array<long>", "events array<long>"]))

        def _held(self) -> pd.DataFrame:
            return pd.DataFrame(dict(zip([*_NAMES, "units", "events"], map(list, self.total.get()), strict=True)))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            known = self.total.exists()
            new = pd.concat([self._added(frame.assign(units=frame["quantity_micro"], events=1)) for frame in rows])
            every = self._added(pd.concat([self._held().assign(touched=0), new.assign(touched=1)])) if known else self._added(new.assign(touched=1))
            self.total.update(tuple([None if pd.isna(x) else x for x in every[n]] for n in _NAMES) + (every["units"].tolist(), every["events"].tolist()))
            if not known:
                self.handle.registerTimer(int(key[1]))
            yield self._rows(key, every[every["touched"] > 0], False)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            every = self._held()
            self.total.clear()
            yield self._rows(key, every, True)

        @staticmethod
        def _added(frame) -> pd.DataFrame:
            """One row for each key, nulls being one too."""
            sums = [c for c in ("units", "events", "touched") if c in frame]
            return frame.groupby(_NAMES, dropna=False, sort=False, as_index=False)[sums].sum().astype({c: "int64" for c in sums})

        @staticmethod
        def _rows(key, frame, closed) -> pd.DataFrame:
            frame = frame.reset_index(drop=True)
            names = {n: frame[n].astype(object).where(frame[n].notna(), None) for n in _NAMES}
            return pd.DataFrame({**names, "period": pd.to_datetime([key[0]] * len(frame), unit="us"), "units_micro": frame["units"], "events": frame["events"], "closed": closed})

        def close(self) -> None:
            pass

    return Closing()


def stream_closing_usage(events: DataFrame, unit: str = "month", watermark: str = WATERMARK, shards: int = SHARDS) -> DataFrame:
    """Usage by subscription, code, GPU model and period, for an upsert by ``USAGE_KEY``.

    Every batch gives the running sum of the keys it touched (``closed`` = false).  Once the watermark passes a period's end its keys
    give their last sum (``closed`` = true) and leave the state, so the state holds open periods only.  Takes events with
    ``timestamp``, ``quantity_micro`` and ``gpu_type``, deduplicated; runs in update mode on RocksDB state.  Rows that come after
    the watermark are not seen (see :mod:`tallyhouse.streaming.late`); a null quantity counts as an event of 0.

    The keys of a period are dealt to ``shards`` states, so that the calls to the state store, each of which waits for an answer, do not
    grow with the keys.  A state is read and written whole: more shards where a period has more than some millions of keys; the
    number must stay the same over the restarts of a stream.
    """
    timed = events.withColumn("event_ts", F.timestamp_seconds("timestamp")).withWatermark("event_ts", watermark)
    period = event_period(F.col("timestamp"), unit)
    ends = F.unix_millis(period + F.expr(f"interval 1 {unit}"))
    shard = F.pmod(F.xxhash64(*_NAMES), F.lit(shards))
    keyed = timed.select(*_NAMES, F.unix_micros(period).alias("period_us"), ends.alias("ends_ms"), shard.alias("shard"), "event_ts", F.coalesce("quantity_micro", F.lit(0)).cast("bigint").alias("quantity_micro"))
    grouped = keyed.groupBy("period_us", "ends_ms", "shard")
    return grouped.transformWithStateInPandas(closing_handler(), outputStructType=CLOSING_USAGE, outputMode="Update", timeMode="EventTime")


def usage_table(path: str):
    """The table that :func:`stream_closing_usage` is upserted into."""
    from tallyhouse.sources.upserts import UpsertTable

    return UpsertTable(path, CLOSING_USAGE, USAGE_KEY, "period")
