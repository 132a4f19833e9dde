"""Writing events and reports, and batching events for a billing backend."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.settings import EVENT_BATCH

EVENT_COLUMNS = ["transaction_id", "external_subscription_id", "code", "timestamp", "properties"]


def write_events(df: DataFrame, path: str, mode: str = "append") -> None:
    """Event rows by date: a resend keeps its date, so duplicates can be looked for within one."""
    dated = df.withColumn("event_date", F.to_date(F.timestamp_seconds("timestamp")))
    dated.write.mode(mode).partitionBy("event_date").parquet(path)


def write_report(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(format).save(path)


def _payload(rows: list[dict]) -> str:
    return json.dumps({"events": [r | {"properties": json.loads(r["properties"] or "{}")} for r in rows]}, separators=(",", ":"), ensure_ascii=False)


def _batcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            full = len(held) // n * n
            if full:
                parts = [held[i : i + n] for i in range(0, full, n)]
                held = held[full:]
                yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int32()), pa.array([_payload(p) for p in parts])], ["n_events", "payload"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array([_payload(held)])], ["n_events", "payload"])

    return run


def event_batches(df: DataFrame, n: int = EVENT_BATCH) -> DataFrame:
    """Payloads ``{"events": [...]}`` of at most ``n`` events each, formed inside each partition without a shuffle."""
    return df.select(*EVENT_COLUMNS).mapInArrow(_batcher(n), PAYLOADS)


PAYLOADS = "n_events int, payload string"


def foreach_batch_sink(send: Callable[[Iterable[str]], None] | None = None, n: int = EVENT_BATCH, outbox: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands each partition's payloads to ``send``.

    With an ``outbox`` the payloads are first written under it by batch number (a repeated batch
    replaces its own) and sent from there; without ``send`` they wait there for another sender.
    A failing ``send`` fails the batch, which is then sent again; transaction ids make that safe.
    """

    def sink(batch: DataFrame, number: int) -> None:
        payloads = event_batches(batch, n)
        if outbox:
            path = f"{outbox.rstrip('/')}/{number:012d}"
            payloads.write.mode("overwrite").parquet(path)
            payloads = batch.sparkSession.read.schema(PAYLOADS).parquet(path)
        if send:
            payloads.foreachPartition(lambda rows: send(r["payload"] for r in rows))

    return sink
