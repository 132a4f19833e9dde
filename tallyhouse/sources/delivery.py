"""Delivery of event payloads with acknowledgement: an outbox, a ledger, and only what the ledger lacks is sent.

``outbox/batch=<n>`` holds the payloads of a batch, formed once: a batch that comes again finds them there.  ``ledger/attempt=<n>``
holds what became of each payload of an attempt.  A payload's id is the hash of its text, so equal payloads are sent once.

A sender that fails for some payloads fails for those only: the others are acknowledged and not sent again.  A task that is
lost between sending and writing its acknowledgements sends again; receivers know events by their transaction ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.settings import EVENT_BATCH
from tallyhouse.sources.sinks import event_batches
from tallyhouse.sources.upserts import folders, removed

OUTBOX = "payload_id string, n_events int, payload string"
LEDGER = "payload_id string, n_events int, sent boolean, error string"


def _sender(send: Callable[[str, str], None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors: list[str | None] = []
            for ident, payload in zip(batch.column("payload_id").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                try:
                    send(ident, payload)
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  whatever a sender fails with is that payload's failure
                    errors.append(f"{type(error).__name__}: {error}"[:1000])
            yield pa.RecordBatch.from_arrays([batch.column("payload_id"), batch.column("n_events"), pa.array([e is None for e in errors]), pa.array(errors, pa.string())], ["payload_id", "n_events", "sent", "error"])

    return run


class Undelivered(RuntimeError):
    """Payloads that the sender did not take; the batch fails, and its next try sends only these."""


@dataclass(frozen=True)
class Outbox:
    path: str
    n: int = EVENT_BATCH

    def _read(self, spark: SparkSession, kind: str, label: str, schema: str) -> DataFrame:
        root, names = f"{self.path}/{kind}", folders(spark, f"{self.path}/{kind}")
        if not names:
            return spark.createDataFrame([], f"{schema}, {label} long")
        return spark.read.schema(f"{schema}, {label} long").option("basePath", root).parquet(*[f"{root}/{x}" for x in names])

    def put(self, batch: DataFrame, number: int) -> None:
        """Forms the payloads of a batch; those of a batch that is there already stay as they are."""
        if f"batch={number}" not in folders(batch.sparkSession, f"{self.path}/outbox"):
            payloads = event_batches(batch, self.n).select(F.sha2("payload", 256).alias("payload_id"), "n_events", "payload")
            payloads.write.mode("overwrite").parquet(f"{self.path}/outbox/batch={number}")

    def payloads(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "outbox", "batch", OUTBOX)

    def ledger(self, spark: SparkSession) -> DataFrame:
        """What became of the payloads of each attempt."""
        return self._read(spark, "ledger", "attempt", LEDGER)

    def delivered(self, spark: SparkSession) -> DataFrame:
        """(payload_id, n_events, attempt) of acknowledged payloads."""
        return self.ledger(spark).where("sent").select("payload_id", "n_events", "attempt")

    def pending(self, spark: SparkSession) -> DataFrame:
        """Payloads without an acknowledgement, each once."""
        return self.payloads(spark).drop("batch").join(self.delivered(spark).select("payload_id"), "payload_id", "left_anti").dropDuplicates(["payload_id"])

    def failing(self, spark: SparkSession) -> DataFrame:
        """(payload_id, attempts, error): payloads that no attempt has delivered, with the last error."""
        tried = self.ledger(spark).groupBy("payload_id").agg(F.max("sent").alias("sent"), F.count("*").alias("attempts"), F.max_by("error", "attempt").alias("error"))
        return tried.where("not sent").drop("sent")

    def deliver(self, spark: SparkSession, send: Callable[[str, str], None]) -> tuple[int, int]:
        """One attempt: ``send(payload_id, payload)`` for everything pending; (sent, failed)."""
        tries = [int(x.split("=")[1]) for x in folders(spark, f"{self.path}/ledger", complete=False)]
        attempt = max(tries, default=-1) + 1
        self.pending(spark).select("payload_id", "n_events", "payload").mapInArrow(_sender(send), LEDGER).write.parquet(f"{self.path}/ledger/attempt={attempt}")
        row = spark.read.schema(LEDGER).parquet(f"{self.path}/ledger/attempt={attempt}").agg(F.count_if("sent").alias("sent"), F.count_if(~F.col("sent")).alias("failed")).first()
        return row["sent"], row["failed"]

    def retire(self, spark: SparkSession) -> list[int]:
        """Removes the payloads of batches that are delivered whole; the ledger stays, so that they are known if they come again."""
        open_ = self.payloads(spark).join(self.delivered(spark).select("payload_id"), "payload_id", "left_anti").select("batch").distinct()
        left = {f"batch={r['batch']}" for r in open_.collect()}  # numbers of batches with something pending
        done = [n for n in folders(spark, f"{self.path}/outbox") if n not in left]
        for n in done:
            removed(spark, f"{self.path}/outbox/{n}")
        return sorted(int(n.split("=")[1]) for n in done)

    def sink(self, send: Callable[[str, str], None], attempts: int = 3) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function: forms the payloads, tries to deliver what is pending, and fails the batch if something is left."""

        def write(batch: DataFrame, number: int) -> None:
            spark = batch.sparkSession
            self.put(batch, number)
            for _ in range(attempts):
                _, failed = self.deliver(spark, send)
                if not failed:
                    return
            raise Undelivered(f"{failed} payloads are not delivered after {attempts} attempts")

        return write
