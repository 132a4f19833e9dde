"""Each payload is delivered once; batches are committed once and deduplicated without an exchange."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tallyhouse.fixtures import Inputs
from tallyhouse.operators import rating
from tallyhouse.sources.commits import EventTable
from tallyhouse.sources.delivery import Outbox

SF = "/root/testdata/sf0.001"


def recorder(folder, broken=None):
    """Writes a file for each payload that it takes; ``broken`` names a file while it is there some payloads are refused."""

    def send(ident, payload):
        if broken and os.path.exists(broken) and int(ident[0], 16) < 8:
            raise ConnectionError("refused")
        with open(os.path.join(folder, f"{ident}-{uuid.uuid4().hex}"), "w") as file:
            file.write(payload)

    return send


def sent(folder):
    names = os.listdir(folder)
    return names, [e["transaction_id"] for n in names for e in json.load(open(os.path.join(folder, n)))["events"]]


def test_a_sender_that_fails_half_way_gets_each_payload_once(spark, tmp_path):
    folder, broken = str(tmp_path / "sent"), str(tmp_path / "broken")
    os.makedirs(folder)
    open(broken, "w").close()
    events = Inputs(spark, SF)["usage_events"].repartition(3)
    box = Outbox(str(tmp_path / "box"), n=10)
    box.put(events, 0)
    total = box.payloads(spark).count()
    done, failed = box.deliver(spark, recorder(folder, broken))
    assert done > 0 and failed > 0 and done + failed == total and box.pending(spark).count() == failed
    assert box.deliver(spark, recorder(folder, broken)) == (0, failed)
    assert {(r["attempts"], r["error"]) for r in box.failing(spark).collect()} == {(2, "ConnectionError: refused")}
    assert box.retire(spark) == []
    os.remove(broken)
    box.put(events.limit(5), 0)  # the batch comes again: its payloads stay as they were
    assert box.deliver(spark, recorder(folder, broken)) == (failed, 0) and box.deliver(spark, recorder(folder)) == (0, 0)
    names, ids = sent(folder)
    assert len(names) == total == len({n.split("-")[0] for n in names})
    assert sorted(ids) == sorted(r["transaction_id"] for r in events.select("transaction_id").collect())
    assert box.retire(spark) == [0] and box.payloads(spark).count() == 0 and box.failing(spark).count() == 0


def test_a_stream_that_fails_and_starts_again(spark, tmp_path):
    source, folder, broken = str(tmp_path / "s"), str(tmp_path / "sent"), str(tmp_path / "broken")
    os.makedirs(folder)
    open(broken, "w").close()
    Inputs(spark, SF)["usage_events"].write.parquet(source)
    box = Outbox(str(tmp_path / "box"), n=10)

    def start():
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        query = stream.writeStream.foreachBatch(box.sink(recorder(folder, broken), attempts=2)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(180)

    with pytest.raises(Exception, match="not delivered after 2 attempts"):
        start()
    half = len(os.listdir(folder))
    os.remove(broken)
    start()
    names, ids = sent(folder)
    assert 0 < half < len(names) == len({n.split("-")[0] for n in names})
    assert len(ids) == spark.read.parquet(source).count()


def test_empty_batches_and_equal_payloads(spark, tmp_path):
    folder = str(tmp_path / "sent")
    os.makedirs(folder)
    box = Outbox(str(tmp_path / "box"))
    events = Inputs(spark, SF)["usage_events"].orderBy("transaction_id").limit(20).coalesce(1)
    assert box.deliver(spark, recorder(folder)) == (0, 0)
    box.put(events.where("false"), 0)
    box.put(events, 1)
    box.put(events, 2)
    assert box.deliver(spark, recorder(folder)) == (1, 0) and len(os.listdir(folder)) == 1
    assert box.retire(spark) == [0, 1, 2]


@pytest.fixture(params=[True, False])
def table(spark, tmp_path, request):
    found = EventTable(f"t_{uuid.uuid4().hex}", 4, str(tmp_path / "events") if request.param else None)
    found.create(spark)
    yield found
    spark.sql(f"DROP TABLE {found.name}")


def test_commits_replace_their_batch(spark, table):
    events = Inputs(spark, SF)["usage_events"]
    table.commit(events, 0)
    count = events.count()
    assert table.rows(spark).count() == count
    table.commit(events, 0)
    assert table.rows(spark).count() == count
    days = [r["d"] for r in events.select(F.to_date(F.timestamp_seconds("timestamp")).alias("d")).distinct().orderBy("d").collect()]
    table.commit(events.where(F.to_date(F.timestamp_seconds("timestamp")) == F.lit(days[0])), 0)  # the retry has one date only
    assert [r["event_date"] for r in table.rows(spark).select("event_date").distinct().collect()] == days[:1]
    table.commit(events, 1)
    table.rollback(spark, 0)
    assert table.rows(spark).count() == count
    key = lambda df: sorted(map(tuple, df.select("transaction_id", "code", "properties").collect()))
    assert key(table.deduped(spark)) == key(rating.dedupe_events(events))


def test_dedupe_needs_no_exchange(spark, table):
    events = Inputs(spark, SF)["usage_events"]
    table.commit(events, 0)
    table.commit(events, 1)
    plan = table.deduped(spark)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert "Exchange" in rating.dedupe_events(events)._jdf.queryExecution().executedPlan().toString()
