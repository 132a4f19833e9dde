"""Closing periods and the upsert table: state falls when a period closes, stream equals batch."""

import os

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import rating
from tallyhouse.sources.upserts import UpsertTable, folders
from tallyhouse.streaming import periods, run

DAY = 86_400
T0 = 1704067200  # a Monday and the first of a month


def events(spark, rows):
    """(day, subscription, micro) rows."""
    return spark.createDataFrame([(s, "c", None, T0 + int(d * DAY), q) for d, s, q in rows], "external_subscription_id string, code string, gpu_type string, timestamp long, quantity_micro long")


BATCHES = [
    [(0, "a", 1), (1, "a", 2), (2, "b", 5), (6.9, "c", 7)],
    [(8, "a", 10), (6, "a", 100), (9, "b", 1)],  # the row of day 6 comes before the first week is closed
    [(10, "a", 20), (3, "b", 1000)],  # by now the week is closed: this row is too late
    [(22, "d", 3)],
]


def streamed(spark, tmp_path, compact_every=None):
    source = str(tmp_path / "source")
    for rows in BATCHES:
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
    table = periods.usage_table(str(tmp_path / "table"))
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    with run.rocksdb(spark):
        query = periods.stream_closing_usage(stream, "week", "1 day").writeStream.foreachBatch(table.sink(compact_every)).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    return table, [(p["batchId"], p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["stateOperators"]]


def rows_of(df):
    return sorted((r["external_subscription_id"], (int(r["period"].timestamp()) - T0) // DAY, r["units_micro"], r["events"], r["closed"]) for r in df.collect())


WANT = [("a", 0, 103, 3, True), ("a", 7, 30, 2, True), ("b", 0, 5, 1, True), ("b", 7, 1, 1, True), ("c", 0, 7, 1, True), ("d", 21, 3, 1, False)]


@pytest.mark.parametrize("compact_every", [None, 2])
def test_periods_close_and_leave_the_state(spark, tmp_path, compact_every):
    table, state = streamed(spark, tmp_path, compact_every)
    assert rows_of(table.rows(spark)) == WANT
    # closed weeks are the batch's sums without the row that came too late
    batch = rating.period_usage(events(spark, [r for rows in BATCHES for r in rows if r != (3, "b", 1000)]), "week")
    assert sorted((r["external_subscription_id"], r["units_micro"]) for r in batch.collect()) == sorted((s, u) for s, _, u, _, _ in WANT)
    most = max(n for _, n in state)
    assert state[-1][1] < most, state  # one key of the open week is left


def test_upserts_keep_the_last_version(spark, tmp_path):
    table = UpsertTable(str(tmp_path / "t"), "k string, period long, v long", ["k", "period"], "period")
    assert table.rows(spark).count() == 0 and table.compact(spark) is None
    add = lambda number, *rows: table.add(spark.createDataFrame(rows, "k string, period long, v long"), number)
    now = lambda: sorted(tuple(r) for r in table.rows(spark).select("k", "period", "v").collect())
    add(0, ("a", 1, 1), ("b", 1, 1), ("a", 2, 1))
    add(1, ("a", 1, 2), ("a", 1, 3), ("c", 3, 9))
    want = [("a", 1, 3), ("a", 2, 1), ("b", 1, 1), ("c", 3, 9)]
    assert now() == want
    add(1, ("a", 1, 4))  # the batch again: what it said before is gone
    want = [("a", 1, 4), ("a", 2, 1), ("b", 1, 1)]
    assert now() == want
    assert table.compact(spark) == 1 and now() == want and folders(spark, f"{table.path}/delta") == []
    first = {p: os.path.getmtime(tmp_path / "t" / "base" / "upto=1" / p) for p in ("period=1", "period=2")}
    add(2, ("b", 1, 7), ("d", 4, 0))
    assert now() == [("a", 1, 4), ("a", 2, 1), ("b", 1, 7), ("d", 4, 0)]
    assert table.compact(spark) == 2 and now() == [("a", 1, 4), ("a", 2, 1), ("b", 1, 7), ("d", 4, 0)]
    # period 2 had no change: its files stay, period 1 moved to the new base
    assert os.path.getmtime(tmp_path / "t" / "base" / "upto=1" / "period=2") == first["period=2"]
    assert sorted(x for x in os.listdir(tmp_path / "t" / "base" / "upto=1") if "=" in x) == ["period=2"]
    assert sorted(x for x in os.listdir(tmp_path / "t" / "base" / "upto=2") if "=" in x) == ["period=1", "period=4"]


def test_an_unfinished_compaction_is_not_read(spark, tmp_path):
    table = UpsertTable(str(tmp_path / "t"), "k string, period long, v long", ["k", "period"], "period")
    table.add(spark.createDataFrame([("a", 1, 1)], "k string, period long, v long"), 0)
    spark.createDataFrame([("a", 1, 5)], "k string, period long, v long").write.partitionBy("period").parquet(f"{table.path}/base/upto=0")
    os.remove(tmp_path / "t" / "base" / "upto=0" / "_SUCCESS")
    assert [tuple(r) for r in table.rows(spark).select("k", "v").collect()] == [("a", 1)]
    assert table.compact(spark) == 0 and [r["v"] for r in table.rows(spark).collect()] == [1]
    assert rows_of(periods.usage_table(str(tmp_path / "none")).rows(spark).where(F.lit(True))) == []


def test_states_are_by_shard(spark, tmp_path):
    source = str(tmp_path / "source")
    rows = [(0, f"s{k}", k) for k in range(300)] + [(1, "s7", 1), (2, None, 9)]
    events(spark, rows).coalesce(1).write.parquet(source)
    table = periods.usage_table(str(tmp_path / "table"))
    with run.rocksdb(spark):
        stream = periods.stream_closing_usage(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), "week", "1 day", shards=2)
        query = stream.writeStream.foreachBatch(table.sink()).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    want = [(f"s{k}", k + (k == 7), 1 + (k == 7)) for k in range(300)] + [(None, 9, 1)]
    found = [(r["external_subscription_id"], r["units_micro"], r["events"]) for r in table.rows(spark).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) < 20
