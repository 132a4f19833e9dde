"""Late rows change exactly their ticks, and repeating a batch or a recomputation changes nothing."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tallyhouse.streaming.late import LateTable

T0 = dt.datetime(2024, 3, 1)
SCHEMA = "ts timestamp, namespace string, v long"


def per_minute(samples):
    return samples.groupBy(F.date_trunc("minute", "ts").alias("tick_ts"), "namespace").agg(F.sum("v").alias("v"))


def table(tmp_path):
    return LateTable(str(tmp_path / "t"), SCHEMA, per_minute, "tick_ts timestamp, namespace string, v long", window_s=60, delay_s=600)


def batch(spark, *rows):
    return spark.createDataFrame([(T0 + dt.timedelta(minutes=m) if m is not None else None, n, v) for m, n, v in rows], SCHEMA)


def rows(t, spark):
    return sorted(((r["tick_ts"] - T0).total_seconds() / 60, r["namespace"], r["v"]) for r in t.rows(spark).collect())


def files(tmp_path):
    root = tmp_path / "t" / "result"
    return {str(p.relative_to(root)): (os.stat(p).st_mtime_ns, p.read_bytes()) for p in root.rglob("*.parquet")}


def test_late_rows_change_their_ticks_only(spark, tmp_path):
    t = table(tmp_path)
    assert t.rows(spark).count() == t.late(spark).count() == 0 and t.recompute(spark) == []
    t.take(batch(spark, (0, "a", 1), (61, "a", 2), (130, "b", 4), (None, "a", 99)), 0)
    t.take(batch(spark, (200, "a", 8), (119.5, "b", 16), (120.5, "b", 32), (5, "c", 64)), 1)
    # batch 0 closed everything before minute 120: what ends by then is late, what lies behind is not
    assert sorted((r["v"], r["batch_number"]) for r in t.late(spark).collect()) == [(16, 1), (64, 1)]
    before = rows(t, spark)
    assert before == [(0, "a", 1), (61, "a", 2), (120, "b", 32), (130, "b", 4), (200, "a", 8)]
    held = files(tmp_path)
    assert sorted(t.recompute(spark)) == ["2024-03-01-00", "2024-03-01-01"]
    after = rows(t, spark)
    assert after == sorted([*before, (5, "c", 64), (119, "b", 16)]) and t.late(spark).count() == 0
    # files of the hours without late rows were not written again
    kept = {k: v for k, v in files(tmp_path).items() if "-02/" in k or "-03/" in k}
    assert kept and all(held[k] == v for k, v in kept.items())
    assert t.recompute(spark) == [] and rows(t, spark) == after


def test_repeats_change_nothing(spark, tmp_path):
    t = table(tmp_path)
    t.take(batch(spark, (0, "a", 1), (300, "a", 2)), 0)
    second = batch(spark, (1, "a", 4), (1, "a", 4), (310, "b", 8))
    for _ in range(2):
        t.take(second, 1)
        assert t.late(spark).count() == 2 and t.history(spark).count() == 5
    t.recompute(spark)
    want = [(0, "a", 1), (1, "a", 8), (300, "a", 2), (310, "b", 8)]
    assert rows(t, spark) == want
    t.take(second, 1)  # a batch that comes again after its late rows were taken up
    t.recompute(spark)
    assert rows(t, spark) == want


def test_a_stream_feeds_it(spark, tmp_path):
    source, t = str(tmp_path / "s"), table(tmp_path)
    for part in ([(0, "a", 1), (100, "a", 2)], [(3, "a", 4), (101, "a", 8)], [(2, "b", 16)]):
        batch(spark, *part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    stream.writeStream.foreachBatch(t.take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(180)
    assert t.late(spark).count() == 2
    t.recompute(spark)
    direct = per_minute(spark.read.schema(SCHEMA).parquet(source))
    assert rows(t, spark) == sorted(((r["tick_ts"] - T0).total_seconds() / 60, r["namespace"], r["v"]) for r in direct.collect())
