"""Metering as one stream equals the batch operators on closed ticks."""

import random

from pyspark.sql import functions as F

from tallyhouse.operators import collect, convert, lifecycle
from tallyhouse.streaming import tenants

T0 = 1704067200
RECONCILES = "tick_ts timestamp, uid string, name string, namespace string, subscription_id string"
SAMPLES = "ts timestamp, namespace string, kind string, object string, value long"


def given(spark, seed=1, minutes=20):
    """Reconciles every 30 s (some find nobody), samples at any second; tenants come and go."""
    rng = random.Random(seed)
    alive = {t: sorted(rng.sample(range(minutes * 2), 2)) for t in range(6)}
    found = [(T0 + 30 * k, f"u{t}", f"n{t}", f"ns-{t % 4}", f"s{t}") for k in range(minutes * 2) for t, (a, b) in alive.items() if a <= k <= b]
    seen = [(T0 + rng.randrange(minutes * 60), f"ns-{rng.randrange(3)}", rng.choice([*tenants.MEASURES, "other"]), f"o{rng.randrange(3)}", rng.randrange(5000)) for _ in range(400)]
    timed = lambda rows, schema, column: spark.createDataFrame(rows, schema.replace("timestamp", "long", 1)).withColumn(column, F.timestamp_seconds(F.col(column)))
    return timed(found, RECONCILES, "tick_ts"), timed(sorted(set(seen)), SAMPLES, "ts")


def stream_of(spark, folder, df, at, last):
    """The rows by time in three files, and one far later that closes all windows."""
    bounds = [T0, T0 + 400, T0 + 800, T0 + 10**6]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        df.where((F.unix_timestamp(at) >= a) & (F.unix_timestamp(at) < b)).coalesce(1).write.mode("append").parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def streams(spark, tmp_path, reconciles, samples):
    late = F.timestamp_seconds(F.lit(T0 + 10**6))
    closing_r = reconciles.limit(1).withColumns({"tick_ts": late, "uid": F.lit("closing"), "namespace": F.lit("closing")})
    closing_s = samples.limit(1).withColumns({"ts": late, "namespace": F.lit("closing")})
    return stream_of(spark, str(tmp_path / "r"), reconciles, "tick_ts", closing_r), stream_of(spark, str(tmp_path / "s"), samples, "ts", closing_s)


def output(spark, tmp_path, df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.table(name)


def batch(spark, reconciles, samples):
    last = samples.groupBy(F.window("ts", "60 seconds").alias("w"), "namespace", "kind", "object").agg(F.max(F.struct("ts", "value"))["value"].alias("v"))
    sums = [F.coalesce(F.sum(F.when(F.col("kind") == m, F.col("v"))), F.lit(0)).alias(m) for m in tenants.MEASURES]
    measures = last.groupBy(F.col("w.end").alias("tick_ts"), "namespace").agg(*sums)
    # a reconcile that found nobody is known by its time
    times = spark.range(0, 40).select(F.timestamp_seconds(F.lit(T0) + F.col("id") * 30).alias("tick_ts"))
    ticks = spark.range(0, 20).select(F.timestamp_seconds(F.lit(T0) + F.col("id") * 60).alias("tick_ts"))
    known = lifecycle.asof_tenant_set(ticks, reconciles, times).drop("reconcile_ts")
    return collect.meter_tenants(known, measures)


COLUMNS = ["tick_ts", "uid", "namespace", "subscription_id", *tenants.MEASURES]


def test_tenants_and_measures_meet_as_in_batch(spark, tmp_path):
    reconciles, samples = given(spark)
    r, s = streams(spark, tmp_path, reconciles, samples)
    joined = tenants.stream_meter_tenants(tenants.stream_tenant_ticks(r, 60, 30, "1 minute"), tenants.stream_measures(s, 60, "1 minute"))
    got = sorted(map(tuple, output(spark, tmp_path, joined, "metered").where("uid <> 'closing'").select(*COLUMNS).collect()))
    want = sorted(map(tuple, batch(spark, reconciles, samples).select(*COLUMNS).collect()))
    assert len(want) > 30 and any(row[4] for row in want) and any(not any(row[4:]) for row in want)
    assert got == want


def test_events_equal_the_batch_events(spark, tmp_path):
    reconciles, samples = given(spark, seed=5)
    r, s = streams(spark, tmp_path, reconciles, samples)
    key = lambda df: sorted(map(tuple, df.select("transaction_id", "code", "quantity_micro", "properties").collect()))
    got = output(spark, tmp_path, tenants.stream_meter_events(r, s, 1 / 60, watermark="1 minute"), "events").where("transaction_id not like 'closing%'")
    want = convert.meter_events(batch(spark, reconciles, samples), 1 / 60)
    assert key(got) == key(want) and want.count() > 100


def test_ticks_of_a_reconcile(spark):
    rows = spark.createDataFrame([(T0, "a"), (T0 + 30, "b"), (T0 + 31, "c"), (T0 + 59, "d"), (T0 - 1, "e")], "at long, uid string").select(F.timestamp_seconds("at").alias("tick_ts"), "uid")
    ends = lambda hold: sorted((r["uid"], int(r["window"]["end"].timestamp()) - T0) for r in tenants.stream_tenant_ticks(rows, 60, hold).collect())
    assert ends(30) == [("a", 0), ("c", 60), ("d", 60), ("e", 0)]
    assert ends(60) == [("a", 0), ("b", 60), ("c", 60), ("d", 60), ("e", 0)]
    assert ends(120)[:2] == [("a", 0), ("a", 60)]
