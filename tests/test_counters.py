"""Counter rates at the edges of windows, by hand."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators.counters import counter_rate

T0 = 1704067200


def rates(spark, values, **options):
    """{series: row} of (series, second, value) rows in windows of five minutes."""
    values = [(s, float(at), float(v)) for s, at, v in values]
    df = spark.createDataFrame(values, "s string, at double, value double").select("s", (F.timestamp_micros((F.lit(T0 * 1_000_000) + F.col("at") * 1_000_000).cast("bigint"))).alias("ts"), "value")
    found = counter_rate(df, ["s"], extrapolate=True, **options)
    return {(r["s"], int(r["window"]["start"].timestamp()) - T0): r for r in found.collect()}


def test_edges_by_hand(spark):
    full = [("full", 15 + 30 * k, 1000.0 + 60 * k) for k in range(10)]  # 15 .. 285, each edge 15 s away
    short = [("short", 120, 1000.0), ("short", 150, 1010.0), ("short", 180, 1020.0)]  # edges far away: half a mean distance each
    zero = [("zero", 15, 5.0), ("zero", 45, 65.0), ("zero", 75, 125.0)]  # was zero 2.5 s before the first sample
    reset = [("reset", 30, 50.0), ("reset", 60, 70.0), ("reset", 90, 10.0), ("reset", 120, 40.0)]  # 20, then a restart: 10, 30
    flat = [("flat", 100, 7.0), ("flat", 130, 7.0)]
    one = [("one", 10, 7.0)]
    got = rates(spark, full + short + zero + reset + flat + one)
    assert got["full", 0]["increase"] == 540 and got["full", 0]["extrapolated"] == pytest.approx(540 * 300 / 270) and got["full", 0]["rate"] == pytest.approx(2.0)
    assert got["short", 0]["extrapolated"] == pytest.approx(20 * (60 + 15 + 15) / 60)
    assert got["zero", 0]["extrapolated"] == pytest.approx(120 * (60 + 2.5 + 15) / 60)
    assert got["reset", 0]["increase"] == 60 and got["reset", 0]["extrapolated"] == pytest.approx(60 * (90 + 30 + 15) / 90)
    assert got["flat", 0]["extrapolated"] == 0 == got["flat", 0]["rate"]
    assert ("one", 0) not in got


def test_the_limit_of_the_edge(spark):
    # mean distance 100 s: an edge 100 s away is reached, one 111 s away is not
    near, far = [("near", 100, 5000.0), ("near", 200, 5100.0)], [("far", 111, 5000.0), ("far", 211, 5100.0)]
    got = rates(spark, near + far)
    assert got["near", 0]["extrapolated"] == pytest.approx(100 * 300 / 100)
    assert got["far", 0]["extrapolated"] == pytest.approx(100 * (100 + 50 + 89) / 100)


def test_sliding_windows_and_plain_rates_stay(spark):
    rows = [("s", 15.0 + 30 * k, 1000.0 + 60 * k) for k in range(20)]
    got = rates(spark, rows, step_s=60)
    assert len(got) > 10 and got["s", 60]["rate"] == pytest.approx(2.0)
    df = spark.createDataFrame(rows, "s string, at double, value double").select("s", F.timestamp_seconds(F.col("at") + T0).alias("ts"), "value")
    plain = counter_rate(df, ["s"])
    assert plain.columns == ["s", "window", "increase", "covered_us", "samples", "rate"] and all(r["rate"] == pytest.approx(2.0) for r in plain.collect())
