"""Tiers equal the direct sums after late and deleted events, and only changed partitions are written."""

import os

from pyspark.sql import functions as F

from tallyhouse.operators import rating
from tallyhouse.plans.rollup import UsageTiers, changed_days

T0, DAY = 1704067200, 86_400  # the first of January
SCHEMA = "external_subscription_id string, code string, gpu_type string, timestamp long, quantity_micro long"


def events(spark, *rows):
    return spark.createDataFrame([(s, "c", g, T0 + int(d * DAY), q) for d, s, g, q in rows], SCHEMA)


FIRST = [(0, "a", None, 1), (0.5, "a", None, 2), (1, "b", "T4", 4), (31, "a", None, 8), (31.2, "b", None, 16), (45, "a", None, 32)]


def key(df):
    return sorted(((r["external_subscription_id"], r["code"], r["gpu_type"] or "", r["period"], r["units_micro"], r["events"]) for r in df.collect()))


def agree(spark, tiers, now):
    for unit in ("hour", "day", "month"):
        assert key(tiers.usage(spark, unit)) == key(rating.period_usage(now, unit)), unit


def written(tmp_path, tier):
    root = tmp_path / "t" / tier
    return {p.name.split("=")[1]: max(os.stat(f).st_mtime_ns for f in p.iterdir()) for p in root.iterdir() if p.is_dir() and "=" in p.name}


def test_late_and_deleted_events(spark, tmp_path):
    tiers, now = UsageTiers(str(tmp_path / "t")), events(spark, *FIRST)
    assert tiers.usage(spark, "month").count() == 0
    tiers.refresh(now, changed_days(now))
    agree(spark, tiers, now)
    before = {t: written(tmp_path, t) for t in ("hour", "day", "month")}
    # a late event of a known day, one of a new day, a deletion that leaves a day empty
    late, gone = events(spark, (1.1, "a", None, 64), (3, "c", None, 128)), events(spark, FIRST[5])
    now = events(spark, *FIRST[:5]).unionByName(late)
    tiers.refresh(now, changed_days(late, gone))
    agree(spark, tiers, now)
    after = {t: written(tmp_path, t) for t in before}
    same = {t: {p for p, at in before[t].items() if after[t][p] == at} for t in before}
    assert same == {"hour": {"2024-01-01", "2024-02-01"}, "day": {"2024-01-01", "2024-02-01"}, "month": set()}
    # one month only
    more = events(spark, (50, "d", None, 256))
    now = now.unionByName(more)
    january = written(tmp_path, "month")["2024-01"]
    tiers.refresh(now, changed_days(more))
    agree(spark, tiers, now)
    assert written(tmp_path, "month")["2024-01"] == january


def test_a_month_that_loses_everything_and_a_repeat(spark, tmp_path):
    tiers, now = UsageTiers(str(tmp_path / "t")), events(spark, *FIRST)
    tiers.refresh(now, changed_days(now))
    left = events(spark, *FIRST[:3])
    for _ in range(2):
        tiers.refresh(left, changed_days(events(spark, *FIRST[3:])))
        agree(spark, tiers, left)
    tiers.refresh(left, changed_days(left).where("false"))
    agree(spark, tiers, left)


def test_only_changed_days_of_a_dated_table_are_read(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, *FIRST).withColumn("event_date", F.to_date(F.timestamp_seconds("timestamp"))).write.partitionBy("event_date").parquet(path)
    stored = spark.read.schema(f"{SCHEMA}, event_date date").parquet(path)
    tiers = UsageTiers(str(tmp_path / "t"))
    tiers.refresh(stored, changed_days(stored))
    agree(spark, tiers, stored)
    # files of a day that did not change are not needed
    for f in (tmp_path / "events" / "event_date=2024-01-01").iterdir():
        if f.suffix == ".parquet":
            f.write_bytes(b"broken")
    tiers.refresh(stored, changed_days(events(spark, (31, "a", None, 8))))
    assert tiers.usage(spark, "day").count() == 5
