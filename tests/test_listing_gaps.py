"""Failed listings: what stands in for them, and that nobody is terminated by one."""

from pyspark.sql import functions as F

from tallyhouse.operators import lifecycle


def ticks(df, *columns):
    return df.withColumns({c: F.timestamp_seconds(F.col(c)) for c in columns})


def given(spark, manifest, snapshots):
    return (
        ticks(spark.createDataFrame(manifest, "tick_ts long, namespace string, complete boolean"), "tick_ts"),
        ticks(spark.createDataFrame(snapshots, "tick_ts long, namespace string, external_id string"), "tick_ts"),
    )


MANIFEST = [(0, "n", True), (0, "m", True), (30, "n", False), (30, "m", True), (60, "m", True), (90, "n", True), (90, "m", False), (120, "n", True), (120, "m", None), (0, "late", False), (60, "late", True)]
SNAPSHOTS = [(0, "n", "a"), (0, "n", "b"), (30, "n", "b"), (90, "n", "a"), (120, "n", "a"), (0, "m", "x"), (30, "m", "x"), (60, "m", "y"), (120, "m", "z"), (60, "late", "l"), (0, "late", "early")]


def rows(df, *columns):
    return sorted(tuple(int(v.timestamp()) if hasattr(v, "timestamp") else v for v in r) for r in df.select(*columns).collect())


def test_the_last_complete_listing_stands_in(spark):
    manifest, snapshots = given(spark, MANIFEST, SNAPSHOTS)
    whole = lifecycle.complete_snapshots(snapshots, manifest)
    assert whole.columns == ["tick_ts", "namespace", "external_id", "carried"]
    of_n = rows(whole.where("namespace = 'n'"), "tick_ts", "external_id", "carried")
    # the failed listing at 30 saw only b, the one at 60 was not tried; at 90 b is gone for certain
    assert of_n == [(0, "a", False), (0, "b", False), (30, "a", True), (30, "b", True), (60, "a", True), (60, "b", True), (90, "a", False), (120, "a", False)]
    assert rows(whole.where("namespace = 'm'"), "tick_ts", "external_id", "carried") == [(0, "x", False), (30, "x", False), (60, "y", False), (90, "y", True), (120, "y", True)]
    assert rows(whole.where("namespace = 'late'"), "tick_ts", "external_id") == [(60, "l"), (90, "l"), (120, "l")]


def test_no_termination_in_a_gap(spark):
    manifest, snapshots = given(spark, MANIFEST, SNAPSHOTS)
    plain = rows(lifecycle.lifecycle_events(snapshots.select("external_id", "tick_ts"), manifest.select("tick_ts").distinct()), "tick_ts", "external_id", "event")
    assert (30, "a", "terminated") in plain and (90, "a", "created") in plain  # what a failed listing did before
    found = rows(lifecycle.gated_intervals(snapshots, manifest).na.fill(0), "external_id", "start_ts", "reconciles")
    assert found == [("a", 0, 5), ("b", 0, 3), ("l", 60, 3), ("x", 0, 2), ("y", 60, 3)]
    ends = {r["external_id"]: r["end_ts"] for r in lifecycle.gated_intervals(snapshots, manifest).collect()}
    assert int(ends["b"].timestamp()) == 90 and ends["a"] is None and int(ends["x"].timestamp()) == 60


def test_a_gap_may_be_too_long_to_carry(spark):
    manifest, snapshots = given(spark, MANIFEST, SNAPSHOTS)
    assert rows(lifecycle.complete_snapshots(snapshots, manifest, max_gap=1).where("namespace = 'n' and carried"), "tick_ts", "external_id") == [(30, "a"), (30, "b")]
    assert lifecycle.complete_snapshots(snapshots, manifest, max_gap=0).where("carried").count() == 0


def test_gaps_are_listed(spark):
    manifest, _ = given(spark, MANIFEST, SNAPSHOTS)
    found = rows(lifecycle.listing_gaps(manifest), "namespace", "first_ts", "last_ts", "reconciles", "known_before")
    assert found == [("late", 0, 30, 2, False), ("late", 90, 120, 2, True), ("m", 90, 120, 2, True), ("n", 30, 60, 2, True)]


def test_contradicting_and_empty_manifests(spark):
    manifest, snapshots = given(spark, [(0, "n", True), (0, "n", False)], [(0, "n", "a")])
    assert lifecycle.complete_snapshots(snapshots, manifest).count() == 0
    assert lifecycle.complete_snapshots(snapshots, manifest.where("false")).count() == 0
    assert lifecycle.gated_intervals(snapshots, manifest.where("false")).count() == 0
