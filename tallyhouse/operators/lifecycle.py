"""Tenant lifecycle from stored reconcile snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.operators.intervals import within_intervals


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def new_tenants(known: DataFrame, alive: DataFrame, key: str | list[str] = "external_id") -> DataFrame:
    return alive.join(known.select(*_keys(key)), _keys(key), "left_anti")


def removed_tenants(known: DataFrame, alive: DataFrame, key: str | list[str] = "external_id") -> DataFrame:
    return known.join(alive.select(*_keys(key)), _keys(key), "left_anti")


def retained_tenants(known: DataFrame, alive: DataFrame, key: str | list[str] = "external_id") -> DataFrame:
    return alive.join(known.select(*_keys(key)), _keys(key), "left_semi")


def tenant_set_diff(known: DataFrame, alive: DataFrame, key: str | list[str] = "external_id") -> DataFrame:
    """Every id of both sides with its state: new, removed or retained; one full join."""
    keys = _keys(key)
    a = known.select(*keys).distinct().withColumn("was", F.lit(True))
    b = alive.select(*keys).distinct().withColumn("is", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "removed").otherwise("retained").alias("state"))


def _numbered(snapshots: DataFrame, reconciles: DataFrame | None) -> DataFrame:
    """(tick_ts, seq, next_ts) of every reconcile: those of the list, and those that found somebody."""
    ticks = snapshots.select("tick_ts")
    if reconciles is not None:
        ticks = ticks.unionByName(reconciles.select("tick_ts"))
    order = Window.orderBy("tick_ts")
    # one row for each reconcile: small whatever the number of tenants
    return ticks.distinct().select("tick_ts", F.row_number().over(order).alias("seq"), F.lead("tick_ts").over(order).alias("next_ts"))


def consecutive_sets(snapshots: DataFrame, reconciles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(known, alive) for the set differences of all reconciles at once, by tick_ts and external_id.

    ``known`` holds, at each reconcile, the tenants of the one before it.
    """
    alive = snapshots.select("tick_ts", "external_id").distinct()
    numbered = _numbered(snapshots, reconciles).where("next_ts is not null")
    return alive.join(numbered, "tick_ts").select(F.col("next_ts").alias("tick_ts"), "external_id"), alive


def subscription_intervals(snapshots: DataFrame, reconciles: DataFrame | None = None) -> DataFrame:
    """Presence in consecutive reconciles to [start_ts, end_ts); a return opens a new interval.

    ``end_ts`` is the first reconcile without the tenant, null while it is still there.  A
    reconcile that found nobody has no row in ``snapshots(tick_ts, external_id)`` and ends every
    interval; so that it is known, give the times of all reconciles as ``reconciles(tick_ts)``.
    """
    order = Window.partitionBy("external_id").orderBy("seq")
    present = snapshots.select("external_id", "tick_ts").distinct().join(_numbered(snapshots, reconciles), "tick_ts")
    islands = present.withColumn("island", F.col("seq") - F.row_number().over(order))
    return islands.groupBy("external_id", "island").agg(F.min("tick_ts").alias("start_ts"), F.max_by("next_ts", "seq").alias("end_ts"), F.count("*").alias("reconciles")).drop("island")


def lifecycle_events(snapshots: DataFrame, reconciles: DataFrame | None = None) -> DataFrame:
    """A ``created`` and, once it is gone, a ``terminated`` row for each interval."""
    spans = subscription_intervals(snapshots, reconciles)
    both = F.array(F.struct(F.lit("created").alias("event"), F.col("start_ts").alias("tick_ts")), F.struct(F.lit("terminated").alias("event"), F.col("end_ts").alias("tick_ts")))
    return spans.select("external_id", F.explode(both).alias("e")).select("external_id", "e.event", "e.tick_ts").where("tick_ts is not null")


def asof_reconcile(ticks: DataFrame, reconciles: DataFrame) -> DataFrame:
    """For each collection tick the latest reconcile at or before it (both lists hold one row a tick)."""
    marks = ticks.select("tick_ts", F.lit(True).alias("is_tick"), F.lit(None).cast("timestamp").alias("reconcile")).distinct().unionByName(
        reconciles.select("tick_ts", F.lit(False).alias("is_tick"), F.col("tick_ts").alias("reconcile")).distinct()
    )
    upto = Window.orderBy("tick_ts", "is_tick").rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("reconcile_ts", F.last("reconcile", ignorenulls=True).over(upto)).where("is_tick and reconcile_ts is not null").select("tick_ts", "reconcile_ts")


def asof_tenant_set(ticks: DataFrame, snapshots: DataFrame, reconciles: DataFrame | None = None) -> DataFrame:
    """The tenants known at each collection tick: those of the latest reconcile; an equality join on the found time.

    After a reconcile that found nobody (see :func:`subscription_intervals`) nobody is known.
    """
    found = asof_reconcile(ticks, _numbered(snapshots, reconciles))
    return found.join(snapshots.withColumnRenamed("tick_ts", "reconcile_ts"), "reconcile_ts")


def usage_within_subscription(usage: DataFrame, intervals: DataFrame) -> DataFrame:
    """Samples inside a tenant's [start_ts, end_ts), by time buckets (see :func:`within_intervals`)."""
    spans = intervals.select("external_id", F.col("start_ts").alias("span_start"), F.col("end_ts").alias("span_end"))
    return within_intervals(usage, spans, ["external_id"], "tick_ts", "span_start", "span_end").drop("span_start", "span_end")


# -- incomplete snapshots -------------------------------------------------------------------------


def listing_sources(manifest: DataFrame, max_gap: int | None = None) -> DataFrame:
    """(tick_ts, namespace, source_ts, carried): the listing that stands for each namespace at each reconcile.

    ``manifest(tick_ts, namespace, complete)`` has a row for each namespace that a reconcile tried to list; at a time where a namespace
    has no complete row (the listing failed, or was not tried) its last complete listing before stands for it, for
    ``max_gap`` further reconciles at most (None: until it is listed again).  A namespace begins with its first complete listing.
    """
    # one row a reconcile; two rows that disagree about a namespace count as incomplete
    ticks = manifest.select("tick_ts").distinct().withColumn("seq", F.row_number().over(Window.orderBy("tick_ts")))
    each = manifest.groupBy("tick_ts", "namespace").agg(F.min(F.coalesce("complete", F.lit(False))).alias("complete"))
    listed = each.where("complete").join(ticks, "tick_ts").select("namespace", F.col("tick_ts").alias("source_ts"), "seq")
    last = ticks.agg(F.max("seq").alias("last_seq"))  # one row
    following = F.lead("seq").over(Window.partitionBy("namespace").orderBy("seq"))
    stands = listed.withColumn("next_seq", following).crossJoin(F.broadcast(last)).withColumn("upto", F.coalesce(F.col("next_seq") - 1, F.col("last_seq")))
    if max_gap is not None:
        stands = stands.withColumn("upto", F.least("upto", F.col("seq") + F.lit(max_gap)))
    covered = stands.select("namespace", "source_ts", F.explode(F.sequence("seq", "upto")).alias("seq"))
    return covered.join(ticks, "seq").select("tick_ts", "namespace", "source_ts", (F.col("source_ts") < F.col("tick_ts")).alias("carried"))


def complete_snapshots(snapshots: DataFrame, manifest: DataFrame, max_gap: int | None = None) -> DataFrame:
    """``snapshots`` as they would be had every listing succeeded: what failed is replaced by the last complete listing before.

    ``snapshots(tick_ts, namespace, …)`` rows of an incomplete listing are dropped, since some tenants may be missing from it; the rows that
    stand in have its time and ``carried`` = true.  Removal is only seen once a complete listing lacks the tenant.
    """
    stored = snapshots.withColumnRenamed("tick_ts", "source_ts")
    joined = stored.join(listing_sources(manifest, max_gap), ["namespace", "source_ts"])
    return joined.select(*snapshots.columns, "carried")


def gated_intervals(snapshots: DataFrame, manifest: DataFrame, max_gap: int | None = None) -> DataFrame:
    """:func:`subscription_intervals` over complete snapshots: no interval ends, and none begins, because a listing failed."""
    whole = complete_snapshots(snapshots, manifest, max_gap)
    return subscription_intervals(whole.select("external_id", "tick_ts"), manifest.select("tick_ts").distinct())


def listing_gaps(manifest: DataFrame) -> DataFrame:
    """Stretches of reconciles that a namespace was not listed completely in: namespace, first and last of them, and how many.

    A stretch before the first complete listing has ``known_before`` = false: nothing could stand in for it.
    """
    ticks = manifest.select("tick_ts").distinct().withColumn("seq", F.row_number().over(Window.orderBy("tick_ts")))
    each = manifest.groupBy("tick_ts", "namespace").agg(F.min(F.coalesce("complete", F.lit(False))).alias("complete")).join(ticks, "tick_ts")
    last = ticks.agg(F.max("seq").alias("last_seq"))  # one row
    order = Window.partitionBy("namespace").orderBy("seq")
    done = each.where("complete").select("namespace", "seq").withColumn("next_seq", F.lead("seq").over(order)).crossJoin(F.broadcast(last))
    after = done.select("namespace", (F.col("seq") + 1).alias("from"), F.coalesce(F.col("next_seq") - 1, F.col("last_seq")).alias("upto"), F.lit(True).alias("known_before"))
    # before the first complete listing only what was tried is known
    bounds = each.groupBy("namespace").agg(F.min("seq").alias("from"), F.min(F.when(F.col("complete"), F.col("seq"))).alias("first_done")).crossJoin(F.broadcast(last))
    before = bounds.select("namespace", "from", F.coalesce(F.col("first_done") - 1, F.col("last_seq")).alias("upto"), F.lit(False).alias("known_before"))
    gaps = after.unionByName(before).where("upto >= `from`")
    at = lambda name, new: ticks.select(F.col("seq").alias(name), F.col("tick_ts").alias(new))
    return gaps.join(at("from", "first_ts"), "from").join(at("upto", "last_ts"), "upto").select("namespace", "first_ts", "last_ts", (F.col("upto") - F.col("from") + 1).cast("bigint").alias("reconciles"), "known_before")
