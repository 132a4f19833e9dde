"""Spend reports: tenants, shares, ranks and the fleet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_subscriptions(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("status = 'active'")


def primary_subscription(subscriptions: DataFrame, order_by: str = "external_id") -> DataFrame:
    """The first active subscription of each customer."""
    order = Window.partitionBy("external_customer_id").orderBy(order_by)
    return active_subscriptions(subscriptions).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def nonzero_usage(rows: DataFrame, cents: str = "amount_cents", units: str = "units_micro") -> DataFrame:
    return rows.where(~((F.coalesce(F.col(cents), F.lit(0)) == 0) & (F.coalesce(F.col(units), F.lit(0)) == 0)))


def tenant_spend(charges: DataFrame, tenant: str = "external_subscription_id") -> DataFrame:
    """Cents by tenant and code, by tenant, and in total; ``level`` is 0, 1 and 3."""
    return charges.rollup(tenant, "code").agg(F.sum("amount_cents").cast("bigint").alias("amount_cents"), F.grouping_id().cast("bigint").alias("level"))


def customer_usage(customers: DataFrame, subscriptions: DataFrame, spend: DataFrame) -> DataFrame:
    """Customers with their primary subscription and its spend; ``pending`` without one, and then no amount."""
    primary = primary_subscription(subscriptions).select(F.col("external_customer_id").alias("external_id"), F.col("external_id").alias("subscription_id"), "plan_code")
    amounts = spend.select(F.col("external_subscription_id").alias("subscription_id"), "amount_cents")
    joined = customers.join(primary, "external_id", "left").join(amounts, "subscription_id", "left")
    return joined.withColumn("status", F.when(F.col("subscription_id").isNull(), "pending").otherwise("active"))


def fleet_summary(spend: DataFrame, name: str = "external_id") -> DataFrame:
    """One row: tenants, total, largest and mean cents, and the top tenant (``-`` if nobody spent)."""
    cents = F.coalesce(F.col("amount_cents"), F.lit(0))
    # of equal amounts the name that sorts first: the largest (cents, reversed order) is found as a minimum
    top = F.min(F.struct((-cents).alias("less"), F.col(name).alias("who")))
    one = spend.agg(F.count("*").alias("tenants"), F.coalesce(F.sum(cents), F.lit(0)).alias("total_cents"), F.coalesce(F.max(cents), F.lit(0)).alias("max_cents"), top.alias("top"))
    mean = F.when(F.col("tenants") > 0, F.floor(F.col("total_cents") / F.col("tenants") + 0.5)).otherwise(0)
    return one.select("tenants", "total_cents", "max_cents", F.when(F.col("max_cents") > 0, F.col("top.who")).otherwise("-").alias("top_tenant"), mean.cast("bigint").alias("mean_cents"))


def top_tenants(spend: DataFrame, k: int, name: str = "external_id") -> DataFrame:
    """The k largest by amount, ties by name: kept as k rows a partition, never fully sorted."""
    return spend.orderBy(F.coalesce(F.col("amount_cents"), F.lit(0)).desc(), name).limit(k)


def top_spender(spend: DataFrame, name: str = "external_id") -> DataFrame:
    return fleet_summary(spend, name).select("top_tenant", "max_cents")


def rank_tenants(spend: DataFrame, name: str = "external_id", partition: str | None = None) -> DataFrame:
    """Place by amount, descending; no usage counts 0.

    The place is the number of tenants with more, plus those with as much and an earlier name.  Amounts are
    counted first, so the only ordered window runs over different amounts, and places within an amount over
    the tenants that share it.
    """
    cents = F.coalesce(F.col("amount_cents"), F.lit(0))
    keyed = spend.withColumn("spent", cents)
    group = [partition] if partition else []
    amounts = keyed.groupBy(*group, "spent").agg(F.count("*").alias("many"))
    above = Window.partitionBy(*group).orderBy(F.col("spent").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = amounts.select(*group, "spent", F.coalesce(F.sum("many").over(above), F.lit(0)).alias("more"))
    inside = Window.partitionBy(*group, "spent").orderBy(name)
    placed = keyed.withColumn("place", F.row_number().over(inside)).join(starts, [*group, "spent"])
    return placed.withColumn("rank", (F.col("more") + F.col("place")).cast("bigint")).drop("place", "more", "spent")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * F.lit(100.0) / whole + 0.5)).otherwise(0).cast("bigint")


def spend_bar_pct(spend: DataFrame) -> DataFrame:
    """Each tenant's share of the largest amount, rounded; the largest is one broadcast row."""
    most = spend.agg(F.max("amount_cents").alias("most"))
    return spend.crossJoin(F.broadcast(most)).withColumn("bar_pct", _percent(F.coalesce(F.col("amount_cents"), F.lit(0)), F.coalesce(F.col("most"), F.lit(0)))).drop("most")


def metric_share_pct(charges: DataFrame, tenant: str = "external_subscription_id") -> DataFrame:
    """Each metric's share of its tenant's amount, at most 100."""
    whole = F.sum("amount_cents").over(Window.partitionBy(tenant))
    return charges.withColumn("share_pct", F.least(F.lit(100), _percent(F.col("amount_cents"), whole)).cast("bigint"))
