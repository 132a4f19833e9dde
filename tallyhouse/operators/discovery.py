"""Tenant discovery: which tenants exist at each tick."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import rfc3339
from tallyhouse.functions.settings import DEFAULT_NAMING, Naming


def filter_label(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.try_element_at("labels", F.lit(key)) == value)


def filter_namespaces(df: DataFrame, namespaces: list[str] | DataFrame) -> DataFrame:
    """Rows of the watched namespaces; an empty list watches all.  A DataFrame(namespace) is joined instead."""
    if isinstance(namespaces, DataFrame):
        return df.join(namespaces.select("namespace").distinct(), "namespace", "left_semi")
    return df.where(F.col("namespace").isin(*namespaces)) if namespaces else df


def tenant_ids(df: DataFrame, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    w = naming.word
    return df.withColumns(
        {
            "external_id": F.concat_ws("-", F.lit(w), "namespace", "name"),
            "subscription_id": F.concat_ws("-", F.lit(f"sub-{w}"), "namespace", "name"),
            "display_name": F.concat(F.lit(f"{naming.title}: "), "name", F.lit(" ("), "namespace", F.lit(")")),
        }
    )


def dedupe_deployments(stateful: DataFrame, deployments: DataFrame) -> DataFrame:
    """StatefulSets, and those Deployments that have no StatefulSet of the same name in the namespace."""
    extra = deployments.join(stateful.select("tick_ts", "namespace", "name"), ["tick_ts", "namespace", "name"], "left_anti")
    return stateful.unionByName(extra)


def workload_tenants(workloads: DataFrame, app: str, namespaces: list[str] | None = None) -> DataFrame:
    """Tenants found by the label ``app`` of their workloads."""
    found = filter_namespaces(filter_label(workloads, "app", app), namespaces or [])
    return dedupe_deployments(found.where("kind = 'StatefulSet'"), found.where("kind = 'Deployment'")).drop("kind")


def discover_tenants(workloads: DataFrame, platform: DataFrame) -> DataFrame:
    """At each tick the platform's list as a whole if it has any row, else the workload scan."""
    scanned = workloads.join(platform.select("tick_ts").distinct(), "tick_ts", "left_anti")
    return platform.unionByName(scanned)


def first_seen_tenants(tenants: DataFrame) -> DataFrame:
    """The first record of every external id; ``collisions`` counts the different (namespace, name) pairs behind it."""
    order = Window.partitionBy("external_id").orderBy("tick_ts", "namespace", "name")
    whole = Window.partitionBy("external_id")
    pairs = F.size(F.collect_set(F.struct("namespace", "name")).over(whole))
    return tenants.withColumns({"seen": F.row_number().over(order), "collisions": pairs}).where("seen = 1").drop("seen")


def customer_dim(tenants: DataFrame, currency: str = "USD", naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Customer rows with their metadata as an array of key and value."""
    items = {"name": F.col("name"), "namespace": F.col("namespace"), "uid": F.col("uid"), "created_at": rfc3339(F.col("created_at"))}
    metadata = F.array(*[F.struct(F.lit(f"{naming.word}_{k}" if k != "created_at" else k).alias("key"), v.alias("value")) for k, v in items.items()])
    return tenants.select("external_id", F.col("display_name").alias("name"), F.lit(currency).alias("currency"), metadata.alias("metadata"))


def subscription_dim(tenants: DataFrame, plan_code: str) -> DataFrame:
    return tenants.select(
        F.col("external_id").alias("external_customer_id"), F.lit(plan_code).alias("plan_code"), F.col("subscription_id").alias("external_id"), F.lit("active").alias("status")
    )


def union_events(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
