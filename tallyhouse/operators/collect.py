"""Measuring tenants: aggregates of inventory and usage samples per tick and namespace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import is_spot, node_gpu_type, node_selectors, pod_gpu_count, pod_gpu_type, pod_is_spot
from tallyhouse.functions.settings import DEFAULT_NAMING, SPOT_DISCOUNT_PERCENT, Naming

KEY = ["tick_ts", "namespace"]
#: Column of tables that hold several host clusters: names of namespaces and nodes are unique within one only.
HOST = "host_cluster"


def key_of(*frames: DataFrame, base: list[str] | None = None) -> list[str]:
    """The key that tables are grouped and joined by: ``KEY`` (or ``base``), with the host cluster where all of them have one.

    Tables with and without a host cluster cannot be told apart by name, so they are not joined.
    """
    have = [HOST in f.columns for f in frames]
    if any(have) and not all(have):
        raise ValueError(f"{HOST} must be in all tables or in none")
    return [*(base or KEY), *([HOST] if all(have) and have else [])]


def bound_pvcs(df: DataFrame) -> DataFrame:
    return df.where("phase = 'Bound'")


def running_pods(df: DataFrame) -> DataFrame:
    return df.where("phase = 'Running'")


def scheduled_pods(df: DataFrame) -> DataFrame:
    return df.where("node_name <> ''")


def gpu_pods(df: DataFrame) -> DataFrame:
    return df.withColumn("gpu_count", pod_gpu_count(F.col("containers"))).where("gpu_count > 0")


def load_balancers(df: DataFrame) -> DataFrame:
    return df.where("type = 'LoadBalancer'")


def cpu_memory_by_namespace(container_usage: DataFrame) -> DataFrame:
    """Sums stay BIGINT (exact and without order) until the caller divides."""
    return container_usage.groupBy(*key_of(container_usage)).agg(F.sum("cpu_milli").alias("cpu_milli"), F.sum("memory_bytes").alias("memory_bytes"))


def storage_by_namespace(pvcs: DataFrame) -> DataFrame:
    return bound_pvcs(pvcs).groupBy(*key_of(pvcs)).agg(F.sum("storage_bytes").alias("storage_bytes"))


def lb_count(services: DataFrame) -> DataFrame:
    return load_balancers(services).groupBy(*key_of(services)).agg(F.count("*").alias("lb_count"))


def attach_nodes(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pods with gpu_type and spot of their node, in one join; without the node: ``unknown`` and not spot."""
    key = key_of(pods, nodes, base=["tick_ts", "node_name"])
    facts = nodes.select(*key, pod_gpu_type(F.col("labels")).alias("gpu_type"), pod_is_spot(F.col("labels")).alias("spot"))
    joined = pods.join(facts, key, "left")
    return joined.withColumns({"gpu_type": F.coalesce("gpu_type", F.lit("unknown")), "spot": F.coalesce("spot", F.lit(False))})


def attach_gpu_type(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    return attach_nodes(pods, nodes).drop("spot")


def attach_spot(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    return attach_nodes(pods, nodes).drop("gpu_type")


def gpu_by_type(pods: DataFrame, nodes: DataFrame) -> DataFrame:
    return attach_gpu_type(gpu_pods(running_pods(pods)), nodes).groupBy(*key_of(pods), "gpu_type").agg(F.sum("gpu_count").alias("gpu_count"))


def gpu_total(by_type: DataFrame) -> DataFrame:
    return by_type.groupBy(*key_of(by_type)).agg(F.sum("gpu_count").alias("gpu_total"))


def spot_cost_multiplier(pods: DataFrame, nodes: DataFrame, discount_pct: float = SPOT_DISCOUNT_PERCENT) -> DataFrame:
    """1 - discount x share of spot pods among running, scheduled pods; namespaces without such pods have no row (1.0)."""
    seen = attach_spot(scheduled_pods(running_pods(pods)), nodes)
    counts = seen.groupBy(*key_of(seen)).agg(F.count_if("spot").alias("spot_pods"), F.count("*").alias("scheduled_pods"))
    share = F.col("spot_pods").cast("double") / F.col("scheduled_pods")
    return counts.withColumn("cost_multiplier", F.lit(1.0) - F.lit(discount_pct / 100.0) * share)


def match_private_nodes(tenants: DataFrame, nodes: DataFrame, template: str | None = None, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """(tick, namespace, node) for every node with any of the tenant's labels; each node once a namespace.

    The either-or condition becomes one equality join on exploded (key, value) pairs.
    """
    key, at = key_of(tenants, nodes), key_of(tenants, nodes, base=["tick_ts"])
    wanted = tenants.select(*key).distinct().withColumn("pair", F.explode(node_selectors(F.col("namespace"), template, naming)))
    wanted = wanted.select(*key, F.col("pair.key").alias("label_key"), F.col("pair.value").alias("label_value"))
    keys = [f"{naming.label_domain}/managed-by", f"{naming.label_domain}/cluster"] + ([template.partition("=")[0]] if template and "=" in template else [])
    held = nodes.withColumn("cells", F.map_filter("labels", lambda k, _: k.isin(*keys))).where(F.size("cells") > 0)
    held = held.select(*at, "node_name", "labels", "capacity", F.explode("cells").alias("label_key", "label_value"))
    return held.join(wanted, [*at, "label_key", "label_value"]).drop("label_key", "label_value").dropDuplicates([*key, "node_name"])


def shared_private_nodes(matched: DataFrame) -> DataFrame:
    """Nodes that more than one namespace's tenants match, and are billed for: their namespaces, in order.

    Namespaces that differ only in their prefix have the same short name, so a node with that name in its label is dedicated to both.
    """
    each = matched.groupBy(*key_of(matched, base=["tick_ts", "node_name"])).agg(F.sort_array(F.collect_set("namespace")).alias("namespaces"))
    return each.where(F.size("namespaces") > 1)


def private_nodes(matched: DataFrame) -> DataFrame:
    """Capacity, GPU model and spot state of matched nodes."""
    capacity = {f"{c}": F.coalesce(F.col(f"capacity.{c}"), F.lit(0)) for c in ("cpu", "memory", "gpu", "ephemeral_storage")}
    return matched.select(
        *key_of(matched), "node_name", *[v.alias(k) for k, v in capacity.items()], node_gpu_type(F.col("labels")).alias("gpu_type"),
        F.try_element_at("labels", F.lit("node.kubernetes.io/instance-type")).alias("instance_type"), is_spot(F.col("labels")).alias("spot"),
    )


def private_node_usage(private: DataFrame, node_usage: DataFrame) -> DataFrame:
    """Measured usage of the tenant's nodes; a node without a sample counts 0."""
    joined = private.join(node_usage, key_of(private, node_usage, base=["tick_ts", "node_name"]), "left")
    return joined.groupBy(*key_of(private)).agg(F.sum(F.coalesce("cpu_milli", F.lit(0))).alias("cpu_milli"), F.sum(F.coalesce("memory_bytes", F.lit(0))).alias("memory_bytes"))


def private_node_totals(private: DataFrame) -> DataFrame:
    return private.groupBy(*key_of(private)).agg(F.sum("cpu").alias("private_cpu"), F.sum("memory").alias("private_memory"), F.count("*").alias("private_nodes"))


def private_gpus_by_type(private: DataFrame) -> DataFrame:
    """GPUs of dedicated nodes by model; nodes without a model are not billed."""
    return private.where("gpu > 0 and gpu_type <> ''").groupBy(*key_of(private), "gpu_type").agg(F.sum("gpu").alias("gpu_count"))


def combined_usage(by_namespace: DataFrame, of_private: DataFrame) -> DataFrame:
    """Namespace usage plus the measured usage of dedicated nodes."""
    key = key_of(by_namespace, of_private)
    both = by_namespace.select(*key, "cpu_milli", "memory_bytes").unionByName(of_private.select(*key, "cpu_milli", "memory_bytes"))
    return both.groupBy(*key).agg(F.sum("cpu_milli").alias("cpu_milli"), F.sum("memory_bytes").alias("memory_bytes"))


def first_series(samples: DataFrame) -> DataFrame:
    """One sample for each (time, metric, namespace, gpu): that of the least UUID."""
    key = [F.col("ts"), F.col("metric"), F.col("labels.namespace"), F.col("labels.gpu")]
    order = Window.partitionBy(*key).orderBy(F.col("labels.UUID").asc_nulls_last(), "value")
    return samples.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def gpu_memory_join(util: DataFrame, used: DataFrame, free: DataFrame, by: str = "gpu") -> DataFrame:
    """Utilization samples with memory used and total of the same (namespace, gpu), or of the same UUID.

    Index numbers repeat across nodes, so matching by ``gpu`` takes the first series; 0 without a match.
    """
    label = "UUID" if by == "UUID" else "gpu"

    def side(df: DataFrame, name: str) -> DataFrame:
        one = first_series(df) if label == "gpu" else df
        return one.groupBy("ts", F.col("labels.namespace").alias("namespace"), F.col(f"labels.{label}").alias("series")).agg(F.max("value").alias(name))

    # the sum of both series exists only where both do, as in the query language it comes from
    total = _paired(used, free, label)
    base = util.withColumns({"namespace": F.col("labels.namespace"), "series": F.col(f"labels.{label}")})
    joined = base.join(side(used, "memory_used"), ["ts", "namespace", "series"], "left").join(total, ["ts", "namespace", "series"], "left")
    return joined.withColumns({"memory_used": F.coalesce("memory_used", F.lit(0.0)), "memory_total": F.coalesce("memory_total", F.lit(0.0))})


def _paired(used: DataFrame, free: DataFrame, label: str) -> DataFrame:
    key = ["ts", "namespace", "series", "uuid"]

    def flat(df: DataFrame, name: str) -> DataFrame:
        return df.select("ts", F.col("labels.namespace").alias("namespace"), F.col(f"labels.{label}").alias("series"), F.col("labels.UUID").alias("uuid"), F.col("value").alias(name))

    both = flat(used, "used").join(flat(free, "free"), key)
    return both.groupBy("ts", "namespace", "series").agg(F.min_by(F.col("used") + F.col("free"), "uuid").alias("memory_total"))


def gpu_utilization(samples: DataFrame) -> DataFrame:
    """Average over the GPU series of each (tick, namespace), and their number."""
    return samples.groupBy(*key_of(samples)).agg(F.avg("value").alias("avg_util"), F.count("*").alias("gpu_series"))


def meter_tenants(tenants: DataFrame, *measures: DataFrame) -> DataFrame:
    """Every tenant with its namespace's measures; missing ones are 0, a missing multiplier 1.

    Tenants that share a namespace each get all of its usage.
    """
    key = key_of(tenants, *measures)
    joined = reduce(lambda left, right: left.join(right, key, "left"), measures, tenants)
    absent = {c: 1.0 if c == "cost_multiplier" else 0 for m in measures for c in m.columns if c not in key}
    return joined.fillna(absent)
