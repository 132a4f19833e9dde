"""From measures to usage events: one pass over tenant rows, no union of a dozen plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import GIB, event_properties, transaction_id, trunc6, usage_quantity
from tallyhouse.functions.settings import DEFAULT_NAMING, PRIVATE_MODE, Naming
from tallyhouse.operators.collect import key_of

def _kind(kind: str, metric: str, field: str, quantity: Column, emitted: Column, raw: Column | None = None, count: Column | None = None, mode: str | None = None, gpu_type: Column | None = None) -> Column:
    one = F.struct(
        F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.lit(field).alias("field"), quantity.alias("quantity_micro"),
        (raw if raw is not None else F.lit(None)).cast("double").alias("raw"), (count if count is not None else F.lit(None)).cast("bigint").alias("count"),
        (gpu_type if gpu_type is not None else F.lit(None)).cast("string").alias("gpu_type"), F.lit(mode).cast("string").alias("mode"),
    )
    return F.when(emitted, one)


def _positive(x: Column) -> Column:
    return (x > 0) & ~F.isnan(x.cast("double"))


def billable_only(events: DataFrame) -> DataFrame:
    """Drops candidates whose raw measure is zero or absent; instance and dedicated-node hours always stay."""
    raw = F.coalesce(F.col("raw"), F.col("count").cast("double"))
    return events.where((F.col("metric").isin("instance_hours", "private_node_hours")) | F.coalesce(_positive(raw), F.lit(False)))


def meter_events(tenant_metrics: DataFrame, hours: float, naming: Naming = DEFAULT_NAMING, gpus: DataFrame | None = None, private_gpus: DataFrame | None = None) -> DataFrame:
    """Usage events of one row per tenant and tick.

    Measures (0 when absent): cpu_milli, memory_bytes, storage_bytes, avg_util, gpu_series, egress_bytes, lb_count,
    cost_multiplier, private_cpu, private_memory, private_nodes.  ``gpus`` and ``private_gpus`` (tick_ts, namespace,
    gpu_type, gpu_count) add one event for each GPU model.
    """
    have = set(tenant_metrics.columns)

    def of(name: str, default: float = 0.0) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    h = F.lit(hours)
    cores, gib, stored = of("cpu_milli") / F.lit(1000.0), of("memory_bytes") / F.lit(float(GIB)), of("storage_bytes") / F.lit(float(GIB))
    egress, mult, util, nodes = of("egress_bytes") / F.lit(float(GIB)), of("cost_multiplier", 1.0), of("avg_util"), of("private_nodes")
    pn_gib, has_private = of("private_memory") / F.lit(float(GIB)), of("private_nodes") > 0
    kinds = F.array(
        _kind("cpu", "cpu_core_hours", "cpu_core_hours", usage_quantity(cores, h, mult), _positive(cores), cores),
        _kind("mem", "memory_gb_hours", "memory_gb_hours", usage_quantity(gib, h, mult), _positive(gib), gib),
        _kind("stor", "storage_gb_hours", "storage_gb_hours", usage_quantity(stored, h), _positive(stored), stored),
        _kind("inst", "instance_hours", "instance_hours", usage_quantity(F.lit(1.0), h), F.lit(True)),
        _kind("gpuutil", "gpu_utilization", "gpu_util_score", usage_quantity(util, h), of("gpu_series") > 0, util, of("gpu_series")),
        _kind("net", "network_egress_gb", "egress_gb", usage_quantity(egress, F.lit(1.0)), _positive(egress), egress),
        _kind("lb", "lb_hours", "lb_hours", usage_quantity(of("lb_count"), h), of("lb_count") > 0, None, of("lb_count")),
        _kind("pn-cpu", "cpu_core_hours", "cpu_core_hours", usage_quantity(of("private_cpu"), h), has_private & (of("private_cpu") > 0), of("private_cpu"), None, PRIVATE_MODE),
        _kind("pn-mem", "memory_gb_hours", "memory_gb_hours", usage_quantity(pn_gib, h), has_private & _positive(pn_gib), pn_gib, None, PRIVATE_MODE),
        _kind("pn-hours", "private_node_hours", "private_node_hours", usage_quantity(nodes, h), has_private, None, nodes, PRIVATE_MODE),
    )
    sides = [(by_type, kind, mode) for by_type, kind, mode in ((gpus, "gpu", None), (private_gpus, "pn-gpu", PRIVATE_MODE)) if by_type is not None]
    if sides:
        tenant_metrics = tenant_metrics.join(_models(sides), key_of(tenant_metrics, *[s for s, _, _ in sides]), "left")
        # the models of a namespace lie in one array, so tenants are read and exploded once
        one = lambda g: F.struct(
            g["kind"].alias("kind"), F.lit("gpu_hours").alias("metric"), F.lit("gpu_hours").alias("field"), usage_quantity(g["gpu_count"], h).alias("quantity_micro"),
            F.lit(None).cast("double").alias("raw"), g["gpu_count"].alias("count"), g["gpu_type"].alias("gpu_type"), g["mode"].alias("mode"),
        )
        kinds = F.concat(kinds, F.transform(F.coalesce("gpu_models", F.array().cast(_MODELS)), one))
    tenant = ["tick_ts", "uid", "name", "namespace", "subscription_id"]
    base = tenant_metrics.select(*tenant, mult.alias("cost_multiplier"), F.explode(F.filter(kinds, lambda e: e.isNotNull())).alias("e"))
    return _finished(base, naming)


_MODELS = "array<struct<kind:string,gpu_type:string,gpu_count:bigint,mode:string>>"


def _models(sides: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(key, gpu_models): a row for each namespace with its GPU models, shared and dedicated; models are few."""
    key = key_of(*[s for s, _, _ in sides])
    rows = [
        s.where("gpu_count > 0").select(*key, F.struct(F.lit(kind).alias("kind"), F.col("gpu_type").alias("gpu_type"), F.col("gpu_count").cast("bigint").alias("gpu_count"), F.lit(mode).cast("string").alias("mode")).alias("model"))
        for s, kind, mode in sides
    ]
    both = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    return both.groupBy(*key).agg(F.collect_list("model").alias("gpu_models"))


def _finished(base: DataFrame, naming: Naming) -> DataFrame:
    e, unix = F.col("e"), F.unix_timestamp("tick_ts")
    with_gpu = F.col("e.gpu_type").isNotNull()
    ident = F.when(with_gpu, transaction_id(F.col("uid"), e["kind"], e["gpu_type"], unix)).otherwise(transaction_id(F.col("uid"), e["kind"], None, unix))
    word, quantity, raw, metric, private = naming.word, e["quantity_micro"] / F.lit(1e6), trunc6(e["raw"]), e["metric"], e["mode"].isNotNull()

    def only(condition: Column, value: Column, name: str) -> Column:
        return F.when(condition, value).alias(name)

    fields = ("cpu_core_hours", "memory_gb_hours", "storage_gb_hours", "instance_hours", "gpu_hours", "gpu_util_score", "egress_gb", "lb_hours", "private_node_hours")
    properties = event_properties(
        *[only(e["field"] == f, quantity, f) for f in fields],
        only(metric == "cpu_core_hours", raw, "raw_cpu_cores"),
        only((metric == "cpu_core_hours") & ~private, trunc6(F.col("cost_multiplier")), "cost_multiplier"),
        only(metric == "memory_gb_hours", raw, "raw_memory_gb"),
        only(metric == "storage_gb_hours", raw, "raw_storage_gb"),
        only(metric == "gpu_utilization", raw, "avg_utilization_pct"),
        only(metric.isin("gpu_hours", "gpu_utilization"), e["count"], "gpu_count"),
        e["gpu_type"].alias("gpu_type"),
        only(metric == "lb_hours", e["count"], "lb_count"),
        only(metric == "private_node_hours", e["count"], "node_count"),
        e["mode"].alias("billing_mode"),
        F.col("name").alias(f"{word}_name"),
        F.col("namespace").alias(f"{word}_namespace"),
    )
    return base.select(
        "tick_ts", ident.alias("transaction_id"), F.col("subscription_id").alias("external_subscription_id"), F.concat(F.lit(f"{word}_"), metric).alias("code"),
        unix.alias("timestamp"), e["quantity_micro"].alias("quantity_micro"), e["gpu_type"].alias("gpu_type"), e["mode"].alias("billing_mode"), properties.alias("properties"),
    )
