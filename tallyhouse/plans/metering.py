"""The three workloads end to end: metering sweep, lifecycle, and usage to spend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.settings import DEFAULT_NAMING, SPOT_DISCOUNT_PERCENT, Naming
from tallyhouse.operators import collect, convert, discovery, rating, report
from tallyhouse.sources.catalog import gpu_price_book, price_book


def metering_sweep(
    tenants: DataFrame,
    hours: float,
    *,
    container_usage: DataFrame | None = None,
    pods: DataFrame | None = None,
    nodes: DataFrame | None = None,
    node_usage: DataFrame | None = None,
    pvcs: DataFrame | None = None,
    services: DataFrame | None = None,
    gpu_samples: DataFrame | None = None,
    egress: DataFrame | None = None,
    discount_pct: float = SPOT_DISCOUNT_PERCENT,
    template: str | None = None,
    naming: Naming = DEFAULT_NAMING,
    private_billing: str = "both",
) -> DataFrame:
    """Usage events of all tenants at all ticks, from whichever sources are given.

    Every aggregate has the key (tick_ts, namespace), and ``host_cluster`` where the tables have it, so they meet the tenants in one partitioning.
    Dedicated nodes are billed by their capacity and by the usage measured on them; with ``private_billing`` ``"capacity"`` or ``"usage"``
    by one of the two only.
    """
    if private_billing not in ("both", "capacity", "usage"):
        raise ValueError(f"private_billing is {private_billing!r}, not 'both', 'capacity' or 'usage'")
    measures, gpus, private_gpus, usage, private = [], None, None, None, None
    if container_usage is not None:
        usage = collect.cpu_memory_by_namespace(container_usage)
    if nodes is not None:
        private = collect.private_nodes(collect.match_private_nodes(tenants, nodes, template, naming))
        if private_billing != "usage":
            measures.append(collect.private_node_totals(private))
            private_gpus = collect.private_gpus_by_type(private)
        if node_usage is not None and private_billing != "capacity":
            of_private = collect.private_node_usage(private, node_usage)
            usage = of_private if usage is None else collect.combined_usage(usage, of_private)
    if usage is not None:
        measures.append(usage)
    if pvcs is not None:
        measures.append(collect.storage_by_namespace(pvcs))
    if services is not None:
        measures.append(collect.lb_count(services))
    if pods is not None and nodes is not None:
        measures.append(collect.spot_cost_multiplier(pods, nodes, discount_pct).select(*collect.key_of(pods), "cost_multiplier"))
        gpus = collect.gpu_by_type(pods, nodes)
    if gpu_samples is not None:
        measures.append(collect.gpu_utilization(gpu_samples))
    if egress is not None:
        measures.append(egress.select(*collect.key_of(egress), "egress_bytes"))
    return convert.meter_events(collect.meter_tenants(tenants, *measures), hours, naming, gpus, private_gpus)


def spend_by_subscription(events: DataFrame, book: str = "default", naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Events to cents by subscription and code under one price book, all periods together."""
    spark = events.sparkSession
    usage = rating.period_usage(rating.dedupe_events(events))
    priced = rating.charge_usage(rating.price_usage(usage, price_book(spark, book, naming=naming), gpu_price_book(spark, book)))
    return priced.groupBy("external_subscription_id", "code").agg(F.sum("amount_cents").alias("amount_cents"), F.sum("units_micro").alias("units_micro"))


def top_spending_tenants(tenants: DataFrame, container_usage: DataFrame, hours: float, k: int = 10, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """The minimum slice from samples to a spend report: who spends most."""
    identified = discovery.tenant_ids(tenants, naming)
    ticks = container_usage.select("tick_ts", "namespace").distinct()
    at_ticks = identified.drop("tick_ts").join(ticks, "namespace")
    events = metering_sweep(at_ticks, hours, container_usage=container_usage, naming=naming)
    # texts of the payload decide between differing resends after all that is billed, so they need not be made and shuffled
    spend = spend_by_subscription(events.drop("billing_mode", "properties"), naming=naming).groupBy("external_subscription_id").agg(F.sum("amount_cents").alias("amount_cents"))
    return report.top_tenants(spend, k, name="external_subscription_id")
