"""Metering, rating, lifecycle and reports on small hand-made rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions.settings import Naming
from tallyhouse.operators import collect, convert, counters, discovery, lifecycle, rating, report
from tallyhouse.plans import metering
from tallyhouse.sources import catalog, readers, sinks
from tallyhouse.sources.schemas import SCHEMAS

ACME = Naming("acme", "Acme", "acme.io")
HOUR, GIB = 60 / 3600, 1024**3
T = "2024-01-01 00:00:00"


def table(spark, name, rows):
    schema = SCHEMAS.get(name, name)
    frame = spark.createDataFrame(rows, re.sub(r" timestamp(,|$)", r" string\1", schema))
    times = [f.name for f in spark.createDataFrame([], schema).schema if f.dataType.typeName() == "timestamp"]
    return frame.withColumns({t: F.col(t).cast("timestamp") for t in times}) if times else frame


@pytest.fixture
def tenant(spark):
    row = table(spark, "tenants", [(T, "my-" + "c", "acme-team-gpu", "uid-1", T, {})])
    return discovery.tenant_ids(row, ACME)


def test_ids_of_a_documented_tenant(spark):
    row = discovery.tenant_ids(table(spark, "tenants", [(T, "my-acme", "acme-team-alpha", "u", T, {})]), ACME).collect()[0]
    assert row["external_id"] == "acme-acme-team-alpha-my-acme" and row["subscription_id"] == "sub-" + row["external_id"]
    assert row["display_name"] == "Acme: my-acme (acme-team-alpha)"


def test_a_dedicated_node_gives_seven_events(spark, tenant):
    labels = {"acme.io/managed-by": "team-gpu", "cloud.google.com/gke-accelerator": "nvidia-tesla-t4", "node.kubernetes.io/instance-type": "n1-standard-8"}
    nodes = table(spark, "nodes", [(T, "n1", labels, (8, 30 * GIB, 1, 0)), (T, "n2", {"acme.io/cluster": "other"}, (1, GIB, 0, 0))])
    usage = table(spark, "node_usage", [(T, "n1", 2150, int(8.45 * GIB))])
    events = metering.metering_sweep(tenant, HOUR, nodes=nodes, node_usage=usage, naming=ACME).collect()
    got = {r["transaction_id"].removeprefix("uid-1-").removesuffix("-1704067200"): r for r in events}
    assert set(got) == {"cpu", "mem", "inst", "pn-gpu-nvidia-tesla-t4", "pn-cpu", "pn-mem", "pn-hours"}
    assert {k: got[k]["quantity_micro"] for k in ("pn-cpu", "pn-mem", "pn-gpu-nvidia-tesla-t4", "pn-hours", "cpu")} == {"pn-cpu": 133333, "pn-mem": 500000, "pn-gpu-nvidia-tesla-t4": 16666, "pn-hours": 16666, "cpu": 35833}
    assert json.loads(got["pn-cpu"]["properties"]) == {"cpu_core_hours": 0.133333, "raw_cpu_cores": 8.0, "billing_mode": "private_node", "acme_name": "my-c", "acme_namespace": "acme-team-gpu"}
    assert json.loads(got["pn-gpu-nvidia-tesla-t4"]["properties"]) == {"gpu_hours": 0.016666, "gpu_count": 1, "gpu_type": "nvidia-tesla-t4", "billing_mode": "private_node", "acme_name": "my-c", "acme_namespace": "acme-team-gpu"}
    assert json.loads(got["pn-hours"]["properties"]) == {"private_node_hours": 0.016666, "node_count": 1, "billing_mode": "private_node", "acme_name": "my-c", "acme_namespace": "acme-team-gpu"}
    assert json.loads(got["cpu"]["properties"]) == {"cpu_core_hours": 0.035833, "raw_cpu_cores": 2.15, "cost_multiplier": 1.0, "acme_name": "my-c", "acme_namespace": "acme-team-gpu"}
    assert got["pn-gpu-nvidia-tesla-t4"]["code"] == "acme_gpu_hours"


def test_cpu_memory_and_storage_give_four_events(spark):
    tenants = discovery.tenant_ids(table(spark, "tenants", [(T, f"c{i}", f"ns{i}", f"u{i}", T, {}) for i in range(3)]))
    usage = table(spark, "container_usage", [(T, f"ns{i}", "p", "c", 250, int(0.51 * GIB)) for i in range(3)])
    pvcs = table(spark, "pvcs", [(T, f"ns{i}", n, "Bound", 5 * GIB) for i in range(3) for n in "ab"] + [(T, "ns0", "c", "Pending", GIB)])
    events = metering.metering_sweep(tenants, HOUR, container_usage=usage, pvcs=pvcs)
    assert events.count() == 12
    assert {r["quantity_micro"] for r in events.where("code = 'tenant_storage_gb_hours'").collect()} == {166666}
    assert metering.metering_sweep(tenants, HOUR).count() == 3  # a tenant without samples still bills its instance


def test_utilization_and_network_events(spark, tenant):
    gpu = table(spark, "tick_ts timestamp, namespace string, value double", [(T, "acme-team-gpu", 40.0), (T, "acme-team-gpu", 50.0)])
    egress = table(spark, "tick_ts timestamp, namespace string, egress_bytes double", [(T, "acme-team-gpu", 1.5 * GIB)])
    services = table(spark, "services", [(T, "acme-team-gpu", "a", "LoadBalancer"), (T, "acme-team-gpu", "b", "ClusterIP")])
    events = {r["code"]: json.loads(r["properties"]) for r in metering.metering_sweep(tenant, HOUR, gpu_samples=gpu, egress=egress, services=services, naming=ACME).collect()}
    assert events["acme_gpu_utilization"]["gpu_util_score"] == 0.75 and events["acme_gpu_utilization"]["avg_utilization_pct"] == 45.0 and events["acme_gpu_utilization"]["gpu_count"] == 2
    assert events["acme_network_egress_gb"]["egress_gb"] == 1.5
    assert events["acme_lb_hours"]["lb_count"] == 1


def test_spot_multiplier(spark):
    nodes = table(spark, "nodes", [(T, "s", {"karpenter.sh/capacity-type": "spot"}, None), (T, "d", {}, None)])
    pods = table(spark, "pods", [(T, "a", "p1", "Running", "s", []), (T, "a", "p2", "Running", "d", []), (T, "a", "p3", "Pending", "s", []), (T, "b", "p", "Running", "", []), (T, "c", "p", "Running", "gone", [])])
    got = {r["namespace"]: r["cost_multiplier"] for r in collect.spot_cost_multiplier(pods, nodes).collect()}
    assert got == {"a": pytest.approx(0.7), "c": 1.0}
    tenants = discovery.tenant_ids(table(spark, "tenants", [(T, "n", "b", "u", T, {})]))
    assert collect.meter_tenants(tenants, collect.spot_cost_multiplier(pods, nodes).select("tick_ts", "namespace", "cost_multiplier")).collect()[0]["cost_multiplier"] == 1.0


def test_gpus_of_pods_and_of_dedicated_nodes_without_label(spark):
    nodes = table(spark, "nodes", [(T, "n", {"acme.io/cluster": "a"}, (1, 1, 8, 0))])
    pods = table(spark, "pods", [(T, "a", "p", "Running", "n", [("c", 2, 2)])])
    assert [(r["gpu_type"], r["gpu_count"]) for r in collect.gpu_by_type(pods, nodes).collect()] == [("unknown", 2)]
    tenants = table(spark, "tenants", [(T, "x", "a", "u", T, {}), (T, "y", "a", "v", T, {}), (T, "z", "vc-a", "w", T, {}), (T, "q", "acme-a", "w", T, {})])
    private = collect.private_nodes(collect.match_private_nodes(tenants, nodes, naming=ACME))
    assert sorted(r["namespace"] for r in private.collect()) == ["a", "acme-a", "vc-a"]
    assert collect.private_gpus_by_type(private).count() == 0


def test_custom_label_and_distinct_nodes(spark):
    nodes = table(spark, "nodes", [(T, "n", {"own": "x=a", "acme.io/cluster": "a", "acme.io/managed-by": "a"}, (1, 1, 0, 0)), (T, "m", {"own": "x=b"}, (1, 1, 0, 0))])
    tenants = table(spark, "tenants", [(T, "x", "vc-a", "u", T, {})])
    assert [r["node_name"] for r in collect.match_private_nodes(tenants, nodes, "own=x=%s", ACME).collect()] == ["n"]


def test_two_tenants_of_one_namespace_both_get_its_usage(spark):
    tenants = discovery.tenant_ids(table(spark, "tenants", [(T, "a", "n", "u", T, {}), (T, "b", "n", "v", T, {})]))
    usage = table(spark, "container_usage", [(T, "n", "p", "c", 1000, 0)])
    events = metering.metering_sweep(tenants, HOUR, container_usage=usage)
    assert {(r["transaction_id"], r["quantity_micro"]) for r in events.where("code = 'tenant_cpu_core_hours'").collect()} == {("u-cpu-1704067200", 16666), ("v-cpu-1704067200", 16666)}


def test_discovery_prefers_the_platform_list_as_a_whole(spark):
    scan = table(spark, "tick_ts timestamp, name string", [(t, f"w{i}") for i in range(5) for t in (T, "2024-01-01 00:01:00")])
    platform = table(spark, "tick_ts timestamp, name string", [("2024-01-01 00:01:00", "p")])
    counts = {str(r["tick_ts"]): r["count"] for r in discovery.discover_tenants(scan, platform).groupBy("tick_ts").count().collect()}
    assert list(counts.values()) in ([5, 1], [1, 5])


def test_same_external_id_keeps_the_first_and_counts(spark):
    rows = discovery.tenant_ids(table(spark, "tenants", [(T, "c", "a-b", "late", T, {}), (T, "b-c", "a", "first", T, {})]))
    got = discovery.first_seen_tenants(rows).collect()
    assert [(r["uid"], r["collisions"]) for r in got] == [("first", 2)]


def test_platform_objects_of_odd_shape(spark):
    objects = ['{"metadata":{"name":"a","namespace":5,"labels":{"x":"1","y":2,"z":null}}}', "{}", "no json", '{"metadata":{"creationTimestamp":"2024-01-01T00:00:00Z","uid":null}}', None]
    rows = readers.parse_platform_instances(table(spark, "platform_instances", [(T, o) for o in objects])).collect()
    assert [(r["name"], r["namespace"], r["uid"], r["labels"]) for r in rows] == [("a", "", "", {"x": "1"}), ("", "", "", {}), ("", "", "", {}), ("", "", "", {}), ("", "", "", {})]
    assert [r["created_at"] is not None for r in rows] == [False, False, False, True, False]


def test_responses_of_odd_shape(spark):
    bodies = ['{"status":"success","data":{"result":[{"metric":{"a":"b"},"value":[1,"2.5"]},{"metric":{},"value":[1]},{"metric":{},"value":[1,"abc"]}]}}', '{"status":"error"}', "x", '{"status":"success","data":{"result":[]}}']
    rows = readers.parse_prom_vector(table(spark, "prom_responses", [(T, b) for b in bodies])).collect()
    assert [r["value"] for r in rows] == [2.5, 0.0, 0.0] and rows[0]["labels"] == {"a": "b"}


def test_counter_restart(spark):
    rows = [("2024-01-01 00:00:%02d" % s, v, "x") for s, v in ((0, 10.0), (10, 15.0), (20, 3.0), (30, 4.0))]
    samples = table(spark, "ts timestamp, value double, series string", rows)
    got = counters.counter_rate(samples, ["series"]).collect()[0]
    assert got["increase"] == 9.0 and got["rate"] == pytest.approx(0.3)
    assert counters.counter_rate(samples.limit(1), ["series"]).count() == 0
    sliding = counters.counter_rate(samples, ["series"], 60, 30).collect()
    assert {r["increase"] for r in sliding} == {9.0, 8.0} or len(sliding) == 2


def test_intervals_reopen(spark):
    days = [("id", f"2024-01-0{d} 00:00:00") for d in (1, 2, 5, 6)] + [("all", f"2024-01-0{d} 00:00:00") for d in range(1, 8)]
    snapshots = table(spark, "external_id string, tick_ts timestamp", days)
    spans = sorted((str(r["start_ts"])[:10], str(r["end_ts"])[:10]) for r in lifecycle.subscription_intervals(snapshots).where("external_id = 'id'").collect())
    assert spans == [("2024-01-01", "2024-01-03"), ("2024-01-05", "2024-01-07")]
    assert lifecycle.lifecycle_events(snapshots).groupBy("event").count().collect()


def test_reconciles_that_find_nobody(spark):
    snapshots = table(spark, "external_id string, tick_ts timestamp", [("id", f"2024-01-01 00:0{m}:00") for m in (1, 2, 4)])
    times = table(spark, "tick_ts timestamp", [(f"2024-01-01 00:0{m}:00",) for m in range(1, 6)])
    minute = lambda t: t and t.minute
    spans = sorted((minute(r["start_ts"]), minute(r["end_ts"])) for r in lifecycle.subscription_intervals(snapshots, times).collect())
    assert spans == [(1, 3), (4, 5)]
    events = sorted((minute(r["tick_ts"]), r["event"]) for r in lifecycle.lifecycle_events(snapshots, times).collect())
    assert events == [(1, "created"), (3, "terminated"), (4, "created"), (5, "terminated")]
    known = lifecycle.asof_tenant_set(times, snapshots, times).collect()
    assert sorted(minute(r["tick_ts"]) for r in known) == [1, 2, 4]
    states = {(minute(r["tick_ts"]), r["state"]) for r in lifecycle.tenant_set_diff(*lifecycle.consecutive_sets(snapshots, times), ["tick_ts", "external_id"]).collect()}
    assert states == {(1, "new"), (2, "retained"), (3, "removed"), (4, "new"), (5, "removed")}


def test_resends_are_billed_once_and_prices_apply(spark):
    event = ("t1", "s", "tenant_gpu_hours", 1704067200, '{"gpu_hours":0.016666,"gpu_type":"NVIDIA-T4"}')
    other = ("t2", "s", "tenant_gpu_hours", 1704067260, '{"gpu_hours":10.5,"gpu_type":"new"}')
    events = table(spark, "usage_events", [event, event, other, ("t3", "s", "unknown_code", 1, "{}")])
    usage = rating.period_usage(rating.measured(rating.dedupe_events(events), catalog.metric_catalog(spark)))
    assert {r["gpu_type"]: r["units_micro"] for r in usage.collect()} == {"NVIDIA-T4": 16666, "new": 10_500_000}
    charged = rating.charge_usage(rating.price_usage(usage, catalog.price_book(spark, "default"), catalog.gpu_price_book(spark, "default")))
    assert {r["gpu_type"]: (str(r["unit_price"]), r["amount_cents"]) for r in charged.collect()} == {"NVIDIA-T4": ("0.750000", 1), "new": ("2.500000", 2625)}
    assert rating.differing_resends(events).count() == 0
    assert rating.differing_resends(table(spark, "usage_events", [event, ("t1", *other[1:])])).collect()[0]["variants"] == 2


def test_price_books_hold_the_documented_prices(spark):
    books = {(r["book"], r["code"]): str(r["amount"]) for r in catalog.price_book(spark).collect()}
    assert books["default", "tenant_lb_hours"] == "0.025000" and books["neocloud", "tenant_gpu_hours"] == "3.500000" and books["zero", "tenant_gpu_hours"] == "0.000000"
    assert {r["gpu_type"]: str(r["price"]) for r in catalog.gpu_price_book(spark, "default").collect()}["NVIDIA-T4"] == "0.750000"
    assert catalog.metric_catalog(spark).count() == 9


def test_reports_when_nobody_spends(spark):
    spend = spark.createDataFrame([("b", 0), ("a", None)], "external_id string, amount_cents bigint")
    row = report.fleet_summary(spend).collect()[0]
    assert (row["tenants"], row["total_cents"], row["top_tenant"], row["mean_cents"]) == (2, 0, "-", 0)
    assert {r["bar_pct"] for r in report.spend_bar_pct(spend).collect()} == {0}
    assert [(r["external_id"], r["rank"]) for r in report.rank_tenants(spend).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    empty = report.fleet_summary(spend.where("false")).collect()[0]
    assert (empty["tenants"], empty["top_tenant"]) == (0, "-")


def test_event_batches_and_tables_round_trip(spark, tmp_path):
    rows = [(f"t{i}", "s", "c", 1704067200 + i, '{"x":1}') for i in range(250)]
    events = table(spark, "usage_events", rows).repartition(1)
    batches = sinks.event_batches(events).collect()
    assert sorted(r["n_events"] for r in batches) == [50, 100, 100]
    assert {e["transaction_id"] for r in batches for e in json.loads(r["payload"])["events"]} == {r[0] for r in rows}
    sinks.write_events(events, str(tmp_path / "events"))
    assert spark.read.parquet(str(tmp_path / "events")).where("event_date = date'2024-01-01'").count() == 250
    assert readers.read_inventory(spark, str(tmp_path / "events"), "usage_events").count() == 250
    sinks.write_report(events, str(tmp_path / "report"), "json")
    assert spark.read.json(str(tmp_path / "report")).count() == 250


def test_quantity_strings_become_numbers(spark, tmp_path):
    raw = table(spark, "container_usage_raw", [(T, "n", "p", "c", "250m", "1Gi"), (T, "n", "p", "d", "bad", None)])
    raw.write.parquet(str(tmp_path / "u"))
    got = readers.parsed_usage(readers.read_resource_usage(spark, str(tmp_path / "u"), "container_usage_raw")).collect()
    assert sorted((r["cpu_milli"], r["memory_bytes"]) for r in got) == [(0, 0), (250, GIB)]


def test_results_do_not_depend_on_the_order_of_rows(spark):
    from tallyhouse.fixtures import Inputs

    i = Inputs(spark, "/root/testdata/sf0.001")
    usage = i["container_usage"]
    key = lambda df: sorted(map(tuple, collect.cpu_memory_by_namespace(df).collect()))
    assert key(usage) == key(usage.orderBy(F.rand(3)).repartition(7))


def test_billable_only_looks_at_the_raw_measure(spark):
    rows = spark.createDataFrame([("cpu_core_hours", 1e-9, None), ("cpu_core_hours", 0.0, None), ("cpu_core_hours", float("nan"), None), ("lb_hours", None, 2), ("instance_hours", None, None)], "metric string, raw double, count bigint")
    assert sorted(r["metric"] for r in convert.billable_only(rows).collect()) == ["cpu_core_hours", "instance_hours", "lb_hours"]


def test_dedicated_nodes_by_capacity_or_by_usage(spark, tenant):
    nodes = table(spark, "nodes", [(T, "n1", {"acme.io/managed-by": "team-gpu"}, (8, 30 * GIB, 1, 0))])
    usage = table(spark, "node_usage", [(T, "n1", 2150, int(8.45 * GIB))])
    kinds = lambda how: {r["transaction_id"].split("uid-1-")[1].removesuffix("-1704067200") for r in metering.metering_sweep(tenant, HOUR, nodes=nodes, node_usage=usage, naming=ACME, private_billing=how).collect()}
    assert kinds("capacity") == {"inst", "pn-cpu", "pn-mem", "pn-hours"} and kinds("usage") == {"inst", "cpu", "mem"}
    assert kinds("both") == kinds("capacity") | kinds("usage")
    with pytest.raises(ValueError, match="private_billing"):
        kinds("neither")


def test_a_node_that_two_namespaces_match_is_reported(spark):
    tenants = table(spark, "tenants", [(T, n, ns, n, T, {}) for n, ns in (("a", "acme-x"), ("b", "vc-x"), ("c", "y"))])
    nodes = table(spark, "nodes", [(T, "both", {"acme.io/managed-by": "x"}, None), (T, "one", {"acme.io/managed-by": "acme-x"}, None), (T, "y", {"acme.io/cluster": "y"}, None)])
    matched = collect.match_private_nodes(tenants, nodes, naming=ACME)
    assert [(r["node_name"], r["namespaces"]) for r in collect.shared_private_nodes(matched).collect()] == [("both", ["acme-x", "vc-x"])]


def test_host_clusters_are_kept_apart(spark):
    """The same namespaces and nodes in two clusters: each is metered as it would be alone."""
    tenants = table(spark, "tenants", [(T, "c", "ns", "u", T, {}), (T, "d", "other", "v", T, {})])
    nodes = table(spark, "nodes", [(T, "n1", {"acme.io/managed-by": "ns", "nvidia.com/gpu.product": "T4"}, (8, 30 * GIB, 1, 0))])
    pods = table(spark, "pods", [(T, "other", "p", "Running", "n1", [("c", 2, 2)])])
    usage = table(spark, "container_usage", [(T, "ns", "p", "c", 250, GIB), (T, "other", "p", "c", 500, GIB)])
    node_usage, pvcs = table(spark, "node_usage", [(T, "n1", 1000, GIB)]), table(spark, "pvcs", [(T, "ns", "a", "Bound", GIB)])
    services, gpu = table(spark, "services", [(T, "ns", "s", "LoadBalancer")]), table(spark, "tick_ts timestamp, namespace string, value double", [(T, "ns", 40.0)])

    def sweep(*clusters):
        def laid(df, grows=None):
            if not clusters:
                return df
            parts = [df.withColumn("host_cluster", F.lit(c)) for c in clusters]
            if grows:  # the second cluster uses more
                parts[1] = parts[1].withColumn(grows, F.col(grows) * 2)
            return parts[0].unionByName(parts[1])

        ids = discovery.tenant_ids(laid(tenants).withColumn("uid", F.concat_ws("-", "host_cluster", "uid")) if clusters else tenants, ACME)
        rows = metering.metering_sweep(ids, HOUR, container_usage=laid(usage, "cpu_milli"), pods=laid(pods), nodes=laid(nodes), node_usage=laid(node_usage), pvcs=laid(pvcs), services=laid(services), gpu_samples=laid(gpu), naming=ACME)
        return {r["transaction_id"]: r["quantity_micro"] for r in rows.collect()}

    alone, both = sweep(), sweep("east", "west")
    assert len(both) == 2 * len(alone) and {k.removeprefix("east-"): v for k, v in both.items() if k.startswith("east-")} == alone
    west = {k.removeprefix("west-"): v for k, v in both.items() if k.startswith("west-")}
    assert west["v-cpu-1704067200"] == 2 * alone["v-cpu-1704067200"] and west["u-stor-1704067200"] == alone["u-stor-1704067200"]
    with pytest.raises(ValueError, match="host_cluster"):
        collect.attach_nodes(pods, nodes.withColumn("host_cluster", F.lit("east")))


def test_top_spending_tenants_makes_no_payloads(spark):
    from tallyhouse.queries import QUERIES

    plan = QUERIES["top_spending_tenants"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "tenant_namespace" not in plan and "memory_gb_hours" in plan
