"""Schemas of the domain tables; ``tick_ts`` is the time of the sweep or snapshot."""

SCHEMAS = {
    "workloads": "tick_ts timestamp, kind string, name string, namespace string, uid string, created_at timestamp, labels map<string,string>",
    "platform_instances": "tick_ts timestamp, obj string",
    "tenants": "tick_ts timestamp, name string, namespace string, uid string, created_at timestamp, labels map<string,string>",
    "pods": "tick_ts timestamp, namespace string, pod string, phase string, node_name string, containers array<struct<name:string,gpu_request:bigint,gpu_limit:bigint>>",
    "container_usage": "tick_ts timestamp, namespace string, pod string, container string, cpu_milli bigint, memory_bytes bigint",
    "container_usage_raw": "tick_ts timestamp, namespace string, pod string, container string, cpu string, memory string",
    "node_usage": "tick_ts timestamp, node_name string, cpu_milli bigint, memory_bytes bigint",
    "nodes": "tick_ts timestamp, node_name string, labels map<string,string>, capacity struct<cpu:bigint,memory:bigint,gpu:bigint,ephemeral_storage:bigint>",
    "pvcs": "tick_ts timestamp, namespace string, name string, phase string, storage_bytes bigint",
    "services": "tick_ts timestamp, namespace string, name string, type string",
    "prom_samples": "ts timestamp, metric string, labels map<string,string>, value double",
    "prom_responses": "tick_ts timestamp, body string",
    "reconciles": "tick_ts timestamp, external_id string, name string, namespace string",
    "usage_events": "transaction_id string, external_subscription_id string, code string, timestamp bigint, properties string",
    "customers": "external_id string, name string, currency string",
    "subscriptions": "external_customer_id string, plan_code string, external_id string, status string",
}

#: Columns that a row cannot do without: its time and the keys that it is joined and summed by.
REQUIRED = {
    "workloads": ("tick_ts", "kind", "name", "namespace"),
    "platform_instances": ("tick_ts", "obj"),
    "tenants": ("tick_ts", "name", "namespace"),
    "pods": ("tick_ts", "namespace", "pod"),
    "container_usage": ("tick_ts", "namespace", "pod", "container"),
    "container_usage_raw": ("tick_ts", "namespace", "pod", "container"),
    "node_usage": ("tick_ts", "node_name"),
    "nodes": ("tick_ts", "node_name"),
    "pvcs": ("tick_ts", "namespace", "name"),
    "services": ("tick_ts", "namespace", "name"),
    "prom_samples": ("ts", "metric", "value"),
    "prom_responses": ("tick_ts", "body"),
    "reconciles": ("tick_ts", "external_id"),
    "usage_events": ("transaction_id", "external_subscription_id", "code", "timestamp"),
    "customers": ("external_id",),
    "subscriptions": ("external_customer_id", "external_id"),
}
#: Numbers that cannot be less than zero.
NOT_NEGATIVE = ("cpu_milli", "memory_bytes", "storage_bytes", "timestamp")
