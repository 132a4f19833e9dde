"""A deterministic mapping from the given star-schema tables to the domain tables.

Each mapping is one SQL text with two spellings of a few functions, so Spark and DuckDB derive the
same rows; maps, arrays and structs are put together from flat columns on the Spark side.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
T0 = "timestamp '2024-01-01 00:00:00'"
T0_US = 1704067200 * 1_000_000
#: Word for tenants in the mapping's ids and labels; the operators' default.
WORD, DOMAIN = "tenant", "tenancy.example.com"


class Spark:
    tenants = None  # the number of tenants, once it is counted
    unix = staticmethod(lambda x: f"unix_timestamp(cast({x} as timestamp))")
    us = staticmethod(lambda x: f"unix_micros(cast({x} as timestamp))")
    from_us = staticmethod(lambda x: f"timestamp_micros({x})")
    key = staticmethod(lambda x, k: f"get_json_object({x}, '$.{k}')")
    div = staticmethod(lambda a, b: f"(({a}) div {b})")


class Duck:
    tenants = "(select count(*) from {supplier})"
    unix = staticmethod(lambda x: f"cast(floor(epoch({x})) as bigint)")
    us = staticmethod(lambda x: f"epoch_us({x})")
    from_us = staticmethod(lambda x: f"make_timestamp({x})")
    key = staticmethod(lambda x, k: f"json_extract_string({x}, '$.{k}')")
    div = staticmethod(lambda a, b: f"(({a}) // {b})")


def _ns(k: str) -> str:
    return f"((case ({k}) % 3 when 0 then '{WORD}-team-' when 1 then 'vc-team-' else 'team-' end) || cast({k} as string))"


def texts(d) -> dict[str, str]:
    """SQL of every derived table, with {name} for the tables it reads."""
    owner = "o"  # of a row of the part table; the number of tenants is looked up once a table
    return {
        "tenants": f"select {T0} as tick_ts, s_suppkey as k, 'tc-' || cast(s_suppkey as string) as name, {_ns('s_suppkey')} as namespace, 'uid-' || cast(s_suppkey as string) as uid, {d.from_us(f'{T0_US} + s_suppkey * 3600000000')} as created_at from {{supplier}}",
        "workloads": f"""
select tick_ts, case when k % 5 = 0 then 'Deployment' else 'StatefulSet' end as kind, name, namespace, uid, '{WORD}' as app from {{tenants}}
union all select tick_ts, 'Deployment', name, namespace, uid || '-d', '{WORD}' from {{tenants}} where k % 7 = 0 and k % 5 <> 0
union all select tick_ts, 'StatefulSet', 'other-' || cast(k as string), namespace, uid || '-o', 'web' from {{tenants}}""",
        "node_rows": f"""
select {T0} as tick_ts, p_partkey as k, 'node-' || cast(p_partkey as string) as node_name,
  case p_type when 'PROMO' then 'NVIDIA H100 80GB' when 'LARGE' then 'NVIDIA-L40S' when 'MEDIUM' then 'NVIDIA-T4' end as gpu_product,
  case when p_type = 'SMALL' then 'nvidia-tesla-t4' end as gke_accelerator,
  case p_size % 5 when 0 then 'spot' when 1 then 'on-demand' end as karpenter,
  case when p_partkey % 7 = 0 then 'SPOT' end as eks,
  case p_partkey % 8 when 0 then {_ns(owner)} when 1 then 'team-' || cast({owner} as string) end as managed_by,
  case p_partkey % 8 when 1 then {_ns(owner)} when 2 then 'team-' || cast({owner} as string) end as cluster,
  cast(p_size as bigint) as cpu, cast(floor(p_retailprice) as bigint) * 1073741824 as memory,
  case when p_type in ('PROMO', 'LARGE', 'STANDARD') then cast(p_size % 9 as bigint) else cast(0 as bigint) end as gpu
from (select *, p_partkey % {d.tenants} as o from {{part}}) parts""",
        "container_rows": f"""
select {T0} as tick_ts, {_ns('l_suppkey')} as namespace, 'pod-' || cast(l_suppkey as string) || '-' || cast(l_orderkey as string) as pod,
  case o_orderstatus when 'F' then 'Running' when 'O' then 'Pending' else 'Succeeded' end as phase, l_partkey, l_linenumber, l_quantity, l_extendedprice,
  case when l_linenumber % 3 = 0 then null else cast(l_linenumber % 3 as bigint) end as gpu_limit,
  case when l_linenumber % 2 = 0 and l_linenumber % 3 <> 0 then cast(l_linenumber % 3 as bigint) end as gpu_request
from {{lineitem}} join {{orders}} on l_orderkey = o_orderkey""",
        "pvcs": f"select {T0} as tick_ts, {_ns('t')} as namespace, 'pvc-' || cast(o_orderkey as string) as name, case when o_orderstatus = 'F' then 'Bound' else 'Pending' end as phase, cast(floor(o_totalprice) as bigint) * 1048576 as storage_bytes from (select *, o_custkey % {d.tenants} as t from {{orders}}) o",
        "services": f"select {T0} as tick_ts, {_ns('t')} as namespace, 'svc-' || cast(c_custkey as string) as name, case when c_mktsegment = 'BUILDING' then 'LoadBalancer' else 'ClusterIP' end as type from (select *, c_custkey % {d.tenants} as t from {{customer}}) c",
        "node_usage": "select tick_ts, node_name, cpu * 500 as cpu_milli, memory / 2 as memory_bytes from {node_rows} where k % 10 <> 0".replace("memory / 2", d.div("memory", 2)),
        "container_now": f"select {T0} as tick_ts, {_ns('l_suppkey')} as namespace, 'pod-' || cast(l_orderkey as string) as pod, cast(l_linenumber as string) as container, cast(l_quantity * 100 as bigint) as cpu_milli, cast(floor(l_extendedprice) as bigint) * 1048576 as memory_bytes from {{lineitem}}",
        "container_usage": f"select cast(date_trunc('week', l_shipdate) as timestamp) as tick_ts, {_ns('l_suppkey')} as namespace, 'pod-' || cast(l_orderkey as string) as pod, cast(l_linenumber as string) as container, cast(l_quantity * 100 as bigint) as cpu_milli, cast(floor(l_extendedprice) as bigint) * 1048576 as memory_bytes from {{lineitem}}",
        "counter_rows": f"""
select event_id, user_id, event_type, {_ns('t')} as namespace, {d.from_us(f"{T0_US} + " + d.div(f"{d.us('ts')} - {T0_US}", 1440))} as ts, cast(round(value * 100) as bigint) as cents,
  case when cast({d.key('props', 'k')} as int) < 10 then 1 else 0 end as restart from (select *, user_id % {d.tenants} as t from {{events}}) e""",
        "counter_runs": "select *, sum(restart) over (partition by user_id, event_type order by ts, event_id rows unbounded preceding) as run from {counter_rows}",
        "counters": "select event_id, user_id, event_type, namespace, ts, cast(sum(cents) over (partition by user_id, event_type, run order by ts, event_id rows unbounded preceding) as double) as value from {counter_runs}",
        "gpu_samples": f"select {T0} as tick_ts, {_ns('t')} as namespace, cast(user_id % 8 as string) as gpu, user_id as uuid, event_type, event_id, least(value, cast(100 as double)) as value from (select *, user_id % {d.tenants} as t from {{events}}) e where event_type in ('view', 'click')",
        "reconciles": f"select distinct cast(date_trunc('day', ts) as timestamp) as tick_ts, 'id-' || cast(user_id as string) as external_id from {{events}}",
        "reconcile_times": "select tick_ts from {reconciles} union select tick_ts + interval 12 hours from {reconciles} where extract(day from tick_ts) % 4 = 0",
        # listings by namespace: one fails every day (half of its tenants are missing then), another is not tried every fifth day
        "listings": "select distinct cast(date_trunc('day', ts) as timestamp) as tick_ts, user_id % 7 as k from {events} where not (user_id % 7 = 3 and extract(day from ts) % 5 = 2)",
        "manifest": "select tick_ts, 'ns-' || cast(k as string) as namespace, k <> extract(day from tick_ts) % 9 as complete from {listings}",
        "ns_snapshots": "select distinct cast(date_trunc('day', ts) as timestamp) as tick_ts, 'id-' || cast(user_id as string) as external_id, 'ns-' || cast(user_id % 7 as string) as namespace from {events} where not (user_id % 7 = extract(day from ts) % 9 and user_id % 2 = 0) and not (user_id % 7 = 3 and extract(day from ts) % 5 = 2)",
        # a third of all intervals and samples are one tenant's
        "spans": f"""
select o_orderkey as span_id, case when o_orderkey % 3 = 0 then 'busy' else 'id-' || cast(o_orderkey % 50 as string) end as external_id, {d.from_us(f"{d.us('o_orderdate')} + (o_custkey % 24) * 3600000000")} as start_ts,
  case when o_orderkey % 1000 = 0 then null else {d.from_us(f"{d.us('o_orderdate')} + (o_custkey % 24 + case when o_orderkey % 500 = 1 then 9600 when o_orderkey % 50 = 2 then -1 else o_custkey % 60 end) * 3600000000")} end as end_ts from {{orders}}""",
        "span_points": f"select l_orderkey * 8 + l_linenumber as point_id, case when l_orderkey % 3 = 0 then 'busy' else 'id-' || cast(l_orderkey % 50 as string) end as external_id, {d.from_us(f"{d.us('l_shipdate')} + l_linenumber * 3600000000")} as tick_ts, cast(l_quantity as bigint) as units from {{lineitem}}",
        # container samples as JSON lines, some of them broken: ``wrong`` says how
        "usage_lines": """
select line, wrong, namespace, pod, container, cpu_milli, memory_bytes, case wrong when 1 then ' ' when 2 then substr(good, 1, 40) when 3 then '[' || good || ']' else good end as value from (
 select *, '{{"tick_ts":"2024-01-01T00:00:00Z"' || case when wrong = 4 then '' else ',"namespace":"' || namespace || '"' end || ',"pod":"' || pod || '","container":"' || container || '","cpu_milli":' || case wrong when 5 then '"many"' when 6 then '-1' else cast(cpu_milli as string) end
  || ',"memory_bytes":' || case wrong when 5 then '1.5' else cast(memory_bytes as string) end || case when wrong = 7 then ',"extra":{{"a":[1]}}' else '' end || '}}' as good from (
  select namespace, pod, container, cpu_milli, memory_bytes, pod || '/' || container || '/' || namespace as line, memory_bytes % 29 % 12 as wrong from {container_now}) r) r""",
        "usage_rows": f"""
select event_id, 'id-' || cast(user_id as string) as subscription, '{WORD}_' || case event_type when 'click' then 'cpu_core_hours' when 'view' then 'memory_gb_hours' when 'purchase' then 'gpu_hours' when 'signup' then 'network_egress_gb' else 'lb_hours' end as code,
  case event_type when 'click' then 'cpu_core_hours' when 'view' then 'memory_gb_hours' when 'purchase' then 'gpu_hours' when 'signup' then 'egress_gb' else 'lb_hours' end as field,
  {d.unix('ts')} as unix, value, case when event_type = 'purchase' then case user_id % 3 when 0 then 'NVIDIA-T4' when 1 then 'NVIDIA-L40S' else 'OTHER' end end as gpu_type from {{events}}""",
        "usage_events": """
select 'uid-' || subscription || '-' || cast(unix as string) || '-' || cast(event_id as string) as transaction_id, subscription as external_subscription_id, code, unix as timestamp,
  '{{"' || field || '":' || cast(value as string) || case when gpu_type is null then '' else ',"gpu_type":"' || gpu_type || '"' end || '}}' as properties
from (select * from {usage_rows} union all select * from {usage_rows} where event_id % 10 = 0) r""",
        "customers": "select 'c-' || cast(c_custkey as string) as external_id, c_name as name, 'USD' as currency from {customer}",
        "subscriptions": "select 'c-' || cast(o_custkey as string) as external_customer_id, 'standard' as plan_code, o_orderkey as external_id, case when o_orderstatus = 'O' then 'active' else 'terminated' end as status from {orders}",
        "spend": "select 'c-' || cast(c_custkey as string) as external_id, case when c_custkey % 9 = 0 then null else cast(round(abs(c_acctbal)) as bigint) end as amount_cents from {customer}",
    }


def oracle(sql: str) -> str:
    """A DuckDB query on the base tables: the derived tables it reads become CTEs."""
    known, order = texts(Duck), []

    def visit(text: str) -> None:
        for name in re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(sql)
    names = {n: n for n in (*BASE, *(f"fx_{n}" for n in known))} | {n: f"fx_{n}" for n in known}
    ctes = [f"fx_{n} AS ({known[n].format(**names)})" for n in order]
    body = sql.format(**names)
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + (",\n" + body.lstrip()[5:] if body.lstrip()[:5].upper() == "WITH " else "\n" + body)


class Inputs:
    """Base and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self._held, self._texts = spark, sf_dir, {}, None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._held:  # each table's files are looked at once
            self._held[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet") if name in BASE else self.sql(self._text(name))
        return self._held[name]

    def _text(self, name: str) -> str:
        if self._texts is None:
            # counted once for all derived tables, so that plans do not repeat the count
            counted = type("Counted", (Spark,), {"tenants": str(self["supplier"].count())})
            self._texts = texts(counted)
        return self._texts[name]

    def sql(self, text: str) -> DataFrame:
        used = {n: self[n] for n in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))}
        return self.spark.sql(text, **used)

    def nodes(self) -> DataFrame:
        labels = {
            "nvidia.com/gpu.product": "gpu_product", "cloud.google.com/gke-accelerator": "gke_accelerator", "karpenter.sh/capacity-type": "karpenter",
            "eks.amazonaws.com/capacityType": "eks", f"{DOMAIN}/managed-by": "managed_by", f"{DOMAIN}/cluster": "cluster",
        }
        held = F.map_filter(F.create_map(*[x for k, c in labels.items() for x in (F.lit(k), F.col(c))]), lambda _, v: v.isNotNull())
        capacity = F.struct("cpu", "memory", "gpu", F.lit(0).cast("bigint").alias("ephemeral_storage"))
        return self["node_rows"].select("tick_ts", "node_name", held.alias("labels"), capacity.alias("capacity"))

    def pods(self) -> DataFrame:
        one = F.struct("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "gpu_request", "gpu_limit")
        grouped = self["container_rows"].groupBy("tick_ts", "namespace", "pod", "phase").agg(F.sort_array(F.collect_list(one)).alias("c"), F.min("l_partkey").alias("part"))
        containers = F.transform("c", lambda x: F.struct(x["l_linenumber"].cast("string").alias("name"), x["gpu_request"].alias("gpu_request"), x["gpu_limit"].alias("gpu_limit")))
        return grouped.select("tick_ts", "namespace", "pod", "phase", F.concat(F.lit("node-"), F.col("part").cast("string")).alias("node_name"), containers.alias("containers"))

    def workloads(self) -> DataFrame:
        rows = self["workloads"]
        return rows.select("tick_ts", "kind", "name", "namespace", "uid", F.lit(None).cast("timestamp").alias("created_at"), F.create_map(F.lit("app"), "app").alias("labels"))

    def prom(self, types: tuple[str, ...]) -> DataFrame:
        rows = self["gpu_samples"].where(F.col("event_type").isin(*types))
        labels = F.create_map(F.lit("namespace"), "namespace", F.lit("gpu"), "gpu", F.lit("UUID"), F.lpad(F.col("uuid").cast("string"), 6, "0"))
        return rows.select(F.col("tick_ts").alias("ts"), F.lit("m").alias("metric"), labels.alias("labels"), "value", "event_id")
