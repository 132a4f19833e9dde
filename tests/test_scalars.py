"""Scalar functions: documented values and edge cases."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import scalars as S
from tallyhouse.functions.settings import Naming


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double"}
    row = spark.range(1).select(*[F.lit(v).cast(kinds.get(type(v), "string")).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("x, expected", [(8.2, 8.199999), (0.0166666666, 0.016666), (-1.9999999, -1.999999), (0.0, 0.0), (float("nan"), None), (1e300, None)])
def test_trunc6_cuts_toward_zero(spark, x, expected):
    assert one(spark, S.trunc6(F.col("x")), x=x) == expected


def test_documented_quantities(spark):
    hour = F.lit(60 / 3600)
    assert one(spark, S.usage_quantity(F.lit(8.0), hour)) == 133333
    assert one(spark, S.usage_quantity(F.lit(30.0), hour)) == 500000
    assert one(spark, S.usage_quantity(F.lit(1), hour)) == 16666
    assert one(spark, S.usage_quantity(F.lit(96), F.lit(1.0))) == 96_000_000


@pytest.mark.parametrize(
    "text, scale, expected",
    [("250m", 1000, 250), ("1", 1000, 1000), ("1.5", 1000, 1500), ("100n", 1000, 1), ("1u", 1000, 1), ("8Gi", 1, 8 * 2**30), ("1.5Ki", 1, 1536), ("2M", 1, 2_000_000), ("1e3", 1, 1000), ("1E", 1, 10**18),
     ("12E2", 1, 1200), ("5e-1", 1, 1), (".5", 1000, 500), ("", 1, 0), ("abc", 1, 0), ("1 Gi", 1, 0), ("1.5d", 1, 0), (None, 1, 0), ("1056718848Ki", 1, 1056718848 * 1024)],
)
def test_quantities(spark, text, scale, expected):
    assert one(spark, S.parse_quantity(F.lit(text).cast("string"), scale)) == expected


@pytest.mark.parametrize("text, seconds", [("60s", 60), ("5m", 300), ("1h30m", 5400), ("500ms", 0.5), ("1.5h", 5400), ("bad", 60), ("", 60), (None, 60), ("5", 60), ("5x", 60)])
def test_durations(spark, text, seconds):
    assert S.interval_hours(text) == pytest.approx(seconds / 3600)
    assert one(spark, S.duration_hours(F.lit(text).cast("string"))) == pytest.approx(seconds / 3600)


@pytest.mark.parametrize("namespace, short", [("tenant-vc-a", "vc-a"), ("vc-a", "a"), ("a", "a"), ("x-tenant-a", "x-tenant-a")])
def test_short_names(spark, namespace, short):
    assert one(spark, S.tenant_short_name(F.lit(namespace))) == short


def test_platform_names_are_a_setting(spark):
    naming = Naming("acme", "Acme", "acme.io")
    found = one(spark, S.node_selectors(F.lit("acme-team-gpu"), None, naming))
    assert [(p["key"], p["value"]) for p in found] == [("acme.io/managed-by", "acme-team-gpu"), ("acme.io/cluster", "acme-team-gpu"), ("acme.io/managed-by", "team-gpu"), ("acme.io/cluster", "team-gpu")]
    assert naming.code("cpu_core_hours") == "acme_cpu_core_hours"


def test_custom_selector_splits_at_the_first_sign(spark):
    pair = one(spark, S.custom_selector("tenant=x=%s-%s", F.lit("a")))
    assert (pair["key"], pair["value"]) == ("tenant", "x=a-a")
    assert one(spark, S.custom_selector("nothing", F.lit("a"))) is None
    assert len(one(spark, S.node_selectors(F.lit("a"), "nothing"))) == 2


def labels(**pairs):
    flat = [x for k, v in pairs.items() for x in (F.lit(k), F.lit(v))]
    return F.create_map(*flat) if flat else F.expr("cast(map() as map<string,string>)")


def test_gpu_types(spark):
    product = {"nvidia.com/gpu.product": "NVIDIA H100 80GB"}
    assert one(spark, S.pod_gpu_type(labels(**product))) == "NVIDIA-H100-80GB"
    assert one(spark, S.pod_gpu_type(labels())) == "unknown" and one(spark, S.node_gpu_type(labels())) == ""
    blank = {"nvidia.com/gpu.product": "  "}
    assert one(spark, S.pod_gpu_type(labels(**blank))) == "" and one(spark, S.node_gpu_type(labels(**blank))) == ""
    kind = {"node.kubernetes.io/instance-type": "n1 std"}
    assert one(spark, S.pod_gpu_type(labels(**kind))) == "n1-std" and one(spark, S.node_gpu_type(labels(**kind))) == ""
    assert one(spark, S.sanitize_gpu_type(F.lit("  a b "))) == "a-b"


@pytest.mark.parametrize("value, spot", [("Spot", False), ("SPOT", True), ("spot", True), ("true", True), ("preemptible", True), ("", False)])
def test_spot_values(spark, value, spot):
    assert one(spark, S.is_spot(labels(**{"karpenter.sh/capacity-type": value}))) is spot
    assert one(spark, S.pod_is_spot(labels(**{"node.kubernetes.io/instance-type": value}))) is spot
    assert one(spark, S.is_spot(labels(**{"node.kubernetes.io/instance-type": value}))) is False
    assert one(spark, S.is_spot(F.lit(None).cast("map<string,string>"))) is False


def test_gpu_count_folds_in_order(spark):
    kind = "array<struct<name:string,gpu_request:bigint,gpu_limit:bigint>>"
    count = lambda rows: one(spark, S.pod_gpu_count(F.from_json(F.lit(rows), kind)))
    assert count('[{"gpu_limit":2},{"gpu_limit":1},{"gpu_request":3,"gpu_limit":3}]') == 5
    assert count('[{"gpu_request":1,"gpu_limit":9},{"gpu_limit":4}]') == 1
    assert count("[]") == 0 and one(spark, S.pod_gpu_count(F.lit(None).cast(kind))) == 0


def test_ids_floats_times(spark):
    assert one(spark, S.sanitize_id(F.lit("A 100/é_x-1"))) == "A100_x-1"
    assert one(spark, S.transaction_id(F.lit("u"), F.lit("gpu"), F.lit("A 1"), F.lit(7))) == "u-gpu-A1-7"
    assert [one(spark, S.parse_float_or_zero(F.lit(t))) for t in ("1.5", "1.5d", "abc", "", "-2e1", ".5")] == [1.5, 0.0, 0.0, 0.0, -20.0, 0.5]
    assert one(spark, S.rfc3339(S.parse_rfc3339(F.lit("2024-05-06T07:08:09+02:00")))) == "2024-05-06T05:08:09Z"
    assert one(spark, S.parse_rfc3339(F.lit("2024-05-06"))) is None
    assert str(one(spark, S.cents_to_money(F.lit(12345)))) == "123.45"
    assert one(spark, S.property_value(F.lit('{"a":1.5,"b":"x"}'), F.lit("a"))) == 1.5
    assert one(spark, S.property_value(F.lit("no json"), F.lit("a"))) is None
