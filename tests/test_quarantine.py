"""Lines and rows that do not fit, each with its reason."""

import pytest
from pyspark.sql import functions as F

from tallyhouse.sources import quarantine
from tallyhouse.sources.schemas import REQUIRED, SCHEMAS

GOOD = '{"tick_ts":"2024-01-01T00:00:00Z","namespace":"n","pod":"p","container":"c","cpu_milli":5,"memory_bytes":7}'
LINES = [
    (GOOD, None),
    (GOOD.replace("5", "null"), None),
    (GOOD.replace('"cpu_milli":5,', '"cpu_milli":5,"more":[1],'), None),
    ("", "empty"),
    (None, "empty"),
    ("  ", "empty"),
    (GOOD[:-1], "malformed"),
    ("nonsense", "malformed"),
    ("[" + GOOD + "]", "not an object"),
    ("5", "not an object"),
    ("null", "not an object"),
    (GOOD.replace("5", '"5"'), "wrong type: cpu_milli"),
    (GOOD.replace("5", "1.5").replace(":7", ':"x"'), "wrong type: cpu_milli, memory_bytes"),
    (GOOD.replace("2024-01-01T00:00:00Z", "yesterday"), "wrong type: tick_ts"),
    (GOOD.replace('"pod":"p",', ""), "missing pod"),
    (GOOD.replace('"pod":"p"', '"pod":null'), "missing pod"),
    ("{}", "missing tick_ts"),
    (GOOD.replace("5", "-5"), "negative cpu_milli"),
]


def test_reasons_of_json_lines(spark):
    lines = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(LINES)], "k int, value string")
    judged = quarantine.judged_lines(lines, "container_usage")
    assert {r["k"]: r["reason"] for r in judged.collect()} == {k: r for k, (_, r) in enumerate(LINES)}
    good, bad = quarantine.split_lines(judged)
    assert good.count() == 3 and good.schema.simpleString() == spark.createDataFrame([], SCHEMAS["container_usage"]).schema.simpleString()
    assert bad.columns == ["k", "value", "reason"] and bad.count() == len(LINES) - 3
    assert {r["cpu_milli"] for r in good.collect()} == {5, None}


def test_reasons_of_csv_lines(spark):
    cases = {"2024-01-01T00:00:00Z,n,p,c,5,7": None, "2024-01-01T00:00:00Z,n,p,c,5": "malformed", "2024-01-01T00:00:00Z,n,p,c,x,7": "wrong type: cpu_milli", "2024-01-01T00:00:00Z,n,,c,5,7": "missing pod", "2024-01-01T00:00:00Z,n,p,c,5,-7": "negative memory_bytes", "": "empty"}
    lines = spark.createDataFrame([(k,) for k in cases], "value string")
    judged = quarantine.judged_lines(lines, "container_usage", format="csv")
    assert {r["value"]: r["reason"] for r in judged.collect()} == cases


def test_typed_rows(spark):
    rows = spark.createDataFrame([("a", "n", 1), (None, "n", 1), ("a", None, None), ("a", "n", -1)], "pod string, namespace string, cpu_milli long").withColumn("tick_ts", F.lit("2024-01-01").cast("timestamp"))
    judged = quarantine.judged_rows(rows, "pods")
    assert sorted(str(r["reason"]) for r in judged.collect()) == ["None", "missing namespace", "missing pod", "negative cpu_milli"]


def test_files_are_split_in_one_pass(spark, tmp_path):
    folder, aside = tmp_path / "in", str(tmp_path / "aside")
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(v for v, _ in LINES if v))
    (folder / "b.json").write_text(GOOD)
    good = quarantine.read_with_quarantine(spark, str(folder), "container_usage", aside)
    assert good.count() == 4 and good.columns == ["tick_ts", "namespace", "pod", "container", "cpu_milli", "memory_bytes"]
    bad = quarantine.quarantined(spark, aside)
    assert bad.count() == len([1 for v, r in LINES if v and r]) and all(r["source_file"].endswith("a.json") for r in bad.collect())
    report = {r["reason"]: r["lines"] for r in quarantine.quarantine_report(bad).collect()}
    assert report["missing pod"] == 2 and report["malformed"] == 2
    clean = quarantine.read_with_quarantine(spark, str(folder / "b.json"), "container_usage", str(tmp_path / "other"))
    assert clean.count() == 1 and quarantine.quarantined(spark, str(tmp_path / "other")).count() == 0


@pytest.mark.parametrize("table", sorted(SCHEMAS))
def test_required_columns_exist(spark, table):
    rows = spark.createDataFrame([], SCHEMAS[table])
    assert set(REQUIRED[table]) <= set(rows.columns)
    lines = spark.createDataFrame([("{}",), ("x",)], "value string")
    reasons = {r["value"]: r["reason"] for r in quarantine.judged_lines(lines, table).collect()}
    assert reasons == {"{}": f"missing {REQUIRED[table][0]}", "x": "malformed"}


def test_a_line_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"namespace":"a"}',)], "value string")
    for side in quarantine.split_lines(quarantine.judged_lines(lines, "container_usage")):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1, plan


def test_only_json_objects_are_rows(spark):
    texts = ['\t\r\n {"v":1}', '[{"v":1}]', '"{"', "{'v':1}", "\ufeff{}", "null", " 7", '{"v":"a"}']
    judged = quarantine.judged_lines(spark.createDataFrame([(t,) for t in texts], "value string"), "t", schema="v long")
    assert [r["reason"] for r in judged.collect()] == [None, "not an object", "not an object", "malformed", "malformed", "not an object", "not an object", "wrong type: v"]
