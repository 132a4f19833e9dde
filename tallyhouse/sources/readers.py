"""Reading histories with fixed schemas, and parsing the platform's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import parse_float_or_zero, parse_quantity, parse_rfc3339
from tallyhouse.sources.schemas import SCHEMAS


def read_inventory(spark: SparkSession, path: str, table: str, format: str = "parquet") -> DataFrame:
    """One domain table with its fixed schema: no inference, no schema drift."""
    return spark.read.schema(SCHEMAS[table]).format(format).load(path)


def read_resource_usage(spark: SparkSession, path: str, table: str = "container_usage", format: str = "parquet", stream: bool = False) -> DataFrame:
    """Container or node usage samples, as a batch or (from files that arrive) as a stream."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(SCHEMAS[table]).format(format).load(path)


def parsed_usage(raw: DataFrame) -> DataFrame:
    """Quantity strings ``cpu`` and ``memory`` to BIGINT ``cpu_milli`` and ``memory_bytes``."""
    return raw.withColumns({"cpu_milli": parse_quantity(F.col("cpu"), 1000), "memory_bytes": parse_quantity(F.col("memory"))}).drop("cpu", "memory")


def _text(path: str) -> Column:
    """A string at a path of the object; empty if it is missing or no string."""
    found = F.try_variant_get("tree", path, "variant")
    return F.coalesce(F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get("tree", path, "string")), F.lit(""))


def parse_platform_instances(df: DataFrame) -> DataFrame:
    """``obj`` JSON to tenant rows; label values that are no strings are dropped, a bad time is null."""
    parsed = df.withColumn("tree", F.try_parse_json("obj"))
    labels = F.coalesce(F.from_json(F.get_json_object("obj", "$.metadata.labels"), "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    strings = F.map_filter(labels, lambda _, v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return parsed.select(
        "tick_ts",
        _text("$.metadata.name").alias("name"),
        _text("$.metadata.namespace").alias("namespace"),
        _text("$.metadata.uid").alias("uid"),
        parse_rfc3339(_text("$.metadata.creationTimestamp")).alias("created_at"),
        F.transform_values(strings, lambda _, v: F.try_variant_get(v, "$", "string")).alias("labels"),
    )


_RESPONSE = "status string, data struct<result: array<struct<metric: map<string,string>, value: array<string>>>>"


def parse_prom_vector(df: DataFrame, json_col: str = "body") -> DataFrame:
    """Query responses to rows (…, labels, value); only successful ones; a bad or missing number is 0."""
    parsed = df.withColumn("response", F.from_json(json_col, _RESPONSE)).where("response.status = 'success'")
    one = parsed.withColumn("sample", F.explode("response.data.result"))
    text = F.coalesce(F.get(F.col("sample.value"), F.lit(1)), F.lit(""))
    kept = [c for c in df.columns if c != json_col]
    return one.select(*kept, F.col("sample.metric").alias("labels"), parse_float_or_zero(text).alias("value"))


def parse_watch_namespaces(csv: Column) -> Column:
    """A comma-separated list to trimmed, non-empty names."""
    return F.filter(F.transform(F.split(F.coalesce(csv, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
