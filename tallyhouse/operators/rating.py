"""From events to usage and charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.scalars import micro, property_value

USAGE_KEY = ["external_subscription_id", "code", "gpu_type", "period"]


def dedupe_events(events: DataFrame) -> DataFrame:
    """One event for each transaction id.

    Resent events are identical, so any will do; should they differ, the one that sorts first (by
    subscription, code, time and properties) is taken, in one aggregation with map-side combine.
    """
    order = [c for c in ("external_subscription_id", "code", "timestamp") if c in events.columns]
    rest = [c for c in events.columns if c not in (*order, "transaction_id")]
    least = events.groupBy("transaction_id").agg(F.min(F.struct(*order, *rest)).alias("e"))
    return least.select(*[F.col("transaction_id") if c == "transaction_id" else F.col(f"e.{c}") for c in events.columns])


def differing_resends(events: DataFrame) -> DataFrame:
    """Transaction ids that came with different contents: two GPU models that sanitize to one text, for example."""
    rest = [c for c in events.columns if c != "transaction_id"]
    return events.distinct().groupBy("transaction_id").agg(F.count("*").alias("variants"), F.min(F.struct(*rest)).alias("first")).where("variants > 1").select("transaction_id", "variants")


def measured(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds quantity_micro, the catalog's summed field of each event's JSON properties, and its GPU model."""
    fields = F.broadcast(catalog.select("code", "field_name"))  # nine rows
    joined = events.join(fields, "code")
    value = property_value(F.col("properties"), F.col("field_name"))
    # properties hold at most six decimals: round the double's millionths back to the integer they are
    return joined.withColumns({"quantity_micro": F.round(value * 1e6).try_cast("bigint"), "gpu_type": F.get_json_object("properties", "$.gpu_type")}).drop("field_name")


def event_period(timestamp: Column, unit: str = "month") -> Column:
    return F.date_trunc(unit, F.timestamp_seconds(timestamp))


def period_usage(events: DataFrame, unit: str = "month") -> DataFrame:
    """Sum of quantities by subscription, code, GPU model and billing period.

    Takes events with ``quantity_micro`` and ``gpu_type`` (from ``meter_events`` or ``measured``), deduplicated.
    """
    keyed = events.withColumn("period", event_period(F.col("timestamp"), unit))
    return keyed.groupBy(*USAGE_KEY).agg(F.sum("quantity_micro").alias("units_micro"), F.count("*").alias("events"))


def price_usage(usage: DataFrame, charges: DataFrame, gpu_prices: DataFrame) -> DataFrame:
    """Adds ``unit_price`` per book: the GPU model's price where the book has one, else the metric's.

    ``charges(book, code, amount)`` and ``gpu_prices(book, gpu_type, price)`` are price lists of some dozen rows.
    """
    known = valid_charges(charges)
    with_book = usage.join(F.broadcast(known.select("book", "code", "amount")), "code")
    is_gpu = F.col("code").endswith("gpu_hours")
    models = gpu_prices.select(F.col("book").alias("price_book"), F.col("gpu_type").alias("price_type"), F.col("price").alias("sku_price"))
    match = is_gpu & (F.col("book") == F.col("price_book")) & (F.col("gpu_type") == F.col("price_type"))
    priced = with_book.join(F.broadcast(models), match, "left").drop("price_book", "price_type")
    return priced.withColumn("unit_price", F.coalesce("sku_price", "amount")).drop("sku_price", "amount")


def valid_charges(charges: DataFrame) -> DataFrame:
    """Charges whose metric is known (not null, not empty)."""
    return charges.where("code is not null and code <> ''")


def charge_cents(units_micro: Column, unit_price: Column) -> Column:
    """Units times price in cents, half up, exact in DECIMAL."""
    return F.round(units_micro.cast("decimal(20,0)") * unit_price.cast("decimal(18,6)") / F.lit(10_000).cast("decimal(5,0)"), 0).cast("bigint")


def charge_usage(priced: DataFrame) -> DataFrame:
    return priced.withColumn("amount_cents", charge_cents(F.col("units_micro"), F.col("unit_price")))


def compare_price_books(usage: DataFrame, charges: DataFrame, gpu_prices: DataFrame) -> DataFrame:
    """The same usage under each book, by subscription."""
    priced = charge_usage(price_usage(usage, charges, gpu_prices))
    return priced.groupBy("book", "external_subscription_id").agg(F.sum("amount_cents").alias("amount_cents"))


def last_collection(events: DataFrame) -> DataFrame:
    return events.groupBy("external_subscription_id").agg(F.max("timestamp").alias("last_collection"))


def to_micro(value: Column) -> Column:
    return micro(value.cast("double"))


def running_total(usage: DataFrame) -> DataFrame:
    """Cumulative units of each subscription and code over its periods."""
    order = Window.partitionBy("external_subscription_id", "code", "gpu_type").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return usage.withColumn("running_micro", F.sum("units_micro").over(order))
