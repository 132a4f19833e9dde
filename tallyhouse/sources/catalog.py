"""Small dimension tables: the metrics, price books, and GPU prices."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.settings import BOOK_GPU_PRICES, DEFAULT_NAMING, METRICS, PRICE_BOOKS, Naming


def metric_catalog(spark: SparkSession, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """The nine metrics: code, name, aggregation, summed field, whether the spot multiplier applies."""
    rows = [(naming.code(m), name, "sum_agg", field, spot) for m, field, name, spot in METRICS]
    return spark.createDataFrame(rows, "code string, name string, aggregation_type string, field_name string, spot_priced boolean")


def price_book(spark: SparkSession, *names: str, naming: Naming = DEFAULT_NAMING) -> DataFrame:
    """Unit prices of the named books (all without a name): book, code, amount; unnamed prices are 0."""
    rows = [
        (book, naming.code(m), "standard", Decimal(price or "0"))
        for book in (names or tuple(PRICE_BOOKS))
        for (m, *_), price in zip(METRICS, PRICE_BOOKS[book], strict=True)
    ]
    return spark.createDataFrame(rows, "book string, code string, charge_model string, amount decimal(18,6)")


def parse_gpu_prices(df: DataFrame, col: str = "gpu_prices") -> DataFrame:
    """``TYPE:PRICE,TYPE:PRICE`` to rows (…, gpu_type, price); pairs without a readable price are left out."""
    kept = [c for c in df.columns if c != col]
    one = df.select(*kept, F.explode(F.split(col, ",")).alias("pair"))
    price = F.trim(F.split_part("pair", F.lit(":"), F.lit(2))).try_cast("decimal(18,6)")
    return one.select(*kept, F.trim(F.split_part("pair", F.lit(":"), F.lit(1))).alias("gpu_type"), price.alias("price")).where("price is not null and gpu_type <> ''")


def gpu_price_book(spark: SparkSession, *names: str) -> DataFrame:
    """GPU model prices of the named books: book, gpu_type, price."""
    rows = [(book, text) for book, text in BOOK_GPU_PRICES.items() if not names or book in names]
    return parse_gpu_prices(spark.createDataFrame(rows, "book string, gpu_prices string"))
