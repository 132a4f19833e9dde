"""Counter series: increases, rates, and bytes moved per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.settings import RATE_WINDOW_SECONDS


def counter_increase(samples: DataFrame, series: list[str]) -> DataFrame:
    """Each sample with its increase over the one before; a drop is a restart from 0. The first has none."""
    order = Window.partitionBy(*series).orderBy("ts", "value")
    before = F.lag("value").over(order)
    return samples.withColumns({"increase": F.when(F.col("value") >= before, F.col("value") - before).when(before.isNotNull(), F.col("value")), "before_ts": F.lag("ts").over(order)})


#: A window's edge is reached from the first or last sample if it is nearer than this many mean distances of samples.
EDGE_DISTANCES = 1.1


def extrapolated(increase: Column, first_value: Column, first_us: Column, last_us: Column, samples: Column, start_us: Column, end_us: Column) -> Column:
    """The increase that a counter would have had over the whole window, from two samples at least inside it.

    The increase between the first and last sample is stretched to each edge of the window that lies within ``EDGE_DISTANCES`` mean sample distances,
    and by half a mean distance towards an edge further away.  At the start it is not stretched beyond
    the time at which the counter, falling at its mean rate, would have been zero.
    """
    covered = (last_us - first_us).cast("double")
    mean = covered / (samples - 1)
    to_start, to_end = (first_us - start_us).cast("double"), (end_us - last_us).cast("double")

    def reached(distance: Column) -> Column:
        return F.when(distance < mean * EDGE_DISTANCES, distance).otherwise(mean / 2)

    to_zero = F.when((increase > 0) & (first_value >= 0), covered * (first_value / increase))
    before = F.least(reached(to_start), to_zero)  # null is passed over
    return increase * ((covered + before + reached(to_end)) / covered)


def counter_rate(samples: DataFrame, series: list[str], window_s: int = RATE_WINDOW_SECONDS, step_s: int | None = None, extrapolate: bool = False) -> DataFrame:
    """Increase per second of each series in every window, from pairs of samples that lie inside it; two at least.

    Increases are computed once; sliding windows then share them.  The rate is the increase over the time between the
    first and the last sample; with ``extrapolate`` the increase is carried on to the window's edges (see :func:`extrapolated`)
    and divided by the window's length, as metrics servers do it.
    """
    rows = counter_increase(samples, series)
    window = F.window("ts", f"{window_s} seconds", f"{step_s or window_s} seconds")
    placed = rows.withColumn("window", window) if step_s in (None, window_s) else rows.select("*", window.alias("window"))
    inside = F.col("before_ts") >= F.col("window.start")
    micros = F.unix_micros("ts")
    more = [F.min(F.struct("ts", "value"))["value"].alias("first_value"), F.min(micros).alias("first_us"), F.max(micros).alias("last_us")] if extrapolate else []
    grouped = placed.groupBy(*series, "window").agg(
        F.sum(F.when(inside, F.col("increase"))).alias("increase"),
        (F.max(micros) - F.min(micros)).alias("covered_us"),
        F.count("*").alias("samples"),
        *more,
    )
    found = grouped.where("samples >= 2 and covered_us > 0")
    if not extrapolate:
        return found.withColumn("rate", F.col("increase") / (F.col("covered_us") / 1e6))
    whole = extrapolated(F.col("increase"), F.col("first_value"), F.col("first_us"), F.col("last_us"), F.col("samples"), F.unix_micros("window.start"), F.unix_micros("window.end"))
    return found.withColumn("extrapolated", whole).withColumn("rate", F.col("extrapolated") / F.lit(float(window_s))).drop("first_value", "first_us", "last_us")


def network_bytes(rates: DataFrame, key: list[str], scale_seconds: int = RATE_WINDOW_SECONDS) -> DataFrame:
    """Sum of the series' rates, times a fixed number of seconds (the metering tick may be shorter)."""
    return rates.groupBy(*key, "window").agg((F.sum("rate") * F.lit(scale_seconds)).alias("bytes"), F.count("*").alias("series"))
