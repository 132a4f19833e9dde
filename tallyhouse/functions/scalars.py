"""Scalar column functions.  All are built-in expressions: no Python runs on the rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyhouse.functions.settings import COLLECTION_SECONDS, DEFAULT_NAMING, NODE_GPU_LABELS, POD_GPU_LABELS, POD_SPOT_LABELS, SPOT_LABELS, SPOT_VALUES, Naming

GIB = 1024**3


def micro(x: Column) -> Column:
    """Millionths of ``x`` as BIGINT, cut toward zero; null for null, NaN and what a BIGINT cannot hold."""
    return F.when(~F.isnan(x), (x * F.lit(1e6)).try_cast("bigint"))


def trunc6(x: Column) -> Column:
    """``x`` cut (not rounded) to six decimals."""
    return micro(x.cast("double")) / F.lit(1e6)


def usage_quantity(measure: Column, hours: Column, multiplier: Column | None = None) -> Column:
    """measure x hours x multiplier, from left to right in double, in millionths."""
    product = measure.cast("double") * hours.cast("double")
    return micro(product if multiplier is None else product * multiplier.cast("double"))


def sanitize_id(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9_-]", "")


def sanitize_gpu_type(s: Column) -> Column:
    """Outer white space (of any kind) goes, inner spaces become hyphens, case stays."""
    return F.replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), F.lit(" "), F.lit("-"))


def bytes_to_gib(b: Column) -> Column:
    return b.cast("double") / F.lit(float(GIB))


def tenant_short_name(namespace: Column, naming: Naming = DEFAULT_NAMING) -> Column:
    """The namespace without one leading platform prefix."""
    return F.regexp_replace(namespace, "^(" + "|".join(re.escape(p) for p in naming.short_prefixes) + ")", "")


def custom_selector(template: str, short_name: Column) -> Column:
    """``key=value`` split at the first ``=``, each ``%s`` of the value replaced; null without ``=``."""
    key, found, value = template.partition("=")
    pair = F.struct(F.lit(key).alias("key"), F.replace(F.lit(value), F.lit("%s"), short_name).alias("value"))
    return pair if found else F.lit(None).cast("struct<key:string,value:string>")


def node_selectors(namespace: Column, template: str | None = None, naming: Naming = DEFAULT_NAMING) -> Column:
    """The (key, value) labels of which any one makes a node the tenant's, in order, without repeats."""
    short = tenant_short_name(namespace, naming)
    keys = [f"{naming.label_domain}/managed-by", f"{naming.label_domain}/cluster"]
    pairs = [F.struct(F.lit(k).alias("key"), v.alias("value")) for v in (namespace, short) for k in keys]
    if template:
        pairs.append(custom_selector(template, short))
    return F.array_distinct(F.filter(F.array(*pairs), lambda p: p.isNotNull() & p["value"].isNotNull()))


def first_label(labels: Column, keys: Sequence[str]) -> Column:
    """The first of ``keys`` that is present and not empty; null if none is."""
    return F.coalesce(*[F.nullif(F.try_element_at(labels, F.lit(k)), F.lit("")) for k in keys])


def pod_gpu_type(labels: Column) -> Column:
    return F.coalesce(sanitize_gpu_type(first_label(labels, POD_GPU_LABELS)), F.lit("unknown"))


def node_gpu_type(labels: Column) -> Column:
    return F.coalesce(sanitize_gpu_type(first_label(labels, NODE_GPU_LABELS)), F.lit(""))


def is_spot(labels: Column, keys: Sequence[str] = SPOT_LABELS) -> Column:
    hit = F.exists(F.array(*[F.lit(k) for k in keys]), lambda k: F.coalesce(F.try_element_at(labels, k).isin(*SPOT_VALUES), F.lit(False)))
    return F.coalesce(hit, F.lit(False))


def pod_is_spot(labels: Column) -> Column:
    return is_spot(labels, POD_SPOT_LABELS)


def pod_gpu_count(containers: Column) -> Column:
    """Requests add up; a container's limit counts only while the running total is still zero."""

    def add(total: Column, c: Column) -> Column:
        asked = total + F.coalesce(c["gpu_request"], F.lit(0)).cast("bigint")
        return F.when(asked == 0, F.coalesce(c["gpu_limit"], F.lit(0)).cast("bigint")).otherwise(asked)

    return F.coalesce(F.aggregate(containers, F.lit(0).cast("bigint"), add), F.lit(0).cast("bigint"))


_QUANTITY = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(n|u|m|k|M|G|T|P|E|Ki|Mi|Gi|Ti|Pi|Ei|[eE][+-]?[0-9]+)?$"
# Multipliers of quantity suffixes, beside powers of ten.
_SUFFIXES = {"": 1.0, "n": 1e-9, "u": 1e-6, "m": 1e-3, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18, "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60}


def parse_quantity(s: Column, scale: int = 1) -> Column:
    """A cluster quantity such as ``250m``, ``1.5Gi`` or ``1e3``, times ``scale``, rounded up; 0 if it is none.

    Whole multiples are exact in DECIMAL; ``scale=1000`` gives milli-units.
    """
    number, suffix = F.regexp_extract(s, _QUANTITY, 1), F.regexp_extract(s, _QUANTITY, 2)
    value = F.nullif(number, F.lit("")).try_cast("decimal(28,9)")
    down = F.when(suffix == "n", 10**9).when(suffix == "u", 10**6).when(suffix == "m", 1000).otherwise(1)
    up = F.lit(1)
    for name, times in _SUFFIXES.items():
        if times > 1:
            up = F.when(suffix == name, F.lit(int(times))).otherwise(up)
    powered = suffix.rlike("^[eE][+-]?[0-9]+$")
    exact = F.ceil(value * F.lit(scale).cast("decimal(10,0)") * up.cast("decimal(20,0)") / down.cast("decimal(10,0)")).try_cast("bigint")
    shifted = F.ceil(F.concat(number, suffix).try_cast("double") * scale).try_cast("bigint")
    return F.coalesce(F.when(powered, shifted).otherwise(exact), F.lit(0).cast("bigint"))


# Seconds of duration units.
_UNITS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}
_DURATION = r"([0-9]+\.?[0-9]*|\.[0-9]+)(h|ms|m|s|us|µs|ns)"


def interval_hours(duration: str | None, default_seconds: int = COLLECTION_SECONDS) -> float:
    """Hours of a duration such as ``1h30m``; of the default if it is none (for configuration)."""
    text = duration or ""
    parts = re.findall(_DURATION, text)
    whole = bool(parts) and "".join(a + b for a, b in parts) == text.lstrip("+-")
    seconds = sum(float(a) * _UNITS[b] for a, b in parts) if whole else float(default_seconds)
    return (-seconds if whole and text.startswith("-") else seconds) / 3600


def duration_hours(s: Column, default_seconds: int = COLLECTION_SECONDS) -> Column:
    """The same for a column."""
    numbers, units = F.regexp_extract_all(s, F.lit(_DURATION), F.lit(1)), F.regexp_extract_all(s, F.lit(_DURATION), F.lit(2))
    factor = F.create_map(*[F.lit(x) for pair in _UNITS.items() for x in pair])
    seconds = F.aggregate(F.zip_with(numbers, units, lambda a, b: a.cast("double") * F.element_at(factor, b)), F.lit(0.0), lambda t, x: t + x)
    return F.when(s.rlike(f"^({_DURATION})+$"), seconds).otherwise(F.lit(float(default_seconds))) / 3600


def transaction_id(uid: Column, kind: Column, gpu_type: Column | None, unix: Column) -> Column:
    """``uid-kind-[gpu-]unix``, the same for a resent event."""
    parts = [uid, kind] + ([sanitize_id(gpu_type)] if gpu_type is not None else []) + [unix.cast("string")]
    return F.concat_ws("-", *parts)


def event_properties(*columns: Column) -> Column:
    """A JSON object of the given columns; nulls are left out."""
    return F.to_json(F.struct(*columns))


def property_value(properties: Column, field: Column) -> Column:
    """The number that the catalog's field names inside the JSON."""
    return F.try_element_at(F.from_json(properties, "map<string,string>"), field).try_cast("double")


def parse_float_or_zero(s: Column) -> Column:
    number = F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def parse_rfc3339(s: Column) -> Column:
    return F.try_to_timestamp(F.when(s.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), s))


def cents_to_money(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / F.lit(100)).cast("decimal(18,2)")
