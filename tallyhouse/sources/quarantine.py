"""Rows that do not fit their table are kept aside with a reason, instead of becoming nulls or stopping the job."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.sources.schemas import NOT_NEGATIVE, REQUIRED, SCHEMAS

_CORRUPT = "corrupt_record"


def _first(*cases: tuple[Column, Column]) -> Column:
    """The result of the first condition that holds, else null."""
    return reduce(lambda later, case: F.when(case[0], case[1]).otherwise(later), reversed(cases), F.lit(None).cast("string"))


def _missing(columns: list[str], record: str) -> list[tuple[Column, Column]]:
    return [(F.col(f"{record}.{c}").isNull(), F.lit(f"missing {c}")) for c in columns]


def judged_lines(lines: DataFrame, table: str, column: str = "value", format: str = "json", schema: str | None = None, required: tuple[str, ...] | None = None) -> DataFrame:
    """``lines`` with ``record``, the row of the table that the text in ``column`` says, and ``reason``, null where the row is good.

    Reasons, the first that applies: ``empty`` (null or white space), ``malformed`` (no JSON, or too few or many CSV fields),
    ``not an object``, ``wrong type: <columns>`` (a value that is there but cannot be read as its column's type), ``missing <column>`` (a
    required one), ``negative <column>``.  Fields that the table does not have are passed over.
    """
    schema = schema or SCHEMAS[table]
    fields = T._parse_datatype_string(schema)
    required = REQUIRED.get(table, ()) if required is None else required
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    text = F.trim(F.col(column))
    parse = F.from_json if format == "json" else F.from_csv
    # generated, so that a line is parsed once, however many columns, reasons and filters look at the record
    whole = F.try_parse_json(F.col(column)).isNotNull() if format == "json" else F.lit(True)
    one = F.struct(parse(F.col(column), f"{schema}, {_CORRUPT} string", options).alias("record"), whole.alias("whole_line"))
    parsed = lines.select("*", F.inline(F.array(one)))
    corrupt = F.col(f"record.{_CORRUPT}").isNotNull()
    if format == "json":
        tree = F.try_parse_json(F.col(column))  # of lines that are wrong only
        # a column that the text has a value for and the record has not; names are keys of the outermost object
        unread = [F.when(F.col(f"record.`{f.name}`").isNull() & F.coalesce(F.schema_of_variant(F.try_variant_get(tree, f"$.{f.name}", "variant")) != "VOID", F.lit(False)), F.lit(f.name)) for f in fields]
        cases = [
            (~F.col("whole_line"), F.lit("malformed")),
            (~F.ltrim(F.col(column), F.lit(" \t\r\n")).startswith("{"), F.lit("not an object")),
            (corrupt, F.concat(F.lit("wrong type: "), F.concat_ws(", ", *unread))),
        ]
    else:
        split = F.from_csv(F.col(column), ", ".join(f"c{k} string" for k in range(len(fields))) + f", {_CORRUPT} string", options)
        whole = split[_CORRUPT].isNull()
        unread = [F.when(F.col(f"record.`{f.name}`").isNull() & split[f"c{k}"].isNotNull(), F.lit(f.name)) for k, f in enumerate(fields)]
        cases = [(~whole, F.lit("malformed")), (corrupt, F.concat(F.lit("wrong type: "), F.concat_ws(", ", *unread)))]
    low = [(F.col(f"record.{f.name}") < 0, F.lit(f"negative {f.name}")) for f in fields if f.name in NOT_NEGATIVE and isinstance(f.dataType, T.NumericType)]
    reason = _first((F.col(column).isNull() | (text == ""), F.lit("empty")), *cases, *_missing(list(required), "record"), *low)
    return parsed.withColumn("reason", reason).drop("whole_line").withColumn("record", F.struct(*[F.col(f"record.`{f.name}`").alias(f.name) for f in fields]))


def judged_rows(rows: DataFrame, table: str, required: tuple[str, ...] | None = None) -> DataFrame:
    """Typed rows (a Parquet table that others write) with the ``reason`` that one is not usable: ``missing …`` or ``negative …``."""
    required = REQUIRED.get(table, ()) if required is None else required
    low = [(F.col(c) < 0, F.lit(f"negative {c}")) for c, kind in rows.dtypes if c in NOT_NEGATIVE and kind in ("int", "bigint", "double")]
    return rows.withColumn("reason", _first(*[(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required], *low))


def split_lines(judged: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good rows of the table, bad rows as text with their reason and whatever other columns the lines had)."""
    others = [c for c in judged.columns if c not in ("record", "reason", column)]
    return judged.where("reason is null").select("record.*"), judged.where("reason is not null").select(*others, column, "reason")


def read_with_quarantine(spark: SparkSession, path: str, table: str, quarantine: str, format: str = "json") -> DataFrame:
    """The good rows of text files; bad lines are appended to ``quarantine`` as (source_file, value, reason), by reason.

    One pass over the files writes both sides; the good ones are then read back with their fixed schema.
    """
    lines = spark.read.text(path).withColumn("source_file", F.col("_metadata.file_path"))
    judged = judged_lines(lines, table, format=format)
    good = F.col("reason").isNull()
    staged = f"{quarantine.rstrip('/')}/staged/{uuid.uuid4().hex}"
    rows = judged.select("record", F.when(~good, F.col("value")).alias("value"), F.when(~good, F.col("source_file")).alias("source_file"), "reason", good.alias("accepted"))
    rows.write.mode("overwrite").partitionBy("accepted").parquet(staged)
    back = spark.read.schema(f"record struct<{_nested(SCHEMAS[table])}>, value string, source_file string, reason string, accepted boolean").parquet(staged)
    back.where("not accepted").select("source_file", "value", "reason").write.mode("append").partitionBy("reason").parquet(f"{quarantine.rstrip('/')}/rows")
    return back.where("accepted").select("record.*")


def _nested(schema: str) -> str:
    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in T._parse_datatype_string(schema))


def quarantined(spark: SparkSession, quarantine: str) -> DataFrame:
    """All lines kept aside so far."""
    return spark.read.schema("source_file string, value string, reason string").parquet(f"{quarantine.rstrip('/')}/rows")


def quarantine_report(bad: DataFrame) -> DataFrame:
    """How many lines each reason kept aside, and one of them."""
    return bad.groupBy("reason").agg(F.count("*").alias("lines"), F.min("value").alias("example"))
