"""A Parquet table that batches of changed rows are merged into: base and deltas, by partition.

``delta/batch_number=<n>/<partition>=…`` holds the rows of one batch; a batch that is written again replaces itself.
``base/upto=<n>/<partition>=…`` holds, for a partition, the latest row of each key of all batches up to n.  Compaction
writes a new base for the partitions that have deltas, and for no others, so closed periods are never rewritten.
A reader takes of each partition the newest base and the deltas behind it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folders(spark: SparkSession, path: str, complete: bool = True) -> list[str]:
    """Names of the folders under a path, of finished writes only; none if it is not there."""
    system, where = _file_system(spark, path)
    if not system.exists(where):
        return []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(f.getPath().getName() for f in system.listStatus(where) if f.isDirectory() and (not complete or system.exists(done(f.getPath(), "_SUCCESS"))))


def removed(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def overwrite_parts(df: DataFrame, path: str, *parts: str) -> None:
    """Replaces those partitions of a table that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def only_parts(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of those partitions that ``wanted`` has in the same column; no others are read.

    The names of the partitions (days or hours that changed) go through the driver, so that the scan knows them.
    """
    names = [r[0] for r in wanted.select(column).distinct().collect()]
    return df.where(F.col(column).isin(names)) if names else df.where("false")


@dataclass(frozen=True)
class UpsertTable:
    """Rows with one current version for each key; ``partition`` is one of the keys, with few values (a billing period)."""

    path: str
    schema: str
    keys: list[str] = field(default_factory=list)
    partition: str = "period"

    def _numbered(self, spark: SparkSession, kind: str, label: str, names: list[str]) -> DataFrame:
        columns = self.schema + f", {label} long"
        if not names:
            return spark.createDataFrame([], columns)
        root = f"{self.path}/{kind}"
        return spark.read.schema(columns).option("basePath", root).parquet(*[f"{root}/{n}" for n in names])

    def _bases(self, spark: SparkSession) -> DataFrame:
        return self._numbered(spark, "base", "upto", folders(spark, f"{self.path}/base"))

    def _deltas(self, spark: SparkSession) -> DataFrame:
        return self._numbered(spark, "delta", "batch_number", folders(spark, f"{self.path}/delta"))

    def add(self, batch: DataFrame, number: int) -> None:
        """Keeps the rows of a batch; the same number again replaces them.  Of rows with one key the one that sorts last counts."""
        rest = [c for c in batch.columns if c not in self.keys]
        last = batch.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("r")).select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])
        last.write.mode("overwrite").partitionBy(self.partition).parquet(f"{self.path}/delta/batch_number={number}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """The current row of each key."""
        bases, deltas = self._bases(spark), self._deltas(spark)
        newest = bases.groupBy(self.partition).agg(F.max("upto").alias("newest"))  # a row for each partition
        same = lambda df: df[self.partition].eqNullSafe(newest[self.partition])
        held = bases.join(newest, same(bases) & (bases["upto"] == newest["newest"]), "left_semi").withColumnRenamed("upto", "batch_number")
        behind = deltas.join(newest, same(deltas) & (deltas["batch_number"] <= newest["newest"]), "left_anti")
        every = held.unionByName(behind)
        rest = [c for c in every.columns if c not in (*self.keys, "batch_number")]
        latest = every.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "batch_number").alias("r"))
        return latest.select(*self.keys, *[F.col(f"r.{c}").alias(c) for c in rest])

    def compact(self, spark: SparkSession) -> int | None:
        """Merges the deltas into new bases of their partitions and removes what no reader needs; gives the last batch merged."""
        deltas = folders(spark, f"{self.path}/delta")
        if not deltas:
            return None
        numbers = sorted(int(n.split("=")[1]) for n in deltas)
        touched = self._deltas(spark).select(self.partition).distinct()
        rows = self.rows(spark)
        merged = rows.join(touched, rows[self.partition].eqNullSafe(touched[self.partition]), "left_semi")
        merged.write.mode("overwrite").partitionBy(self.partition).parquet(f"{self.path}/base/upto={numbers[-1]}")
        for n in numbers:
            removed(spark, f"{self.path}/delta/batch_number={n}")
        self._drop_old_bases(spark)
        return numbers[-1]

    def _drop_old_bases(self, spark: SparkSession) -> None:
        """Removes partitions of bases that a newer base holds; the names of the folders tell."""
        seen: set[str] = set()
        for base in sorted(folders(spark, f"{self.path}/base"), key=lambda n: -int(n.split("=")[1])):
            parts = folders(spark, f"{self.path}/base/{base}", complete=False)
            for part in parts:
                if part in seen:
                    removed(spark, f"{self.path}/base/{base}/{part}")
            if set(parts) <= seen:
                removed(spark, f"{self.path}/base/{base}")
            seen |= set(parts)

    def sink(self, compact_every: int | None = None) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function that upserts each batch, and compacts after every so many."""

        def write(batch: DataFrame, number: int) -> None:
            self.add(batch, number)
            if compact_every and (number + 1) % compact_every == 0:
                self.compact(batch.sparkSession)

        return write
