"""Stored tables that an ingest run changes bucket by bucket and all at once.

A table lies below ``root/<table>/bucket=K/run=R``: its rows are spread over buckets by a
hash of their key, and a run writes the next rows of the buckets it touches into folders of its own.
The run's marker (``root/_runs/run=R``, one file with one row a bucket) is written last.
Readers take of each bucket the newest run that has a marker, so that

* files of untouched buckets stay as they are, and are not read;
* a run that breaks between two tables leaves readers unchanged, and repeating it replaces its own folders;
* repeating a run that has its marker does nothing.

One run at a time may write. Folders of former runs stay until ``stale`` names them to whoever
clears them. A null key is a key like any other; an empty table, and a bucket whose rows are all
gone, read as no rows. Columns named ``bucket`` and ``run`` are taken by the layout: a table that has
one is refused. What the driver holds is the markers: a row a bucket and run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from opinio.session import write_once

_MARKS = "tab string, bucket int, n_rows bigint, run bigint"


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    schema: StructType
    buckets: int = 64


@dataclass(frozen=True)
class Change:
    """``keys``: one column with the keys of all rows that change or are new.
    ``next_rows``: from the stored rows of their buckets to the rows that replace them."""
    keys: DataFrame
    next_rows: Callable[[DataFrame], DataFrame]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class RunStore:
    def __init__(self, spark: SparkSession, root: str, tables: list[Table]):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = {t.name: t for t in tables}
        for t in tables:
            if {"bucket", "run"} & {c.lower() for c in t.schema.names}:
                raise ValueError(f"{t.name}: columns bucket and run belong to the layout")

    def marks(self) -> DataFrame:
        """(tab, bucket, n_rows, run) of all runs that are complete."""
        try:
            return self.spark.read.schema(_MARKS).parquet(f"{self.root}/_runs")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MARKS)

    def current(self, table: str) -> dict[int, int]:
        """bucket -> newest complete run; at most one entry a bucket."""
        rows = self.marks().where(F.col("tab") == table).groupBy("bucket").agg(F.max("run").alias("run")).collect()
        return {r["bucket"]: r["run"] for r in rows}

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The table as of the newest complete runs, or only some of its buckets (partition filters)."""
        t = self.tables[table]
        by_run: dict[int, list[int]] = {}
        for bucket, run in self.current(table).items():
            if buckets is None or bucket in buckets:
                by_run.setdefault(run, []).append(bucket)
        wanted = None
        for run, of_run in sorted(by_run.items()):
            part = (F.col("run") == run) & F.col("bucket").isin(sorted(of_run))
            wanted = part if wanted is None else wanted | part
        if wanted is None:
            return self.spark.createDataFrame([], t.schema)
        return self._files(t).where(wanted).select(*t.schema.names)

    def _files(self, t: Table) -> DataFrame:
        """All runs' rows, complete or not."""
        layout = StructType(list(t.schema.fields)).add("bucket", IntegerType()).add("run", LongType())
        return self.spark.read.schema(layout).parquet(f"{self.root}/{t.name}")

    def _write(self, run: int, t: Table, change: Change) -> DataFrame:
        """Writes the next rows of the touched buckets; returns (tab, bucket, n_rows) of each of them."""
        keys = change.keys.select(bucket_of(F.col(change.keys.columns[0]), t.buckets).alias("bucket")).distinct()
        touched = sorted(r["bucket"] for r in keys.collect())  # at most t.buckets numbers
        marks = self.spark.createDataFrame([(t.name, b) for b in touched], "tab string, bucket int")
        if not touched:
            return marks.withColumn("n_rows", F.lit(0).cast("bigint"))
        rows = change.next_rows(self.read(t.name, touched)).select(*[F.col(f.name).cast(f.dataType) for f in t.schema.fields])
        (rows.withColumn("bucket", bucket_of(F.col(t.key), t.buckets)).withColumn("run", F.lit(run).cast("bigint"))
         .repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "run").parquet(f"{self.root}/{t.name}"))
        own = self._files(t).where((F.col("run") == run) & F.col("bucket").isin(touched))
        counts = own.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))  # from the files' footers
        return marks.join(counts, "bucket", "left").select("tab", "bucket", F.coalesce("n_rows", F.lit(0).cast("bigint")).alias("n_rows"))

    def is_complete(self, run: int) -> bool:
        return bool(self.marks().where(F.col("run") == run).take(1))

    def commit(self, run: int, changes: dict[str, Callable[[], Change]]) -> bool:
        """One run: the tables in the order of ``changes``, the marker last. False, and nothing
        is computed or written, if the run is complete. Runs are numbered upwards."""
        if self.is_complete(run):
            return False
        newest = self.marks().agg(F.max("run").alias("r")).first()["r"]
        if newest is not None and run < newest:
            raise ValueError(f"run {run} comes after run {newest}")
        marks = self.spark.createDataFrame([("", -1, 0)], "tab string, bucket int, n_rows bigint")  # a run without rows
        for name, change in changes.items():
            marks = marks.unionByName(self._write(run, self.tables[name], change()))
        marks.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/_runs/run={run}")
        return True

    def stale(self, table: str) -> DataFrame:
        """(bucket, run) of complete runs that no reader takes any more."""
        m = self.marks().where(F.col("tab") == table).select("bucket", "run")
        newest = m.groupBy("bucket").agg(F.max("run").alias("newest"))
        return m.join(newest, "bucket").where("run < newest").select("bucket", "run")


def initial(rows: DataFrame, key: str) -> Callable[[], Change]:
    """The first run of a table: all its rows."""
    return lambda: Change(rows.select(key), lambda stored: rows)


def replace(rows: DataFrame, key: str) -> Callable[[], Change]:
    """Rows that replace the stored ones of equal key, or are new (keys not null, unique on both sides)."""
    def change() -> Change:
        kept = write_once(rows, "run-rows")
        return Change(kept.select(key), lambda stored: stored.join(kept.select(key), key, "left_anti")
                      .select(*kept.columns).unionByName(kept))
    return change


def delete(keys: DataFrame, key: str) -> Callable[[], Change]:
    """Rows whose key is listed go."""
    def change() -> Change:
        gone = write_once(keys.select(key).distinct(), "run-keys")
        return Change(gone, lambda stored: stored.join(gone, key, "left_anti").select(*stored.columns))
    return change
