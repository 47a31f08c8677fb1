"""Runs over a bucketed store: only touched buckets change, and a run shows as a whole or not at all."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from opinio.sources.runs import Change, RunStore, Table, bucket_of, delete, initial, replace


@pytest.fixture
def store(spark, tmp_path):
    rows = spark.range(0, 200).select("id", F.concat(F.lit("v"), "id").alias("body"))
    s = RunStore(spark, str(tmp_path), [Table("a", "id", rows.schema, 16), Table("b", "id", rows.schema, 4)])
    assert s.commit(0, {"a": initial(rows, "id"), "b": initial(rows.where("id < 3"), "id")})
    return s


def content(store, table="a"):
    return {r.id: r.body for r in store.read(table).collect()}


def files(store, table="a"):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{store.root}/{table}/*/*/*.parquet")}


def test_only_touched_buckets_are_written_and_read(spark, store):
    before = files(store)
    new = spark.createDataFrame([(7, "seven"), (900, "new")], "id long, body string")
    touched = {r.b for r in new.select(bucket_of(F.col("id"), 16).alias("b")).collect()}
    assert store.commit(1, {"a": replace(new, "id")})
    after = files(store)
    assert before.items() <= after.items()
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(after) - set(before)} == touched
    assert content(store) == {**{i: f"v{i}" for i in range(200)}, 7: "seven", 900: "new"}
    plan = store.read("a", sorted(touched))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "run" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {(r.bucket, r.run) for r in store.stale("a").collect()} == {(b, 0) for b in touched}


def test_a_broken_run_changes_nothing_and_can_be_repeated(spark, store):
    new = spark.createDataFrame([(1, "one"), (300, "x")], "id long, body string")

    def breaks():
        raise OSError("lost")
    with pytest.raises(OSError):
        store.commit(1, {"a": replace(new, "id"), "b": breaks})
    assert content(store) == {i: f"v{i}" for i in range(200)} and not store.is_complete(1)
    assert store.commit(1, {"a": replace(new, "id"), "b": delete(spark.range(0, 2), "id")})
    want = {**{i: f"v{i}" for i in range(200)}, 1: "one", 300: "x"}
    assert content(store) == want and content(store, "b") == {2: "v2"}
    held = files(store)
    assert store.commit(1, {"a": delete(spark.range(0, 200), "id")}) is False  # complete: nothing is done
    assert content(store) == want and files(store) == held
    with pytest.raises(ValueError):
        store.commit(0 - 1, {})


def test_emptied_buckets_and_empty_tables(spark, store):
    assert store.commit(1, {"a": delete(spark.range(0, 200), "id"), "b": delete(spark.range(0, 0), "id")})
    assert content(store) == {} and len(content(store, "b")) == 3
    assert store.commit(2, {"a": initial(spark.createDataFrame([(None, "n"), (5, "f")], "id long, body string"), "id")})
    assert content(store) == {None: "n", 5: "f"}
    assert store.commit(3, {}) and content(store) == {None: "n", 5: "f"}


def test_names_of_the_layout_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        RunStore(spark, str(tmp_path), [Table("a", "id", spark.range(1).selectExpr("id", "id AS Run").schema)])


def test_change_sees_the_stored_rows_of_its_buckets_only(spark, store):
    seen = []

    def next_rows(stored):
        seen.extend(r.id for r in stored.collect())
        return stored
    keys = spark.createDataFrame([(3,)], "id long")
    store.commit(1, {"a": lambda: Change(keys, next_rows)})
    assert 3 in seen and len(seen) < 60
