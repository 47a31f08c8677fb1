"""Insert-or-ignore over the keyed store against sets in Python."""

import uuid

import pytest
from pyspark.sql import functions as F

from opinio.sources.store import KeyedStore


@pytest.fixture
def store(spark, tmp_path):
    name = f"keys_{uuid.uuid4().hex}"
    s = KeyedStore(spark, name, str(tmp_path), ["url"], parts=4, buckets=4, blocks=8)
    yield s
    for t in (name, f"{name}_filter"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def urls(spark, start, end):
    return spark.range(start, end).select(F.concat(F.lit("u"), "id").alias("url"), F.col("id"))


def fresh(store, keys):
    return {r.url: r.pos for r in store.fresh(keys, "pos").collect()}


def test_stored_keys_win_and_the_first_of_a_batch(spark, store):
    batch = spark.createDataFrame([("u1", 5), ("a", 9), ("a", 7), ("u2999", 1), ("b", 3)], "url string, pos long")
    assert fresh(store, batch) == {"u1": 5, "a": 7, "u2999": 1, "b": 3}   # nothing stored yet
    store.append(urls(spark, 0, 3000))
    assert fresh(store, batch) == {"a": 7, "b": 3}
    store.append(spark.createDataFrame([("a", 3000), ("b", 3001)], "url string, id long"))
    assert fresh(store, batch) == {}                                      # replay
    store.append(spark.createDataFrame([("a", 3000)], "url string, id long"))
    assert fresh(store, batch.unionByName(spark.createDataFrame([("c", 1)], batch.schema))) == {"c": 1}
    every = urls(spark, 0, 6000).select("url", F.col("id").alias("pos"))
    assert fresh(store, every) == {f"u{i}": i for i in range(3000, 6000)}


def test_the_filter_rules_out_most_new_keys_and_never_a_stored_one(spark, store):
    store.append(urls(spark, 0, 2000))
    store.append(urls(spark, 2000, 4000))                                 # two appends a block are merged
    judged = store.judged(urls(spark, 0, 8000)).collect()
    assert all(r.maybe_fs for r in judged if r.id < 4000)
    assert sum(r.maybe_fs for r in judged if r.id >= 4000) < 40
    assert len(judged) == 8000


def test_no_exchange_of_the_stored_keys_and_only_touched_folders(spark, store):
    store.append(urls(spark, 0, 4000))
    batch = spark.createDataFrame([("u17", 1), ("new", 2)], "url string, pos long")
    part = store.judged(batch.where("pos = 1")).first()["part"]
    plan = store.fresh(batch, "pos")._jdf.queryExecution().executedPlan().toString()
    join = plan[plan.index("SortMergeJoin"):]
    stored_side = join[:join.index(f"{store.name}[") if f"{store.name}[" in join else join.index("Bucketed: true")]
    stored_side = stored_side[stored_side.rindex("Sort ["):]
    assert "Exchange" not in stored_side and "Bucketed: true" in join
    assert f"(part#" in join and str(part) in join.split("PartitionFilters: [")[-1].split("]")[0]
    unseen = spark.createDataFrame([("never stored", 1)], "url string, pos long")
    assert fresh(store, unseen) == {"never stored": 1}


def test_null_and_compound_keys_empty_batches_and_tables(spark, tmp_path, store):
    nothing = spark.createDataFrame([], "url string, pos long")
    store.append(spark.createDataFrame([], "url string, id long"))
    assert fresh(store, nothing) == {} and fresh(store, spark.createDataFrame([("x", 1)], nothing.schema)) == {"x": 1}
    store.append(spark.createDataFrame([(None, 1), ("x", 2)], "url string, id long"))
    assert fresh(store, nothing) == {}
    got = fresh(store, spark.createDataFrame([(None, 4), (None, 3), ("x", 1), ("y", 2)], nothing.schema))
    assert got == {None: 3, "y": 2}
    name = f"keys_{uuid.uuid4().hex}"
    two = KeyedStore(spark, name, str(tmp_path / "two"), ["a", "b"], parts=2, buckets=2, blocks=2)
    two.append(spark.createDataFrame([(1, "x", 10), (2, "x", 11)], "a int, b string, id long"))
    keys = spark.createDataFrame([(1, "x", 0), (1, "y", 1), (None, "x", 2)], "a int, b string, pos long")
    assert {(r.a, r.b) for r in two.fresh(keys, "pos").collect()} == {(1, "y"), (None, "x")}
    assert {(r.pos, r.id) for r in two.resolve(keys).collect()} == {(0, 10), (1, None), (2, None)}
    for t in (name, f"{name}_filter"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    with pytest.raises(ValueError):
        KeyedStore(spark, "x", str(tmp_path), ["part"])
    with pytest.raises(ValueError):
        KeyedStore(spark, "x", str(tmp_path), ["url"], parts=3, blocks=4)
