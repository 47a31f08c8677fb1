"""Invariants and brute-force checks of the distributed building blocks."""

import itertools
import random

import pytest

from pyspark.sql import functions as F

from opinio.operators import control as C
from opinio.operators import corpus as K
from opinio.operators import sentiment as S
from opinio.operators.ids import dense_ids, running_total


def test_dense_ids_consecutive(spark):
    keys = list(range(0, 3000, 3))
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = sorted((r.k, r.id) for r in dense_ids(df, ["k"], 100).collect())
    assert got == [(k, 101 + i) for i, k in enumerate(sorted(keys))]


def test_running_total_per_group(spark):
    rows = [(g, i, (g * 7 + i) % 5) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, i int, v int")
    out = running_total(df, ["i"], F.col("v"), "rt", inclusive=False, partition_cols=["g"]).collect()
    exp = {}
    for g in range(3):
        acc = 0
        for i in range(50):
            exp[(g, i)] = acc
            acc += (g * 7 + i) % 5
    assert {(r.g, r.i): r.rt for r in out} == exp


def test_pair_counts_brute_force(spark):
    rnd = random.Random(7)
    rows = [(i, 0, "x" * rnd.randint(1, 600), rnd.choice([-1, 0, 1])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, sample_no int, text string, label int")
    exp = {}
    for a, b in itertools.combinations(rows, 2):
        if a[3] == b[3] and len(a[2]) + len(b[2]) < 512:
            exp[a[3]] = exp.get(a[3], 0) + 1
    got = {r.label: r.n_pairs for r in K.pair_counts(df).collect() if r.n_pairs}
    assert got == exp


def test_class_balance_fills_to_target(spark):
    rnd = random.Random(3)
    rows = [(i, 0, "w" * rnd.randint(5, 200), lab) for i, lab in enumerate([-1] * 4 + [0] * 9 + [1] * 30)]
    df = spark.createDataFrame(rows, "id long, sample_no int, text string, label int").withColumn(
        "key", F.col("id").cast("string"))
    bal = K.class_balance(df)
    counts = {r.label: r["count"] for r in bal.groupBy("label").count().collect()}
    # the largest class's size is the target; a class runs out of pairs in its rounds
    assert counts[1] == 30 and counts[-1] <= 30 and counts[0] == 30
    assert counts[-1] == 4 + 3 + 2 + 1
    gen = bal.filter("origin = 'generated'")
    assert gen.select("key").distinct().count() == gen.count()  # distinct pairs


def test_todo_excludes_logged(model):
    todo = C.todo_analyzer(model).select("comment_id")
    logged = model.analyzer_log.select(F.col("comment_id"))
    assert todo.join(logged, "comment_id", "inner").count() == 0


def test_nearest_lexicon_brute_force_and_bound(spark):
    rnd = random.Random(5)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(8)]
    queries = [(i, vec()) for i in range(60)]
    entries = [(i, vec(), float(i % 3)) for i in range(40)]
    entries.append((40, entries[7][1], 9.0))   # a tie: the lower id wins
    queries.append((60, entries[7][1]))
    q = spark.createDataFrame(queries, "qid long, vec array<double>")
    lex = spark.createDataFrame(entries, "lex_id long, vec array<double>, score double")

    def distance(a, b):
        norm = lambda x: sum(v * v for v in x) ** 0.5
        return 1 - sum(x * y for x, y in zip(a, b)) / norm(a) / norm(b)
    want = {i: min((round(distance(v, w), 9), j, s) for j, w, s in entries) for i, v in queries}
    got = {r.qid: (round(r.distance, 9), r.lex_id, r.score) for r in S.nearest_lexicon(q, lex, "qid", "vec").collect()}
    assert got == want
    assert S.nearest_lexicon(q, lex.limit(0), "qid", "vec").collect() == []
    with pytest.raises(ValueError):
        S.nearest_lexicon(q, lex, "qid", "vec", max_bytes=100)


def test_thread_levels_brute_force(spark):
    parents = {1: None, 2: 1, 3: 2, 4: 3, 5: 1, 6: None, 7: 6, 8: 99}
    df = spark.createDataFrame(list(parents.items()), "id long, parent_id long")
    from opinio.operators.comment_tree import thread_levels
    got = {r.id: (r.root_id, r.depth) for r in thread_levels(df).collect()}

    def walk(i):
        d = 0
        while parents.get(i) in parents:
            i, d = parents[i], d + 1
        return i, d
    assert got == {i: walk(i) for i in parents}


def test_sizing_conf_scales_with_input():
    from opinio.session import sizing_conf
    small = sizing_conf(10 * 1024 ** 2, cores=8)
    big = sizing_conf(100 * 1024 ** 4, cores=8000)
    assert small["spark.sql.shuffle.partitions"] == "16"          # two waves of 8 cores
    assert int(big["spark.sql.shuffle.partitions"]) == 409600      # 100 TB / 256 MB


def test_non_word_class_removes_exactly_the_plain_class(spark):
    """The intersection-form regex used for speed removes the same characters
    as the plain negated class, over every code point below U+3000."""
    import re

    from opinio.functions.strings import WORD_CHARS, WORD_CHARS_DIGITS, non_word_class
    text = "".join(chr(i) for i in range(1, 0x3000) if not 0xD800 <= i < 0xE000) + "😀 a_b Ä-ö ß.1"
    df = spark.createDataFrame([(text,)], "t string")
    for digits in (False, True):
        keep = WORD_CHARS_DIGITS if digits else WORD_CHARS
        for keep_ws in (False, True):
            plain = f"[^{keep}" + (" \t\n\x0b\f\r" if keep_ws else "") + "]+"
            got = df.select(F.regexp_replace("t", non_word_class(digits, keep_ws), "").alias("r")).first().r
            assert got == re.sub(plain, "", text), (digits, keep_ws)


def test_dense_ids_at_any_partition_count(spark):
    """Large rows and few sampled keys: ids stay unique and in order however the rows are cut."""
    df = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("k"), F.repeat(F.lit("x"), 200).alias("payload"))
    for n in (2, 4, 16, 200):
        out = dense_ids(df, ["k"], 0, partitions=n)
        got = out.agg(F.count_distinct("id").alias("ids"), F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        assert (got.ids, got.lo, got.hi) == (200_000, 1, 200_000)
        rank = out.select("id", "k").orderBy("k").toPandas()
        assert rank["id"].tolist() == list(range(1, 200_001))
