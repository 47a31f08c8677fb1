"""Words are counted inside their texts (topics.word_counts): no exchange of texts' words."""

from pyspark.sql import functions as F

from opinio.operators import topics as TP

ROWS = [(1, " Ab... ab\tAB x - y"), (1, "x  ab"), (None, "zz"), (None, "zz a"), (2, ""), (3, None), (4, "é_1 Straße a b\n")]


def _frequencies_by_word(texts):
    """Every word cleaned for itself, counts grouped by (id, word)."""
    from opinio.functions.strings import clean_word
    w = texts.select("id", F.posexplode(F.split("text", r"\s+")).alias("pos", "w"))
    return (w.select("id", "pos", clean_word(F.col("w"), digits=True).alias("word")).groupBy("id", "word")
            .agg(F.count(F.lit(1)).alias("cnt"), F.min("pos").alias("first_pos")))


def _rows(df):
    return sorted(map(tuple, df.select("id", "word", "cnt", "first_pos").collect()), key=repr)


def test_word_frequency_adds_up_repeated_and_null_ids(spark):
    texts = spark.createDataFrame(ROWS, "id long, text string")
    got = TP.word_frequency(texts, "id", "text")
    assert _rows(got) == _rows(_frequencies_by_word(texts))
    assert got.dtypes == _frequencies_by_word(texts).dtypes
    assert (None, "zz", 2, 0) in _rows(got) and (1, "ab", 4, 1) in _rows(got)


def test_topics_of_repeated_ids(spark):
    texts = spark.createDataFrame([(1, "q q, r"), (1, "r r q s"), (2, "s s s . t T t"), (3, "q q")], "id long, text string")
    got = sorted(map(tuple, TP.topics_top5(texts, spark.createDataFrame([("",)], "word string")).collect()))
    assert got == [(1, 1, "r", 3), (1, 2, "q", 3), (2, 1, "s", 3), (2, 2, "t", 3)] or \
        got == [(1, 1, "q", 3), (1, 2, "r", 3), (2, 1, "s", 3), (2, 2, "t", 3)]


def _exchanged_by_word(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "word" in line]


def test_words_of_large_texts_are_not_exchanged(spark, monkeypatch):
    monkeypatch.setattr(TP, "ensure_parallelism", lambda df, *keys: df)  # as for an input of many splits
    texts = spark.range(50).select("id", F.lit("a b a").alias("text"))
    assert not _exchanged_by_word(TP.word_frequency(texts, "id", "text"))
    stop = spark.createDataFrame([("",)], "word string")
    assert not _exchanged_by_word(TP.topics_top5(texts, stop))
