"""Plans that have to grow with their input only."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from opinio.operators import ingest as I
from opinio.operators import sentences as SN

from conftest import SF_SMALL


def test_only_texts_beyond_ascii_go_to_python(spark):
    from opinio.functions import strings
    rows = [("plain",), ("ﬁé",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(strings.nfkd("t")).collect()] == ["plain", "fié", None, ""]
    plan = df.select(strings.nfkd("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE(t" in plan


def test_nfkd_and_pieces_take_small_batches(spark):
    from opinio.session import BYTES_A_BATCH, TEXTS_A_BATCH
    most = {f"spark.sql.execution.arrow.max{k}PerBatch": n for k, n in (("Records", TEXTS_A_BATCH), ("Bytes", BYTES_A_BATCH))}
    before = {k: spark.conf.get(k) for k in most}
    try:
        for query in ("normalise_text_nfkd", "op13_sentencepiece"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
            E.queries()[query](spark, SF_SMALL)
            assert {k: int(spark.conf.get(k)) for k in most} == most, query
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_body_diff_takes_fingerprints_for_stored_texts(spark):
    from opinio.functions.hashing import content_hash
    stored = spark.createDataFrame([(7, 1, 3, "h", "b"), (8, 2, 0, "h", "old")],
                                   "id long, article_id long, proc_counter int, headline string, body string")
    new = spark.createDataFrame([(1, "h", "b", 0, None), (2, "h", "new", 4, None), (3, "x", "y", 0, None)],
                                "article_id long, headline string, body string, proc_counter int, proc_timestamp timestamp")
    hashes = stored.select("id", "article_id", "proc_counter", content_hash(F.col("headline"), F.col("body")).alias("text_hash"))
    got = [tuple(r) for r in I.body_version_diff(new, hashes).orderBy("article_id").collect()]
    assert got == [tuple(r) for r in I.body_version_diff(new, stored).orderBy("article_id").collect()]
    assert [r[2:4] for r in got] == [(False, 4), (True, 5), (True, 1)]


def test_sentences_are_trimmed_without_a_pattern(spark):
    lines = spark.createDataFrame([(1, "\x0b One \ttwo!\f Three\r\n four. \t\n"), (2, " \t ")], "doc int, text string")
    out = SN.split_sentences(lines, ["doc"], SN.learn_boundaries(lines))
    assert [tuple(r) for r in out.orderBy("sentence_no").collect()] == [(1, 0, "One \ttwo!"), (1, 1, "Three\r\n four.")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(sentence" not in plan
