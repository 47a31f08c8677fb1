"""Pipeline operators keep rows, columns and spans: clashing ids, helper names, cards beside digits."""

import pytest
from pyspark.sql import functions as F

from opinio.llm import decontam, pii, simhash
from opinio.llm.common import free_name


def test_one_id_on_two_texts_keeps_both(spark):
    rows = [(5, "alpha beta gamma delta epsilon zeta", "a"), (5, "one two three four five six seven", "b"),
            (6, "one two three four five six seven", "c"), (5, "alpha beta gamma delta epsilon zeta", "0"),
            (None, "other words stand here alone", "d"), (None, "other words stand here alone", "e"), (7, None, "f"), (8, "", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = {(r.doc_id, r.text, r.tag) for r in simhash.keep_one(docs).collect()}
    assert got == {(5, rows[0][1], "0"), (5, rows[1][1], "b"), (None, rows[4][1], "d"), (7, None, "f")}


def test_columns_named_like_helpers_stay(spark):
    mine = ["_hash", "_n", "_length", "_own", "_fp", "_id", "digest", "fp", "n", "root", "_language", "n_hit", "items"]
    docs = spark.createDataFrame([(i, f"text number {i} of words and more words", *[f"{c}{i}" for c in mine]) for i in range(4)],
                                 "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in mine))
    benchmark = spark.createDataFrame([(1, "text number 2 of words")], "item_id long, text string")
    for kept in (simhash.keep_one(docs), decontam.drop_contaminated(docs, benchmark), pii.mask(docs)):
        assert kept.columns == docs.columns
        for r in kept.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in mine)
    assert {r.doc_id for r in decontam.drop_contaminated(docs, benchmark).collect()} == {0, 1, 3}
    assert free_name(docs, "_language") == "_language_" and free_name(docs, "new") == "new"


def test_pipeline_stage_with_clashing_columns(spark):
    import corpus_pipeline
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("_language", F.lit("mine"))
    kept = corpus_pipeline.language_id(spark, table, "/root/testdata/sf0.001")
    assert kept.columns == table.columns and {r[0] for r in kept.select("_language").distinct().collect()} == {"mine"}


@pytest.mark.parametrize("text,card", [
    ("card 4111 1111 1111 1111 12/26", "4111 1111 1111 1111"), ("card 4111 1111 1111 1111 123", "4111 1111 1111 1111"),
    ("visa 4111111111111111 2026", "4111111111111111"), ("order 7 4111 1111 1111 1111", "4111 1111 1111 1111"),
    ("4111-1111-1111-1111 5500 0000 0000 0004", "4111-1111-1111-1111"), ("amex 3782 822463 10005 7", "3782 822463 10005")])
def test_cards_beside_other_digits(text, card):
    base, spans = pii.find_spans(text)
    assert not [s for s in base if s[0] == "card"]
    start = text.index(card)
    assert ("card", start, start + len(card)) in spans
    assert card not in pii.masked(text, spans)


@pytest.mark.parametrize("text", ["4111 1111 1111 1112 12/26", "numbers 1234 5678 9012 3456 7890 1234", "2024-01-02 10 20 30 40 50 60 70",
                                  "0000 0000 0000 0000 0000", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"])
def test_other_numbers_are_no_cards(text):
    assert not [s for s in pii.find_spans(text)[1] if s[0] == "card"]


def test_whole_cards_stay_base_spans():
    assert pii.find_spans("pay 4111 1111 1111 1111 now") == ([("card", 4, 23)],) * 2
