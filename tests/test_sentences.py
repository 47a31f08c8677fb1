"""Learned sentence boundaries: statistics, rules and both ways of splitting."""

import math

import pytest
from pyspark.sql import functions as F

from opinio.operators import corpus as K
from opinio.operators import sentences as SN

FILLER = ["Die Katze schläft heute lange. Der Hund wacht im Garten. Im Garten blüht es. Das Haus steht leer.",
          "Wir sehen das Haus und den Hund. Die Sonne scheint. Der Tag war schön und die Luft klar.",
          "Viele Leute kommen am Abend. Das Essen schmeckt gut! Was sagt der Gast dazu? Die Musik spielt."]
SPECIAL = ["Am 3. Mai kam Dr. Weber zu uns.", "Seit dem 3. Mai fehlt Dr. Klein.", "Bis zum 12. Mai bleibt Dr. Weber hier.",
           "Obst, z. B. Äpfel und ggf. Birnen, schmeckt.", "Man nimmt z. B. Mehl und ggf. Zucker.", "Nimm ggf. Salz."]


@pytest.fixture(scope="module")
def trained(spark):
    texts = FILLER * 60 + SPECIAL * 12
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    return SN.learn_boundaries(lines)


def split(spark, model, text, **options):
    lines = spark.createDataFrame([(1, text)], "id long, text string")
    return [r.sentence for r in SN.split_sentences(lines, ["id"], model, **options).orderBy("sentence_no").collect()]


CASES = [
    ("Am 3. Mai kam Dr. Weber. Die Katze schläft.", ["Am 3. Mai kam Dr. Weber.", "Die Katze schläft."]),
    ("Das Obst, z. B. Äpfel, ist da. Der Hund auch.", ["Das Obst, z. B. Äpfel, ist da.", "Der Hund auch."]),
    ("Es gibt ggf. Birnen. Das Haus ist alt.", ["Es gibt ggf. Birnen.", "Das Haus ist alt."]),
    ("Er zählt 5. Dann geht er.", ["Er zählt 5.", "Dann geht er."]),
    ("Die 5. oder 6. Reise", ["Die 5. oder 6.", "Reise"]),  # an unlearned number and noun part, as in the paper
    ("Er heißt J. Weber. Was nun? Gut!", ["Er heißt J. Weber.", "Was nun?", "Gut!"]),
    ('Sie sagt: „Es regnet.“ Der Hund  bellt ...  und (laut.) Die Katze?\t', ['Sie sagt: „Es regnet.“', "Der Hund  bellt ...  und (laut.)",
                                                                              "Die Katze?"]),
    ("Er wartet ... Die Sonne scheint.", ["Er wartet ...", "Die Sonne scheint."]),
    ("ohne Punkt", ["ohne Punkt"]), ("  ", []), ("", []), (None, []), ("...", ["..."]), (". . .", [". . ."])]


@pytest.mark.parametrize("text,expected", CASES)
def test_split(spark, trained, text, expected):
    if text == ". . .":  # bare marks are words of their own
        assert "".join(split(spark, trained, text)).replace(" ", "") == "..."
    else:
        assert split(spark, trained, text) == expected


def test_model_holds_what_the_corpus_teaches(trained):
    got = {(r.kind, r.key) for r in trained.collect()}
    assert {("abbreviation", "dr"), ("abbreviation", "ggf"), ("collocation", "## mai"), ("collocation", "dr weber")} <= got
    assert {("starter", "die"), ("starter", "der"), ("opener", "die"), ("opener", "der")} <= got
    assert not {("abbreviation", "garten"), ("abbreviation", "mai"), ("opener", "hund"), ("starter", "weber")} & got


def test_both_ways_of_splitting_agree(spark, trained):
    texts = [t for t, _ in CASES] + SPECIAL + FILLER + ["x. " * 3000 + "Die Katze"]
    rows = [(i % 9, None if i % 4 == 0 else i, t) for i, t in enumerate(texts)] + [(1, 1, "Dr. Weber geht. Die Katze."), (1, 1, "Dr. Weber geht. Die Katze.")]
    lines = spark.createDataFrame(rows, "a long, b long, text string")
    plain = SN.split_sentences(lines, ["a", "b"], trained)
    joined = SN.split_sentences(lines, ["a", "b"], trained, literal_bytes=0)
    key = lambda r: (str(r.a), str(r.b), r.sentence_no, r.sentence)
    assert sorted(map(key, plain.collect())) == sorted(map(key, joined.collect()))
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_counts_and_ratio(spark):
    lines = spark.createDataFrame([("Der Hund. (Der) Ort der Tat, 3.5 der!",), (None,), ("",)], "text string")
    types = {r.typ: (r.n, r.n_dot, r.n_lower, r.n_upper_mid) for r in SN.word_types(lines).collect()}
    assert types == {"der": (4, 0, 2, 0), "hund": (1, 1, 0, 1), "ort": (1, 0, 0, 1), "tat": (1, 0, 0, 1), "##": (1, 0, 0, 0)}
    pairs = {(r.typ, r.end, r.next_typ, r.next_case, r.n) for r in SN.marked_pairs(lines).collect()}
    assert pairs == {("hund", ".", "der", "u", 1)}
    a, b, both, n = 30, 20, 15, 1000
    want = 0.0
    for k, row, col in ((both, a, b), (a - both, a, n - b), (b - both, n - a, b), (n - a - b + both, n - a, n - b)):
        want += 2 * k * math.log(k * n / row / col)
    got = spark.range(1).select(SN.log_likelihood(F.lit(a), F.lit(b), F.lit(both), F.lit(n)).alias("x")).first().x
    assert abs(got - want) < 1e-9


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "id long, text string")
    model = SN.learn_boundaries(empty)
    assert model.collect() == [] and SN.split_sentences(empty, ["id"], model).collect() == []
    assert split(spark, model, "Ein Satz. Noch einer, z. B. dieser.") == ["Ein Satz.", "Noch einer, z. B. dieser."]


def test_preprocessing_with_learned_boundaries(spark, trained):
    lines = spark.createDataFrame([(1, "Am 3. Mai kam Dr. Weber. Die Katze schläft.")], "doc long, text string")
    got = K.corpus_preprocess(lines, ["doc"], umlauts=True, boundaries=trained).orderBy("sentence_no").collect()
    assert [r.sentence for r in got] == ["Am 3 Mai kam Dr Weber", "Die Katze schlaeft"]


def test_stop_list_is_no_exchange_and_equals_the_join(spark, monkeypatch):
    lines = spark.createDataFrame([(i, "Die Katze ist für uns da. Ist für alle. Und da") for i in range(5)], "doc long, text string")
    stop = spark.createDataFrame([("ist",), ("für",), ("Die",), ("",), (None,)], "word string")
    plain = K.corpus_preprocess(lines, ["doc"], umlauts=True, stopwords=stop)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr("opinio.session.LITERAL_BYTES", 0)
    joined = K.corpus_preprocess(lines, ["doc"], umlauts=True, stopwords=stop)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, joined.collect())) != []


def test_text_files_line_to_line(spark):
    from opinio.session import scratch_path
    base = scratch_path(spark, "t-lines")
    spark.createDataFrame([("Die Katze schläft. Ja.",), ("",), ("Der Hund\rbellt laut! Und der Gast?",)], "value string").write.mode("overwrite").text(f"{base}/in")
    for _ in range(2):  # a second run writes the same files anew
        got = K.preprocess_text_files(spark, f"{base}/in", f"{base}/out", umlauts=True)
        assert sorted(r.value for r in got.collect()) == ["Der Hund bellt laut", "Die Katze schlaeft", "Und der Gast"]
