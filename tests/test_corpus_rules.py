"""Corpus and versioning rules with hand-made inputs."""

import datetime as dt

from pyspark.sql import functions as F

from opinio.operators import corpus as K
from opinio.operators import ingest as I


def test_bigram_rewrite_is_greedy_left_to_right(spark):
    corpus = spark.createDataFrame([(1, 0, "a b c"), (2, 0, "a b c d"), (3, 0, "x a b")],
                                   "doc long, sentence_no int, sentence string")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    got = {r.doc: r.sentence for r in K.bigram_rewrite(corpus, phrases, ["doc"]).collect()}
    assert got == {1: "a_b c", 2: "a_b c_d", 3: "x a_b"}


def test_phrase_score_threshold(spark):
    # vocabulary: 3 unigrams + 2 bigrams = 5; score(p q) = (c - 5) / c_p / c_q * 5
    rows = [(i, 0, "p q") for i in range(12)] + [(100, 0, "q r")]
    corpus = spark.createDataFrame(rows, "doc long, sentence_no int, sentence string")
    got = {(r.a, r.b): r.score for r in K.bigram_phrases(corpus, threshold=0.1).collect()}
    assert got == {("p", "q"): round((12 - 5) / 12 / 13 * 5, 9)}
    assert K.bigram_phrases(corpus).count() == 0  # default threshold 10 rejects it


def test_corpus_preprocess_rules(spark):
    lines = spark.createDataFrame([(1, "Schöne Grüße! (Ja) . Nein. Eins zwei drei.")], "doc long, text string")
    out = K.corpus_preprocess(lines, ["doc"], umlauts=True, punctuation=True)
    got = [r.sentence for r in out.orderBy("sentence_no").collect()]
    assert got == ["Schoene Gruesse", "Eins zwei drei"]   # one-word sentences dropped
    first = K.corpus_preprocess(lines, ["doc"], umlauts=True, punctuation=True, first_only=True)
    assert [r.sentence for r in first.collect()] == ["Schoene Gruesse"]


def test_version_diff_and_upsert(spark):
    ts = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([(10, 1, "h", "body", ts, 3), (11, 2, "h2", "old", ts, 1)],
                                   "id long, article_id long, headline string, body string, "
                                   "proc_timestamp timestamp_ntz, proc_counter int")
    incoming = spark.createDataFrame([(1, "h", "body", ts, 0), (2, "h2", "new", ts, 0), (3, "h3", "b3", ts, 0)],
                                     "article_id long, headline string, body string, "
                                     "proc_timestamp timestamp_ntz, proc_counter int")
    diff = I.body_version_diff(incoming, stored)
    d = {r.article_id: (r.insert, r.new_counter) for r in diff.collect()}
    assert d == {1: (False, 4), 2: (True, 1), 3: (True, 1)}
    changes = I.body_upsert(stored, diff)
    rows = {r.id: (r.op, r.article_id, r.body, r.proc_counter) for r in changes.collect()}
    assert rows == {10: ("update", 1, None, 4), 12: ("insert", 2, "new", 1), 13: ("insert", 3, "b3", 1)}
    up = {r.id: (r.article_id, r.body, r.proc_counter) for r in I.apply_body_upsert(stored, changes).collect()}
    assert up == {10: (1, "body", 4), 11: (2, "old", 1), 12: (2, "new", 1), 13: (3, "b3", 1)}


def test_validate_comments_removes_nul(spark):
    df = spark.createDataFrame([(1, 5, 0, "a\u0000b", dt.datetime(2024, 1, 1)), (2, -1, 0, "x", None)],
                               "external_id long, article_body_id long, level int, body string, "
                               "proc_timestamp timestamp_ntz")
    got = {r.external_id: (r.body, r.is_valid, r.reasons) for r in I.validate_comments(df).collect()}
    assert got[1] == ("ab", True, [])
    assert got[2][1] is False and set(got[2][2]) == {"body_id_not_positive", "timestamp_missing"}


def test_class_balance_uses_every_pair_that_fits(spark):
    # 5 short and 30 long items of class 1: 10 + 150 pairs fit, most of them far apart in the length order
    def balance(size):
        rows = [(0, f"k{i}", "z" * 600) for i in range(35 + size)]
        rows += [(1, f"s{i}", "s" * (10 + i)) for i in range(5)] + [(1, f"l{i:02}", "l" * (400 + i)) for i in range(30)]
        got = K.class_balance(spark.createDataFrame(rows, "label int, key string, text string"))
        made = [r.key[2:].split("|") for r in got.filter("origin = 'generated'").collect()]
        return made, dict((k, len(t)) for _, k, t in rows)

    for size, expected in ((1, 1), (37, 37), (120, 120), (160, 160), (200, 160)):
        made, length = balance(size)
        assert len(made) == len({frozenset(p) for p in made}) == expected
        assert all(a != b and length[a] + length[b] < 512 for a, b in made)
    order = sorted((k for k in length if k[0] in "sl"), key=length.get)
    # rounds in order: 5 pairs a round
    rounds = [abs(order.index(a) - order.index(b)) for a, b in balance(37)[0]]
    assert max(rounds) == 8 and [rounds.count(r) for r in range(1, 9)] == [5, 5, 5, 5, 5, 5, 5, 2]


def test_corpus_preprocess_drops_stop_words(spark):
    lines = spark.createDataFrame([(1, "Die Katze ist für uns da. Ist für alle. Der Hund und der Hund!"), (2, "und da")],
                                  "doc long, text string")
    stop = spark.createDataFrame([("ist",), ("für",), ("für",), ("und",), ("der",), ("",)], "word string")
    out = K.corpus_preprocess(lines, ["doc"], umlauts=True, stopwords=stop)
    got = [(r.doc, r.sentence_no, r.sentence) for r in out.orderBy("doc", "sentence_no").collect()]
    # as in the reference: exact match, the list in digraphs as the text, the > 1 word rule afterwards
    assert got == [(1, 0, "Die Katze uns da"), (1, 1, "Ist alle"), (1, 2, "Der Hund Hund")]


def test_registered_corpus_has_no_stop_words(spark):
    import __spark_entry__ as E
    from opinio.functions.strings import umlaut_digraphs

    from conftest import SF_SMALL
    queries = E.queries()
    stop = {r.w for r in queries["stopword_scan"](spark, SF_SMALL).select(umlaut_digraphs(F.col("word")).alias("w")).collect()}
    rows = queries["corpus_preprocess"](spark, SF_SMALL).collect()
    assert rows and all(len(w := r.sentence.split(" ")) > 1 and stop.isdisjoint(w) for r in rows)


def test_bigram_rewrite_of_repeated_and_null_keys(spark):
    rows = [(1, 0, "a b c d e"), (None, 0, "x a b"), (2, 0, "a b"), (2, 0, "c c"), (3, 0, ""), (4, 0, None), (5, 1, "a b a b c b c x")]
    corpus = spark.createDataFrame(rows, "doc int, sentence_no int, sentence string")
    phrases = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "a string, b string")
    got = sorted(map(tuple, K.bigram_rewrite(corpus, phrases, ["doc"]).collect()), key=repr)
    merged = K._rewrite_merged(corpus, phrases, ["doc", "sentence_no"], "sentence")  # all tokens in one window a key
    assert got == sorted(map(tuple, merged.collect()), key=repr)
    assert (1, 0, "a_b c_d e") in got and (5, 1, "a_b a_b c b_c x") in got and (None, 0, "x a_b") in got


def test_bigram_rewrite_exchanges_places_of_phrases_only(spark):
    corpus = spark.range(50).selectExpr("id AS doc", "0 AS sentence_no", "'a b c' AS sentence")
    phrases = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = K.bigram_rewrite(corpus, phrases, ["doc"])._jdf.queryExecution().optimizedPlan().toString()
    windows = plan[plan.index("Window"):]
    assert "Join Inner" in windows  # tokens are joined with phrases before they reach a window


def test_corpus_is_tokenised_once(spark):
    lines = spark.createDataFrame([(1, "One two. Three four!")], "doc int, text string")
    plan = K.bigram_counts(K.corpus_preprocess(lines, ["doc"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_classifier_fits_on_stored_term_frequencies(spark, monkeypatch):
    """Texts are cut and hashed once, before the passes of the fit; rows of other splits take no part."""
    from pyspark.ml import Pipeline
    from opinio.operators import corpus
    seen, fit = [], Pipeline.fit
    monkeypatch.setattr(Pipeline, "fit", lambda self, data: seen.append((data.columns, self.getStages()[-1])) or fit(self, data))
    words = {-1: "schlecht mies", 0: "neutral  egal", 1: "gut\tToll"}
    rows = [(f"{split}{i}", label, text, split) for split, n in (("train", 8), ("test", 2)) for i in range(n) for label, text in words.items()]
    rows += [("test9", 1, "TOLL", "test"), ("val1", 0, None, "val")]
    data = spark.createDataFrame(rows, "key string, label int, text string, split string")
    got = corpus.train_classifier(data, num_features=1 << 10)
    assert sorted((r.key, r.label) for r in got.collect()) == sorted((k, y) for k, y, _, split in rows if split == "test")
    assert all(r.prediction == r.label for r in got.collect())
    (columns, regression), = seen
    assert "text" not in columns and "_tf" in columns and regression.getMaxBlockSizeInMB() == corpus.TRAIN_BLOCK_MB
