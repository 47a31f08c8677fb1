"""Language ID, byte BPE, PII and quality on small fixtures and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.llm import bpe, langid, pii, quality
from opinio.llm import queries as Q

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=False):
    rows = [(i, t, "en", "s", 0) for i, t in texts]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("score", F.lit("clash")).withColumn("n_tokens", F.lit("clash")) if extra else df


EDGE = [(1, None), (2, ""), (3, "   \n "), (4, "123 !!"), (None, "the of and"), (5, "the of and"), (5, "the of and"),
        (6, "x" * 300_000), (7, "der die das und")]


# ---- language ID ---------------------------------------------------------

def test_language_id_edges_and_model(spark):
    train = spark.createDataFrame([("the cat and the dog that was here", "en")] * 20 + [("der hund und die katze das war", "de")] * 20
                                  + [(None, "en"), ("x y", None), ("the end", "en")], "text string, lang string")
    model = langid.train(train, min_rate=1e-4)
    assert model.languages == ["en", "de"]
    got = {(r.doc_id, r.text if r.text is None else r.text[:9]): r._language
           for r in langid.identify(docs(spark, EDGE, extra=True), model).collect()}
    for key in ((1, None), (2, ""), (3, "   \n "), (4, "123 !!")):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert got[(7, "der die d")].lang_pred == "de" and got[(5, "the of an")].lang_pred == "en"
    assert got[(6, "xxxxxxxxx")].lang_pred == "en" and got[(6, "xxxxxxxxx")].score == 0.0  # unknown: the commoner language


def test_language_model_of_an_empty_table(spark):
    model = langid.train(docs(spark, []))
    assert model.predict("some text") == ("und", 0.0)


def test_many_languages_need_several_words_of_bits():
    import pandas as pd
    langs = [f"l{i:03d}" for i in range(70)]
    gram = {lang: next(langid.letter_grams(chr(0x4E00 + i) * 5)) for i, lang in enumerate(langs)}
    chosen = pd.DataFrame([(k, int(g)) for k, gs in gram.items() for g in gs], columns=["lang", "gram"]).drop_duplicates()
    model = langid.build(langs, chosen)
    assert model.slots.shape[0] == 2
    assert all(model.predict(chr(0x4E00 + i) * 5)[0] == lang for i, lang in enumerate(langs))


def test_grams_do_not_depend_on_the_piece_length(monkeypatch):
    text = "Ab, c  d\n\nefg 12 hi " * 30
    whole = np.concatenate(list(langid.letter_grams(text)))
    monkeypatch.setattr(langid, "_PIECE", 7)
    assert np.array_equal(np.concatenate(list(langid.letter_grams(text))), whole)


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = Q.op1_language_id(spark, SF).where("held_out").join(truth, "doc_id").collect()
    assert got and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95 and all(0 <= r.score <= 1 for r in got)


# ---- byte-level BPE ------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    ranks = bpe.load_ranks(Q.vocabulary())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens_are_the_pattern_matches():
    import public_tokenizers
    import regex
    pattern, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(5000):
        text = "".join(rnd.choice(" \n\t'sdtmrevl12½Ⅷab.É!\x1c\x85 漢😀ªّ") for _ in range(rnd.randint(0, 16)))
        assert [w for ws in bpe.pretokens(text) for w in ws] == pattern.findall(text)


def test_encoding_equals_the_library_and_round_trips(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 1 << 15)  # several blocks
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(
        docs(spark, [*EDGE, (8, "<|endoftext|> don't\x00"), (9, "é" * 5)], extra=True).select("doc_id", "text"))
    got = bpe.decode(bpe.encode(table, Q.vocabulary(), buckets=5), Q.vocabulary()).collect()
    want = []
    for r in table.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), (r.text or "").encode()))
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in got), key=key) == sorted(want, key=key)


def test_digests_decode_beside_the_ids(spark):
    """One Python worker a task: nothing runs in Python behind the stage that puts the ids together."""
    table = docs(spark, EDGE, extra=True).select("doc_id", "text")
    plan = Q.encoded_digests(table, Q.vocabulary())._jdf.queryExecution().sparkPlan().toString()
    assert re.findall(r"FlatMapCoGroupsInArrow|MapInArrow", plan)[0] == "FlatMapCoGroupsInArrow"
    two = bpe.decode(bpe.encode(table, Q.vocabulary()), Q.vocabulary()).collect()
    one = bpe.encode(table, Q.vocabulary(), decoded="decoded").collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, bytes(r.ids), bytes(r.decoded))
    assert one and sorted(map(key, one)) == sorted(map(key, two))


def test_encoding_of_an_empty_table(spark):
    assert Q.encoded_digests(docs(spark, []), Q.vocabulary()).collect() == []


# ---- personal data --------------------------------------------------------------------

def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(3)
    for _ in range(30000):
        text = "".join(rnd.choice("a@.@1-1+ 2.5(é0") for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(text) == plain_base(text)
    text = "x 4111 1111 1111 1111, +1 (203) 555-8282 a.b@c.d.e 255.1.2.003 256.1.1.1 4111111111111112"
    assert pii.base_spans(text) == plain_base(text) and len(pii.base_spans(text)) == 4


def test_added_spans_need_checksum_or_context():
    assert pii.find_spans("iban DE89 3704 0044 0532 0130 00.")[1] == [("iban", 5, 32)]
    assert pii.find_spans("DE88 3704 0044 0532 0130 00")[1] == []
    assert pii.find_spans("my card 378282246310005")[1] == [("card", 8, 23)]
    assert pii.find_spans("number 378282246310005")[1] == []
    assert pii.find_spans("SSN 123-45-6789")[1] == [("national_id", 4, 15)] and pii.find_spans("123-45-6789")[1] == []


def test_long_runs_take_linear_time():
    for c in ("1", "a", "1.", "+1 ", "a@", "A1", "1 "):
        pii.find_spans(c * 100_000)


def test_iban_before_and_after_other_tokens():
    spain, belgium = "ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034"
    for number in (spain, belgium, spain.replace(" ", ""), "DE89 3704 0044 0532 0130 00"):
        for tail in ("", " BIC", " 2024", " BANK", " BANKING 12", f" {spain}", f" {belgium} X1"):
            for head in ("", "REF ", "AB13 ", "AB13 CD34 "):
                text, at = head + number + tail, len(head)
                spans = pii.find_spans(text)[1]
                assert ("iban", at, at + len(number)) in spans, text
                assert number not in pii.masked(text, spans)
                assert sum(k == "iban" for k, _, _ in spans) == 1 + (spain in tail or belgium in tail)
    assert pii.find_spans(spain.replace("91", "92") + " BIC")[1] == []
    assert pii.find_spans("ES9121000418450200051332Y")[1] == []


def test_pii_edges_and_masking(spark):
    rows = [*EDGE, (10, "ask a@b.co or 10.0.0.1"), (11, "é 4111111111111111 x"), (11, "é 4111111111111111 x")]
    found = pii.find_pii(docs(spark, rows, extra=True).drop("pii")).collect()
    assert len(found) == len(rows) and {r.doc_id for r in found if r.pii.spans} == {10, 11}
    masked = {(r.doc_id, r.text) for r in pii.mask(docs(spark, rows)).collect()}
    assert {(10, "ask [EMAIL] or [IP]"), (11, "é [CARD] x"), (1, None), (2, "")} <= masked


def test_pii_query_on_the_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in Q.op9_pii(spark, SF).collect():
        base = plain_base(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.BASE_KINDS]
        assert set(joined.split(",")) <= set(r.spans.split(",")) or not base


# ---- quality -----------------------------------------------------------------------------

def test_quality_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 0), (None, 1, 0), (5, 7, 0), (6, None, 0)],
                                   "doc_id long, quality int, toxic int")
    rows = [(i, ("some plain words of text. " if i % 2 else "AA!! AA!! 99 ") * (i + 3)) for i in range(40)]
    table = docs(spark, [*rows, (50, None), (51, ""), (None, "words"), (52, "y" * 200_000)], extra=True).drop("score")
    got = {r.doc_id: r.score for r in quality.train_and_score(table, labels, F.col("doc_id").isNotNull()).collect()}
    assert len(got) == 44 and all(0 <= s <= 1 for s in got.values()) and got[50] == got[51]
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(40))


def test_quality_without_labels_or_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.train_and_score(docs(spark, [(1, "a"), (2, None)]), labels, F.lit(True)).collect()
    assert [r.score for r in got] == [0.5, 0.5]
    assert quality.train_and_score(docs(spark, []), labels, F.lit(True)).collect() == []


def test_quality_sums_give_the_direct_estimate(spark):
    rnd = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = np.concatenate((rnd.normal(0, 1, (60, d)), rnd.normal(1, 2, (90, d))))
    y = [0] * 60 + [1] * 90
    rows = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y)], "features array<double>, label int").repartition(5)
    model = quality.fit(rows)
    assert np.allclose(model.means, [x[:60].mean(0), x[60:].mean(0)]) and np.allclose(model.prior, (0.4, 0.6))
    own = [np.cov(x[:60].T, bias=True), np.cov(x[60:].T, bias=True)]
    pooled = 0.4 * own[0] + 0.6 * own[1]
    pooled = (1 - quality.DIAGONAL_SHARE) * pooled + quality.DIAGONAL_SHARE * np.diag(np.diag(pooled))
    log = []
    for c in (0, 1):
        s = quality.OWN_SHARE * own[c] + (1 - quality.OWN_SHARE) * pooled + quality.RIDGE * np.eye(d)
        diff = x - model.means[c]
        log.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(s), diff) - 0.5 * np.linalg.slogdet(s)[1] + np.log(model.prior[c]))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(-(log[1] - log[0]) / quality.TEMPERATURE)))


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = Q.op10_quality(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.93


def test_small_batches_keep_a_sessions_lower_values(spark):
    from opinio.llm.common import BYTES_A_BATCH, TEXTS_A_BATCH, small_batches
    rows, size = (f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes"))
    before = {k: spark.conf.get(k) for k in (rows, size)}
    try:
        for given, left in (("10000", "64m"), (str(TEXTS_A_BATCH), str(BYTES_A_BATCH))), (("50", "1m"), ("50", "1m")):
            spark.conf.set(rows, given[0])
            spark.conf.set(size, given[1])
            small_batches(spark.range(1))
            assert (spark.conf.get(rows), spark.conf.get(size)) == left
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
