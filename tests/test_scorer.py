"""Batch scoring with a broadcast model file against a direct computation."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinio.operators import scorer as SC
from opinio.operators import sentiment as S

WEIGHTS = [[(b * 7 + k * 3) % 11 * 100 - 500 for k in range(5)] for b in range(9)]


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model") / "linear")
    return SC.broadcast_model(spark, SC.write_model(spark, path, SC.HashedLinear.dumps(WEIGHTS)))


def direct(text, size):
    tokens = re.split("[ \t\n\x0b\f\r]+", text or "")
    for start in range(0, len(tokens), size):
        piece = tokens[start:start + size]
        rows = [WEIGHTS[int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 9] for t in piece]
        yield [sum(c) / 1000.0 / len(piece) for c in zip(*rows)]


def test_every_chunk_of_every_text_is_scored(spark, model):
    long = " ".join(f"w{i % 173}" for i in range(5000))      # 500 chunks: many calls for one text
    texts = {1: "a b c", 2: "", 3: None, 4: long, 5: " ä  ö\n\nß ", 6: "x" * 100_000, 7: "t " * 10}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("chunk", F.lit("user's"))
    got = {(r.doc_id, r.chunk): r.logits for r in SC.chunk_logits(docs, model, size=10).collect()}
    want = {(i, n): x for i, t in texts.items() for n, x in enumerate(direct(t, 10))}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    pieces = S.token_chunks(docs.where("text IS NOT NULL"), size=10).select("doc_id", "chunk")
    assert {(r.doc_id, r.chunk) for r in pieces.collect()} == {k for k in got if k[0] != 3}


def test_chunks_of_a_text_are_combined_by_inverse_variance(spark, model):
    text = " ".join(f"w{i}" for i in range(23))
    docs = spark.createDataFrame([("k", text), (None, "x"), ("e", "")], "id string, body string")
    got = {r.id: r for r in SC.score_texts(docs, model, id_col="id", text_col="body", size=10).collect()}
    pairs = []
    for logits in direct(text, 10):
        w = np.exp(logits) / np.exp(logits).sum()
        scale = np.array(S.SCALES["stars5"])
        mean = (w * scale).sum()
        pairs.append((mean, math.sqrt((w * (scale - mean) ** 2).sum())))
    weight = sum(1 / e ** 2 for _, e in pairs)
    assert got["k"].chunks == 3 and set(got) == {"k", None, "e"}
    assert got["k"].value == pytest.approx(sum(v / e ** 2 for v, e in pairs) / weight, abs=1e-8)
    assert got["k"].error == pytest.approx(math.sqrt(1 / weight), abs=1e-8)
    assert SC.score_texts(docs.where("false"), model, id_col="id", text_col="body").collect() == []


def test_a_worker_loads_a_model_once_and_takes_another_model_anew(spark, model, tmp_path):
    seen = str(tmp_path / "loads")

    def load(content):
        with open(seen, "a") as f:
            f.write("x")
        return SC.HashedLinear(content)
    docs = spark.range(0, 400).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).repartition(40)
    assert SC.chunk_logits(docs, model, load).count() == 400
    with open(seen) as f:
        assert 1 <= len(f.read()) <= 8 < 40                   # at most one a worker, not one a task
    other = SC.broadcast_model(spark, SC.write_model(spark, str(tmp_path / "m2"), SC.HashedLinear.dumps([[0] * 5])))
    assert {tuple(r.logits) for r in SC.chunk_logits(docs, other, load).collect()} == {(0.0,) * 5}


def test_model_files_beyond_the_bound_or_not_one_are_refused(spark, tmp_path):
    path = SC.write_model(spark, str(tmp_path / "m"), SC.HashedLinear.dumps(WEIGHTS))
    with pytest.raises(ValueError):
        SC.broadcast_model(spark, path, limit=10)
    spark.createDataFrame([("x",)], "value string").write.mode("append").text(path)
    with pytest.raises(ValueError):
        SC.broadcast_model(spark, path)
