"""Batch model scoring of whole texts (N3) with a model read from a file.

The model file is read by Spark from the shared folder, checked against ``MODEL_BYTES`` and
broadcast once; a Python worker loads it at its first batch and keeps it for all later tasks of
that broadcast. Texts come as an iterator of Arrow batches, are cut into chunks of ``size`` tokens
inside the batch and scored ``CHUNKS_A_CALL`` chunks a call, so what a worker holds beside one
batch of texts does not grow with the number of chunks; no token array ever leaves the worker
or stands in a row. Outgoing rows are (id, chunk, logits).

Cases: a null text counts as an empty one, which is one chunk with one empty token; tokens are what
``\\s+`` of ASCII blanks separates (leading and trailing blanks give empty tokens, as in
``token_chunks``); rows of equal ids are scored row by row and combined like chunks of one text; no rows
give no rows; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from opinio.functions.numeric import fround
from opinio.operators.sentiment import CHUNK_TOKENS, inverse_variance, logits_to_sentiment
from opinio.session import ensure_parallelism

MODEL_BYTES = 256 << 20    # largest model file that is broadcast
CHUNKS_A_CALL = 64         # chunks handed to a model at once

#: ``scorer(chunks: list of token lists) -> logits [len(chunks), classes]``
Scorer = Callable[[list[list[str]]], np.ndarray]
_BLANKS = re.compile("[ \t\n\x0b\f\r]+")


class HashedLinear:
    """A linear model over hashed tokens: the logits of a chunk are the mean of its tokens'
    weights. File: JSON with ``weights``, one row of integers (thousandths) a hash bucket; a token's bucket is
    the first four hex digits of its MD5 modulo the number of rows."""

    def __init__(self, content: bytes):
        self.weights = np.asarray(json.loads(content)["weights"], dtype=np.int64)

    @staticmethod
    def dumps(weights: list[list[int]]) -> str:
        return json.dumps({"weights": weights})

    def __call__(self, chunks: list[list[str]]) -> np.ndarray:
        codes, words = pd.factorize(np.array([t for c in chunks for t in c], dtype=object))
        rows = np.array([int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % len(self.weights) for w in words])
        sizes = np.array([len(c) for c in chunks])
        sums = np.add.reduceat(self.weights[rows[codes]], np.cumsum(sizes) - sizes, axis=0)
        return sums / 1000.0 / sizes[:, None]


def write_model(spark: SparkSession, path: str, content: str) -> str:
    """One line of text as a model file below ``path`` (a shared folder)."""
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(path)
    return path


@dataclass(frozen=True)
class Model:
    """A broadcast model file; ``version`` names it in the workers."""
    version: str
    content: Broadcast[bytes]


def broadcast_model(spark: SparkSession, path: str, limit: int = MODEL_BYTES) -> Model:
    """The one file below ``path``, broadcast; its size is read before its content."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    sizes = [r["length"] for r in files.select("length").take(2)]
    if len(sizes) != 1 or sizes[0] > limit:
        raise ValueError(f"{path}: expected one model file of at most {limit} bytes, found lengths {sizes}")
    return Model(uuid.uuid4().hex, spark.sparkContext.broadcast(bytes(files.select("content").first()["content"])))


_LOADED: dict[tuple[str, str], Scorer] = {}    # of this Python worker; the newest model only


def _loaded(model: Model, load: Callable[[bytes], Scorer]) -> Scorer:
    which = (model.version, load.__qualname__)
    if which not in _LOADED:
        _LOADED.clear()
        _LOADED[which] = load(model.content.value)
    return _LOADED[which]


def chunk_logits(docs: DataFrame, model: Model, load: Callable[[bytes], Scorer] = HashedLinear,
                 id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_TOKENS) -> DataFrame:
    """(id, chunk, logits): every chunk of ``size`` tokens of every text, scored by the model."""
    docs = ensure_parallelism(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")))
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("chunk", IntegerType()),
                         StructField("logits", ArrayType(DoubleType()))])

    def rows(held: list, scorer: Scorer) -> pd.DataFrame:
        logits = scorer([c for _, _, c in held])
        return pd.DataFrame({id_col: pd.Series([i for i, _, _ in held], dtype=object),
                             "chunk": [n for _, n, _ in held], "logits": list(np.asarray(logits, dtype=float))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _loaded(model, load)
        for batch in batches:
            held = []
            for key, text in zip(batch[id_col], batch["_text"]):
                tokens = _BLANKS.split(text)
                for n, start in enumerate(range(0, len(tokens), size)):
                    held.append((key, n, tokens[start:start + size]))
                    if len(held) == CHUNKS_A_CALL:
                        yield rows(held, scorer)
                        held = []
            if held:
                yield rows(held, scorer)
    return docs.mapInPandas(run, schema)


def score_texts(docs: DataFrame, model: Model, load: Callable[[bytes], Scorer] = HashedLinear,
                scale: str = "stars5", id_col: str = "doc_id", text_col: str = "text",
                size: int = CHUNK_TOKENS) -> DataFrame:
    """N3-N5 for one model: (id, chunks, value, error), chunks combined by inverse variance."""
    value, error = logits_to_sentiment(F.col("logits"), scale)
    scored = chunk_logits(docs, model, load, id_col, text_col, size).select(id_col, value.alias("_v"), error.alias("_e"))
    v, e = inverse_variance(F.col("_v"), F.col("_e"))
    return scored.groupBy(id_col).agg(F.count(F.lit(1)).alias("chunks"), fround(v).alias("value"), fround(e).alias("error"))
