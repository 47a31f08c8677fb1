"""Corpus pipeline over ``documents``: language ID, SimHash near-dedup,
benchmark decontamination, masking of personal data, byte-level BPE.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents. Stage results on nulls,
empty texts, repeated rows and empty tables are those of their operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm import decontam, langid, pii, simhash
from opinio.llm.common import free_name, is_training
from opinio.llm.queries import encoded_digests, vocabulary
from opinio.session import scratch_path

#: A text goes if its language knows less than this share of its n-grams.
MIN_LANGUAGE_SCORE = 0.25
SHINGLE = 3
MAX_BITS = 3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters or in none of the learned languages."""
    model = langid.train(docs.where(is_training(F.col("doc_id"))))
    out = free_name(docs, "_language")
    found = langid.identify(docs, model, out=out)
    keep = (F.col(f"{out}.lang_pred") != langid.UNDETERMINED) & (F.col(f"{out}.score") >= MIN_LANGUAGE_SCORE)
    return found.where(keep).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that with the smallest id."""
    return simhash.keep_one(docs, shingle=SHINGLE, max_bits=MAX_BITS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more is benchmark text."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data; ``n_chars`` follows the text."""
    return pii.mask(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encoded_digests(docs, vocabulary())


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("decontaminate", decontaminate),
          ("mask_pii", mask_pii), ("byte_bpe", byte_bpe)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch_path(spark, f"llm-pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{name}")
    return docs
