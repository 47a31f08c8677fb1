"""Token counts kept as additive totals by source, language and tokenizer version.

A batch of changes (upserts with a text, deletes) becomes signed entries: a
document's former counts with a minus, its new ones with a plus; an insert has
no former ones, a delete no new ones, a revised count both. Only documents in
the batch are looked up in the ledger of entries. Entries and their totals go
into the batch's own folder, then a commit marker is written; readers use
committed batches only. A batch that is delivered again after its commit does
nothing; one that broke off before it overwrites its own folder.

Tokenizers are given as version -> column function (text -> count), counted
before anything is shuffled: texts never leave their task.

Edge cases: null text counts no tokens; null source or language is a group of
its own; changes without doc_id are ignored; of several changes to a document
in a batch the one with the largest ``seq`` counts (a delete wins a tie, then the
larger count); deleting or revising an unknown document is no error; groups
without documents leave the totals; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm.common import broadcast_if_bounded, written

GROUP = ("source", "lang", "tokenizer")
_ENTRY = "doc_id bigint, source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"
_TOTAL = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The batches below ``path``, empty if there are none yet."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], f"{schema}, batch bigint")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """(batch) of every committed batch."""
    return _stored(spark, f"{root}/commits", "done boolean").select("batch").distinct()


def _of_committed(spark: SparkSession, root: str, what: str, schema: str) -> DataFrame:
    return _stored(spark, f"{root}/{what}", schema).join(broadcast_if_bounded(committed(spark, root), 16), "batch").drop("batch")


def apply_batch(spark: SparkSession, root: str, batch: int, changes: DataFrame,
                tokenizers: dict[str, Callable[[Column], Column]]) -> bool:
    """Apply ``changes`` (seq, op 'upsert' / 'delete', doc_id, source, lang, text)
    once; False if the batch was committed before. An upsert revises the
    given tokenizers' counts, a delete takes the document out of all."""
    if not committed(spark, root).where(F.col("batch") == batch).isEmpty():
        return False
    counts = F.array(*[F.struct(F.lit(v).alias("tokenizer"), F.coalesce(count(F.col("text")), F.lit(0)).cast("bigint").alias("n_tokens"))
                       for v, count in tokenizers.items()])
    counted = changes.where("doc_id is not null").select(
        "doc_id", F.struct(F.col("seq"), (F.col("op") == "delete").alias("deleted"), F.when(F.col("op") != "delete", counts).alias("counts"),
                           "source", "lang").alias("change"))
    last = written(counted.groupBy("doc_id").agg(F.max("change").alias("change")).select("doc_id", "change.*"), "changes")
    added = (last.where("not deleted").select("doc_id", "source", "lang", F.explode("counts").alias("c"))
             .select("doc_id", "source", "lang", "c.tokenizer", F.lit(1).cast("bigint").alias("n_docs"), "c.n_tokens"))
    held = (_of_committed(spark, root, "entries", _ENTRY).join(last.select("doc_id", "deleted"), "doc_id")
            .where(F.col("deleted") | F.col("tokenizer").isin(*tokenizers)))
    former = (held.groupBy("doc_id", *GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
              .where("n_docs <> 0").select("doc_id", *GROUP, -F.col("n_docs"), -F.col("n_tokens")))
    added.union(former).write.mode("overwrite").parquet(f"{root}/entries/batch={batch}")
    entries = spark.read.schema(_ENTRY).parquet(f"{root}/entries/batch={batch}")
    (entries.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
     .write.mode("overwrite").parquet(f"{root}/totals/batch={batch}"))
    spark.range(1).select(F.lit(True).alias("done")).write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")
    return True


def totals(spark: SparkSession, root: str) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) after all committed batches."""
    return (_of_committed(spark, root, "totals", _TOTAL).groupBy(*GROUP)
            .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0"))


def pattern_counter(pattern: str) -> Callable[[Column], Column]:
    """Count of the matches of a pattern."""
    return lambda text: F.regexp_count(text, F.lit(pattern))
