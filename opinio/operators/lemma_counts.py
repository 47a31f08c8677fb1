"""Incremental distinct counts: documents per lemma and publication month (M18 kept on T10).

The full count groups every topic result at every run. Here two stored tables (``RunStore``) are kept:

* ``support`` (article_header_id, lemma_id, mth_published, n): how many live topic results an article has
  for a lemma, with the article's month; bucketed by article, as runs and re-dated articles come by article.
  One row more per dated article, without a lemma and with n = 0, keeps its month;
* ``counts`` (lemma_id, mth_published, doc_count), bucketed by lemma.

A run brings signed topic results and the dates of articles. A count changes only where the support of
an (article, lemma) comes, goes or changes its month, so a run reads and rewrites the buckets of its
articles and of their lemmas. The changes of a lemma are summed map-side: a lemma of a third of
all articles is one row a task and month in the exchange.

Cases: results repeated within a run or over runs add up and count an article once; removals beyond what
is there leave nothing (never below zero); an article without a date, or dated null, is kept
in ``support`` and counted in no month until it is dated; an article may be dated before its first
result; of several dates of an article in a run the latest holds; results without article
or lemma are skipped; empty inputs are a run without changes; a repeated run does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StructField, StructType

from opinio.session import write_once
from opinio.sources.runs import Change, RunStore, Table

_SUPPORT = StructType([StructField("article_header_id", LongType()), StructField("lemma_id", LongType()),
                       StructField("mth_published", DateType()), StructField("n", LongType())])
_COUNTS = StructType([StructField("lemma_id", LongType()), StructField("mth_published", DateType()),
                      StructField("doc_count", LongType())])


class LemmaMonthCounts:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark = spark
        self.store = RunStore(spark, root, [Table("support", "article_header_id", _SUPPORT, buckets),
                                            Table("counts", "lemma_id", _COUNTS, buckets)])

    def counts(self) -> DataFrame:
        """(lemma_id, mth_published, doc_count) as of the newest complete run."""
        return self.store.read("counts")

    def apply(self, run: int, results: DataFrame, dates: DataFrame) -> bool:
        """One run: ``results`` (article_header_id, lemma_id, sign), sign +1 for an added and -1 for a
        removed topic result, and ``dates`` (article_header_id, source_date) of new and re-dated
        articles. False, and nothing is done, if the run is complete."""
        if self.store.is_complete(run):
            return False
        signed = write_once(
            results.where("article_header_id IS NOT NULL AND lemma_id IS NOT NULL")
            .groupBy(F.col("article_header_id").cast("bigint").alias("article_header_id"),
                     F.col("lemma_id").cast("bigint").alias("lemma_id"))
            .agg(F.sum("sign").cast("bigint").alias("plus")), "signed-results")
        dated = write_once(
            dates.where("article_header_id IS NOT NULL")
            .groupBy(F.col("article_header_id").cast("bigint").alias("article_header_id"))
            .agg(F.trunc(F.max("source_date"), "month").alias("new_month")), "run-dates")
        articles = write_once(signed.select("article_header_id").unionByName(dated.select("article_header_id")).distinct(),
                              "run-articles")
        moved: list[DataFrame] = []

        def support_change() -> Change:
            def next_rows(stored: DataFrame) -> DataFrame:
                moved.append(write_once(_moved(stored.join(articles, "article_header_id", "left_semi"), signed, dated), "moved"))
                live = moved[0].where("n > 0 OR (lemma_id IS NULL AND month IS NOT NULL)").select("article_header_id", "lemma_id", F.col("month").alias("mth_published"), "n")
                return stored.join(articles, "article_header_id", "left_anti").select(*_SUPPORT.names).unionByName(live)
            return Change(articles, next_rows)

        def counts_change() -> Change:
            if not moved:   # no article in this run
                return Change(signed.select("lemma_id"), lambda stored: stored)
            gone = moved[0].where("old_n > 0 AND old_month IS NOT NULL").select(
                "lemma_id", F.col("old_month").alias("mth_published"), F.lit(-1).alias("d"))
            come = moved[0].where("n > 0 AND month IS NOT NULL").select(
                "lemma_id", F.col("month").alias("mth_published"), F.lit(1).alias("d"))
            delta = write_once(gone.unionByName(come).groupBy("lemma_id", "mth_published")
                               .agg(F.sum("d").alias("doc_count")).where("doc_count <> 0"), "count-deltas")
            return Change(delta.select("lemma_id"), lambda stored: (
                stored.unionByName(delta).groupBy("lemma_id", "mth_published")
                .agg(F.sum("doc_count").alias("doc_count")).where("doc_count > 0")))

        return self.store.commit(run, {"support": support_change, "counts": counts_change})


def _moved(held: DataFrame, signed: DataFrame, dated: DataFrame) -> DataFrame:
    """(article_header_id, lemma_id, old_n, old_month, n, month) of every supported or signed pair of the
    run's articles, and of their month rows. An article's month is that of the run's date, else the stored one."""
    month_of = (held.where("lemma_id IS NULL").select("article_header_id", F.col("mth_published").alias("stored_month"))
                .join(dated.withColumn("has_date", F.lit(True)), "article_header_id", "full")
                .select("article_header_id", F.when(F.col("has_date"), F.col("new_month"))
                        .otherwise(F.col("stored_month")).alias("month")))
    pairs = (held.where("lemma_id IS NOT NULL")
             .select("article_header_id", "lemma_id", F.col("n").alias("old_n"), F.col("mth_published").alias("old_month"))
             .join(signed, ["article_header_id", "lemma_id"], "full").join(month_of, "article_header_id", "left"))
    old, none = F.coalesce("old_n", F.lit(0)).cast("bigint"), F.lit(0).cast("bigint")
    moved = pairs.select("article_header_id", "lemma_id", old.alias("old_n"), "old_month",
                         F.greatest(old + F.coalesce("plus", F.lit(0)), none).alias("n"), "month")
    return moved.unionByName(month_of.select("article_header_id", F.lit(None).cast("bigint").alias("lemma_id"),
                                             none.alias("old_n"), F.lit(None).cast("date").alias("old_month"),
                                             none.alias("n"), "month"))
