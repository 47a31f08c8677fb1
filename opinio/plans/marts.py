"""Reporting marts and ad-hoc analyst queries.

All functions are ``NewsModel (+ params) -> DataFrame``. Scalar reports that
the reference assembles from one-row CTEs joined on a constant are built
without a cross join: tagged one-row aggregates are unioned and folded by a
single global aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.functions.dates import calendar_columns
from opinio.functions.numeric import fround
from opinio.plans.dashboards import comment_keyword_match
from opinio.sources.news_model import NewsModel, date_lit


def fold_scalars(parts: dict[str, DataFrame]) -> DataFrame:
    """Combine one-row, one-column count aggregates into a single row without
    a cross join: union ``(name, n)`` rows, then pivot by conditional max."""
    rows = None
    for name, df in parts.items():
        r = df.select(F.lit(name).alias("k"), F.col(df.columns[0]).cast("bigint").alias("n"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in parts])


def database_statistics(m: NewsModel) -> DataFrame:
    """M9: four table counts in one row (analysed = ensemble results)."""
    parts = {
        "n_article_headers": m.article_header.agg(F.count("id")),
        "n_article_bodies": m.article_body.agg(F.count("id")),
        "n_comments": m.comment.agg(F.count("id")),
        "n_analyzed_comments": m.analyzer1_result.filter(F.col("sub_id") == 1).agg(F.count("id")),
    }
    return fold_scalars(parts)


def pct_comments_analysed(m: NewsModel) -> DataFrame:
    """Share of comments with an ensemble result, in percent, 2 decimals.
    Zero comments gives NULL instead of the reference's division error."""
    s = database_statistics(m)
    return s.select(F.round(F.try_divide(F.col("n_analyzed_comments"), F.col("n_comments")) * 100, 2)
                    .alias("pct_comments_analyzed"))


def _hdr_body_comment(m: NewsModel) -> DataFrame:
    ah = m.article_header.select(F.col("id").alias("article_id"), "url", "source_id", "source_date")
    ab = m.article_body.select(F.col("id").alias("article_body_id"), "article_id")
    ct = m.comment.select(F.col("id").alias("comment_id"), "article_body_id", F.col("body").alias("comment_body"))
    return ct.join(ab, "article_body_id", "inner").join(ah, "article_id", "inner")


def comments_per_date(m: NewsModel) -> DataFrame:
    """Comments per article publication date (plain count, inner joins)."""
    j = _hdr_body_comment(m)
    return (j.groupBy(F.col("source_date").alias("article_date"))
            .agg(F.count("comment_id").alias("n_comments")).orderBy("article_date"))


def data_by_source(m: NewsModel) -> DataFrame:
    """Distinct comments and distinct commented articles per source."""
    j = _hdr_body_comment(m)
    return (j.groupBy("source_id")
            .agg(F.count_distinct("comment_id").alias("count_comments"),
                 F.count_distinct("article_id").alias("count_articles")))


def weighted_mean(value: Column, error: Column) -> Column:
    """Inverse-variance weighted mean ``sum(v/e^2)/sum(1/e^2)``;
    zero errors are excluded from both sums (ANSI-safe via NULLIF)."""
    e2 = F.nullif(error * error, F.lit(0.0))
    return F.try_divide(F.sum(value / e2), F.sum(F.lit(1.0) / e2))


def sentiment_by_created_date(m: NewsModel, keyword: str, sub_id: int | None = None) -> DataFrame:
    """Weighted and simple mean sentiment plus count per comment creation
    date for comments containing the keyword. As in the reference, no model
    filter by default (count = comments x models); ``sub_id`` narrows it."""
    r = m.analyzer1_result.select("comment_id", "sub_id", "sentiment_value", "error_value")
    if sub_id is not None:
        r = r.filter(F.col("sub_id") == sub_id)
    ct = (m.comment.filter(comment_keyword_match(F.col("body"), keyword))
          .select(F.col("id").alias("comment_id"), "date_created"))
    j = r.join(ct, "comment_id", "inner")
    return (j.groupBy(F.col("date_created").alias("date"))
            .agg(fround(weighted_mean(F.col("sentiment_value"), F.col("error_value")))
                 .alias("sentiment_error_weighted"),
                 fround(F.avg("sentiment_value")).alias("sentiment_simple_average"),
                 F.count("comment_id").alias("count_comments"))
            .orderBy(F.col("date").desc()))


def obsolete_share(m: NewsModel, source_id: int = 3) -> DataFrame:
    """Share of obsolete articles of one source."""
    ah = m.article_header.filter(F.col("source_id") == source_id)
    return ah.agg(fround(F.sum(F.when(F.col("obsolete"), 1).otherwise(0)) /
                         F.count("obsolete")).alias("share_obsolete"))


def comment_duplicates(m: NewsModel) -> DataFrame:
    """(url, comment body) groups holding more than one comment id. Groups
    are keyed by the body's SHA-256 instead of the body. The joins follow
    primary keys, so a comment is one row and plain counts are distinct
    counts; articles are counted by a second step over (url, hash, article)."""
    j = _hdr_body_comment(m).withColumn("_h", F.sha2("comment_body", 256))
    per_article = j.groupBy("url", "_h", "article_id").agg(F.count(F.lit(1)).alias("n"),
                                                           F.first("comment_body").alias("body"))
    return (per_article.groupBy("url", "_h")
            .agg(F.first("body").alias("body"), F.sum("n").alias("comment_count"),
                 F.count(F.lit(1)).alias("hdr_count"))
            .filter(F.col("comment_count") > 1)
            .select("url", "body", "comment_count", "hdr_count")
            .orderBy(F.col("comment_count").desc()))


def unanimous_positive(m: NewsModel, threshold: float = 0.5, max_sub_id: int = 4) -> DataFrame:
    """Comments whose every model score exceeds the threshold."""
    per = (m.analyzer1_result.filter(F.col("sub_id") < max_sub_id)
           .groupBy("comment_id")
           .agg(F.avg("sentiment_value").alias("avg_sent"), F.min("sentiment_value").alias("min_sent"))
           .filter(F.col("min_sent") > threshold))
    ct = m.comment.select(F.col("id").alias("comment_id"), "body")
    return (per.join(ct, "comment_id", "inner")
            .select("comment_id", fround(F.col("avg_sent")).alias("avg_sent"), "body")
            .orderBy(F.col("avg_sent").desc()))


def article_date_bound(m: NewsModel, latest: bool) -> DataFrame:
    """O2: earliest / latest article date as ``dd-MM-yyyy``. NULL dates are
    ignored (the reference's DESC LIMIT 1 would return a NULL first)."""
    agg = F.max("source_date") if latest else F.min("source_date")
    name = "latest_date" if latest else "earliest_date"
    return m.article_header.agg(F.date_format(agg, "dd-MM-yyyy").alias(name))


def article_header_current(m: NewsModel) -> DataFrame:
    """non-obsolete articles with their source and source type (the two
    dimensions are fixed literal relations, so their broadcast is bounded)."""
    sth = F.broadcast(m.source_type_header.select(F.col("id").alias("type_id"),
                                                  F.col("type").alias("src_type")))
    sh = F.broadcast(m.source_header.select(F.col("id").alias("src_id"), F.col("type").alias("type_id"),
                                            F.col("source").alias("src_name")))
    ah = m.article_header.filter(~F.col("obsolete"))
    return (ah.join(sh, ah.source_id == sh.src_id, "inner").join(sth, "type_id", "inner")
            .select("src_type", "src_name", "src_id", F.col("id").alias("article_id"),
                    "url", "source_date", "obsolete"))


def article_body_last(m: NewsModel) -> DataFrame:
    """The latest body version per article (highest id): ``max(id)``
    per article (hash aggregation over ids only) and a semi-join of the
    bodies on that id. (``max_by`` over a struct holding the text would fall
    back to a sort aggregation of whole bodies.)"""
    ab = m.article_body
    last = m.article_body_last_id.select(F.col("last_article_body_id").alias("_last"))
    return ab.join(last, ab.id == last._last, "left_semi")


def fact_dates(m: NewsModel) -> DataFrame:
    """All dates the news facts refer to (article dates, comment dates,
    body processing days)."""
    return (m.article_header.select(F.col("source_date").alias("d"))
            .unionByName(m.comment.select(F.col("date_created").alias("d")))
            .unionByName(m.article_body.select(F.col("proc_timestamp").cast("date").alias("d")))
            .filter(F.col("d").isNotNull()))


def calendar_for_facts(m: NewsModel) -> DataFrame:
    """The 25-column calendar dimension over the span of fact dates
    (min..max). The span is generated by ``sequence`` from a one-row
    aggregate and exploded: size = number of days, independent of rows."""
    span = fact_dates(m).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.select(*calendar_columns(F.col("date")))


def date_range_lookup(m: NewsModel, start: str, end: str) -> DataFrame:
    """Dates of the calendar between two dates (inclusive)."""
    cal = calendar_for_facts(m)
    return cal.filter(F.col("date").between(date_lit(start), date_lit(end))).select("date")


def topics_by_source(m: NewsModel, topic_results: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Distinct (source, detector, lemma) triples over five relations;
    source and detector are fixed literal relations (bounded broadcasts), the
    lemma table joins like a fact."""
    ah = m.article_header.select(F.col("id").alias("article_header_id"), F.col("source_id").alias("article_source_id"))
    sh = F.broadcast(m.source_header.select(F.col("id").alias("article_source_id"),
                                            F.col("source").alias("article_source")))
    tdh = F.broadcast(m.topic_detector_header.select(F.col("id").alias("topic_detector_id"), "topic_detector"))
    lh = lemmas.select(F.col("id").alias("lemma_id"), "lemma")
    j = (topic_results.select("article_header_id", "topic_detector_id", "lemma_id")
         .join(ah, "article_header_id", "inner").join(lh, "lemma_id", "inner")
         .join(sh, "article_source_id", "inner").join(tdh, "topic_detector_id", "inner"))
    return j.select("article_source_id", "article_source", "topic_detector_id", "topic_detector",
                    "lemma_id", "lemma").distinct()


def lemma_month_doc_count(m: NewsModel, topic_results: DataFrame) -> DataFrame:
    """Documents per lemma and publication month (the doc_count table
    the reference declares with UNIQUE(lemma, month) but never fills)."""
    ah = m.article_header.select(F.col("id").alias("article_header_id"), "source_date")
    j = topic_results.join(ah, "article_header_id", "inner").filter(F.col("source_date").isNotNull())
    return (j.groupBy("lemma_id", F.trunc("source_date", "month").alias("mth_published"))
            .agg(F.count_distinct("article_header_id").alias("doc_count")))
