"""Dashboard queries (M1-M8): sentiment and volume series per outlet.

Each function takes the news model plus user parameters (date range,
outlets, model name, keyword / article text) and returns a lazy DataFrame.
Parameters bind as literals; there is no SQL string interpolation.

Plan shape at scale: the outlet dimension is a literal relation with a
proven size bound and is broadcast; the model name resolves to result sub
ids against the fixed model relation, so it becomes a filter on the results
scan; every fact table is pruned to the join keys before the joins, the
date range filters the article scan, and the final GROUP BY runs partial
aggregation before its (tiny, per-day) shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.functions.numeric import fround
from opinio.sources.news_model import NLP_MODELS, NewsModel, date_lit

ALL_OUTLETS = ("Spiegel", "Welt", "FAZ")


@dataclass(frozen=True)
class DashboardParams:
    """Dashboard variables: ``$__timeFilter`` range (inclusive), ``$news_outlet``
    (multi-select), ``$nlp_model``, ``$comment_key_word``, ``$article_text``."""
    date_from: str = "2024-01-01"
    date_to: str = "2024-01-31"
    outlets: tuple[str, ...] = field(default=ALL_OUTLETS)
    nlp_model: str = "Ensemble"
    keyword: str = "the"
    article_text: str = "and"


def comment_keyword_match(body: Column, keyword: str) -> Column:
    """``body ILIKE '% kw%'`` -- the leading blank makes it a word-prefix
    match and misses a keyword at position 0 (kept as in the dashboards)."""
    return body.ilike(f"% {keyword}%")


def article_text_match(body: Column, text: str) -> Column:
    """``body ILIKE '%text%'``; a blank text is true for every non-null
    body and false for NULL bodies (articles without a body vanish)."""
    return body.ilike(f"%{text}%")


def time_filter(col: Column, p: DashboardParams) -> Column:
    """inclusive date range; NULL dates never pass."""
    return col.between(date_lit(p.date_from), date_lit(p.date_to))


def _articles(m: NewsModel, p: DashboardParams) -> DataFrame:
    """article_header LEFT JOIN source_header filtered on outlet: the filter
    on the dimension turns it into an inner join (EliminateOuterJoin)."""
    sh = F.broadcast(m.source_header.filter(F.col("source").isin(list(p.outlets)))
                     .select(F.col("id").alias("source_id")))
    ah = (m.article_header.filter(time_filter(F.col("source_date"), p))
          .select(F.col("id").alias("article_id"), "source_id", "source_date"))
    return ah.join(sh, "source_id", "inner")


def model_ids(name: str) -> list[int]:
    """Result sub ids of a model name in the fixed model relation."""
    return [i for i, n in NLP_MODELS if n == name]


def _model_results(m: NewsModel, p: DashboardParams, extra=()) -> DataFrame:
    """analyzer1_result of the chosen model. ``LEFT JOIN`` to the literal
    model relation filtered on its name is ``sub_id IN (ids of that name)``;
    resolving the name against the fixed relation at plan time turns it into
    a filter that reaches the results scan."""
    r = m.analyzer1_result.filter(F.col("sub_id").isin(model_ids(p.nlp_model)))
    return r.select("comment_id", "sub_id", "sentiment_value", *extra)


def _scored_comments(m: NewsModel, p: DashboardParams, *, by_keyword: bool,
                     extra=()) -> DataFrame:
    ct = m.comment
    ab = m.article_body
    if by_keyword:
        ct = ct.filter(comment_keyword_match(F.col("body"), p.keyword))
    else:
        ab = ab.filter(article_text_match(F.col("body"), p.article_text))
    ct = ct.select(F.col("id").alias("comment_id"), "article_body_id")
    ab = ab.select(F.col("id").alias("article_body_id"), "article_id")
    return (_model_results(m, p, extra)
            .join(ct, "comment_id", "inner")
            .join(ab, "article_body_id", "inner")
            .join(_articles(m, p), "article_id", "inner"))


def avg_sentiment(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M1: one number, average sentiment of comments under matching articles."""
    j = _scored_comments(m, p, by_keyword=False)
    return j.agg(fround(F.avg("sentiment_value")).alias("sentiment_simple_average"))


def daily_sentiment_by_article_text(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M2: average comment sentiment per article date, article-text filter."""
    j = _scored_comments(m, p, by_keyword=False)
    return (j.groupBy(F.col("source_date").alias("time"))
            .agg(fround(F.avg("sentiment_value")).alias("sentiment_simple_average"))
            .orderBy("time"))


def daily_sentiment(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M3 (flagship): average comment sentiment per article date for comments
    containing the keyword, one model, chosen outlets and date range."""
    j = _scored_comments(m, p, by_keyword=True)
    return (j.groupBy(F.col("source_date").alias("time"))
            .agg(fround(F.avg("sentiment_value")).alias("sentiment_simple_average"))
            .orderBy("time"))


def analysed_comments_per_day(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M8: number of distinct analysed comments per day, keyword and model."""
    j = _scored_comments(m, p, by_keyword=True)
    return (j.groupBy(F.col("source_date").alias("time"))
            .agg(F.count_distinct("comment_id").alias("n_comments"))
            .orderBy("time"))


def _articles_with_text(m: NewsModel, p: DashboardParams) -> DataFrame:
    ab = (m.article_body.filter(article_text_match(F.col("body"), p.article_text))
          .select(F.col("id").alias("article_body_id"), "article_id"))
    return _articles(m, p).join(ab, "article_id", "inner")


def _comments_of(bodies: DataFrame, m: NewsModel, how: str = "inner") -> DataFrame:
    ct = m.comment.select(F.col("id").alias("comment_id"), "article_body_id")
    return bodies.join(ct, "article_body_id", how)


def comment_count(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M4: COUNT(DISTINCT comment) over header -> body -> comment; the LEFT
    JOIN to comments only adds NULL ids, which COUNT DISTINCT ignores."""
    j = _comments_of(_articles_with_text(m, p), m)
    return j.agg(F.count_distinct("comment_id").alias("n_comments"))


def comments_per_day(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M5: distinct comments per article date (date shown as timestamp); the
    LEFT JOIN keeps days whose matching articles have no comment (count 0)."""
    j = _comments_of(_articles_with_text(m, p), m, "left")
    return (j.groupBy(F.col("source_date").cast("timestamp_ntz").alias("time"))
            .agg(F.count_distinct("comment_id").alias("n_comments"))
            .orderBy("time"))


def article_count(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M6: distinct articles having a body version that matches the text."""
    j = _articles_with_text(m, p)
    return j.agg(F.count_distinct("article_id").alias("n_articles"))


def articles_per_day(m: NewsModel, p: DashboardParams) -> DataFrame:
    """M7: distinct matching articles per article date."""
    j = _articles_with_text(m, p)
    return (j.groupBy(F.col("source_date").cast("timestamp_ntz").alias("time"))
            .agg(F.count_distinct("article_id").alias("n_articles"))
            .orderBy("time"))


def outlet_choices(m: NewsModel) -> DataFrame:
    """the outlet variable's choices."""
    return m.source_header.select("source")


def model_choices(m: NewsModel) -> DataFrame:
    """The literal model relation, as offered to the user."""
    return m.nlp_models.select("nlp_model")


def daily_sentiment_weighted(m: NewsModel, p: DashboardParams) -> DataFrame:
    """The flagship series with the inverse-variance weighted mean
    (the reference keeps this column commented out in the panel)."""
    from opinio.plans.marts import weighted_mean
    j = _scored_comments(m, p, by_keyword=True, extra=("error_value",))
    return (j.groupBy(F.col("source_date").alias("time"))
            .agg(fround(weighted_mean(F.col("sentiment_value"), F.col("error_value")))
                 .alias("sentiment_error_weighted"))
            .orderBy("time"))
