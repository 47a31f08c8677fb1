"""Registered streaming queries (R1-R4): final state compared with batch SQL.

Each query stages its input (derived from the driver tables) as files in a
fresh folder below the shared checkpoint directory, runs the stream to
completion (``availableNow``) and returns the sink's final state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.operators import control as C
from opinio.plans.registered.ingest import incoming_comments
from opinio.plans.registered.text import LEX_SQL, clean_sql, lexicon
from opinio.plans.registry import query
from opinio.session import write_once
from opinio.sources.news_model import NewsModel, ts_ntz
from opinio.streaming import jobs as J


def _m(spark, sf):
    return NewsModel(spark, sf)


@query("stream_score_comments", f"""
WITH lex AS {LEX_SQL},
tok AS (SELECT id, unnest(regexp_split_to_array(body, '\\s+')) AS w FROM comment),
hits AS (SELECT t.id, l.score FROM tok t JOIN lex l ON l.word = {clean_sql('t.w')}),
agg AS (SELECT id, avg(score) AS m, stddev_pop(score) AS sd, count(*) AS n FROM hits GROUP BY id)
SELECT c.id, CASE WHEN a.n IS NULL THEN 0.0 ELSE round(a.m, 9) END AS value,
       CASE WHEN a.n IS NULL THEN 1.0 ELSE round(a.sd, 9) END AS error,
       CAST(coalesce(a.n, 0) AS INT) AS hits, CAST(len(regexp_split_to_array(c.body, '\\s+')) AS INT) AS n_tokens
FROM comment c LEFT JOIN agg a ON a.id = c.id""")
def q_stream_score_comments(spark, sf):
    """Comments arrive as files, scored per micro-batch by the lexicon
    model."""
    m = _m(spark, sf)
    base = J.new_stream_dir(spark, "score")
    J.stage_files(m.comment.select("id", "body"), f"{base}/in")
    return J.stream_score_comments(spark, f"{base}/in", "id long, body string", lexicon(spark),
                                   f"{base}/out", f"{base}/ckpt")


@query("stream_dedup_comments", """
SELECT external_id, article_body_id, level, body, proc_timestamp AS event_ts FROM incoming_comments
QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY pos % 2, proc_timestamp, article_body_id, level, body) = 1""")
def q_stream_dedup_comments(spark, sf):
    """R2: incoming comments in two polls (each comment comes again, one minute
    later, in the second), inserted once per external id."""
    m = _m(spark, sf)
    base = J.new_stream_dir(spark, "dedup")
    inc = incoming_comments(m).select("external_id", "article_body_id", "level", "body",
                                      F.col("proc_timestamp").alias("event_ts"), (F.col("pos") % 2).alias("_poll"))
    schema = "external_id long, article_body_id long, level int, body string, event_ts timestamp_ntz"
    out = None
    for poll in (0, 1):
        J.stage_files(inc.filter(F.col("_poll") == poll).drop("_poll"), f"{base}/in")
        out = J.stream_dedup_comments(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ckpt")
    return out.select("external_id", "article_body_id", "level", "body", "event_ts")


@query("stream_daily_sentiment", """
SELECT c.date_created AS day, round(avg(r.sentiment_value), 9) AS avg_sentiment, count(*) AS n_comments
FROM analyzer1_result r JOIN comment c ON c.id = r.comment_id
WHERE r.sub_id = 1 AND c.date_created IS NOT NULL GROUP BY c.date_created""")
def q_stream_daily_sentiment(spark, sf):
    """Ensemble results stream in, any file in any order, and are
    aggregated per day of creation."""
    m = _m(spark, sf)
    base = J.new_stream_dir(spark, "daily")
    r = m.analyzer1_result.filter(F.col("sub_id") == 1).select("comment_id", "sentiment_value")
    c = m.comment.filter(F.col("date_created").isNotNull()).select(
        F.col("id").alias("comment_id"), "date_created", J.day_event_time(F.col("date_created")).alias("ts"))
    J.stage_files(r.join(c, "comment_id", "inner").drop("date_created"), f"{base}/in")
    schema = "comment_id long, sentiment_value double, ts timestamp"
    return J.stream_daily_sentiment(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ckpt")


@query("stream_daily_window", """
SELECT c.date_created AS day, round(avg(r.sentiment_value), 9) AS avg_sentiment, count(*) AS n_comments
FROM analyzer1_result r JOIN comment c ON c.id = r.comment_id
WHERE r.sub_id = 1 AND c.date_created IS NOT NULL GROUP BY c.date_created""")
def q_stream_daily_window(spark, sf):
    """Ensemble results arrive in four polls by day of creation; every
    fifth comment comes in the last poll, most of them beyond the watermark."""
    m = _m(spark, sf)
    base = J.new_stream_dir(spark, "window")
    r = m.analyzer1_result.filter(F.col("sub_id") == 1).select("comment_id", "sentiment_value")
    c = m.comment.filter(F.col("date_created").isNotNull()).select(
        F.col("id").alias("comment_id"), "date_created", J.day_event_time(F.col("date_created")).alias("ts"))
    poll = F.when(F.col("comment_id") % 5 == 1, 3).otherwise(F.least(F.floor((F.dayofmonth("date_created") - 1) / 10), F.lit(2)))
    rows = write_once(r.join(c, "comment_id", "inner").select("comment_id", "sentiment_value", "ts", poll.alias("poll")), "polls")
    out = None
    for n in range(4):
        J.stage_files(rows.where(F.col("poll") == n).drop("poll"), f"{base}/in")
        out = J.stream_daily_window(spark, f"{base}/in", "comment_id long, sentiment_value double, ts timestamp", f"{base}/out",
                                    f"{base}/ckpt")
    return out


def revisit_rows(m: NewsModel, after: str | None, as_of: str) -> DataFrame:
    """What a poll at ``as_of`` brings: all articles (first poll), the bodies processed
    since the last poll, and a row that only moves the clock."""
    clock = F.lit(as_of).cast("timestamp_ntz").cast("timestamp") + F.expr("INTERVAL 1 HOUR")
    ms = lambda ts: F.unix_millis(ts.cast("timestamp"))
    none = F.lit(None)
    rows = m.spark.range(1).select(none.cast("long").alias("article_id"), none.cast("boolean").alias("obsolete"),
                                   none.cast("long").alias("article_body_id"), none.cast("long").alias("proc_ms"),
                                   none.cast("int").alias("proc_counter"), clock.alias("clock"))
    bodies = m.article_body.where(F.col("proc_timestamp") <= ts_ntz(as_of))
    if after is None:
        rows = rows.unionByName(m.article_header.select(F.col("id").alias("article_id"), "obsolete", clock.alias("clock")),
                                allowMissingColumns=True)
    else:
        bodies = bodies.where(F.col("proc_timestamp") > ts_ntz(after))
    visits = bodies.select("article_id", F.lit(False).alias("obsolete"), F.col("id").alias("article_body_id"),
                           ms(F.col("proc_timestamp")).alias("proc_ms"), "proc_counter", clock.alias("clock"))
    return rows.unionByName(visits)


@query("stream_revisit", f"""
WITH newest AS (SELECT * FROM article_body QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY id DESC) = 1)
SELECT a.id AS article_id, newest.id AS article_body_id,
       CASE WHEN newest.id IS NULL THEN 'missing_body' ELSE 'review_now' END AS status
FROM article_header a LEFT JOIN newest ON newest.article_id = a.id
WHERE NOT a.obsolete AND (newest.id IS NULL OR (newest.proc_counter < {C.MAX_REVISITS}
  AND newest.proc_timestamp + to_hours(CAST(power(2, newest.proc_counter) AS BIGINT) - 1) < TIMESTAMP '{C.AS_OF}'))""")
def q_stream_revisit(spark, sf):
    """Articles and their visits in three polls; what is due at the last one."""
    m = _m(spark, sf)
    base = J.new_stream_dir(spark, "revisit")
    after = out = None
    for as_of in ("2024-01-11 00:00:00", "2024-01-21 00:00:00", C.AS_OF):
        J.stage_files(revisit_rows(m, after, as_of), f"{base}/in")
        out = J.stream_revisit(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt")
        after = as_of
    return out.where(F.col("status").isin("missing_body", "review_now")).select("article_id", "article_body_id", "status")
