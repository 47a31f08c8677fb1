"""Registered control queries (T, G9-G11, O3, J5) with their oracles."""

from __future__ import annotations

import uuid

from opinio.operators import control as C
from opinio.operators.lemma_counts import LemmaMonthCounts
from opinio.plans.oracle_model import register_cte
from opinio.plans.registry import query
from pyspark.sql import functions as F
from opinio.session import scratch_path, write_once
from opinio.sources.news_model import NewsModel

AS_OF = f"TIMESTAMP '{C.AS_OF}'"
TODAY = f"CAST({AS_OF} AS DATE)"
LEMMA_ID = "CAST(CAST(('0x' || substr(md5({x}), 1, 15)) AS UBIGINT) AS BIGINT)"

# control-table seeds (derived from the model, see SURVEY 7.3)
register_cte("crawl_dates_proc",
             "SELECT DISTINCT source_id, source_date AS date_processed FROM article_header "
             "WHERE source_date < DATE '2024-01-15'")
register_cte("lemma_header",
             f"SELECT {LEMMA_ID.format(x='lemma')} AS id, lemma FROM (SELECT DISTINCT substr(lower(uv.udf_value), 1, 30) "
             "AS lemma FROM udf_values uv JOIN article_body ab ON uv.object_id = ab.id "
             "WHERE uv.object_type = 1 AND uv.udf_id = 2) t WHERE right(lemma, 1) IN ('0','2','4','6','8')")
_TOPICS = ("SELECT DISTINCT latest.article_id AS article_header_id, 1 AS topic_detector_id, known.id AS lemma_id, "
           f"{TODAY} AS run_date FROM udf_values label "
           "JOIN article_body_last_id latest ON latest.last_article_body_id = label.object_id "
           "JOIN {lemmas} known ON known.lemma = substr(lower(label.udf_value), 1, 30) "
           "WHERE label.object_type = 1 AND label.udf_id = 2 AND {cond}")
register_cte("topic_detector_result", _TOPICS.format(
    lemmas="lemma_header", cond="latest.article_id * 10 <= 9 * (SELECT max(article_id) FROM article_body_last_id)"))
# every label lemma, and the topic results of all articles
register_cte("label_lemma",
             f"SELECT DISTINCT {LEMMA_ID.format(x='substr(lower(udf_value), 1, 30)')} AS id, "
             "substr(lower(udf_value), 1, 30) AS lemma FROM udf_values "
             "WHERE object_type = 1 AND udf_id = 2 AND object_id IN (SELECT id FROM article_body)")
register_cte("label_topic", _TOPICS.format(lemmas="label_lemma", cond="true"))


def _m(spark, sf):
    return NewsModel(spark, sf)


@query("todo_crawl", f"""
WITH live AS (
  SELECT kind.type AS src_type, outlet.source AS src_name, outlet.id AS src_id, a.id AS article_id, a.url,
         a.source_date, a.obsolete
  FROM article_header a JOIN source_header outlet ON outlet.id = a.source_id
  JOIN source_type_header kind ON kind.id = outlet.type WHERE NOT a.obsolete),
newest AS (SELECT * FROM article_body QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY id DESC) = 1),
visit AS (SELECT live.*, n.id AS article_body_id, n.headline, n.body, n.proc_timestamp, n.proc_counter,
                 CAST(power(2, n.proc_counter) AS BIGINT) AS pause
          FROM live LEFT JOIN newest n ON n.article_id = live.article_id)
SELECT * EXCLUDE (pause), coalesce(CAST(pause AS DOUBLE), 0.0e0) AS review_hours,
       CASE WHEN article_body_id IS NULL THEN {AS_OF} - INTERVAL 1 HOUR ELSE proc_timestamp + to_hours(pause) END AS next_review,
       CASE WHEN article_body_id IS NULL THEN 'missing_body' ELSE 'review_now' END AS status
FROM visit
WHERE article_body_id IS NULL OR (proc_counter < {C.MAX_REVISITS} AND proc_timestamp + to_hours(pause - 1) < {AS_OF})""")
def q_todo_crawl(spark, sf):
    return C.todo_crawl(_m(spark, sf))


_NO_RUN = ("CAST(NULL AS INT) AS analyzer_id, CAST(NULL AS TIMESTAMP) AS start_timestamp, "
           "CAST(NULL AS TIMESTAMP) AS end_timestamp, CAST(NULL AS BOOLEAN) AS success, 'new' AS status")
_NEVER_RUN = "NOT EXISTS (FROM analyzer_log run WHERE run.comment_id = todo.comment_id)"
_OPEN_RUNS = ("SELECT todo.*, run.analyzer_id, run.start_timestamp, run.end_timestamp, run.success, 're-run' AS status "
              "FROM todo JOIN analyzer_log run USING (comment_id) WHERE run.analyzer_id = 1 AND run.end_timestamp IS NULL")


@query("todo_analyzer_v1", f"""
WITH todo AS (SELECT id AS comment_id, level AS comment_level, body AS comment_body FROM comment)
SELECT todo.*, {_NO_RUN} FROM todo WHERE {_NEVER_RUN} UNION ALL {_OPEN_RUNS}""")
def q_todo_analyzer_v1(spark, sf):
    return C.todo_analyzer_v1(_m(spark, sf))


@query("todo_analyzer_v2", f"""
WITH dated AS (SELECT b.id AS article_body_id, a.source_date FROM article_header a JOIN article_body b ON b.article_id = a.id),
todo AS (SELECT id AS comment_id, level AS comment_level, body AS comment_body, source_date
         FROM comment JOIN dated USING (article_body_id))
SELECT todo.*, {_NO_RUN} FROM todo WHERE {_NEVER_RUN} UNION ALL {_OPEN_RUNS}""")
def q_todo_analyzer_v2(spark, sf):
    return C.todo_analyzer_v2(_m(spark, sf))


_TODO3 = f"""
SELECT todo.*, {_NO_RUN}
FROM (SELECT id AS comment_id, level AS comment_level, body AS comment_body, date_created AS source_date
      FROM comment WHERE date_created IS NOT NULL) todo
WHERE {_NEVER_RUN}"""


@query("todo_analyzer", _TODO3)
def q_todo_analyzer(spark, sf):
    return C.todo_analyzer(_m(spark, sf))


_NEXT = (f"SELECT * FROM ({_TODO3}) t WHERE start_timestamp IS NULL "
         "ORDER BY comment_level ASC, source_date DESC, comment_id ASC LIMIT 1000")


@query("todo_analyzer_next", _NEXT)
def q_todo_analyzer_next(spark, sf):
    return C.todo_analyzer_next(_m(spark, sf))


_START = f"""
WITH b AS (SELECT DISTINCT comment_id FROM ({_TODO3}) queue)
SELECT (SELECT coalesce(max(id), 0) FROM analyzer_log) + row_number() OVER (ORDER BY comment_id) AS id,
       comment_id, 1 AS analyzer_id, {AS_OF} AS start_timestamp, CAST(NULL AS TIMESTAMP) AS end_timestamp,
       false AS success FROM b"""


@query("analyzer_batch_start", _START)
def q_analyzer_batch_start(spark, sf):
    return C.analyzer_batch_start(_m(spark, sf))


@query("batch_log_ids", f"""
WITH started AS ({_START}),
log2 AS (SELECT id, comment_id, analyzer_id, start_timestamp FROM analyzer_log
         UNION ALL SELECT id, comment_id, analyzer_id, start_timestamp FROM started)
SELECT comment_id, max(id) AS id FROM log2
WHERE analyzer_id = 1 AND start_timestamp = (SELECT max(start_timestamp) FROM log2 WHERE analyzer_id = 1)
GROUP BY comment_id""")
def q_batch_log_ids(spark, sf):
    m = _m(spark, sf)
    log2 = (m.analyzer_log.select("id", "comment_id", "analyzer_id", "start_timestamp")
            .unionByName(C.analyzer_batch_start(m).select("id", "comment_id", "analyzer_id", "start_timestamp")))
    return C.batch_log_ids(log2)


_GUARD = """
SELECT '{kind}' AS kind, CAST(l.{key} AS INT) AS key_id, l.id AS last_log_id,
  CASE WHEN l.start_timestamp IS NULL OR l.end_timestamp IS NOT NULL THEN CAST(86400000 AS BIGINT)
       ELSE date_sub('second', l.start_timestamp, {as_of}) END AS age_seconds,
  (CASE WHEN l.start_timestamp IS NULL OR l.end_timestamp IS NOT NULL THEN CAST(86400000 AS BIGINT)
       ELSE date_sub('second', l.start_timestamp, {as_of}) END) < {sec} AS skip_run
FROM {tbl} l WHERE l.id IN (SELECT max(id) FROM {tbl} GROUP BY {key})"""


@query("run_guard",
       _GUARD.format(kind="analyzer", key="analyzer_id", tbl="analyzer_log", as_of=AS_OF,
                     sec=C.ANALYZER_GUARD_MIN * 60)
       + " UNION ALL " +
       _GUARD.format(kind="scraper", key="source_id", tbl="crawl_log", as_of=AS_OF,
                     sec=C.SCRAPER_GUARD_MIN * 60))
def q_run_guard(spark, sf):
    return C.run_guard(_m(spark, sf))


@query("run_state", """
SELECT source_id, id, start_timestamp, end_timestamp, success FROM crawl_log
WHERE id IN (SELECT max(id) FROM crawl_log GROUP BY source_id)""")
def q_run_state(spark, sf):
    return C.latest_row(_m(spark, sf).crawl_log, "source_id")


_LAST_RUN = ("SELECT sh.id AS source_id, coalesce(l.last_start, TIMESTAMP '1990-01-01 00:00:00') AS last_run "
             "FROM source_header sh LEFT JOIN (SELECT source_id, max(start_timestamp) AS last_start FROM crawl_log "
             "WHERE success GROUP BY source_id) l ON l.source_id = sh.id")
_OLDEST = ("SELECT sh.id AS source_id, coalesce(o.oldest, " + TODAY + ") AS oldest_date FROM source_header sh "
           "LEFT JOIN (SELECT source_id, min(date_processed) AS oldest FROM crawl_dates_proc GROUP BY source_id) o "
           "ON o.source_id = sh.id")


@query("scraper_last_run", _LAST_RUN)
def q_scraper_last_run(spark, sf):
    return C.scraper_last_run(_m(spark, sf))


@query("scraper_oldest_date", _OLDEST)
def q_scraper_oldest_date(spark, sf):
    return C.scraper_oldest_date(_m(spark, sf))


_WINDOW = f"""
lr AS ({_LAST_RUN}), od AS ({_OLDEST}),
w AS (SELECT lr.source_id, greatest(CAST(lr.last_run AS DATE),
             {TODAY} - CASE lr.source_id WHEN 3 THEN 20 ELSE 30 END) AS window_start,
             {TODAY} AS window_end, od.oldest_date FROM lr JOIN od ON lr.source_id = od.source_id),
x AS (SELECT *, least(oldest_date, window_start) AS oldest FROM w),
win AS (SELECT source_id, window_start, window_end,
          CASE WHEN oldest - 7 > DATE '1970-01-01' THEN oldest - 7 END AS backfill_start,
          CASE WHEN oldest - 7 > DATE '1970-01-01' THEN oldest END AS backfill_end FROM x)"""


@query("crawl_window", f"WITH {_WINDOW} SELECT * FROM win")
def q_crawl_window(spark, sf):
    return C.crawl_window(_m(spark, sf))


@query("dates_visited", f"""
WITH {_WINDOW},
reg AS (SELECT source_id, CAST(unnest(generate_series(CAST(window_start AS TIMESTAMP), CAST(window_end AS TIMESTAMP),
        INTERVAL 1 DAY)) AS DATE) AS date_processed FROM win),
bf AS (SELECT source_id, CAST(unnest(generate_series(CAST(backfill_start AS TIMESTAMP), CAST(backfill_end AS TIMESTAMP),
        INTERVAL 1 DAY)) AS DATE) AS date_processed FROM win WHERE backfill_start IS NOT NULL),
nw AS (SELECT DISTINCT * FROM (SELECT * FROM reg UNION ALL SELECT * FROM bf) u)
SELECT n.source_id, n.date_processed FROM nw n WHERE NOT EXISTS
  (SELECT 1 FROM crawl_dates_proc c WHERE c.source_id = n.source_id AND c.date_processed = n.date_processed)""")
def q_dates_visited(spark, sf):
    return C.dates_visited(_m(spark, sf))


@query("seed_dates", """
SELECT DISTINCT source_id, source_date AS date_processed FROM article_header a
WHERE source_date IS NOT NULL AND NOT EXISTS
  (SELECT 1 FROM crawl_dates_proc c WHERE c.source_id = a.source_id AND c.date_processed = a.source_date)""")
def q_seed_dates(spark, sf):
    return C.seed_dates(_m(spark, sf))


_NEW_LEMMAS = """
SELECT substr(lower(label.udf_value), 1, 30) AS lemma
FROM article_body b JOIN udf_values label ON label.object_id = b.id AND label.object_type = 1 AND label.udf_id = 2
WHERE b.article_id > (SELECT coalesce(max(article_header_id), 0) FROM topic_detector_result)
EXCEPT SELECT lemma FROM lemma_header"""


@query("new_lemmas", _NEW_LEMMAS)
def q_new_lemmas(spark, sf):
    return C.new_lemmas(_m(spark, sf))


@query("new_topic_results",
       f"WITH nl AS ({_NEW_LEMMAS}), lh2 AS (SELECT id, lemma FROM lemma_header UNION ALL "
       f"SELECT {LEMMA_ID.format(x='lemma')}, lemma FROM nl) "
       + _TOPICS.format(lemmas="lh2", cond="latest.article_id > (SELECT coalesce(max(article_header_id), 0) "
                                          "FROM topic_detector_result)"))
def q_new_topic_results(spark, sf):
    return C.new_topic_results(_m(spark, sf))


@query("fill_comment_date", f"""
WITH attr AS (SELECT object_id, min(CAST(try_strptime(substring(udf_value, 1, 10), '%Y-%m-%d') AS DATE)) AS attr_date
              FROM udf_values WHERE object_type = 2 AND udf_id = 4 GROUP BY object_id)
SELECT c.id, CASE WHEN coalesce(c.date_created, a.attr_date) IS NULL
                   AND c.proc_timestamp < {AS_OF} - INTERVAL 3 HOUR AND ah.id IS NOT NULL
              THEN ah.source_date ELSE coalesce(c.date_created, a.attr_date) END AS date_created
FROM comment c LEFT JOIN attr a ON c.id = a.object_id LEFT JOIN article_body ab ON c.article_body_id = ab.id
LEFT JOIN article_header ah ON ab.article_id = ah.id""")
def q_fill_comment_date(spark, sf):
    return C.fill_comment_date(_m(spark, sf))


@query("log_cleanup", "SELECT * FROM analyzer_log WHERE NOT (end_timestamp IS NULL AND analyzer_id = 1)")
def q_log_cleanup(spark, sf):
    return C.log_cleanup(_m(spark, sf))


@query("crawl_log_close", f"""
WITH n AS (SELECT source_id, max(id) AS newest_id FROM crawl_log GROUP BY source_id)
SELECT c.id, c.source_id, c.start_timestamp,
  CASE WHEN c.id = n.newest_id AND c.end_timestamp IS NULL THEN {AS_OF} ELSE c.end_timestamp END AS end_timestamp,
  CASE WHEN c.id = n.newest_id AND c.end_timestamp IS NULL THEN true ELSE c.success END AS success
FROM crawl_log c LEFT JOIN n ON c.source_id = n.source_id""")
def q_crawl_log_close(spark, sf):
    return C.crawl_log_close(_m(spark, sf))


# ---- M17 / M18 over the topic tables ---------------------------------------------
from opinio.plans import marts as MT  # noqa: E402


@query("topics_by_source", """
WITH outlet_topic AS (SELECT DISTINCT a.source_id, t.topic_detector_id, t.lemma_id
                      FROM label_topic t JOIN article_header a ON a.id = t.article_header_id)
SELECT o.source_id AS article_source_id, outlet.source AS article_source, o.topic_detector_id, detector.topic_detector,
       o.lemma_id, label_lemma.lemma
FROM outlet_topic o JOIN label_lemma ON label_lemma.id = o.lemma_id
JOIN source_header outlet ON outlet.id = o.source_id
JOIN topic_detector_header detector ON detector.id = o.topic_detector_id""")
def q_topics_by_source(spark, sf):
    m = _m(spark, sf)
    return MT.topics_by_source(m, C.topic_results(m), C.label_lemmas(m))


@query("lemma_month_doc_count", """
WITH dated AS (SELECT id, CAST(date_trunc('month', source_date) AS DATE) AS mth_published
               FROM article_header WHERE source_date IS NOT NULL)
SELECT t.lemma_id, dated.mth_published, count(DISTINCT dated.id) AS doc_count
FROM dated JOIN label_topic t ON t.article_header_id = dated.id GROUP BY ALL""")
def q_lemma_month_doc_count(spark, sf):
    m = _m(spark, sf)
    return MT.lemma_month_doc_count(m, C.topic_results(m))


@query("lemma_month_doc_count_runs", """
WITH dated AS (SELECT id, CAST(date_trunc('month', CASE WHEN source_id = 2 THEN source_date + 31 ELSE source_date END) AS DATE)
                      AS mth_published
               FROM article_header WHERE source_date IS NOT NULL AND NOT obsolete)
SELECT t.lemma_id, dated.mth_published, count(DISTINCT dated.id) AS doc_count
FROM dated JOIN label_topic t ON t.article_header_id = dated.id GROUP BY ALL""")
def q_lemma_month_doc_count_runs(spark, sf):
    """M18 after three runs: the topic results before T10, those that T10 adds, then a run in which outlet 2
    dates its articles 31 days later and the results of obsolete articles are removed."""
    m = _m(spark, sf)
    topics = write_once(C.topic_results(m).select("article_header_id", "lemma_id"), "topic-results")
    dates = m.article_header.select(F.col("id").alias("article_header_id"), "source_date", "source_id", "obsolete")
    watermark = m.article_body_last_id.agg(F.max("article_id")).scalar() * 9
    counts = LemmaMonthCounts(spark, scratch_path(spark, f"lemma-counts-{uuid.uuid4().hex}"), buckets=8)
    added = topics.withColumn("sign", F.lit(1))
    for run, known in enumerate([F.col("article_header_id") * 10 <= watermark, F.col("article_header_id") * 10 > watermark]):
        counts.apply(run, added.where(known), dates.where(known).select("article_header_id", "source_date"))
    dropped = topics.join(dates.where("obsolete").select("article_header_id"), "article_header_id", "left_semi")
    moved = dates.where("source_id = 2").select("article_header_id", F.date_add("source_date", 31).alias("source_date"))
    counts.apply(2, dropped.withColumn("sign", F.lit(-1)), moved)
    return counts.counts()


# ---- T5 / T13 -----------------------------------------------------------------------
@query("analyzer_batch_end", f"""
WITH started AS ({_START})
SELECT s.id, s.comment_id, s.analyzer_id, s.start_timestamp,
       CASE WHEN c.id IS NOT NULL THEN {AS_OF} END AS end_timestamp, c.id IS NOT NULL AS success
FROM started s LEFT JOIN comment c ON c.id = s.comment_id""")
def q_analyzer_batch_end(spark, sf):
    """T5: the started batch is scored (lexicon model, ensemble slot), result
    rows carrying every result column are kept and the log rows closed."""
    from opinio.operators.sentiment import lexicon_sentiment
    from opinio.plans.registered.text import lexicon
    m = _m(spark, sf)
    started = C.analyzer_batch_start(m)
    texts = (m.comment.join(started.select(F.col("comment_id").alias("id")), "id", "left_semi")
             .select("id", F.col("body").alias("text")))
    scores = lexicon_sentiment(texts, lexicon(spark), "id", "text").select(
        F.col("id").alias("comment_id"), F.lit(1).alias("sub_id"),
        F.col("value").alias("sentiment_value"), F.col("error").alias("error_value"))
    _, closed = C.analyzer_batch_end(started, scores, ["sentiment_value", "error_value"])
    return closed


@query("crawl_log_start", """
WITH g AS (""" + _GUARD.format(kind="scraper", key="source_id", tbl="crawl_log", as_of=AS_OF,
                               sec=C.SCRAPER_GUARD_MIN * 60) + f""")
SELECT (SELECT coalesce(max(id), 0) FROM crawl_log) + row_number() OVER (ORDER BY key_id) AS id,
       key_id AS source_id, {AS_OF} AS start_timestamp, CAST(NULL AS TIMESTAMP) AS end_timestamp, false AS success
FROM g WHERE NOT skip_run""")
def q_crawl_log_start(spark, sf):
    return C.crawl_log_start(_m(spark, sf))
