"""Registered reporting queries (M, G, O, Q families) with their oracles."""

from __future__ import annotations

from opinio.plans import dashboards as D
from opinio.plans.registry import query
from pyspark.sql import functions as F
from opinio.sources.news_model import NewsModel

P = D.DashboardParams()

# Oracles of the dashboard panels with the default parameters bound: the scored
# comments (resp. matching articles) of the period, outlets and model are one
# relation, which each panel aggregates.
_PERIOD = f"h.source_date BETWEEN DATE '{P.date_from}' AND DATE '{P.date_to}'"
_OUTLETS = "h.source_id IN (SELECT id FROM source_header WHERE source IN ('Spiegel', 'Welt', 'FAZ'))"
_KW = f"c.body ILIKE '% {P.keyword}%'"
_TXT = f"b.body ILIKE '%{P.article_text}%'"


def _scored(text_filter: str) -> str:
    return f"""
WITH scored AS (
  SELECT h.source_date AS day, r.comment_id, r.sentiment_value AS v, r.error_value AS e
  FROM analyzer1_result r JOIN comment c ON c.id = r.comment_id
  JOIN article_body b ON b.id = c.article_body_id JOIN article_header h ON h.id = b.article_id
  WHERE r.sub_id = (SELECT id FROM nlp_models WHERE nlp_model = '{P.nlp_model}')
    AND {_PERIOD} AND {_OUTLETS} AND {text_filter})"""


_FOUND = f"""
WITH found AS (
  SELECT h.source_date AS day, h.id AS article, b.id AS version
  FROM article_header h JOIN article_body b ON b.article_id = h.id WHERE {_PERIOD} AND {_OUTLETS} AND {_TXT})"""
_ANSWERED = "found LEFT JOIN comment c ON c.article_body_id = found.version"


@query("avg_sentiment", f"{_scored(_TXT)} SELECT round(avg(v), 9) AS sentiment_simple_average FROM scored")
def q_avg_sentiment(spark, sf):
    return D.avg_sentiment(NewsModel(spark, sf), P)


@query("daily_sentiment_by_article_text",
       f"{_scored(_TXT)} SELECT day AS time, round(avg(v), 9) AS sentiment_simple_average FROM scored GROUP BY day ORDER BY day")
def q_daily_sentiment_by_article_text(spark, sf):
    return D.daily_sentiment_by_article_text(NewsModel(spark, sf), P)


@query("daily_sentiment",
       f"{_scored(_KW)} SELECT day AS time, round(avg(v), 9) AS sentiment_simple_average FROM scored GROUP BY day ORDER BY day")
def q_daily_sentiment(spark, sf):
    return D.daily_sentiment(NewsModel(spark, sf), P)


@query("analysed_comments_per_day",
       f"{_scored(_KW)} SELECT day AS time, count(DISTINCT comment_id) AS n_comments FROM scored GROUP BY day ORDER BY day")
def q_analysed_comments_per_day(spark, sf):
    return D.analysed_comments_per_day(NewsModel(spark, sf), P)


@query("comment_count", f"{_FOUND} SELECT count(DISTINCT c.id) AS n_comments FROM {_ANSWERED}")
def q_comment_count(spark, sf):
    return D.comment_count(NewsModel(spark, sf), P)


@query("comments_per_day",
       f"{_FOUND} SELECT day::TIMESTAMP AS time, count(DISTINCT c.id) AS n_comments FROM {_ANSWERED} GROUP BY day ORDER BY day")
def q_comments_per_day(spark, sf):
    return D.comments_per_day(NewsModel(spark, sf), P)


@query("article_count", f"{_FOUND} SELECT count(DISTINCT article) AS n_articles FROM found")
def q_article_count(spark, sf):
    return D.article_count(NewsModel(spark, sf), P)


@query("articles_per_day",
       f"{_FOUND} SELECT day::TIMESTAMP AS time, count(DISTINCT article) AS n_articles FROM found GROUP BY day ORDER BY day")
def q_articles_per_day(spark, sf):
    return D.articles_per_day(NewsModel(spark, sf), P)


# ---- M9-M16, G5-G8, O2, F1, T1 ------------------------------------------------
from opinio.functions.dates import calendar_sql  # noqa: E402
from opinio.plans import marts as MT  # noqa: E402
from opinio.plans import quality as QL  # noqa: E402

_N_ANALYSED = "(SELECT count(id) FROM analyzer1_result WHERE sub_id = 1)"


@query("database_statistics", f"""
SELECT (SELECT count(id) FROM article_header) AS n_article_headers, (SELECT count(id) FROM article_body) AS n_article_bodies,
       (SELECT count(id) FROM comment) AS n_comments, {_N_ANALYSED} AS n_analyzed_comments""")
def q_database_statistics(spark, sf):
    return MT.database_statistics(NewsModel(spark, sf))


@query("pct_comments_analysed",
       f"SELECT round({_N_ANALYSED} / (SELECT count(id) FROM comment) * 100, 2) AS pct_comments_analyzed")
def q_pct_comments_analysed(spark, sf):
    return MT.pct_comments_analysed(NewsModel(spark, sf))


@query("comments_per_date", """
WITH dated AS (SELECT b.id AS article_body_id, a.source_date FROM article_body b JOIN article_header a ON a.id = b.article_id)
SELECT source_date AS article_date, count(*) AS n_comments FROM comment JOIN dated USING (article_body_id) GROUP BY ALL""")
def q_comments_per_date(spark, sf):
    return MT.comments_per_date(NewsModel(spark, sf))


@query("data_by_source", """
WITH placed AS (SELECT comment.id AS comment_id, article_id FROM comment JOIN article_body ON article_body.id = article_body_id)
SELECT source_id, count(DISTINCT article_id) AS count_articles, count(DISTINCT comment_id) AS count_comments
FROM placed JOIN article_header ON article_header.id = placed.article_id GROUP BY source_id""")
def q_data_by_source(spark, sf):
    return MT.data_by_source(NewsModel(spark, sf))


@query("sentiment_by_created_date", f"""
SELECT cmt.date_created AS date,
  round(SUM(sentiment_value / nullif(error_value * error_value, 0)) / SUM(1 / nullif(error_value * error_value, 0)), 9)
    AS sentiment_error_weighted,
  round(AVG(sentiment_value), 9) AS sentiment_simple_average,
  count(cmt.id) AS count_comments
FROM analyzer1_result rslt, comment cmt
WHERE rslt.comment_id = cmt.id AND cmt.body ILIKE '% {P.keyword}%'
GROUP BY cmt.date_created ORDER BY date DESC""")
def q_sentiment_by_created_date(spark, sf):
    return MT.sentiment_by_created_date(NewsModel(spark, sf), P.keyword)


@query("daily_sentiment_weighted",
       f"{_scored(_KW)} SELECT day AS time, round(sum(v / nullif(e * e, 0)) / sum(1 / nullif(e * e, 0)), 9) "
       "AS sentiment_error_weighted FROM scored GROUP BY day ORDER BY day")
def q_daily_sentiment_weighted(spark, sf):
    return D.daily_sentiment_weighted(NewsModel(spark, sf), P)


@query("obsolete_share", """
SELECT round(SUM(CASE WHEN obsolete THEN 1 ELSE 0 END) / COUNT(obsolete), 9) AS share_obsolete
FROM article_header WHERE source_id = 3""")
def q_obsolete_share(spark, sf):
    return MT.obsolete_share(NewsModel(spark, sf), 3)


@query("comment_duplicates", """
WITH said AS (SELECT a.url, c.body, c.id AS comment_id, a.id AS article_id
  FROM article_header a JOIN article_body b ON b.article_id = a.id JOIN comment c ON c.article_body_id = b.id)
SELECT url, body, count(DISTINCT comment_id) AS comment_count, count(DISTINCT article_id) AS hdr_count
FROM said GROUP BY url, body HAVING comment_count > 1""")
def q_comment_duplicates(spark, sf):
    return MT.comment_duplicates(NewsModel(spark, sf))


@query("unanimous_positive", """
SELECT c.id AS comment_id, round(avg(r.sentiment_value), 9) AS avg_sent, c.body
FROM comment c JOIN analyzer1_result r ON r.comment_id = c.id AND r.sub_id BETWEEN 1 AND 3
GROUP BY c.id, c.body HAVING bool_and(r.sentiment_value > 0.5)""")
def q_unanimous_positive(spark, sf):
    return MT.unanimous_positive(NewsModel(spark, sf))


@query("earliest_article_date",
       "SELECT strftime(min(source_date), '%d-%m-%Y') AS earliest_date FROM article_header")
def q_earliest_article_date(spark, sf):
    return MT.article_date_bound(NewsModel(spark, sf), latest=False)


@query("latest_article_date",
       "SELECT strftime(max(source_date), '%d-%m-%Y') AS latest_date FROM article_header")
def q_latest_article_date(spark, sf):
    return MT.article_date_bound(NewsModel(spark, sf), latest=True)


@query("article_header_current", """
WITH outlet AS (SELECT o.id AS src_id, o.source AS src_name, kind.type AS src_type
                FROM source_header o JOIN source_type_header kind ON kind.id = o.type)
SELECT src_type, src_name, src_id, a.id AS article_id, a.url, a.source_date, a.obsolete
FROM article_header a JOIN outlet ON outlet.src_id = a.source_id WHERE NOT a.obsolete""")
def q_article_header_current(spark, sf):
    return MT.article_header_current(NewsModel(spark, sf))


@query("article_body_last_id", "SELECT last_article_body_id, article_id FROM article_body_last_id")
def q_article_body_last_id(spark, sf):
    return NewsModel(spark, sf).article_body_last_id


@query("article_body_last", """
SELECT * FROM article_body QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY id DESC) = 1""")
def q_article_body_last(spark, sf):
    return MT.article_body_last(NewsModel(spark, sf))


_FACT_DATES = """
fact_dates AS (SELECT source_date AS d FROM article_header UNION ALL SELECT date_created FROM comment
               UNION ALL SELECT CAST(proc_timestamp AS DATE) FROM article_body),
span AS (SELECT min(d) AS lo, max(d) AS hi FROM fact_dates WHERE d IS NOT NULL),
days AS (SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS dd
         FROM span)"""


@query("date_dimension", f"WITH {_FACT_DATES} SELECT {calendar_sql('dd')} FROM days")
def q_date_dimension(spark, sf):
    return MT.calendar_for_facts(NewsModel(spark, sf))


@query("date_range_lookup",
       f"WITH {_FACT_DATES} SELECT dd AS date FROM days WHERE dd BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")
def q_date_range_lookup(spark, sf):
    return MT.date_range_lookup(NewsModel(spark, sf), "2024-01-10", "2024-01-20")


# ---- Q1-Q5 data-quality reports ------------------------------------------------
@query("headers_without_body", """
SELECT article_id AS id, url, source_id, source_date
FROM (SELECT id AS article_id, url, source_id, source_date FROM article_header WHERE NOT obsolete)
ANTI JOIN article_body USING (article_id)""")
def q_headers_without_body(spark, sf):
    return QL.headers_without_body(NewsModel(spark, sf))


@query("bodies_without_comments", """
WITH silent AS (SELECT article_id, proc_timestamp, proc_counter FROM article_body
                WHERE NOT EXISTS (FROM comment WHERE comment.article_body_id = article_body.id))
SELECT a.id, a.url, a.source_id, a.source_date, silent.proc_timestamp, silent.proc_counter
FROM silent JOIN article_header a ON a.id = silent.article_id AND NOT a.obsolete""")
def q_bodies_without_comments(spark, sf):
    return QL.bodies_without_comments(NewsModel(spark, sf))


@query("orphan_udf_values", """
WITH owner AS (SELECT 1 AS object_type, id AS object_id FROM article_body UNION ALL SELECT 2, id FROM comment)
SELECT DISTINCT udf_id, CASE object_type WHEN 1 THEN 'udf without article_body attached'
                        ELSE 'udf without comment attached' END AS err_msg, object_id, udf_value
FROM udf_values ANTI JOIN owner USING (object_type, object_id)""")
def q_orphan_udf_values(spark, sf):
    return QL.orphan_udf_values(NewsModel(spark, sf))


@query("comments_without_date", """
WITH undated AS (SELECT id AS co_id, article_body_id AS ab_id FROM comment
                 WHERE date_created IS NULL AND proc_timestamp + INTERVAL 3 HOUR < TIMESTAMP '2024-02-01 00:00:00'),
placed AS (SELECT id AS ab_id, article_id AS ah_id FROM article_body WHERE article_id IN (SELECT id FROM article_header))
SELECT ah_id, ab_id, co_id FROM undated JOIN placed USING (ab_id)""")
def q_comments_without_date(spark, sf):
    return QL.comments_without_date(NewsModel(spark, sf))


_TYPED_SQL = """
WITH field AS (SELECT id AS udf_id, udf_name FROM udf_header WHERE udf_type = '{t}'),
attr AS (SELECT udf_id, object_type, object_id AS article_body_id, udf_value FROM udf_values WHERE object_type = 1)
SELECT article_id, article_body_id, udf_id, udf_name, object_type, {conv} AS udf_value_format
FROM attr JOIN field USING (udf_id)
JOIN (SELECT article_id, last_article_body_id AS article_body_id FROM article_body_last_id) USING (article_body_id)"""
_DATE_CONV = "CAST(try_strptime(substring(udf_value, 1, 10), '%Y-%m-%d') AS DATE)"
for _key, _t, _conv in [("udf_date", "date", _DATE_CONV), ("udf_datetime", "datetime", _DATE_CONV),
                        ("udf_string", "string", "udf_value"),
                        ("udf_integer", "integer", "TRY_CAST(udf_value AS INTEGER)"),
                        ("udf_double", "double", "TRY_CAST(udf_value AS DOUBLE)")]:
    query(_key, _TYPED_SQL.format(conv=_conv, t=_t))(
        lambda spark, sf, _k=_key: QL.typed_udf_view(NewsModel(spark, sf), _k))


# ---- F4 / F5 searches, G12, scalar function families -------------------------------
@query("article_text_search", f"SELECT id, article_id FROM article_body WHERE body ILIKE '%{P.article_text}%'")
def q_article_text_search(spark, sf):
    ab = NewsModel(spark, sf).article_body
    return ab.filter(D.article_text_match(F.col("body"), P.article_text)).select("id", "article_id")


@query("comment_keyword_search", f"SELECT id, article_body_id FROM comment WHERE body ILIKE '% {P.keyword}%'")
def q_comment_keyword_search(spark, sf):
    c = NewsModel(spark, sf).comment
    return c.filter(D.comment_keyword_match(F.col("body"), P.keyword)).select("id", "article_body_id")


@query("topics_per_article", """
SELECT object_id AS article_body_id, list_sort(list(udf_value)) AS topics FROM udf_values
WHERE object_type = 1 AND udf_id = 2 GROUP BY object_id""")
def q_topics_per_article(spark, sf):
    """The label attributes of each body as one sorted list."""
    uv = NewsModel(spark, sf).udf_values.filter((F.col("object_type") == 1) & (F.col("udf_id") == 2))
    return uv.groupBy(F.col("object_id").alias("article_body_id")).agg(
        F.sort_array(F.collect_list("udf_value")).alias("topics"))


@query("scalar_strings", """
SELECT doc_id, substring(lower(text), 1, 30) AS lower30, substring(text, 1, 10) AS first10,
       CAST(length(text) AS INT) AS n_chars, replace(text, 'e', 'E') AS replaced,
       split_part(text, '.', 1) AS first_sentence, contains(lower(text), ' the ') AS has_the,
       concat(source, '/', lang) AS source_lang FROM documents""")
def q_scalar_strings(spark, sf):
    """Section 2.7 string family: substring/lower, length, replace, split
    index, contains, concat."""
    d = NewsModel(spark, sf).table("documents")
    return d.select("doc_id", F.substring(F.lower("text"), 1, 30).alias("lower30"),
                    F.substring("text", 1, 10).alias("first10"), F.length("text").alias("n_chars"),
                    F.replace("text", F.lit("e"), F.lit("E")).alias("replaced"),
                    F.split_part("text", F.lit("."), F.lit(1)).alias("first_sentence"),
                    F.lower("text").contains(" the ").alias("has_the"),
                    F.concat("source", F.lit("/"), "lang").alias("source_lang"))


@query("scalar_dates", """
SELECT event_id, CAST(ts AS DATE) AS d, strftime(CAST(ts AS DATE), '%d-%m-%Y') AS dmy,
       CAST(isodow(ts) AS INT) AS iso_dow, CAST(weekofyear(ts) AS INT) AS week, last_day(CAST(ts AS DATE)) AS month_end,
       CAST(date_trunc('month', ts) AS DATE) AS month_start, ts + INTERVAL 3 HOUR AS plus_3h,
       date_trunc('hour', ts) AS hour_start, CAST(dayofyear(ts) AS INT) AS doy FROM events""")
def q_scalar_dates(spark, sf):
    """Section 2.7 date family: TO_CHAR, ISO day of week, week, month end and
    start, interval arithmetic, truncation, day of year."""
    from opinio.functions.dates import iso_dow
    e = NewsModel(spark, sf).table("events")
    d = F.col("ts").cast("date")
    return e.select("event_id", d.alias("d"), F.date_format(d, "dd-MM-yyyy").alias("dmy"),
                    iso_dow(d).alias("iso_dow"), F.weekofyear(d).alias("week"), F.last_day(d).alias("month_end"),
                    F.trunc(d, "month").alias("month_start"),
                    F.timestamp_add("HOUR", F.lit(3), F.col("ts")).alias("plus_3h"),
                    F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("hour_start"),
                    F.dayofyear(d).alias("doy"))


@query("scalar_math", """
SELECT event_id, power(2, event_id % 10) AS pow2, round(value * 100, 2) AS pct,
       round(log2(value + 1), 9) AS log2v, CAST(floor(value) AS BIGINT) AS fl, round(sqrt(value), 9) AS sq,
       event_id % 7 AS m7 FROM events""")
def q_scalar_math(spark, sf):
    """Section 2.7 math family: power (PostgreSQL ^), round, log2, floor,
    sqrt, modulo."""
    from opinio.functions.numeric import power2
    e = NewsModel(spark, sf).table("events")
    return e.select("event_id", power2(F.col("event_id") % 10).alias("pow2"),
                    F.round(F.col("value") * 100, 2).alias("pct"),
                    F.round(F.log2(F.col("value") + 1), 9).alias("log2v"), F.floor("value").alias("fl"),
                    F.round(F.sqrt("value"), 9).alias("sq"), (F.col("event_id") % 7).alias("m7"))


@query("scalar_arrays", """
SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1:3] AS first3, list_max(embedding) AS mx,
       CAST(list_position(embedding, list_max(embedding)) AS INT) AS argmax FROM embeddings""")
def q_scalar_arrays(spark, sf):
    """Section 2.7 array family: size, slice, max, argmax (array_position)."""
    e = NewsModel(spark, sf).table("embeddings")
    return e.select("vec_id", F.size("embedding").alias("n"), F.slice("embedding", 1, 3).alias("first3"),
                    F.array_max("embedding").alias("mx"),
                    F.array_position("embedding", F.array_max("embedding")).cast("int").alias("argmax"))
