"""Registered page / API extraction queries (S10-S13, F8) with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinio.plans.registered.ingest import incoming_headers
from opinio.plans.registry import query
from opinio.sources import pages as PG
from opinio.sources.news_model import NewsModel


def _m(spark, sf):
    return NewsModel(spark, sf)


@query("page_links", f"""
WITH l AS (SELECT page_id, unnest(ls) AS link, generate_subscripts(ls, 1) - 1 AS pos
           FROM (SELECT page_id, regexp_extract_all(html, '{PG.LINK_PATTERN}', 1) AS ls FROM pages) p)
SELECT page_id, CAST(min(pos) AS INT) AS pos, link FROM l GROUP BY page_id, link""")
def q_page_links(spark, sf):
    return PG.page_links(_m(spark, sf).table("pages"))


def _strip_sql(x: str) -> str:
    s = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for a, b in PG._ENTITIES:
        s = "replace({}, '{}', '{}')".format(s, a.replace("'", "''"), b.replace("'", "''"))
    return f"trim({s})"


_CLEAN = ("regexp_replace(regexp_replace(html, '(?s)<script[^>]*>.*?</script>', '', 'g'), "
          "'(?s)<style[^>]*>.*?</style>', '', 'g')")


@query("page_article_extract", f"""
WITH c AS (SELECT page_id, html, {_CLEAN} AS clean FROM pages),
a AS (SELECT page_id, html, clean, regexp_extract(clean, '(?s)<article[^>]*>(.*)</article>', 1) AS article FROM c),
p AS (SELECT *, (string_split_regex(article, '<p[ >]'))[2:] AS ps FROM a),
k AS (SELECT *, list_slice(ps, 1, coalesce(list_max(list_transform(range(1, greatest(len(ps), 1) + 1),
        lambda i: CASE WHEN NOT contains(coalesce(ps[i], ''), '<em') THEN i ELSE 0 END)), 0)) AS kept FROM p),
t AS (SELECT *, list_filter(list_transform(kept, lambda x: {_strip_sql('x')}), lambda y: y <> '') AS texts FROM k)
SELECT page_id, regexp_extract(html, '<html[^>]*\\slang="([^"]*)"', 1) AS lang,
       {_strip_sql("regexp_extract(clean, '(?s)<title[^>]*>(.*?)</title>', 1)")} AS title,
       {_strip_sql("regexp_extract(clean, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS headline,
       array_to_string(texts, chr(10)) AS body, CAST(len(texts) AS INT) AS n_paragraphs FROM t""")
def q_page_article_extract(spark, sf):
    return PG.page_article_extract(_m(spark, sf).table("pages"))


def raw_comment_dates(m: NewsModel):
    """Stand-in raw comment dates in the outlet's 'dd.mm.yyyy - HH:MM' form
    (level-3 replies carry a date without time, which does not parse)."""
    c = m.comment.select("id", "level", "proc_timestamp")
    raw = F.when(F.col("level") == 3, F.date_format("proc_timestamp", "dd.MM.yyyy")).otherwise(
        F.date_format("proc_timestamp", "dd.MM.yyyy - HH:mm"))
    return c.select("id", raw.alias("raw"))


@query("german_date_normalise", """
WITH r AS (SELECT id, CASE WHEN level = 3 THEN strftime(proc_timestamp, '%d.%m.%Y')
                      ELSE strftime(proc_timestamp, '%d.%m.%Y - %H:%M') END AS raw FROM comment)
SELECT id, raw, CASE WHEN len(string_split(raw, ' - ')) = 2
                     AND try_strptime(split_part(raw, ' - ', 1), '%d.%m.%Y') IS NOT NULL
                THEN strftime(try_strptime(split_part(raw, ' - ', 1), '%d.%m.%Y'), '%Y-%m-%d') || ' '
                     || split_part(raw, ' - ', 2) END AS created_at FROM r""")
def q_german_date_normalise(spark, sf):
    r = raw_comment_dates(_m(spark, sf))
    return r.select("id", "raw", PG.german_datetime(F.col("raw")).alias("created_at"))


def api_batches(m: NewsModel):
    """Stand-in stored API pages: events as comments of document user_id,
    pages of 50 ids, the first record of each page repeated at the end of the
    previous page; creation times with a fraction on even ids."""
    e = m.table("events").select("event_id", "user_id", "ts")
    created = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    base = e.select("user_id", "event_id", created.alias("created"),
                    (F.col("event_id") / 50).cast("long").alias("batch_no"))
    repeat = (base.filter((F.col("event_id") % 50 == 0) & (F.col("batch_no") > 0))
              .withColumn("batch_no", F.col("batch_no") - 1))
    return base.unionByName(repeat)


@query("paged_comment_merge", """
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
                  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS created, CAST(floor(event_id / 50) AS BIGINT) AS batch_no
           FROM events),
b AS (SELECT * FROM e UNION ALL SELECT user_id, event_id, created, batch_no - 1 FROM e
      WHERE event_id % 50 = 0 AND batch_no > 0),
p AS (SELECT user_id, event_id, coalesce(try_strptime(created, '%Y-%m-%dT%H:%M:%S.%f'),
                                         try_strptime(created, '%Y-%m-%dT%H:%M:%S')) AS created_ts, batch_no FROM b),
f AS (SELECT user_id, event_id, arg_min(created_ts, batch_no) AS created_ts FROM p GROUP BY user_id, event_id)
SELECT f.*, min(created_ts) OVER (PARTITION BY user_id) AS cursor FROM f""")
def q_paged_comment_merge(spark, sf):
    return PG.paged_comment_merge(api_batches(_m(spark, sf)), "user_id", "event_id")


@query("paid_filter", """
SELECT pos, url, source_id, source_id = 1 AND pos % 5 = 0 AS is_paid FROM incoming_headers
WHERE NOT CASE source_id WHEN 1 THEN pos % 5 = 0 WHEN 2 THEN contains(url, '/plus')
               WHEN 3 THEN contains(url, '/premiumContent') ELSE false END""")
def q_paid_filter(spark, sf):
    """F8: outlet 1 sends a flag (stand-in: every fifth position), the others mark the url."""
    h = incoming_headers(_m(spark, sf)).select("pos", "url", "source_id")
    return PG.paid_filter(h.withColumn("is_paid", (F.col("source_id") == 1) & (F.col("pos") % 5 == 0)))
