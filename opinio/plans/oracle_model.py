"""The news model as SQL common table expressions for the DuckDB oracle.

Same rules as ``sources/news_model.py``; ``with_model(sql)`` prepends the
CTEs a query mentions (and what they depend on) in dependency order.
"""

from __future__ import annotations

import re

_CTES: list[tuple[str, str]] = [
    ("source_type_header", "SELECT * FROM (VALUES (1,'api'),(2,'crawl')) t(id,type)"),
    ("source_header", "SELECT * FROM (VALUES (1,1,'Spiegel'),(2,2,'Welt'),(3,2,'FAZ')) t(id,type,source)"),
    ("udf_header", "SELECT * FROM (VALUES (1,'headline','string'),(2,'label','string'),"
                   "(3,'author','string'),(4,'date_created','datetime'),(5,'date_modified','datetime'),"
                   "(6,'date_published','datetime'),(7,'first_seen','date'),(8,'word_hint','integer'),"
                   "(9,'weight','double')) t(id,udf_name,udf_type)"),
    ("object_header", "SELECT * FROM (VALUES (1,'article_body'),(2,'comment')) t(id,type)"),
    ("analyzer_header", "SELECT * FROM (VALUES (1,'comment_sentiment','analyzer1_result',"
                        "'v_todo_analyzer1_next')) t(id,analyzer_name,analyzer_table_name,analyzer_view_name)"),
    ("nlp_models", "SELECT * FROM (VALUES (1,'Ensemble'),(2,'Multilanguage Bert'),(3,'German Bert')) t(id,nlp_model)"),
    ("topic_detector_header", "SELECT * FROM (VALUES (1,'generic')) t(id,topic_detector)"),
    ("article_header",
     "SELECT doc_id + 1 AS id, CAST(doc_id % 3 + 1 AS INT) AS source_id, "
     "concat('https://news.example/', source, '/', CAST(doc_id AS VARCHAR)) AS url, "
     "doc_id % 11 = 0 AS obsolete, CASE WHEN doc_id % 50 = 49 THEN NULL "
     "ELSE DATE '2024-01-01' + CAST(doc_id % 30 AS INT) END AS source_date FROM documents"),
    ("article_body",
     "SELECT doc_id * 2 + v AS id, doc_id + 1 AS article_id, "
     "substring(replace(text, chr(10), ' '), 1, 60) AS headline, "
     "CASE WHEN doc_id % 17 = 3 THEN '' ELSE text END AS body, "
     "TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 31) * INTERVAL '1' DAY AS proc_timestamp, "
     "CAST((doc_id + v) % 16 AS INT) AS proc_counter FROM documents "
     "CROSS JOIN (SELECT 1 AS v UNION ALL SELECT 2 AS v) x "
     "WHERE doc_id % 13 <> 5 AND (v = 1 OR doc_id % 4 = 0)"),
    ("article_body_last_id",
     "SELECT max(id) AS last_article_body_id, article_id FROM article_body GROUP BY article_id"),
    ("comment",
     "SELECT c.conv_id * 100 + c.turn + 1 + k.off AS id, b.last_article_body_id AS article_body_id, "
     "CASE WHEN c.turn = 0 THEN NULL ELSE c.conv_id * 100 + c.turn END AS parent_id, "
     "CAST(c.turn AS INT) AS level, c.text AS body, "
     "concat('https://news.example/c/', CAST(c.conv_id AS VARCHAR), c.role, CAST(k.off AS VARCHAR), c.text) AS ext_key, "
     "TIMESTAMP '2024-01-31 00:00:00' + ((c.conv_id + c.turn) % 24) * INTERVAL '1' HOUR AS proc_timestamp, "
     "CASE WHEN c.turn % 4 = 3 THEN NULL ELSE DATE '2024-01-01' + CAST((c.conv_id + c.turn) % 31 AS INT) END AS date_created "
     "FROM conversations c JOIN article_body_last_id b ON b.article_id = c.conv_id + 1 "
     "JOIN (SELECT 0 AS off UNION ALL SELECT 17592186044416 AS off) k ON k.off = 0 OR (c.turn = 0 AND c.conv_id % 9 = 0)"),
    ("analyzer1_result",
     "SELECT c.id * 3 + s AS id, c.id AS comment_id, c.id AS analyzer_log_id, s AS sub_id, "
     "((c.id * 7919 + s * 100) % 2001) / 1000.0e0 - 1.0e0 AS sentiment_value, "
     "0.05e0 + ((c.id * 31 + s * 17) % 90) / 100.0e0 AS error_value "
     "FROM comment c CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 UNION ALL SELECT 3) x WHERE c.id % 5 <> 0"),
    ("analyzer_log",
     "SELECT event_id + 1 AS id, (user_id % 100) * 100 + event_id % 3 + 1 AS comment_id, "
     "CAST(1 + event_id % 2 AS INT) AS analyzer_id, ts AS start_timestamp, "
     "CASE WHEN event_type = 'error' THEN NULL ELSE ts + CAST(floor(value) AS INT) * INTERVAL '1' SECOND END AS end_timestamp, "
     "event_type = 'purchase' AS success FROM events WHERE event_id % 7 = 0"),
    ("crawl_log",
     "SELECT event_id + 1 AS id, CAST(user_id % 3 + 1 AS INT) AS source_id, ts AS start_timestamp, "
     "CASE WHEN value < 50 THEN NULL ELSE ts + INTERVAL '1' HOUR END AS end_timestamp, "
     "value > 100 AS success FROM events WHERE event_type = 'signup'"),
    ("udf_values",
     "SELECT 2 AS udf_id, 1 AS object_type, id AS object_id, concat('Topic-', CAST(article_id % 12 AS VARCHAR)) AS udf_value FROM article_body "
     "UNION ALL SELECT 2, 1, id, concat('Lang-', CAST(id % 5 AS VARCHAR)) FROM article_body "
     "UNION ALL SELECT 4, 1, CASE WHEN id % 29 = 0 THEN id + 35184372088832 ELSE id END, "
     "CASE WHEN id % 37 = 0 THEN '11.01.2024' ELSE concat(CAST(CAST(proc_timestamp AS DATE) AS VARCHAR), 'T08:00:00') END FROM article_body "
     "UNION ALL SELECT 4, 2, CASE WHEN id % 23 = 0 THEN id + 35184372088832 ELSE id END, "
     "concat(CAST(CAST(proc_timestamp AS DATE) AS VARCHAR), ' 10:00') FROM comment WHERE id % 2 = 0 "
     "UNION ALL SELECT 3, 1, id, concat('author-', CAST(id % 17 AS VARCHAR)) FROM article_body "
     "UNION ALL SELECT 7, 1, id, CAST(CAST(proc_timestamp AS DATE) AS VARCHAR) FROM article_body "
     "UNION ALL SELECT 8, 1, id, CAST(id % 100 AS VARCHAR) FROM article_body "
     "UNION ALL SELECT 9, 1, id, concat(CAST(id % 100 AS VARCHAR), '.5') FROM article_body"),
]

_NAMES = [n for n, _ in _CTES]
_BODY = dict(_CTES)


def register_cte(name: str, sql: str) -> None:
    """Add a derived relation (seeds of control tables) after the base model."""
    if name not in _BODY:
        _NAMES.append(name)
    _BODY[name] = sql


def _mentions(sql: str, name: str) -> bool:
    return re.search(rf"\b{re.escape(name)}\b", sql) is not None


def with_model(sql: str) -> str:
    """Prefix ``sql`` with the model CTEs it needs (transitively)."""
    needed: set[str] = set()
    frontier = [sql]
    while frontier:
        text = frontier.pop()
        for n in _NAMES:
            if n not in needed and _mentions(text, n):
                needed.add(n)
                frontier.append(_BODY[n])
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({_BODY[n]})" for n in _NAMES if n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
