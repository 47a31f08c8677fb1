"""Registered ingest queries (W1-W16, C1, F10, F11) with their oracles.

Incoming batches are stand-in inputs shaped from the driver tables (pages ->
article headers, documents -> bodies / attributes, conversations ->
comments). The shaping only produces rows of the expected schema; the jobs
in ``opinio.operators.ingest`` treat them like any crawler output.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions.dates import initial_backoff
from opinio.functions.hashing import external_id_of
from opinio.functions.strings import nfkd, normalise_blanks
from opinio.operators import comment_tree as CT
from opinio.operators import control as C
from opinio.operators import ingest as I
from opinio.operators.ids import dense_ids
from opinio.plans.marts import article_body_last
from opinio.plans.oracle_model import register_cte
from opinio.plans.registry import query
from opinio.sources.news_model import NewsModel, date_lit, ts_ntz
from opinio.session import scratch_path, small_batches
from opinio.sources.runs import RunStore, Table, initial
from opinio.sources.store import KeyedStore

URL_RE = I.URL_PATTERN
EXT_ID = ("CAST((CAST(('0x' || substr(md5({k}), 1, 16)) AS UBIGINT)::HUGEINT - CASE WHEN "
          "CAST(('0x' || substr(md5({k}), 1, 16)) AS UBIGINT) >= 9223372036854775808 "
          "THEN 18446744073709551616 ELSE 0 END) AS BIGINT)")
#: Offsets of stand-in positions, beyond any id of the given tables.
AGAIN, STORED = 1 << 44, 1 << 45
UDF_KEYS = ["headline", "label", "author", "replies", "date_created"]


# ---- stand-in incoming batches ------------------------------------------------
def incoming_headers(m: NewsModel) -> DataFrame:
    p = m.table("pages").select("page_id", "url")
    pid = F.col("page_id")
    first = p.select(pid.alias("pos"), "url", (pid % 4).cast("int").alias("source_id"),
                     F.when(pid % 6 == 0, F.lit(None).cast("boolean")).otherwise(pid % 9 == 0).alias("obsolete"),
                     F.date_add(date_lit("2024-01-01"), (pid % 40).cast("int")).alias("source_date"))
    again = p.filter(pid % 3 == 0).select((pid + F.lit(AGAIN)).alias("pos"), "url",
                                          ((pid + 1) % 3 + 1).cast("int").alias("source_id"),
                                          F.lit(False).alias("obsolete"),
                                          F.date_add(date_lit("2024-01-01"), (pid % 40).cast("int")).alias("source_date"))
    stored = (m.article_header.filter(F.col("id") % 5 == 0)
              .select((F.col("id") + F.lit(STORED)).alias("pos"), "url", "source_id", "obsolete", "source_date"))
    return first.unionByName(again).unionByName(stored)


register_cte("incoming_headers", f"""
SELECT page_id AS pos, url, CAST(page_id % 4 AS INT) AS source_id,
       CASE WHEN page_id % 6 = 0 THEN NULL ELSE page_id % 9 = 0 END AS obsolete,
       DATE '2024-01-01' + CAST(page_id % 40 AS INT) AS source_date FROM pages
UNION ALL
SELECT page_id + {AGAIN}, url, CAST((page_id + 1) % 3 + 1 AS INT), false, DATE '2024-01-01' + CAST(page_id % 40 AS INT)
FROM pages WHERE page_id % 3 = 0
UNION ALL
SELECT id + {STORED}, url, source_id, obsolete, source_date FROM article_header WHERE id % 5 = 0""")


def incoming_bodies(m: NewsModel) -> DataFrame:
    d = m.table("documents").select("doc_id", "text")
    doc = F.col("doc_id")
    model_headline = F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, 60)
    return d.select((doc + 1).alias("article_id"),
                    F.when(doc % 2 == 0, model_headline).otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
                    .alias("headline"),
                    F.when(doc % 3 == 0, F.concat("text", F.lit(" (update)")))
                     .when(doc % 17 == 3, F.lit("")).otherwise(F.col("text")).alias("body"),
                    F.timestamp_add("MILLISECOND", (doc % 1000).cast("int"), ts_ntz("2024-02-01 00:00:00"))
                    .alias("proc_timestamp"),
                    F.lit(None).cast("int").alias("proc_counter"))


register_cte("incoming_bodies", """
SELECT doc_id + 1 AS article_id,
       CASE WHEN doc_id % 2 = 0 THEN substring(replace(text, chr(10), ' '), 1, 60) ELSE split_part(text, chr(10), 1) END
         AS headline,
       CASE WHEN doc_id % 3 = 0 THEN concat(text, ' (update)') WHEN doc_id % 17 = 3 THEN '' ELSE text END AS body,
       TIMESTAMP '2024-02-01 00:00:00' + (doc_id % 1000) * INTERVAL 1 MILLISECOND AS proc_timestamp,
       CAST(NULL AS INT) AS proc_counter FROM documents""")


def incoming_comments(m: NewsModel) -> DataFrame:
    c = m.table("conversations").select("conv_id", "turn", "role", "text")
    ah = m.article_header.select(F.col("id").alias("article_id"), "url")
    last = m.article_body_last_id
    copy = F.col("copy")
    j = (c.withColumn("article_id", F.col("conv_id") + 1).join(ah, "article_id", "inner")
         .join(last, "article_id", "inner")
         .withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))))
    ext_key = F.concat(F.lit("https://news.example/c/"), F.col("conv_id").cast("string"), F.col("role"),
                       F.when(F.col("turn") % 2 == 0, F.lit("0")).otherwise(F.lit("7")), F.col("text"))
    return j.select((F.col("conv_id") * 1000 + F.col("turn") * 2 + copy).alias("pos"),
                    external_id_of(ext_key).alias("external_id"),
                    F.col("last_article_body_id").alias("article_body_id"),
                    F.when(F.col("turn") == 0, F.lit(None).cast("bigint"))
                     .otherwise(F.col("conv_id") * 100 + F.col("turn")).alias("parent_id"),
                    F.col("turn").cast("int").alias("level"),
                    F.col("text").alias("body"),
                    F.timestamp_add("MINUTE", copy.cast("int"), ts_ntz("2024-02-01 00:00:00")).alias("proc_timestamp"))


register_cte("incoming_comments", f"""
SELECT c.conv_id * 1000 + c.turn * 2 + k.copy AS pos,
       {EXT_ID.format(k="concat('https://news.example/c/', CAST(c.conv_id AS VARCHAR), c.role, CASE WHEN c.turn % 2 = 0 THEN '0' ELSE '7' END, c.text)")} AS external_id,
       b.last_article_body_id AS article_body_id,
       CASE WHEN c.turn = 0 THEN NULL ELSE c.conv_id * 100 + c.turn END AS parent_id,
       CAST(c.turn AS INT) AS level, c.text AS body,
       TIMESTAMP '2024-02-01 00:00:00' + k.copy * INTERVAL 1 MINUTE AS proc_timestamp
FROM conversations c JOIN article_header ah ON ah.id = c.conv_id + 1
JOIN article_body_last_id b ON b.article_id = c.conv_id + 1
CROSS JOIN (SELECT 0 AS copy UNION ALL SELECT 1) k""")


def incoming_udfs(m: NewsModel) -> DataFrame:
    d = m.table("documents").select("doc_id", "text")
    doc = F.col("doc_id")
    keys = F.array(*[F.lit(k) for k in UDF_KEYS])
    return d.select(F.lit(1).alias("object_type"), (doc * 2 + 1).alias("object_id"),
                    F.element_at(keys, (doc % len(UDF_KEYS) + 1).cast("int")).alias("key"),
                    F.split_part("text", F.lit("\n"), F.lit(1)).alias("value"))


register_cte("incoming_udfs", """
SELECT 1 AS object_type, doc_id * 2 + 1 AS object_id,
       (['headline','label','author','replies','date_created'])[CAST(doc_id % 5 + 1 AS INT)] AS key,
       split_part(text, chr(10), 1) AS value FROM documents""")


def _m(spark, sf):
    return NewsModel(spark, sf)


def _reasons_sql(rules: list[tuple[str, str]]) -> str:
    arr = ", ".join(f"CASE WHEN coalesce({ok}, false) THEN NULL ELSE '{name}' END" for name, ok in rules)
    return f"list_filter([{arr}], lambda x: x IS NOT NULL)"


_HDR_RULES = [("url_missing", "h.url IS NOT NULL"),
              ("url_invalid", f"regexp_matches(h.url, '{URL_RE}')"),
              ("url_too_long", "length(h.url) < 2048"),
              ("source_missing", "h.source_id IS NOT NULL"),
              ("source_not_positive", "h.source_id > 0"),
              ("source_unknown", "sh.id IS NOT NULL")]
_VALID_HEADERS = f"""
SELECT h.pos, h.url, h.source_id, coalesce(h.obsolete, false) AS obsolete, h.source_date,
       {_reasons_sql(_HDR_RULES)} AS reasons
FROM incoming_headers h LEFT JOIN source_header sh ON h.source_id = sh.id"""


@query("validate_headers", f"SELECT *, len(reasons) = 0 AS is_valid FROM ({_VALID_HEADERS}) v")
def q_validate_headers(spark, sf):
    m = _m(spark, sf)
    return I.validate_headers(incoming_headers(m), m.source_header)


_BODY_RULES = [("article_missing", "article_id IS NOT NULL"), ("article_not_positive", "article_id > 0"),
               ("headline_missing", "headline IS NOT NULL"), ("headline_too_long", "length(headline) <= 200"),
               ("body_missing", "body IS NOT NULL"), ("timestamp_missing", "proc_timestamp IS NOT NULL"),
               ("counter_negative", "proc_counter >= 0")]
_VALID_BODIES = f"""
SELECT article_id, headline, body, proc_timestamp, proc_counter, {_reasons_sql(_BODY_RULES)} AS reasons
FROM (SELECT article_id, headline, body, date_trunc('second', proc_timestamp) AS proc_timestamp,
             coalesce(proc_counter, 0) AS proc_counter FROM incoming_bodies) b"""


@query("validate_bodies", f"SELECT *, len(reasons) = 0 AS is_valid FROM ({_VALID_BODIES}) v")
def q_validate_bodies(spark, sf):
    return I.validate_bodies(incoming_bodies(_m(spark, sf)))


_CMT_RULES = [("body_id_missing", "article_body_id IS NOT NULL"), ("body_id_not_positive", "article_body_id > 0"),
              ("external_id_missing", "external_id IS NOT NULL"), ("level_missing", "level IS NOT NULL"),
              ("level_negative", "level >= 0"), ("body_missing", "body IS NOT NULL"),
              ("timestamp_missing", "proc_timestamp IS NOT NULL")]


@query("validate_comments", f"""
SELECT *, len(reasons) = 0 AS is_valid FROM (
SELECT pos, external_id, article_body_id, parent_id, level, body, proc_timestamp, {_reasons_sql(_CMT_RULES)} AS reasons
FROM incoming_comments) v""")
def q_validate_comments(spark, sf):
    return I.validate_comments(incoming_comments(_m(spark, sf)))


_VALID_UDFS = """
SELECT DISTINCT uh.id AS udf_id, u.object_type, u.object_id, u.value AS udf_value
FROM incoming_udfs u JOIN udf_header uh ON uh.udf_name = u.key
WHERE u.value IS NOT NULL AND length(u.value) <= 80"""


@query("validate_udfs", _VALID_UDFS)
def q_validate_udfs(spark, sf):
    m = _m(spark, sf)
    return I.validate_udfs(incoming_udfs(m), m.udf_header)


_DIFF = f"""
SELECT b.article_id, l.id AS old_id,
       (l.id IS NULL OR b.headline IS DISTINCT FROM l.headline OR b.body IS DISTINCT FROM l.body) AS "insert",
       CASE WHEN (l.id IS NULL OR b.headline IS DISTINCT FROM l.headline OR b.body IS DISTINCT FROM l.body)
            THEN b.proc_counter + 1 ELSE l.proc_counter + 1 END AS new_counter,
       b.headline, b.body, b.proc_timestamp
FROM ({_VALID_BODIES}) b
LEFT JOIN (SELECT ab.* FROM article_body_last_id v JOIN article_body ab ON ab.id = v.last_article_body_id) l
  ON b.article_id = l.article_id
WHERE len(b.reasons) = 0"""


def _diff(m: NewsModel) -> DataFrame:
    valid = I.validate_bodies(incoming_bodies(m)).filter("is_valid")
    return I.body_version_diff(valid, article_body_last(m))


@query("body_version_diff", f'SELECT article_id, old_id, "insert", new_counter FROM ({_DIFF}) d')
def q_body_version_diff(spark, sf):
    return _diff(_m(spark, sf)).select("article_id", "old_id", "insert", "new_counter")


@query("body_upsert", f"""
WITH d AS ({_DIFF})
SELECT 'update' AS op, old_id AS id, article_id, CAST(NULL AS VARCHAR) AS headline, CAST(NULL AS VARCHAR) AS body,
       CAST(NULL AS TIMESTAMP) AS proc_timestamp, new_counter AS proc_counter FROM d WHERE NOT "insert"
UNION ALL
SELECT 'insert', (SELECT coalesce(max(id), 0) FROM article_body) + row_number() OVER (ORDER BY article_id),
       article_id, headline, body, proc_timestamp, new_counter FROM d WHERE "insert" """)
def q_body_upsert(spark, sf):
    m = _m(spark, sf)
    return I.body_upsert(m.article_body, _diff(m))


@query("mark_obsolete", f"""
WITH bad AS (SELECT DISTINCT article_id FROM ({_VALID_BODIES}) b WHERE len(reasons) > 0)
SELECT ah.id, ah.source_id, ah.url, CASE WHEN bad.article_id IS NOT NULL THEN true ELSE ah.obsolete END AS obsolete,
       ah.source_date
FROM article_header ah LEFT JOIN bad ON bad.article_id = ah.id""")
def q_mark_obsolete(spark, sf):
    m = _m(spark, sf)
    bad = I.validate_bodies(incoming_bodies(m)).filter(~F.col("is_valid")).select(F.col("article_id").alias("id"))
    return I.mark_obsolete(m.article_header, bad)


_NEW_HEADERS = f"""
WITH v AS ({_VALID_HEADERS}),
ok AS (SELECT * FROM v WHERE len(reasons) = 0),
first AS (SELECT url, arg_min(pos, pos) AS pos FROM ok GROUP BY url),
batch AS (SELECT ok.* FROM ok JOIN first ON ok.url = first.url AND ok.pos = first.pos),
fresh AS (SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM article_header a WHERE a.url = b.url))
SELECT (SELECT coalesce(max(id), 0) FROM article_header) + row_number() OVER (ORDER BY pos) AS id,
       source_id, url, obsolete, source_date FROM fresh"""


@query("insert_ignore_headers", _NEW_HEADERS)
def q_insert_ignore_headers(spark, sf):
    m = _m(spark, sf)
    ok = I.validate_headers(incoming_headers(m), m.source_header).filter("is_valid").drop("reasons", "is_valid")
    fresh = I.insert_ignore(ok, m.article_header, ["url"], order_col="pos")
    start = m.article_header.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return dense_ids(fresh, ["pos"], start).select("id", "source_id", "url", "obsolete", "source_date")


def _existing_comment_keys(m: NewsModel) -> DataFrame:
    return m.comment.select(external_id_of(F.col("ext_key")).alias("external_id"), "id", "article_body_id")


_EXISTING_EXT = f"(SELECT {EXT_ID.format(k='ext_key')} AS external_id, id, article_body_id FROM comment)"
_NEW_COMMENTS = f"""
WITH ok AS (SELECT * FROM incoming_comments WHERE article_body_id > 0 AND level >= 0),
first AS (SELECT external_id, min(pos) AS pos FROM ok GROUP BY external_id),
batch AS (SELECT ok.* FROM ok JOIN first ON ok.external_id = first.external_id AND ok.pos = first.pos),
fresh AS (SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM {_EXISTING_EXT} e WHERE e.external_id = b.external_id))
SELECT (SELECT coalesce(max(id), 0) FROM comment) + row_number() OVER (ORDER BY pos) AS id,
       pos, external_id, article_body_id, parent_id, level, body, proc_timestamp FROM fresh"""


def _new_comments(m: NewsModel) -> DataFrame:
    ok = (I.validate_comments(incoming_comments(m)).filter("is_valid").drop("reasons", "is_valid"))
    fresh = I.insert_ignore(ok, _existing_comment_keys(m), ["external_id"], order_col="pos")
    start = m.comment.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return dense_ids(fresh, ["pos"], start).select("id", "pos", "external_id", "article_body_id", "parent_id",
                                                   "level", "body", "proc_timestamp")


@query("insert_ignore_comments", _NEW_COMMENTS)
def q_insert_ignore_comments(spark, sf):
    return _new_comments(_m(spark, sf))


def stored_comment_keys(m: NewsModel) -> KeyedStore:
    """The stored comments' external ids with their ids, written on first use in this application."""
    which = (m.spark.sparkContext.applicationId, m.sf_dir)
    with _KEYS_LOCK:
        if which not in _COMMENT_KEYS:
            name = f"comment_keys_{uuid.uuid4().hex}"
            store = KeyedStore(m.spark, name, scratch_path(m.spark, name), ["external_id"], parts=8, buckets=8)
            store.append(_existing_comment_keys(m).select("external_id", "id"))
            _COMMENT_KEYS[which] = store
    return _COMMENT_KEYS[which]


_KEYS_LOCK = threading.Lock()
_COMMENT_KEYS: dict[tuple[str, str], KeyedStore] = {}


@query("insert_ignore_colocated", _NEW_COMMENTS)
def q_insert_ignore_colocated(spark, sf):
    """W8 over the keyed store: keys decide and are numbered, the comments themselves join once by position."""
    m = _m(spark, sf)
    ok = I.validate_comments(incoming_comments(m)).filter("is_valid").drop("reasons", "is_valid")
    fresh = stored_comment_keys(m).fresh(ok.select("external_id", "pos"), "pos")
    start = m.comment.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return dense_ids(fresh.select("pos"), ["pos"], start).join(ok, "pos").select(
        "id", "pos", "external_id", "article_body_id", "parent_id", "level", "body", "proc_timestamp")


@query("insert_ignore_udfs", f"""
SELECT v.* FROM ({_VALID_UDFS}) v WHERE NOT EXISTS (SELECT 1 FROM udf_values u WHERE u.udf_id = v.udf_id
  AND u.object_type = v.object_type AND u.object_id = v.object_id AND u.udf_value = v.udf_value)""")
def q_insert_ignore_udfs(spark, sf):
    m = _m(spark, sf)
    key = ["udf_id", "object_type", "object_id", "udf_value"]
    return I.insert_ignore(I.validate_udfs(incoming_udfs(m), m.udf_header), m.udf_values, key)


@query("insert_ignore_dates", """
SELECT DISTINCT ah.source_id, CAST(b.proc_timestamp AS DATE) AS date_processed
FROM incoming_bodies b JOIN article_header ah ON ah.id = b.article_id
WHERE NOT EXISTS (SELECT 1 FROM crawl_dates_proc c WHERE c.source_id = ah.source_id
                  AND c.date_processed = CAST(b.proc_timestamp AS DATE))""")
def q_insert_ignore_dates(spark, sf):
    m = _m(spark, sf)
    inc = (incoming_bodies(m).join(m.article_header.select(F.col("id").alias("article_id"), "source_id"),
                                   "article_id", "inner")
           .select("source_id", F.col("proc_timestamp").cast("date").alias("date_processed")))
    return I.insert_ignore(inc, C.crawl_dates_proc(m), ["source_id", "date_processed"])


@query("resolve_ids", f"""
WITH nc AS ({_NEW_COMMENTS}),
allc AS (SELECT external_id, article_body_id, id FROM {_EXISTING_EXT} e
         UNION ALL SELECT external_id, article_body_id, id FROM nc)
SELECT i.pos, i.external_id, i.article_body_id, a.id FROM incoming_comments i
LEFT JOIN allc a ON a.external_id = i.external_id AND a.article_body_id = i.article_body_id""")
def q_resolve_ids(spark, sf):
    m = _m(spark, sf)
    allc = _existing_comment_keys(m).unionByName(_new_comments(m).select("external_id", "article_body_id", "id"))
    keys = incoming_comments(m).select("pos", "external_id", "article_body_id")
    return I.resolve_ids(keys, allc, ["external_id", "article_body_id"])


@query("comment_external_id", f"SELECT id, {EXT_ID.format(k='ext_key')} AS external_id FROM comment")
def q_comment_external_id(spark, sf):
    return _existing_comment_keys(_m(spark, sf)).select("id", "external_id")


@query("normalise_text",
       "SELECT doc_id, regexp_replace(translate(text, chr(10) || chr(9), '  '), "
       "'^[\\t\\n\\x0B\\f\\r ]+|[\\t\\n\\x0B\\f\\r ]+$', '', 'g') AS text_norm FROM documents")
def q_normalise_text(spark, sf):
    d = _m(spark, sf).table("documents")
    return d.select("doc_id", normalise_blanks(F.col("text")).alias("text_norm"))


@query("normalise_text_nfkd")
def q_normalise_text_nfkd(spark, sf):
    """W12 unicode part (no DuckDB NFKD): NFKD of the blank-normalised text."""
    d = small_batches(_m(spark, sf).table("documents").select("doc_id", normalise_blanks(F.col("text")).alias("text")))
    return d.select("doc_id", nfkd(F.col("text")).alias("text_nfkd"))


@query("initial_backoff", """
SELECT id, CAST(date_diff('day', source_date, DATE '2024-02-01') AS INT) AS age_days,
       CAST(CASE WHEN date_diff('day', source_date, DATE '2024-02-01') > 0
            THEN greatest(floor(log2(date_diff('day', source_date, DATE '2024-02-01') * 24)) - 1, 0) ELSE 0 END AS INT)
         AS backoff,
       CAST(CASE WHEN date_diff('day', source_date, DATE '2024-02-01') > 0
            THEN greatest(floor(log2(date_diff('day', source_date, DATE '2024-02-01') * 24)) - 1, 0) ELSE 0 END AS INT) + 1
         AS proc_counter
FROM article_header""")
def q_initial_backoff(spark, sf):
    ah = _m(spark, sf).article_header
    age = F.datediff(C.as_of_date(), F.col("source_date"))
    b = initial_backoff(age)
    return ah.select("id", age.alias("age_days"), b.alias("backoff"), (b + 1).alias("proc_counter"))


@query("cascade_delete", """
WITH dead AS (SELECT id FROM article_header WHERE obsolete),
dead_b AS (SELECT id FROM article_body WHERE article_id IN (SELECT id FROM dead))
SELECT 'article_header' AS table_name, count(*) AS n_rows FROM article_header WHERE id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'article_body', count(*) FROM article_body WHERE article_id NOT IN (SELECT id FROM dead)
UNION ALL SELECT 'comment', count(*) FROM comment WHERE article_body_id NOT IN (SELECT id FROM dead_b)
UNION ALL SELECT 'topic_detector_result', count(*) FROM label_topic
  WHERE article_header_id NOT IN (SELECT id FROM dead)""")
def q_cascade_delete(spark, sf):
    m = _m(spark, sf)
    dead = m.article_header.filter("obsolete").select("id")
    left = I.cascade_delete_articles(m.article_header, m.article_body, m.comment,
                                     C.topic_results(m), dead)
    out = None
    for name, df in left.items():
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = r if out is None else out.unionByName(r)
    return out


_FKS = [("article_body.article_id", "article_body", "article_id", "article_header", "id"),
        ("comment.article_body_id", "comment", "article_body_id", "article_body", "id"),
        ("udf_values.udf_id", "udf_values", "udf_id", "udf_header", "id"),
        ("analyzer_log.comment_id", "analyzer_log", "comment_id", "comment", "id"),
        ("analyzer1_result.comment_id", "analyzer1_result", "comment_id", "comment", "id"),
        ("analyzer1_result.analyzer_log_id", "analyzer1_result", "analyzer_log_id", "analyzer_log", "id"),
        ("crawl_log.source_id", "crawl_log", "source_id", "source_header", "id"),
        ("article_header.source_id", "article_header", "source_id", "source_header", "id"),
        ("topic_detector_result.lemma_id", "topic_detector_result", "lemma_id", "lemma_header", "id")]


# the SQL's names of the topic tables over all articles and lemmas
_ALL_TOPICS = {"topic_detector_result": "label_topic", "lemma_header": "label_lemma"}


@query("fk_violations", " UNION ALL ".join(
    f"SELECT '{n}' AS fk_constraint, count(*) AS n_violations FROM {_ALL_TOPICS.get(c, c)} x WHERE x.{fk} IS NOT NULL "
    f"AND NOT EXISTS (SELECT 1 FROM {_ALL_TOPICS.get(p, p)} y WHERE y.{pk} = x.{fk})" for n, c, fk, p, pk in _FKS))
def q_fk_violations(spark, sf):
    m = _m(spark, sf)
    tables = {"article_body": m.article_body, "article_header": m.article_header, "comment": m.comment,
              "udf_values": m.udf_values, "udf_header": m.udf_header, "analyzer_log": m.analyzer_log,
              "analyzer1_result": m.analyzer1_result, "crawl_log": m.crawl_log,
              "source_header": m.source_header, "topic_detector_result": C.topic_results(m),
              "lemma_header": C.label_lemmas(m)}
    return I.fk_violations([(n, tables[c], fk, tables[p], pk) for n, c, fk, p, pk in _FKS])


# ---- C1 / F10 / F11 ----------------------------------------------------------
@query("comment_thread_levels", """
WITH RECURSIVE p AS (SELECT c.id, CASE WHEN c.parent_id IN (SELECT id FROM comment) THEN c.parent_id END AS parent
                     FROM comment c),
t(id, root_id, depth) AS (SELECT id, id, 0 FROM p WHERE parent IS NULL
                          UNION ALL SELECT p.id, t.root_id, t.depth + 1 FROM p JOIN t ON p.parent = t.id)
SELECT id, root_id, depth FROM t""")
def q_comment_thread_levels(spark, sf):
    return CT.thread_levels(_m(spark, sf).comment)


def comment_tree_pages(m: NewsModel) -> DataFrame:
    """Stand-in raw comment pages: one JSON tree per (conversation, turn
    multiple of 3) nesting the next two turns as replies; the user object is
    absent on some replies (their subtree must be dropped)."""
    c = m.table("conversations").select("conv_id", "turn", "role", "text")
    ah = m.article_header.select(F.col("id").alias("article_id"), "url")

    def item(prefix: str) -> DataFrame:
        return c.select(F.col("conv_id").alias(f"{prefix}conv"), F.col("turn").alias(f"{prefix}turn"),
                        F.col("text").alias(f"{prefix}body"),
                        F.when((F.col("conv_id") % 10 == 0) & (F.col("turn") % 2 == 1), F.lit(None))
                         .otherwise(F.struct(F.col("role").alias("username"))).alias(f"{prefix}user"),
                        F.date_format(F.timestamp_add("HOUR", F.col("turn").cast("int"),
                                                      ts_ntz("2024-01-10 00:00:00")), "yyyy-MM-dd'T'HH:mm:ss")
                        .alias(f"{prefix}created"))
    a, b, d = item("a_"), item("b_"), item("c_")
    j = (a.filter(F.col("a_turn") % 3 == 0)
         .join(b, (F.col("b_conv") == F.col("a_conv")) & (F.col("b_turn") == F.col("a_turn") + 1), "left")
         .join(d, (F.col("c_conv") == F.col("a_conv")) & (F.col("c_turn") == F.col("a_turn") + 2), "left"))

    def node(p: str, replies):
        return F.struct(F.col(f"{p}body").alias("body"), F.col(f"{p}user").alias("user"),
                        F.col(f"{p}created").alias("created_at"), replies.alias("replies"))
    empty = F.array().cast("array<struct<body:string,user:struct<username:string>,created_at:string>>")
    leaf = F.when(F.col("c_turn").isNull(), empty).otherwise(
        F.array(F.struct(F.col("c_body").alias("body"), F.col("c_user").alias("user"),
                         F.col("c_created").alias("created_at"))))
    mid = F.when(F.col("b_turn").isNull(), F.array()).otherwise(F.array(F.to_json(node("b_", leaf))))
    tree = F.concat(F.lit('[{"body":'), F.to_json(F.array(F.col("a_body"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col("a_body")))) - 2),
                    F.lit(',"user":'), F.coalesce(F.to_json(F.col("a_user")), F.lit("null")),
                    F.lit(',"created_at":"'), F.col("a_created"), F.lit('","replies":['),
                    F.array_join(mid, ","), F.lit("]}]"))
    return (j.withColumn("article_id", F.col("a_conv") + 1).join(ah, "article_id", "inner")
            .select("url", tree.alias("tree")))


def _tree_items_sql(body: str) -> str:
    """The comments of the stand-in trees with their external ids; items without a user are not kept."""
    ext = EXT_ID.format(k='concat(url, "user", body)')
    return f"""
item AS (SELECT c.conv_id, c.turn, h.url, {body} AS body,
                CASE WHEN c.conv_id % 10 = 0 AND c.turn % 2 = 1 THEN NULL ELSE c.role END AS "user",
                strftime(TIMESTAMP '2024-01-10 00:00:00' + c.turn * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S') AS created_at
         FROM conversations c JOIN article_header h ON h.id = c.conv_id + 1),
kept AS (SELECT *, {ext} AS external_id FROM item WHERE "user" IS NOT NULL AND body IS NOT NULL)"""


def _tree_sql(body: str, levels: int) -> str:
    """Trees of ``levels`` consecutive turns: a comment is listed if its whole chain was kept."""
    return f"""
WITH RECURSIVE {_tree_items_sql(body)},
listed AS (SELECT kept.*, 0 AS level, CAST(NULL AS BIGINT) AS parent_external_id FROM kept WHERE turn % {levels} = 0
           UNION ALL SELECT kept.*, listed.level + 1, listed.external_id
           FROM listed JOIN kept ON kept.conv_id = listed.conv_id AND kept.turn = listed.turn + 1
           WHERE kept.turn % {levels} <> 0)
SELECT url, external_id, parent_external_id, level, body, "user", created_at FROM listed"""


@query("flatten_comment_tree", _tree_sql("c.text", 3))
def q_flatten_comment_tree(spark, sf):
    """Arbitrary-depth flattening of nested comment pages."""
    return CT.flatten_comment_tree(comment_tree_pages(_m(spark, sf)))


def titled_comment_pages(m: NewsModel) -> DataFrame:
    """Stand-in comment pages of outlet 3: items with title and plain author;
    a comment (even turn) and its reply (the next turn)."""
    def item(p: str) -> DataFrame:
        c = m.table("conversations")
        named = F.when((F.col("conv_id") % 10 != 0) | (F.col("turn") % 2 != 1), F.col("role"))
        created = F.timestamp_add("HOUR", F.col("turn").cast("int"), ts_ntz("2024-01-10 00:00:00"))
        return c.select(F.col("conv_id").alias(f"{p}conv"), F.col("turn").alias(f"{p}turn"), F.struct(
            F.concat(F.lit("Re: "), "role").alias("title"), F.col("text").alias("body"), named.alias("author"),
            F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss").alias("created_at")).alias(f"{p}item"))
    a, b = item("a_").filter("a_turn % 2 = 0"), item("b_").filter("b_turn % 2 = 1")
    j = a.join(b, (F.col("b_conv") == F.col("a_conv")) & (F.col("b_turn") == F.col("a_turn") + 1), "left")
    replies = F.array_compact(F.array("b_item")).alias("replies")
    ah = m.article_header.select(F.col("id").alias("article_id"), "url")
    return (j.join(ah, F.col("a_conv") + 1 == F.col("article_id"), "inner")
            .select("url", F.to_json(F.array(F.struct("a_item.*", replies))).alias("tree")))


@query("flatten_titled_comments", _tree_sql("'Re: ' || c.role || ' ' || c.text", 2))
def q_flatten_titled_comments(spark, sf):
    """C1 for outlet 3: title and author are required, the title leads the body."""
    return CT.flatten_comment_tree(titled_comment_pages(_m(spark, sf)), required=CT.REQUIRED_FIELDS_FAZ,
                                   title_in_body=True)


@query("comment_date_window", """
SELECT object_id, udf_value AS created_at FROM udf_values
WHERE object_type = 1 AND udf_id = 4 AND substring(udf_value, 1, 10) >= '2024-01-05'
  AND substring(udf_value, 1, 10) <= '2024-01-20'""")
def q_comment_date_window(spark, sf):
    uv = _m(spark, sf).udf_values.filter((F.col("object_type") == 1) & (F.col("udf_id") == 4))
    rows = uv.select("object_id", F.col("udf_value").alias("created_at"))
    return CT.comment_date_window(rows, "2024-01-05", "2024-01-20")


@query("top_level_comments", "SELECT id, article_body_id, body FROM comment WHERE parent_id IS NULL")
def q_top_level_comments(spark, sf):
    return CT.top_level_comments(_m(spark, sf).comment).select("id", "article_body_id", "body")


# ---- W13 / S4 ---------------------------------------------------------------------
def article_udfs(m: NewsModel) -> DataFrame:
    """Stand-in attribute values keyed by article (as a crawler holds them
    before the body id exists)."""
    d = m.table("documents").select("doc_id", "text")
    doc = F.col("doc_id")
    keys = F.array(*[F.lit(k) for k in UDF_KEYS])
    return d.select((doc + 1).alias("article_id"),
                    F.element_at(keys, (doc % len(UDF_KEYS) + 1).cast("int")).alias("key"),
                    F.split_part("text", F.lit("\n"), F.lit(1)).alias("value"))


@query("ingest_batch", f"""
WITH vb AS ({_VALID_BODIES}), d AS ({_DIFF}), nh AS ({_NEW_HEADERS}),
au AS (SELECT doc_id + 1 AS article_id,
              (['headline','label','author','replies','date_created'])[CAST(doc_id % 5 + 1 AS INT)] AS key,
              split_part(text, chr(10), 1) AS value FROM documents),
nu AS (SELECT DISTINCT uh.id AS udf_id, au.article_id, au.value FROM au JOIN udf_header uh ON uh.udf_name = au.key
       WHERE au.value IS NOT NULL AND length(au.value) <= 80
         AND au.article_id IN (SELECT article_id FROM d WHERE "insert"))
SELECT 'obsolete_marked' AS stage, count(DISTINCT article_id) AS n_rows FROM vb WHERE len(reasons) > 0
UNION ALL SELECT 'new_headers', count(*) FROM nh
UNION ALL SELECT 'new_bodies', count(*) FROM d WHERE "insert"
UNION ALL SELECT 'bumped_bodies', count(*) FROM d WHERE NOT "insert"
UNION ALL SELECT 'new_udfs', count(*) FROM nu""")
def q_ingest_batch(spark, sf):
    """Stage row counts of one ingest run (obsolete -> headers ->
    bodies -> attributes of new versions)."""
    m = _m(spark, sf)
    out = I.ingest_batch(incoming_headers(m), incoming_bodies(m), article_body_last(m), m.article_header,
                         m.source_header, m.udf_header, article_udfs(m))
    res = None
    for stage, df in out.items():
        r = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(stage).alias("stage"), "n_rows")
        res = r if res is None else res.unionByName(r)
    return res


@query("ingest_run", f"""
WITH vb AS ({_VALID_BODIES}), d AS ({_DIFF}), nh AS ({_NEW_HEADERS}),
au AS (SELECT doc_id + 1 AS article_id,
              (['headline','label','author','replies','date_created'])[CAST(doc_id % 5 + 1 AS INT)] AS key,
              split_part(text, chr(10), 1) AS value FROM documents),
nu AS (SELECT DISTINCT f.id AS udf_id, 1 AS object_type, article_id AS object_id, value AS udf_value
       FROM au JOIN udf_header f ON f.udf_name = au.key
       WHERE length(value) <= 80 AND article_id IN (SELECT article_id FROM d WHERE "insert")),
nb AS (SELECT (SELECT coalesce(max(id), 0) FROM article_body) + row_number() OVER (ORDER BY article_id) AS id, article_id, new_counter
       FROM d WHERE "insert")
SELECT 'article_header' AS table_name, id, url AS item,
       CAST(obsolete OR id IN (SELECT article_id FROM vb WHERE len(reasons) > 0) AS VARCHAR) AS state FROM article_header
UNION ALL SELECT 'article_header', id, url, CAST(obsolete AS VARCHAR) FROM nh
UNION ALL SELECT 'article_body', b.id, CAST(b.article_id AS VARCHAR), CAST(coalesce(d.new_counter, b.proc_counter) AS VARCHAR)
FROM article_body b LEFT JOIN d ON d.old_id = b.id AND NOT d."insert"
UNION ALL SELECT 'article_body', id, CAST(article_id AS VARCHAR), CAST(new_counter AS VARCHAR) FROM nb
UNION ALL SELECT 'udf_values', object_id, CAST(udf_id AS VARCHAR) || ':' || CAST(object_type AS VARCHAR), udf_value FROM
  (SELECT udf_id, object_type, object_id, udf_value FROM udf_values
   UNION ALL (SELECT * FROM nu EXCEPT SELECT udf_id, object_type, object_id, udf_value FROM udf_values)) u""")
def q_ingest_run(spark, sf):
    """The store's tables after one atomic run, which is then repeated without effect."""
    m = _m(spark, sf)
    stored = {"article_header": ("id", m.article_header), "article_body": ("id", m.article_body),
              "udf_values": ("object_id", m.udf_values.select("udf_id", "object_type", "object_id", "udf_value"))}
    store = RunStore(spark, scratch_path(spark, f"runs-{uuid.uuid4().hex}"),
                     [Table(name, key, df.schema) for name, (key, df) in stored.items()])
    store.commit(0, {name: initial(df, key) for name, (key, df) in stored.items()})
    for _ in range(2):
        I.ingest_run(store, 1, incoming_headers(m), incoming_bodies(m), m.source_header, m.udf_header, article_udfs(m))

    def shown(name: str, key: str, item, state) -> DataFrame:
        return store.read(name).select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("id"),
                                       item.cast("string").alias("item"), state.cast("string").alias("state"))
    udf = F.concat_ws(":", F.col("udf_id").cast("string"), F.col("object_type").cast("string"))
    return (shown("article_header", "id", F.col("url"), F.col("obsolete"))
            .unionByName(shown("article_body", "id", F.col("article_id"), F.col("proc_counter")))
            .unionByName(shown("udf_values", "object_id", udf, F.col("udf_value"))))


def article_documents(m: NewsModel) -> DataFrame:
    """Stand-in article JSON documents (one per document row)."""
    from opinio.sources.article_json import ARTICLE_SCHEMA  # noqa: F401  (shape reference)
    d = m.table("documents").select("doc_id", "text", "lang", "source")
    doc = F.col("doc_id")
    day = F.lpad((doc % 28 + 1).cast("string"), 2, "0")
    first = F.split_part("text", F.lit("\n"), F.lit(1))
    doc_struct = F.struct(
        F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), doc.cast("string")).alias("url"),
        doc.cast("string").alias("id"), F.col("lang").alias("channel"), F.lit(None).cast("string").alias("subchannel"),
        F.struct(first.alias("main"), F.when(doc % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("S: "), first))
                 .alias("social")).alias("headline"),
        F.lit("").alias("intro"), F.col("text").alias("text"),
        F.array(F.col("source"), F.col("lang")).alias("topics"),
        F.struct(F.lit("ab").alias("abbreviation"), F.array().cast("array<string>").alias("departments"),
                 F.array(F.concat(F.lit("author-"), (doc % 17).cast("string"))).alias("names")).alias("author"),
        (doc % 2 == 0).alias("comments_enabled"),
        F.concat(F.lit("2024-01-"), day, F.lit("T08:00:00+01:00")).alias("date_created"),
        F.when(doc % 2 == 0, F.lit(None)).otherwise(F.concat(F.lit("2024-01-"), day, F.lit("T09:30:00+01:00")))
        .alias("date_modified"),
        F.concat(F.lit("2024-01-"), day, F.lit("T08:00:00+01:00")).alias("date_published"),
        F.array(F.lit("news"), F.col("lang")).alias("breadcrumbs"))
    return d.select(F.to_json(doc_struct).alias("value"))


@query("article_json_flatten", """
WITH a AS (SELECT concat('https://news.example/', source, '/', CAST(doc_id AS VARCHAR)) AS url, doc_id, source, lang,
                  split_part(text, chr(10), 1) AS first,
                  concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')) AS day FROM documents)
SELECT url, 'label' AS key, source AS value FROM a
UNION ALL SELECT url, 'label', lang FROM a
UNION ALL SELECT url, 'author', concat('author-', CAST(doc_id % 17 AS VARCHAR)) FROM a
UNION ALL SELECT url, 'headline', concat('S: ', first) FROM a WHERE doc_id % 3 <> 0
UNION ALL SELECT url, 'date_created', concat(day, 'T08:00:00+01:00') FROM a
UNION ALL SELECT url, 'date_modified', concat(day, 'T09:30:00+01:00') FROM a WHERE doc_id % 2 <> 0
UNION ALL SELECT url, 'date_published', concat(day, 'T08:00:00+01:00') FROM a""")
def q_article_json_flatten(spark, sf):
    """Nested article JSON written as JSON lines, read back with the
    declared schema and flattened to attribute rows."""
    from opinio.sources.article_json import article_attributes, read_articles
    path = scratch_path(spark, f"articles-{uuid.uuid4().hex}")
    article_documents(_m(spark, sf)).write.text(path)
    return article_attributes(read_articles(spark, path))
