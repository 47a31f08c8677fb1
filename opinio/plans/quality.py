"""Data-quality reports (Q1-Q5): missing children, orphans, typed attributes.

Every "LEFT JOIN ... WHERE right IS NULL" of the reference is a
``left_anti`` join here (one shuffle on the key, no NULL-padded rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.functions.dates import parse_date_prefix
from opinio.sources.news_model import NewsModel, ts_ntz

AS_OF = "2024-02-01 00:00:00"


def headers_without_body(m: NewsModel) -> DataFrame:
    """Q1: current articles that have no body version at all."""
    ah = m.article_header.filter(~F.col("obsolete"))
    ab = m.article_body.select("article_id")
    return (ah.join(ab, ah.id == ab.article_id, "left_anti")
            .select("id", "url", "source_id", "source_date"))


def bodies_without_comments(m: NewsModel) -> DataFrame:
    """Q2: every body version (not only the last) of a current article that
    has no comment."""
    ah = m.article_header.filter(~F.col("obsolete")).select("id", "url", "source_id", "source_date")
    ab = m.article_body.select(F.col("id").alias("ab_id"), "article_id", "proc_timestamp", "proc_counter")
    ct = m.comment.select("article_body_id")
    lonely = ab.join(ct, ab.ab_id == ct.article_body_id, "left_anti")
    return (lonely.join(ah, lonely.article_id == ah.id, "inner")
            .select("id", "url", "source_id", "source_date", "proc_timestamp", "proc_counter"))


def orphan_udf_values(m: NewsModel) -> DataFrame:
    """Q3: attribute values whose object (body / comment) does not exist,
    both object types, de-duplicated like SQL UNION."""
    uv = m.udf_values
    ab = m.article_body.select(F.col("id").alias("oid"))
    ct = m.comment.select(F.col("id").alias("oid"))
    cols = ["udf_id", "err_msg", "object_id", "udf_value"]
    a = (uv.filter(F.col("object_type") == 1).join(ab, uv.object_id == ab.oid, "left_anti")
         .withColumn("err_msg", F.lit("udf without article_body attached")).select(*cols))
    c = (uv.filter(F.col("object_type") == 2).join(ct, uv.object_id == ct.oid, "left_anti")
         .withColumn("err_msg", F.lit("udf without comment attached")).select(*cols))
    return a.unionByName(c).distinct()


def comments_without_date(m: NewsModel, as_of: str = AS_OF, min_age_hours: int = 3) -> DataFrame:
    """Q4: comments lacking date_created, processed more than 3 h before as_of."""
    limit = F.timestamp_add("HOUR", F.lit(-min_age_hours), ts_ntz(as_of))
    co = (m.comment.filter(F.col("date_created").isNull() & (F.col("proc_timestamp") < limit))
          .select(F.col("id").alias("co_id"), "article_body_id"))
    ab = m.article_body.select(F.col("id").alias("ab_id"), "article_id")
    ah = m.article_header.select(F.col("id").alias("ah_id"))
    return (co.join(ab, co.article_body_id == ab.ab_id, "inner")
            .join(ah, F.col("article_id") == ah.ah_id, "inner")
            .select("ah_id", "ab_id", "co_id"))


def _typed(m: NewsModel, udf_type: str, convert) -> DataFrame:
    last = m.article_body_last_id
    uh = F.broadcast(m.udf_header.filter(F.col("udf_type") == udf_type)
                     .select(F.col("id").alias("udf_id"), "udf_name"))
    uv = m.udf_values.filter(F.col("object_type") == 1)
    j = (last.join(uv, last.last_article_body_id == uv.object_id, "inner")
         .join(uh, "udf_id", "inner"))
    return j.select("article_id", F.col("last_article_body_id").alias("article_body_id"),
                    "udf_id", "udf_name", "object_type",
                    convert(F.col("udf_value")).alias("udf_value_format"))


def _as_int(v: Column) -> Column:
    return v.try_cast("int")


def _as_double(v: Column) -> Column:
    return v.try_cast("double")


TYPED_VIEWS = {
    # view key: (udf_type filtered on, conversion)
    "udf_date": ("date", parse_date_prefix),
    "udf_datetime": ("datetime", parse_date_prefix),
    "udf_string": ("string", lambda v: v),
    "udf_integer": ("integer", _as_int),
    # the reference's double view filters 'integer' (copy-paste); we filter
    # 'double' by default and keep the literal form behind ``literal=True``
    "udf_double": ("double", _as_double),
}


def typed_udf_view(m: NewsModel, key: str, literal: bool = False) -> DataFrame:
    """Q5: attributes of the latest body of each article, converted to a type
    (dirty values become NULL instead of raising)."""
    udf_type, conv = TYPED_VIEWS[key]
    if key == "udf_double" and literal:
        udf_type = "integer"
    return _typed(m, udf_type, conv)
