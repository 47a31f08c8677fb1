"""Nested article JSON documents (S4) -> header, body and attribute rows.

The schema is declared (no inference). Flattening turns one document into
the rows the store keeps: the header (url, source date), the body
(headline, text) and attribute values (key, value) -- topics become
'label' values, author names 'author', timestamps their string values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_SCHEMA = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("subchannel", T.StringType()),
    T.StructField("headline", T.StructType([T.StructField("main", T.StringType()),
                                            T.StructField("social", T.StringType())])),
    T.StructField("intro", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
    T.StructField("author", T.StructType([T.StructField("abbreviation", T.StringType()),
                                          T.StructField("departments", T.ArrayType(T.StringType())),
                                          T.StructField("names", T.ArrayType(T.StringType()))])),
    T.StructField("comments_enabled", T.BooleanType()),
    T.StructField("date_created", T.StringType()),
    T.StructField("date_modified", T.StringType()),
    T.StructField("date_published", T.StringType()),
    T.StructField("breadcrumbs", T.ArrayType(T.StringType())),
])


def read_articles(spark, path: str) -> DataFrame:
    return spark.read.schema(ARTICLE_SCHEMA).json(path)


def article_rows(articles: DataFrame) -> DataFrame:
    """Header and body columns per article."""
    return articles.select(
        "url", F.col("id").alias("external_id"),
        F.try_to_date(F.substring("date_published", 1, 10), "yyyy-MM-dd").alias("source_date"),
        F.col("headline.main").alias("headline"),
        F.concat_ws(" ", F.col("intro"), F.col("text")).alias("body"),
        F.coalesce(F.col("comments_enabled"), F.lit(False)).alias("comments_enabled"))


def article_attributes(articles: DataFrame) -> DataFrame:
    """(url, key, value) attribute rows: topics -> label, author names ->
    author, the social headline, and the three timestamps as text."""
    kv = F.array_compact(F.concat(
        F.transform(F.coalesce(F.col("topics"), F.array()), lambda t: F.struct(F.lit("label").alias("key"),
                                                                                t.alias("value"))),
        F.transform(F.coalesce(F.col("author.names"), F.array()), lambda n: F.struct(F.lit("author").alias("key"),
                                                                                      n.alias("value"))),
        F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("key"), F.col(c).alias("value")))
                  for k, c in (("headline", "headline.social"), ("date_created", "date_created"),
                               ("date_modified", "date_modified"), ("date_published", "date_published"))])))
    return articles.select("url", F.explode(kv).alias("kv")).select("url", "kv.key", "kv.value")
