"""Streams keep every row, however files and copies arrive."""

import datetime as dt

from pyspark.sql import functions as F

from opinio.streaming import jobs as J


def test_copies_hours_apart_are_inserted_once(spark):
    base = J.new_stream_dir(spark, "t-dedup")
    schema = "external_id long, article_body_id long, level int, body string, event_ts timestamp_ntz"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    polls = [[(1, 10, 0, "a", at(0)), (2, 10, 0, "b", at(0))], [(1, 10, 0, "a", at(10)), (3, 11, 0, "c", at(9))],
             [(3, 11, 0, "c", at(1)), (2, 10, 0, "b", at(23)), (4, 11, 1, "d", at(5)), (4, 11, 1, "d", at(2))]]
    for rows in polls:
        J.stage_files(spark.createDataFrame(rows, schema).repartition(3), f"{base}/in")
        out = J.stream_dedup_comments(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ckpt")
    assert {(r.external_id, r.event_ts.hour) for r in out.collect()} == {(1, 0), (2, 0), (3, 9), (4, 2)}
    assert out.count() == 4


def test_daily_sums_with_files_in_any_order(spark):
    base = J.new_stream_dir(spark, "t-daily")
    rows = (spark.range(4000).select(F.col("id").alias("comment_id"), (F.col("id") % 7).cast("double").alias("sentiment_value"),
                                     J.day_event_time(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 90).cast("int"))).alias("ts"))
            .repartition(9))
    J.stage_files(rows, f"{base}/in")
    out = J.stream_daily_sentiment(spark, f"{base}/in", "comment_id long, sentiment_value double, ts timestamp", f"{base}/out",
                                   f"{base}/ckpt", max_files=2)
    assert out.agg(F.sum("n_comments")).first()[0] == 4000 and out.count() == 90
