"""Micro-batch forms of the reference's polling jobs.

The reference polls every few minutes and keeps progress in log tables.
Here the same work runs as Structured Streaming over a file source:

* R1 ``stream_score_comments``: new comment files -> lexicon sentiment per
  micro-batch -> results appended; the streaming checkpoint replaces the
  analyzer log (a comment is scored exactly once).
* R2 ``stream_dedup_comments``: insert-or-ignore on external id across polls:
  of a micro-batch's rows the first of each id is kept, and only of ids that were never
  seen. The ids are keyed state (``streaming/state.py``), so a copy is ignored however
  late it comes and the sink is never read.
* R3 ``stream_daily_sentiment``: additive (day, sum, count) partials per
  micro-batch, summed when read; no row is too late.
  ``stream_daily_window`` keeps the days as event-time windows with a watermark, and
  rows beyond the watermark in a side table.
* R4 ``stream_revisit``: revisit times per article as keyed state with timers.

Sinks are idempotent: every micro-batch overwrites its own ``batch_id=N``
folder, so a batch replayed after a failure rewrites the same files.
All folders live below the shared checkpoint directory.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from opinio.operators.sentiment import lexicon_sentiment
from opinio.session import scratch_path
from opinio.streaming.state import HOUR_MS, PAGE_BITS, FirstCopies, Revisits, rocksdb_state, smallest_rows

REVISIT_INPUT = ("article_id long, obsolete boolean, article_body_id long, proc_ms long, proc_counter int, clock timestamp")


def new_stream_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stage_files(df: DataFrame, path: str) -> str:
    """Add ``df`` to a file-source input, as many files as it has partitions."""
    df.write.mode("append").parquet(path)
    return path


def _run(writer, checkpoint: str):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def stream_score_comments(spark: SparkSession, source: str, schema, lexicon: DataFrame, out: str,
                          checkpoint: str, max_files: int = 1) -> DataFrame:
    """Score comment files as they arrive; returns the result table."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def score(batch: DataFrame, batch_id: int) -> None:
        texts = batch.select("id", F.col("body").alias("text"))
        res = lexicon_sentiment(texts, lexicon, "id", "text")
        res.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    _run(stream.writeStream.foreachBatch(score), checkpoint)
    return spark.read.parquet(out).drop("batch_id")


def stream_dedup_comments(spark: SparkSession, source: str, schema, out: str, checkpoint: str,
                          max_files: int = 1000) -> DataFrame:
    """R2: one poll over the files that are new since the last one; the first
    copy of each external id wins across polls (inside a micro-batch the
    earliest ``event_ts``, then the smallest row). Copies within a batch of rows go
    before the exchange, so a hot id costs a row a batch; rows without an id are one key."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    order = ["event_ts", *(c for c in stream.columns if c not in ("external_id", "event_ts"))]

    def thin(batches):
        for rows in batches:
            yield smallest_rows(rows, "external_id", order)

    first = (stream.mapInPandas(thin, stream.schema).groupBy("external_id")
             .transformWithState(FirstCopies(order), stream.schema, "append", "none"))
    _run_state(spark, first.writeStream.outputMode("append").foreachBatch(_append_batches(out)), checkpoint)
    return _read_batches(spark, out, stream.schema)


def _append_batches(out: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def _read_batches(spark: SparkSession, out: str, schema: StructType) -> DataFrame:
    """The sink's rows; an empty table if no micro-batch has run yet."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/batch_id=-1")
    return spark.read.schema(StructType([*schema.fields, StructField("batch_id", LongType())])).parquet(out)


def _run_state(spark: SparkSession, writer, checkpoint: str) -> None:
    with rocksdb_state(spark):
        _run(writer, checkpoint)


def stream_revisit(spark: SparkSession, source: str, out: str, checkpoint: str, clock_delay: str = "1 hour",
                   hour_ms: int = HOUR_MS, max_files: int = 1000) -> DataFrame:
    """One poll over new announcements and visits; returns the status of every
    article: ``missing_body``, ``scheduled``, ``review_now`` (due), ``finished`` or ``obsolete``.

    Time is the poll's own: rows carry ``clock`` = the poll's time plus ``clock_delay``, so that the
    watermark ends at the poll's time, no row of a poll is late, and a repeated run gives
    the same. Only pages of articles with new rows or a timer that expired are touched."""
    stream = spark.readStream.schema(REVISIT_INPUT).option("maxFilesPerTrigger", max_files).parquet(source)
    none = F.lit(-1)  # instead of nulls, which pandas would turn into floats
    ids = [F.coalesce(c, none.cast(t)).alias(c) for c, t in (("article_id", "long"), ("article_body_id", "long"),
                                                             ("proc_ms", "long"), ("proc_counter", "int"))]
    stream = stream.select(*ids, F.coalesce("obsolete", F.lit(False)).alias("obsolete"), "clock")
    stream = stream.withColumn("page", F.shiftright("article_id", PAGE_BITS))
    changes = stream.withWatermark("clock", clock_delay).groupBy("page").transformWithState(
        Revisits(hour_ms), Revisits.OUTPUT, "append", "eventTime")
    _run_state(spark, changes.writeStream.outputMode("append").foreachBatch(_append_batches(out)), checkpoint)
    log = _read_batches(spark, out, changes.schema).drop("batch_id")
    version = F.struct("phase", "article_body_id", "proc_counter", "proc_ms")
    newest = F.struct(F.when(F.col("status") == "obsolete", 1).otherwise(0), "article_body_id", "proc_counter", "proc_ms", version)
    last = log.groupBy("article_id").agg(F.max_by(F.struct("article_body_id", "proc_counter", "due_ms", "status"), newest).alias("r"))
    body = F.when(F.col("r.article_body_id") >= 0, F.col("r.article_body_id"))
    return last.select("article_id", body.alias("article_body_id"), F.when(body.isNotNull(), F.col("r.proc_counter")).alias("proc_counter"),
                       "r.due_ms", "r.status")


def day_event_time(d) -> "F.Column":
    """Event time (TIMESTAMP) at UTC midnight of a date, independent of the
    session time zone, so one-day windows align with calendar days."""
    return F.timestamp_seconds(F.unix_date(d).cast("long") * 86400)


def stream_daily_sentiment(spark: SparkSession, source: str, schema, out: str, checkpoint: str,
                           max_files: int = 4) -> DataFrame:
    """Average sentiment and count per day of comment creation (``ts``
    is the event time, see ``day_event_time``)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        day = F.date_from_unix_date(F.floor(F.unix_seconds(F.col("ts")) / 86400).cast("int"))
        (batch.groupBy(day.alias("day")).agg(F.sum("sentiment_value").alias("s"), F.count(F.lit(1)).alias("n"))
         .write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}"))

    _run(stream.writeStream.foreachBatch(write), checkpoint)
    partials = spark.read.schema("day date, s double, n bigint, batch_id bigint").parquet(out)
    total = partials.groupBy("day").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return total.select("day", F.round(F.col("s") / F.col("n"), 9).alias("avg_sentiment"),
                        F.col("n").alias("n_comments"))


def stream_daily_window(spark: SparkSession, source: str, schema, out: str, checkpoint: str,
                        delay_days: int = 3, max_files: int = 4) -> DataFrame:
    """R3 with event-time windows: average sentiment and count per day of ``ts``.

    1. Each micro-batch is written once, split by its own watermark: the latest time of
       all earlier micro-batches (a mark file a batch) less ``delay_days``. Rows whose
       day ended before it, or without a time, go to the side table.
    2. The rows in time feed one-day windows with ``withWatermark`` in update mode, all files of
       a poll as one micro-batch. The watermark then comes from earlier polls only, never beyond
       that of step 1, so no window drops a row (checked: a dropped row raises).

    Windows plus side table hold every row; window state is bounded by the delay."""
    seconds = delay_days * 86400
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source)
    kept = "ts timestamp, sentiment_value double"

    def split(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        mark = None
        if batch_id > 0:
            mark = session.read.schema("high long").parquet(f"{out}/marks/{batch_id - 1}").first()["high"]
        at = F.unix_seconds(F.col("ts"))
        day_end = (F.floor(at / 86400) + 1) * 86400
        late = F.col("ts").isNull() if mark is None else F.coalesce(day_end <= mark - seconds, F.lit(True))
        path = f"{out}/split/batch_id={batch_id}"
        batch.select("ts", "sentiment_value", late.alias("late")).write.mode("overwrite").partitionBy("late").parquet(path)
        high = session.read.schema(f"{kept}, late boolean").parquet(path).agg(F.max(at).alias("high"))
        high.select(F.greatest("high", F.lit(mark).cast("long")).alias("high")).write.mode("overwrite").parquet(f"{out}/marks/{batch_id}")

    _run(stream.writeStream.foreachBatch(split), f"{checkpoint}/split")
    in_time = spark.readStream.schema(kept).parquet(f"{out}/split/*/late=false")
    windows = (in_time.withWatermark("ts", f"{delay_days} days").groupBy(F.window("ts", "1 day").alias("w"))
               .agg(F.sum("sentiment_value").alias("s"), F.count(F.lit(1)).alias("n"))
               .select(F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("day"), "s", "n"))
    query = _run(windows.writeStream.outputMode("update").foreachBatch(_append_batches(f"{out}/windows")), f"{checkpoint}/windows")
    dropped = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if dropped:
        raise RuntimeError(f"{dropped} rows behind the windows' watermark that the split took as in time")
    day = F.date_from_unix_date(F.floor(F.unix_seconds("ts") / 86400).cast("int"))
    side = (spark.read.schema(f"{kept}, late boolean, batch_id long").parquet(f"{out}/split").where("late")
            .groupBy(day.alias("day")).agg(F.sum("sentiment_value").alias("s"), F.count(F.lit(1)).alias("n")))
    last = (_read_batches(spark, f"{out}/windows", windows.schema).groupBy("day")
            .agg(F.max_by(F.struct("s", "n"), "batch_id").alias("r")).select("day", "r.s", "r.n"))
    total = last.unionByName(side).groupBy("day").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return total.select("day", F.round(F.col("s") / F.col("n"), 9).alias("avg_sentiment"), F.col("n").alias("n_comments"))
