"""Incremental control: to-do sets, run guards, run windows, logs, watermarks.

The reference keeps its incremental state in log tables and views evaluated
against ``now()``. Here every function is a pure ``tables -> DataFrame`` job
with an explicit ``as_of`` timestamp; "UPDATE"/"INSERT" become new table
versions (a rewritten DataFrame or the rows to append).

Scale notes: to-do sets are anti-joins (one shuffle on the key); watermarks
are uncorrelated scalar subqueries (``DataFrame.scalar()``), evaluated once
and inlined as literals; generated ids come from ``dense_ids`` (no one-task window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.functions.dates import parse_date_prefix
from opinio.functions.numeric import power2
from opinio.operators.ids import dense_ids
from opinio.plans.marts import article_body_last, article_header_current
from opinio.sources.news_model import NewsModel, date_lit, ts_ntz

AS_OF = "2024-02-01 00:00:00"
MAX_REVISITS = 14            # proc_counter limit of the revisit schedule
ANALYZER_GUARD_MIN = 30      # analyzer run guard (minutes)
SCRAPER_GUARD_MIN = 5 * 60   # scraper run guard (minutes)
NEVER_SECONDS = 1000 * 86400  # "no unfinished run" is treated as 1000 days
BATCH_SIZE = 1000
DEFAULT_LAST_RUN = "1990-01-01 00:00:00"
WINDOW_DAYS = {1: 30, 2: 30, 3: 20}  # regular run look-back per source (FAZ 20)
BACKFILL_DAYS = 7
EPOCH = "1970-01-01"


def as_of_ts(as_of: str = AS_OF) -> Column:
    return ts_ntz(as_of)


def as_of_date(as_of: str = AS_OF) -> Column:
    return ts_ntz(as_of).cast("date")


# ---- T2 crawl to-do ------------------------------------------------------------
def todo_crawl(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """Current articles (a) without any body -> ``missing_body``; (b) whose
    latest body is due for a revisit -> ``review_now``: fewer than 14 visits
    and ``as_of > proc_timestamp + (2^n - 1) h`` (the shown next_review uses
    2^n h, as in the reference).

    The reference combines both with UNION; the branches are disjoint (with
    vs. without a body) and each is unique per article, so a plain union gives
    the same rows without a de-duplicating shuffle of the wide body rows."""
    cur = article_header_current(m)
    last = article_body_last(m).select(
        F.col("id").alias("article_body_id"), F.col("article_id").alias("b_article_id"),
        "headline", "body", "proc_timestamp", "proc_counter")
    cols = cur.columns + ["article_body_id", "headline", "body", "proc_timestamp", "proc_counter"]
    stored = m.article_body.select(F.col("article_id").alias("b_article_id"))   # ids only
    missing = (cur.join(stored, cur.article_id == stored.b_article_id, "left_anti")
               .select(*cur.columns,
                       F.lit(None).cast("bigint").alias("article_body_id"),
                       F.lit(None).cast("string").alias("headline"),
                       F.lit(None).cast("string").alias("body"),
                       F.lit(None).cast("timestamp_ntz").alias("proc_timestamp"),
                       F.lit(None).cast("int").alias("proc_counter"),
                       F.lit(0.0).alias("review_hours"),
                       F.timestamp_add("HOUR", F.lit(-1), as_of_ts(as_of)).alias("next_review"),
                       F.lit("missing_body").alias("status")))
    n = F.col("proc_counter")
    due = (cur.join(last, cur.article_id == last.b_article_id, "inner")
           .filter((n < MAX_REVISITS) &
                   (as_of_ts(as_of) > F.timestamp_add("HOUR", (power2(n) - 1).cast("int"),
                                                      F.col("proc_timestamp"))))
           .select(*cols, power2(n).alias("review_hours"),
                   F.timestamp_add("HOUR", power2(n).cast("int"), F.col("proc_timestamp"))
                   .alias("next_review"),
                   F.lit("review_now").alias("status")))
    return missing.unionByName(due)


# ---- T3 / J5 / O3 / T4 analyzer to-do -------------------------------------------
def _comment_cols(c: DataFrame) -> list[Column]:
    return [F.col("id").alias("comment_id"), F.col("level").alias("comment_level"),
            F.col("body").alias("comment_body")]


_LOG_COLS = ["analyzer_id", "start_timestamp", "end_timestamp", "success"]


def _new_and_open(m: NewsModel, c: DataFrame) -> DataFrame:
    """The comments ``c`` without any log row ('new'), and one row per open log
    row of analyzer 1 ('re-run'). The log is reduced before each join: to its
    distinct comment ids (a comment logged a million times is one row per map
    task) and to the open rows."""
    al = m.analyzer_log
    logged = al.select(F.col("comment_id").alias("l_cid")).distinct()
    none = [F.lit(None).cast(al.schema[k].dataType).alias(k) for k in _LOG_COLS]
    new = (c.join(logged, c.comment_id == logged.l_cid, "left_anti")
           .select(*c.columns, *none, F.lit("new").alias("status")))
    still_open = (al.filter((F.col("analyzer_id") == 1) & F.col("end_timestamp").isNull())
                  .select(F.col("comment_id").alias("l_cid"), *_LOG_COLS))
    again = (c.join(still_open, c.comment_id == still_open.l_cid, "inner")
             .select(*c.columns, *_LOG_COLS, F.lit("re-run").alias("status")))
    return new.unionByName(again)


def todo_analyzer_v1(m: NewsModel) -> DataFrame:
    """T3 first generation (J5): comments never logged, or whose log row of
    analyzer 1 is unfinished."""
    return _new_and_open(m, m.comment.select(*_comment_cols(m.comment)))


def todo_analyzer_v2(m: NewsModel) -> DataFrame:
    """T3 second generation: as v1, restricted to comments whose body and
    article exist, with the article's source_date."""
    ah = m.article_header.select(F.col("id").alias("article_id"), "source_date")
    ab = m.article_body.select(F.col("id").alias("ab_id"), "article_id")
    c = (m.comment.join(ab, m.comment.article_body_id == ab.ab_id, "inner")
         .join(ah, "article_id", "inner")
         .select(*_comment_cols(m.comment), "source_date"))
    return _new_and_open(m, c)


def todo_analyzer(m: NewsModel) -> DataFrame:
    """T3 current generation: comments with a creation date that no analyzer
    has logged yet (anti-join); status is always 'new'."""
    c = m.comment.filter(F.col("date_created").isNotNull())
    al = m.analyzer_log.select(F.col("comment_id").alias("l_cid"))
    todo = c.join(al, c.id == al.l_cid, "left_anti")
    return todo.select(*_comment_cols(c), F.col("date_created").alias("source_date"),
                       F.lit(None).cast("int").alias("analyzer_id"),
                       F.lit(None).cast("timestamp_ntz").alias("start_timestamp"),
                       F.lit(None).cast("timestamp_ntz").alias("end_timestamp"),
                       F.lit(None).cast("boolean").alias("success"),
                       F.lit("new").alias("status"))


def todo_analyzer_next(m: NewsModel, limit: int | None = BATCH_SIZE) -> DataFrame:
    """O3: the next batch: lowest level first, newest date first, limited.
    A comment-id tie-break makes the batch deterministic (top-k per task,
    then a merge of k rows per task: TakeOrderedAndProject). ``limit=None`` is the
    whole queue, in no order."""
    t = todo_analyzer(m).filter(F.col("start_timestamp").isNull())
    if limit is None:
        return t
    return t.orderBy(F.col("comment_level").asc(), F.col("source_date").desc(),
                     F.col("comment_id").asc()).limit(limit)


# The reference joins on a view / table name taken from analyzer_header;
# here the registry maps that name to a DataFrame builder (no dynamic SQL).
ANALYZER_VIEWS = {"v_todo_analyzer1_next": todo_analyzer_next}


def analyzer_todo(m: NewsModel, analyzer_id: int = 1, limit: int | None = BATCH_SIZE) -> DataFrame:
    """The next to-do batch of an analyzer, resolved through the registry
    (fixed rows of analyzer_header: id -> view name -> builder)."""
    from opinio.sources.news_model import ANALYZERS
    view = {a[0]: a[3] for a in ANALYZERS}[analyzer_id]
    return ANALYZER_VIEWS[view](m, limit)


def max_id(df: DataFrame, col: str = "id") -> Column:
    """``coalesce(max(id), 0)`` as an uncorrelated scalar subquery."""
    return df.agg(F.coalesce(F.max(col), F.lit(0)).cast("bigint")).scalar()


def analyzer_batch_start(m: NewsModel, analyzer_id: int = 1, as_of: str = AS_OF,
                         limit: int | None = None) -> DataFrame:
    """T4: the batch as a set of comment ids, logged as started: the log rows to
    append, ids continuing after the current max id in comment-id order. By default
    the whole queue is one batch; ``limit=BATCH_SIZE`` is the reference's. Only the
    comment ids are ranged and numbered, no text moves."""
    batch = analyzer_todo(m, analyzer_id, limit).select("comment_id").distinct()
    return dense_ids(batch, ["comment_id"], max_id(m.analyzer_log)).select(
        "id",
        "comment_id",
        F.lit(analyzer_id).alias("analyzer_id"),
        as_of_ts(as_of).alias("start_timestamp"),
        F.lit(None).cast("timestamp_ntz").alias("end_timestamp"),
        F.lit(False).alias("success"))


def batch_log_ids(log: DataFrame, analyzer_id: int = 1) -> DataFrame:
    """Per comment, the newest log id of the analyzer's latest batch
    (rows sharing the batch start timestamp)."""
    a = log.filter(F.col("analyzer_id") == analyzer_id)
    latest = a.agg(F.max("start_timestamp")).scalar()
    return (a.filter(F.col("start_timestamp") == latest)
            .groupBy("comment_id").agg(F.max("id").alias("id")))


def analyzer_batch_end(started: DataFrame, results: DataFrame, result_cols: list[str],
                       as_of: str = AS_OF) -> tuple[DataFrame, DataFrame]:
    """T5: keep only result rows carrying every result column, attach the
    log id, and close the batch's log rows (end time, success = a complete
    result was written). Returns (result rows to append, closed log rows)."""
    complete = results
    for c in result_cols:
        complete = complete.filter(F.col(c).isNotNull())
    logs = started.select(F.col("id").alias("analyzer_log_id"), "comment_id")
    written = complete.join(logs, "comment_id", "inner")
    done = written.select(F.col("analyzer_log_id").alias("done_id")).distinct()
    closed = (started.join(done, started.id == done.done_id, "left")
              .select("id", "comment_id", "analyzer_id", "start_timestamp",
                      F.when(F.col("done_id").isNotNull(), as_of_ts(as_of))
                       .otherwise(F.col("end_timestamp")).alias("end_timestamp"),
                      F.col("done_id").isNotNull().alias("success")))
    return written, closed


# ---- T6 / G10 run guard and run state ------------------------------------------
def latest_row(log: DataFrame, key: str) -> DataFrame:
    """The newest row (highest id) per key: ``max_by`` keeps one row per
    key per map task before the shuffle."""
    cols = [c for c in log.columns if c != key]
    return (log.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("id")).alias("r"))
            .select(key, *[F.col(f"r.{c}").alias(c) for c in cols]))


def run_guard(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """Per analyzer and per scraper source, seconds since the start of
    the newest log row if it is unfinished (else 1000 days), and whether a new
    run must be skipped (younger than 30 min / 5 h)."""
    def guard(log: DataFrame, key: str, kind: str, minutes: int) -> DataFrame:
        last = latest_row(log.select(key, "id", "start_timestamp", "end_timestamp"), key)
        age = F.when(F.col("start_timestamp").isNull() | F.col("end_timestamp").isNotNull(),
                     F.lit(NEVER_SECONDS).cast("bigint")).otherwise(
            F.timestamp_diff("SECOND", F.col("start_timestamp"), as_of_ts(as_of)))
        return last.select(F.lit(kind).alias("kind"), F.col(key).cast("int").alias("key_id"),
                           F.col("id").alias("last_log_id"), age.alias("age_seconds"),
                           (age < minutes * 60).alias("skip_run"))
    return (guard(m.analyzer_log, "analyzer_id", "analyzer", ANALYZER_GUARD_MIN)
            .unionByName(guard(m.crawl_log, "source_id", "scraper", SCRAPER_GUARD_MIN)))


# ---- G9 / T7 / T8 scraper windows and processed dates ---------------------------
def crawl_dates_proc(m: NewsModel) -> DataFrame:
    """Seed of the processed-dates table (source dates before 2024-01-15)."""
    return (m.article_header.filter(F.col("source_date") < date_lit("2024-01-15"))
            .select("source_id", F.col("source_date").alias("date_processed")).distinct())


def scraper_last_run(m: NewsModel) -> DataFrame:
    """Start of the last successful run per source, default 1990-01-01."""
    ok = (m.crawl_log.filter(F.col("success")).groupBy("source_id")
          .agg(F.max("start_timestamp").alias("last_start")))
    sh = m.source_header.select(F.col("id").alias("source_id"))
    return (sh.join(ok, "source_id", "left")
            .select("source_id", F.coalesce("last_start", ts_ntz(DEFAULT_LAST_RUN)).alias("last_run")))


def scraper_oldest_date(m: NewsModel, dates: DataFrame | None = None, as_of: str = AS_OF) -> DataFrame:
    """Oldest processed date per source, default today (as_of)."""
    dates = crawl_dates_proc(m) if dates is None else dates
    old = dates.groupBy("source_id").agg(F.min("date_processed").alias("oldest"))
    sh = m.source_header.select(F.col("id").alias("source_id"))
    return (sh.join(old, "source_id", "left")
            .select("source_id", F.coalesce("oldest", as_of_date(as_of)).alias("oldest_date")))


def crawl_window(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """Regular window start = max(last successful run, today - 30 d
    (FAZ 20 d)), end = today; the backfill week ends at the oldest processed
    date (after the regular window is marked) and runs only while it starts
    after 1970-01-01."""
    today = as_of_date(as_of)
    look = F.lit(None).cast("int")
    for sid, days in WINDOW_DAYS.items():
        look = F.when(F.col("source_id") == sid, F.lit(days)).otherwise(look)
    last = scraper_last_run(m)
    win = last.select("source_id",
                      F.greatest(F.col("last_run").cast("date"), F.date_sub(today, look))
                      .alias("window_start"),
                      today.alias("window_end"))
    old = scraper_oldest_date(m, as_of=as_of)
    j = win.join(old, "source_id", "inner")
    oldest = F.least(F.col("oldest_date"), F.col("window_start"))
    bf_start = F.date_sub(oldest, BACKFILL_DAYS)
    ok = bf_start > date_lit(EPOCH)
    return j.select("source_id", "window_start", "window_end",
                    F.when(ok, bf_start).alias("backfill_start"),
                    F.when(ok, oldest).alias("backfill_end"))


def dates_visited(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """T7 + W8: every date of the regular window and the backfill week per
    source, inserted-or-ignored into the processed dates: the new rows."""
    w = crawl_window(m, as_of)
    reg = w.select("source_id", F.explode(F.sequence("window_start", "window_end")).alias("date_processed"))
    bf = (w.filter(F.col("backfill_start").isNotNull())
          .select("source_id", F.explode(F.sequence("backfill_start", "backfill_end")).alias("date_processed")))
    new = reg.unionByName(bf).distinct()
    return new.join(crawl_dates_proc(m), ["source_id", "date_processed"], "left_anti")


def seed_dates(m: NewsModel) -> DataFrame:
    """Distinct (source, article date) not yet processed (NULL dates are
    not processed dates and are skipped)."""
    pairs = (m.article_header.filter(F.col("source_date").isNotNull())
             .select("source_id", F.col("source_date").alias("date_processed")).distinct())
    return pairs.join(crawl_dates_proc(m), ["source_id", "date_processed"], "left_anti")


# ---- T9 / T10 lemmas and topic results ------------------------------------------
LABEL_UDF = 2
LEMMA_LEN = 30


def lemma_key(value: Column) -> Column:
    return F.substring(F.lower(value), 1, LEMMA_LEN)


def lemma_id(lemma: Column) -> Column:
    """Deterministic lemma id: 60 bits of md5 (same value in the oracle)."""
    return F.conv(F.substring(F.md5(lemma), 1, 15), 16, 10).cast("bigint")


def _labels_with_article(m: NewsModel) -> DataFrame:
    uv = m.udf_values.filter((F.col("object_type") == 1) & (F.col("udf_id") == LABEL_UDF))
    ab = m.article_body.select(F.col("id").alias("ab_id"), "article_id")
    return uv.join(ab, uv.object_id == ab.ab_id, "inner").select("article_id", "object_id", "udf_value")


def label_lemmas(m: NewsModel) -> DataFrame:
    """All label lemmas (id, lemma)."""
    lem = _labels_with_article(m).select(lemma_key(F.col("udf_value")).alias("lemma")).distinct()
    return lem.select(lemma_id(F.col("lemma")).alias("id"), "lemma")


def lemma_header(m: NewsModel) -> DataFrame:
    """Lemma table before the run of T9: label lemmas ending in an even digit."""
    return label_lemmas(m).filter(F.substring(F.col("lemma"), -1, 1).isin("0", "2", "4", "6", "8"))


def _topic_results(m: NewsModel, lemmas: DataFrame, watermark: Column | None,
                   as_of: str) -> DataFrame:
    last = m.article_body_last_id
    uv = m.udf_values.filter((F.col("object_type") == 1) & (F.col("udf_id") == LABEL_UDF))
    lh = lemmas.select(F.col("id").alias("lemma_id"), "lemma")
    j = (last.join(uv, last.last_article_body_id == uv.object_id, "inner")
         .join(lh, lemma_key(F.col("udf_value")) == F.col("lemma"), "inner"))
    if watermark is not None:
        j = j.filter(F.col("article_id") > watermark)
    return j.select(F.col("article_id").alias("article_header_id"), F.lit(1).alias("topic_detector_id"),
                    "lemma_id", as_of_date(as_of).alias("run_date")).distinct()


def topic_results(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """Topic results of all articles and all lemmas."""
    return _topic_results(m, label_lemmas(m), None, as_of)


def topic_detector_result(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """Topic results before the run of T9 / T10: label topics of all articles but
    the newest tenth (by id), which that run has yet to process."""
    t = _topic_results(m, lemma_header(m), None, as_of)
    newest = m.article_body_last_id.agg(F.max("article_id")).scalar()
    return t.filter(F.col("article_header_id") * 10 <= newest * 9)


def topic_watermark(m: NewsModel) -> Column:
    return max_id(topic_detector_result(m), "article_header_id")


def new_lemmas(m: NewsModel) -> DataFrame:
    """Distinct lower-cased 30-char label lemmas of articles above the
    topic watermark that are not yet known (NOT IN -> anti-join; lemma is
    never NULL so the rewrite is exact). The watermark compares article ids."""
    cand = (_labels_with_article(m).filter(F.col("article_id") > topic_watermark(m))
            .select(lemma_key(F.col("udf_value")).alias("lemma")).distinct())
    return cand.join(lemma_header(m).select("lemma"), "lemma", "left_anti")


def new_topic_results(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """(article, detector 1, lemma id, run date) for the latest body's
    labels above the watermark, after the new lemmas were added."""
    lemmas = lemma_header(m).unionByName(new_lemmas(m).select(lemma_id(F.col("lemma")).alias("id"), "lemma"))
    return _topic_results(m, lemmas, topic_watermark(m), as_of)


# ---- T11 / T12 / T13 -------------------------------------------------------------
DATE_CREATED_UDF = 4


def fill_comment_date(m: NewsModel, as_of: str = AS_OF, min_age_hours: int = 3) -> DataFrame:
    """Comments without date_created take (1) the date prefix of their
    date_created attribute (the earliest if several), else (2) their
    article's source_date once processed more than 3 h before as_of."""
    attr = (m.udf_values.filter((F.col("object_type") == 2) & (F.col("udf_id") == DATE_CREATED_UDF))
            .groupBy(F.col("object_id").alias("a_cid"))
            .agg(F.min(parse_date_prefix(F.col("udf_value"))).alias("attr_date")))
    ab = m.article_body.select(F.col("id").alias("ab_id"), "article_id")
    ah = m.article_header.select(F.col("id").alias("ah_id"), "source_date")
    c = m.comment.select("id", "article_body_id", "proc_timestamp", "date_created")
    limit = F.timestamp_add("HOUR", F.lit(-min_age_hours), as_of_ts(as_of))
    j = (c.join(attr, c.id == attr.a_cid, "left")
         .join(ab, c.article_body_id == ab.ab_id, "left")
         .join(ah, F.col("article_id") == ah.ah_id, "left"))
    step1 = F.coalesce(F.col("date_created"), F.col("attr_date"))
    step2 = F.when(step1.isNull() & (F.col("proc_timestamp") < limit) & F.col("ah_id").isNotNull(),
                   F.col("source_date")).otherwise(step1)
    return j.select("id", step2.alias("date_created"))


def log_cleanup(m: NewsModel, analyzer_id: int = 1) -> DataFrame:
    """The analyzer log without the analyzer's unfinished rows."""
    al = m.analyzer_log
    return al.filter(~(F.col("end_timestamp").isNull() & (F.col("analyzer_id") == analyzer_id)))


def crawl_log_close(m: NewsModel, as_of: str = AS_OF, success: bool = True) -> DataFrame:
    """Close each source's newest run if it is still open (end time,
    success flag); all other rows unchanged. The newest ids are broadcast: one
    row per outlet of ``source_header``, a fixed list, so the log itself is
    not shuffled on its few source ids."""
    cl = m.crawl_log
    outlets = F.broadcast(m.source_header.select(F.col("id").alias("source_id")))
    newest = (cl.join(outlets, "source_id", "left_semi")
              .groupBy("source_id").agg(F.max("id").alias("newest_id")))
    j = cl.join(F.broadcast(newest), "source_id", "left")
    close = (F.col("id") == F.col("newest_id")) & F.col("end_timestamp").isNull()
    return j.select("id", "source_id", "start_timestamp",
                    F.when(close, as_of_ts(as_of)).otherwise(F.col("end_timestamp")).alias("end_timestamp"),
                    F.when(close, F.lit(success)).otherwise(F.col("success")).alias("success"))


def crawl_log_start(m: NewsModel, as_of: str = AS_OF) -> DataFrame:
    """One new open run row per source whose guard allows a run."""
    guard = run_guard(m, as_of).filter((F.col("kind") == "scraper") & ~F.col("skip_run"))
    w = Window.orderBy("key_id")
    return guard.select((max_id(m.crawl_log) + F.row_number().over(w)).alias("id"),
                        F.col("key_id").alias("source_id"), as_of_ts(as_of).alias("start_timestamp"),
                        F.lit(None).cast("timestamp_ntz").alias("end_timestamp"), F.lit(False).alias("success"))
