"""Keyed stream state, revisit timers and event-time windows."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from opinio.operators import control as C
from opinio.plans.registered.streams import revisit_rows
from opinio.streaming import jobs as J
from opinio.streaming.state import MAX_REVISITS, PAGE_BITS, rocksdb_state, smallest_rows

COMMENTS = "external_id long, article_body_id long, level int, body string, event_ts timestamp_ntz"


def test_copies_are_known_without_reading_the_sink(spark):
    base = J.new_stream_dir(spark, "t-keyed")
    at = dt.datetime(2024, 1, 1)
    rows = [(i % 40, 1, 0, "x" if i % 7 else None, at) for i in range(400)] + [(None, 1, 0, "n", at), (None, 1, 0, "m", at)]
    J.stage_files(spark.createDataFrame(rows, COMMENTS).repartition(4), f"{base}/in")
    first = J.stream_dedup_comments(spark, f"{base}/in", COMMENTS, f"{base}/out1", f"{base}/ckpt")
    assert sorted((str(r.external_id), str(r.body)) for r in first.collect()) == sorted(
        [(str(i), "None" if any(j % 40 == i and j % 7 == 0 for j in range(400)) else "x") for i in range(40)] + [("None", "m")])
    J.stage_files(spark.createDataFrame([*rows, (99, 1, 0, "new", at)], COMMENTS), f"{base}/in")
    second = J.stream_dedup_comments(spark, f"{base}/in", COMMENTS, f"{base}/out2", f"{base}/ckpt")  # an empty sink
    assert [(r.external_id, r.body) for r in second.collect()] == [(99, "new")]
    again = J.stream_dedup_comments(spark, f"{base}/in", COMMENTS, f"{base}/out2", f"{base}/ckpt")  # nothing new
    assert again.count() == 1


def test_state_touches_the_keys_of_a_batch_only(spark):
    base = J.new_stream_dir(spark, "t-flat")
    at = dt.datetime(2024, 1, 1)
    for n in range(20):  # twenty files, each with five new ids and five copies
        rows = [(5 * n + i - d, 1, 0, "x", at) for i in range(5) for d in (0, 5) if 5 * n + i - d >= 0]
        J.stage_files(spark.createDataFrame(rows, COMMENTS).coalesce(1), f"{base}/in")
    stream = spark.readStream.schema(COMMENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    from opinio.streaming.state import FirstCopies
    order = ["event_ts", "article_body_id", "level", "body"]
    first = stream.groupBy("external_id").transformWithState(FirstCopies(order), stream.schema, "append", "none")
    with rocksdb_state(spark):
        query = J._run(first.writeStream.foreachBatch(J._append_batches(f"{base}/out")), f"{base}/ckpt")
    updated = [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.numInputRows]
    assert len(updated) == 20 and set(updated) == {5}  # flat, whatever is stored
    assert J._read_batches(spark, f"{base}/out", stream.schema).count() == 100


def test_settings_come_back(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    with rocksdb_state(spark):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == before


def test_smallest_rows_orders_nulls_first():
    rows = pd.DataFrame({"k": [1, 1, 2, 2], "t": [3, 2, 5, 5], "b": ["a", "b", "z", None]})
    assert smallest_rows(rows, "k", ["t", "b"]).sort_values("k").values.tolist() == [[1, 2, "b"], [2, 5, None]]


def due_at(model, as_of):
    """T2 at ``as_of`` over the visits that had happened by then."""
    at = dt.datetime.fromisoformat(as_of)
    latest = {}
    for r in model.article_body.where(F.col("proc_timestamp") <= F.lit(as_of).cast("timestamp_ntz")).collect():
        latest[r.article_id] = max(latest.get(r.article_id, (-1,)), (r.id, r.proc_counter, r.proc_timestamp))
    out = {}
    for r in model.article_header.where("NOT obsolete").collect():
        body, counter, proc = latest.get(r.id, (None, None, None))
        if body is None:
            out[r.id] = (None, "missing_body")
        elif counter < MAX_REVISITS and proc + dt.timedelta(hours=2**counter - 1) < at:
            out[r.id] = (body, "review_now")
    return out


def test_revisits_equal_the_work_list_at_three_times(spark, model):
    base, after = J.new_stream_dir(spark, "t-revisit"), None
    for as_of in ("2024-01-11 00:00:00", "2024-01-21 00:00:00", C.AS_OF):
        J.stage_files(revisit_rows(model, after, as_of).repartition(2), f"{base}/in")
        got = J.stream_revisit(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", max_files=3).collect()  # from the checkpoint
        now = {r.article_id: (r.article_body_id, r.status) for r in got if r.status in ("missing_body", "review_now")}
        assert now == due_at(model, as_of)
        after = as_of
    todo = {r.article_id: r.article_body_id for r in C.todo_crawl(model).select("article_id", "article_body_id").collect()}
    assert {a: b for a, (b, _) in now.items()} == todo
    assert {r.status for r in got} == {"missing_body", "review_now", "scheduled", "finished", "obsolete"}


def visits(spark, rows, clock):
    return spark.createDataFrame([(*r, clock) for r in rows], J.REVISIT_INPUT)


def test_a_visit_moves_the_timer_and_ends_the_schedule(spark):
    base, hour = J.new_stream_dir(spark, "t-moves"), 3_600_000
    start = 1_704_067_200_000  # 2024-01-01
    clock = lambda h: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h + 1)
    polls = [(0, [(1, False, None, None, None), (1, False, 10, start, 2), (2, False, None, None, None)],
              {1: ("scheduled", start + 3 * hour), 2: ("missing_body", None)}),
             (3, [(None,) * 5], {1: ("scheduled", start + 3 * hour), 2: ("missing_body", None)}),  # due only after its time
             (4, [(None,) * 5], {1: ("review_now", start + 3 * hour), 2: ("missing_body", None)}),
             (5, [(1, False, 10, start + 5 * hour, 3), (2, False, 20, start, 14)],
              {1: ("scheduled", start + 12 * hour), 2: ("finished", None)}),
             (6, [(1, False, 10, start, 2)], {1: ("scheduled", start + 12 * hour), 2: ("finished", None)}),  # an old visit again
             (400, [(1, True, None, None, None)], {1: ("obsolete", None), 2: ("finished", None)}),
             (900, [(1, False, 11, start, 1)], {1: ("obsolete", None), 2: ("finished", None)})]
    for hours, rows, expected in polls:
        J.stage_files(visits(spark, rows, clock(hours)), f"{base}/in")
        got = J.stream_revisit(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt").collect()
        assert {r.article_id: (r.status, r.due_ms) for r in got} == expected, hours


def test_a_page_of_articles_is_one_state_row(spark, monkeypatch):
    base, hour, run, queries = J.new_stream_dir(spark, "t-pages"), 3_600_000, J._run, []
    monkeypatch.setattr(J, "_run", lambda *args: queries.append(run(*args)))
    start, n = 1_704_067_200_000, 10 << PAGE_BITS  # 2024-01-01
    clock = lambda h: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(hours=h + 1)
    first = [(i, False, i, start, i % 4) for i in range(n)]  # due after 0, 1, 3 and 7 hours
    again = [(i, i % 8 == 7, i, start + 2 * hour, 4) for i in range(0, n, 3)]  # due at 17; every eighth article is obsolete
    for hours, rows in ((0, first), (2, again), (6, [(None,) * 5]), (18, [(None,) * 5])):
        J.stage_files(visits(spark, rows, clock(hours)), f"{base}/in")
        got = {r.article_id: (r.status, r.due_ms) for r in
               J.stream_revisit(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt").collect()}
        want = {}
        for i in range(n):
            due = 17 if hours >= 2 and i % 3 == 0 else 2 ** (i % 4) - 1
            want[i] = ("obsolete", None) if due == 17 and i % 8 == 7 else ("review_now" if due < hours else "scheduled", start + due * hour)
        assert got == want, hours
    pages = [p.stateOperators[0].numRowsUpdated for q in queries for p in q.recentProgress if p.numInputRows > 1]
    assert len(pages) == 2 and max(pages) <= 3 * 11  # a page's row and timer, not its articles'


def test_windows_and_side_table_hold_every_row(spark):
    base = J.new_stream_dir(spark, "t-window")
    schema = "comment_id long, sentiment_value double, ts timestamp"
    day = lambda d, h=0: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=d, hours=h)
    polls = [[(i, float(i % 5), day(i % 4, i % 24)) for i in range(200)], [(i, 1.0, day(10 + i % 3)) for i in range(90)],
             [(1, 9.0, day(0)), (2, 9.0, day(8)), (3, 9.0, day(12, 5)), (4, 9.0, None)], [(5, 2.0, day(30))], [(6, 4.0, day(11)), (7, 3.0, day(31))]]
    every = []
    for rows in polls:
        J.stage_files(spark.createDataFrame(rows, schema).repartition(5), f"{base}/in")
        every += rows
        out = J.stream_daily_window(spark, f"{base}/in", schema, f"{base}/out", f"{base}/ckpt", delay_days=2, max_files=2)
        sums = {}
        for _, v, ts in every:
            s, n = sums.get(ts and ts.date(), (0.0, 0))
            sums[ts and ts.date()] = (s + v, n + 1)
        got = {r.day: (r.avg_sentiment, r.n_comments) for r in out.collect()}
        assert got == {d: (round(s / n, 9), n) for d, (s, n) in sums.items()}
    late = spark.read.parquet(f"{base}/out/split").where("late = 'true'").collect()
    assert {r.ts.day for r in late if r.ts} >= {1, 12}  # rows of 1 and 12 January came behind the watermark
