"""Keyed streaming state (R2, R4): processors for ``transformWithState``.

State lives in the RocksDB state store, partitioned by key and checkpointed as a
changelog, so a micro-batch costs what its own keys cost, however much has been stored.

* ``FirstCopies`` (R2): one flag a key; emits the first copy of an external id.
* ``Revisits`` (R4): the revisit timers. An article is looked at again ``2^n - 1`` hours
  after its ``n``-th visit until visit ``MAX_REVISITS``; the newest visit and the time it is due
  are the state. A key is a page of ``1 << PAGE_BITS`` neighbouring articles: every call to the
  state store is a round trip from Python, so a call an article would cost more than its rows.
  A page's timer fires when the first of its articles is due. Time is an event clock (the watermark of a ``clock``
  column that each poll sets), so that runs can be repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from opinio.operators.control import MAX_REVISITS

HOUR_MS = 3_600_000
#: Articles a key of ``Revisits``, as a power of two: a poll rewrites the whole pages that it touches.
PAGE_BITS = 6
_STORE = {"spark.sql.streaming.stateStore.providerClass":
          "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def rocksdb_state(spark: SparkSession):
    """The RocksDB state store for the query started inside; the session's settings come back."""
    before = {key: spark.conf.get(key, None) for key in _STORE}
    for key, value in _STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def smallest_rows(rows: pd.DataFrame, key: str, order: list[str]) -> pd.DataFrame:
    """The row of each key that is smallest by ``order`` (nulls first, as in Spark)."""
    return rows.sort_values(order, na_position="first", kind="stable").drop_duplicates(key)


def _nulls_first(row: Row, order: list[str]) -> tuple:
    return tuple((row[c] is not None, row[c]) for c in order)


class FirstCopies(StatefulProcessor):
    """Of a key's rows in a micro-batch the smallest by ``order`` (nulls first, as in
    Spark), unless the key was seen before."""

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self.seen.exists():
            self.seen.update((True,))
            yield min(rows, key=lambda row: _nulls_first(row, self.order))

    def close(self) -> None:
        pass


_NO_VISIT = (-1, -1, -1, False)
_Change = Row("article_id", "article_body_id", "proc_counter", "proc_ms", "phase", "due_ms", "status")


class Revisits(StatefulProcessor):
    """Key: ``article_id >> PAGE_BITS``. Input (article_id, obsolete, article_body_id, proc_ms, proc_counter),
    none null: rows with body -1 announce an article, the others are visits; article -1 only moves the clock.
    Output: a log of status changes; the last row of an article by (article_body_id, proc_counter,
    proc_ms, phase) is its status."""

    OUTPUT = ("article_id long, article_body_id long, proc_counter int, proc_ms long, phase int, "
              "due_ms long, status string")
    #: The pending timer, then of each article the newest visit, whether it is obsolete and when it
    #: falls due (null: not waiting).
    STATE = ("alarm_ms long, article_id array<long>, article_body_id array<long>, proc_counter array<int>, "
             "proc_ms array<long>, obsolete array<boolean>, due_ms array<long>")

    def __init__(self, hour_ms: int = HOUR_MS, max_visits: int = MAX_REVISITS):
        self.hour_ms, self.max_visits = hour_ms, max_visits

    def init(self, handle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", self.STATE)

    def _load(self) -> tuple[int | None, dict[int, tuple]]:
        if not self.page.exists():
            return None, {}
        alarm, *columns = self.page.get()
        return alarm, {article: tuple(rest) for article, *rest in zip(*columns)}

    def _save(self, alarm: int | None, articles: dict[int, tuple]) -> None:
        """Stores the page and moves its timer from ``alarm`` to the first article that waits."""
        waiting = [due for *_, due in articles.values() if due is not None]
        first = min(waiting) + 1 if waiting else None  # due strictly before the clock
        if first != alarm:
            if alarm is not None:
                self.handle.deleteTimer(alarm)
            if first is not None:
                self.handle.registerTimer(first)
        self.page.update((first, list(articles), *map(list, zip(*articles.values()))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        alarm, articles = self._load()
        seen: dict[int, tuple] = {}
        for row in rows:
            article = row["article_id"]
            if article < 0:
                continue
            *visit, obsolete = seen.get(article) or articles.get(article, _NO_VISIT)[:4]
            visit = max(tuple(visit), (row["article_body_id"], row["proc_counter"], row["proc_ms"]))
            seen[article] = (*visit, obsolete or row["obsolete"])
        changes = []
        for article, now in seen.items():
            if article in articles and now == articles[article][:4]:
                continue
            body, counter, proc, obsolete = now
            due = None
            if obsolete:
                phase, status = 3, "obsolete"
            elif body < 0:
                phase, status = 0, "missing_body"
            elif counter >= self.max_visits:
                phase, status = 2, "finished"
            else:
                due = proc + (2 ** counter - 1) * self.hour_ms
                phase, status = 1, "scheduled"
            articles[article] = (*now, due)
            changes.append(_Change(article, body, counter, proc, phase, due, status))
        if changes:
            self._save(alarm, articles)
        yield from changes

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        clock = timerValues.getCurrentWatermarkInMs()
        _, articles = self._load()
        changes = []
        for article, (body, counter, proc, obsolete, due) in articles.items():
            if due is not None and due < clock:
                articles[article] = (body, counter, proc, obsolete, None)
                changes.append(_Change(article, body, counter, proc, 2, due, "review_now"))
        self._save(None, articles)  # Spark deletes the timer that fired
        yield from changes

    def close(self) -> None:
        pass
