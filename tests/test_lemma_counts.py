"""Incremental document counts against the full count of the same state."""

import datetime as dt
import random
from collections import Counter, defaultdict

import pytest

from opinio.operators.lemma_counts import LemmaMonthCounts

RESULTS, DATES = "article_header_id long, lemma_id long, sign int", "article_header_id long, source_date date"


@pytest.fixture
def counts(spark, tmp_path):
    return LemmaMonthCounts(spark, str(tmp_path), buckets=4)


def run(spark, counts, n, results, dates):
    return counts.apply(n, spark.createDataFrame(results, RESULTS), spark.createDataFrame(dates, DATES))


def got(counts):
    return {(r.lemma_id, r.mth_published): r.doc_count for r in counts.counts().collect()}


def test_runs_equal_the_full_count(spark, counts):
    rng = random.Random(5)
    live, date = Counter(), {}
    for n in range(3):
        results = [(rng.randrange(12), rng.randrange(4), rng.choice([1, 1, 1, -1])) for _ in range(25)]
        results += [(a, 99, 1) for a in range(n * 4, n * 4 + 4)]          # a lemma that most articles have
        dates = [(a, rng.choice([None, dt.date(2024, rng.randrange(1, 4), rng.randrange(1, 28))]))
                 for a in rng.sample(range(12), 5)]
        assert run(spark, counts, n, results, dates)
        plus = Counter()
        for a, lemma, sign in results:
            plus[a, lemma] += sign
        for pair, p in plus.items():
            live[pair] = max(0, live[pair] + p)
        date.update(dates)
        full = defaultdict(int)
        for (a, lemma), k in live.items():
            if k and date.get(a):
                full[lemma, date[a].replace(day=1)] += 1
        assert got(counts) == dict(full)


def test_a_redated_article_moves_its_month_and_a_replay_does_nothing(spark, counts):
    assert run(spark, counts, 0, [(1, 7, 1), (2, 7, 1), (2, 8, 1), (2, 8, 1)],
               [(1, dt.date(2024, 1, 5)), (2, dt.date(2024, 1, 9))])
    jan, feb = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    assert got(counts) == {(7, jan): 2, (8, jan): 1}
    assert run(spark, counts, 1, [], [(2, dt.date(2024, 2, 3)), (3, feb)])
    assert got(counts) == {(7, jan): 1, (7, feb): 1, (8, feb): 1}
    assert not run(spark, counts, 1, [(1, 7, -1)], [])
    assert run(spark, counts, 2, [(2, 8, -1)], [])
    assert got(counts) == {(7, jan): 1, (7, feb): 1, (8, feb): 1}         # one of two results is left
    assert run(spark, counts, 3, [(2, 8, -3), (2, 8, 1), (4, 7, 1), (None, 7, 1), (1, None, 1)], [(None, jan)])
    assert got(counts) == {(7, jan): 1, (7, feb): 1}                      # article 4 has no date yet
    assert run(spark, counts, 4, [], [(4, feb), (1, None)])
    assert got(counts) == {(7, feb): 2}


def test_empty_runs(spark, counts):
    assert run(spark, counts, 0, [], []) and got(counts) == {}
    assert run(spark, counts, 1, [(1, 1, 1)], [(1, dt.date(2024, 3, 31))]) and got(counts) == {(1, dt.date(2024, 3, 1)): 1}
    assert run(spark, counts, 2, [], []) and got(counts) == {(1, dt.date(2024, 3, 1)): 1}
