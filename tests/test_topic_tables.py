"""Topic queries over the topic results of all articles and all lemmas."""

from collections import defaultdict

import __spark_entry__ as E
from opinio.operators import control as C

from conftest import SF_SMALL

QUERIES = E.queries()


def test_topic_queries_cover_all_articles_and_lemmas(spark, model):
    label = defaultdict(set)
    for r in model.udf_values.filter("object_type = 1 AND udf_id = 2").collect():
        label[r.object_id].add(r.udf_value.lower()[:30])
    topics = {(r.article_id, x) for r in model.article_body_last_id.collect() for x in label[r.last_article_body_id]}
    header = {r.id: r for r in model.article_header.collect()}
    assert {x[-1] for _, x in topics} & set("13579")
    assert max(a for a, _ in topics) * 10 > max(header) * 9

    got = {(r.article_source_id, r.lemma) for r in QUERIES["topics_by_source"](spark, SF_SMALL).collect()}
    assert got == {(header[a].source_id, x) for a, x in topics}

    name = {r.id: r.lemma for r in C.label_lemmas(model).collect()}
    docs = defaultdict(set)
    for a, x in topics:
        if header[a].source_date is not None:
            docs[x, header[a].source_date.replace(day=1)].add(a)
    got = {(name[r.lemma_id], r.mth_published): r.doc_count
           for r in QUERIES["lemma_month_doc_count"](spark, SF_SMALL).collect()}
    assert got == {k: len(v) for k, v in docs.items()}

    left = {r.table_name: r.n_rows for r in QUERIES["cascade_delete"](spark, SF_SMALL).collect()}
    assert left["topic_detector_result"] == sum(not header[a].obsolete for a, _ in topics)
    assert all(r.n_violations == 0 for r in QUERIES["fk_violations"](spark, SF_SMALL).collect()
               if r.fk_constraint == "topic_detector_result.lemma_id")


def test_analyzer_batch_takes_the_whole_queue_or_a_limit(model):
    newest = model.analyzer_log.agg({"id": "max"}).first()[0]
    queue = sorted(r.comment_id for r in C.todo_analyzer(model).select("comment_id").distinct().collect())
    started = sorted((r.id, r.comment_id) for r in C.analyzer_batch_start(model).collect())
    assert started == [(newest + i, c) for i, c in enumerate(queue, 1)]
    few = {r.comment_id for r in C.todo_analyzer_next(model, 3).collect()}
    assert {r.comment_id for r in C.analyzer_batch_start(model, limit=3).collect()} == few and len(few) == min(3, len(queue))
