"""Hand-computed cases (FIXTURES.md section D), written inline."""

import datetime as dt
import math

from pyspark.sql import functions as F

from opinio.functions.dates import calendar_columns, initial_backoff
from opinio.functions.hashing import external_id_of
from opinio.operators import comment_tree as CT
from opinio.operators import corpus as K
from opinio.operators import ingest as I
from opinio.operators import sentiment as S
from opinio.operators import topics as TP
from opinio.plans.dashboards import article_text_match, comment_keyword_match


def test_w11_external_id(spark):
    df = spark.createDataFrame([("abc",), ("a",)], "k string")
    got = [r[0] for r in df.select(external_id_of(F.col("k"))).collect()]
    assert got == [-8070080442485551184, 919145239626757800]


def test_f5_keyword_leading_blank(spark):
    df = spark.createDataFrame([("Tesla x",), (" Tesla x",)], "body string")
    got = [r[0] for r in df.select(comment_keyword_match(F.col("body"), "tesla")).collect()]
    assert got == [False, True]


def test_f4_blank_text_drops_null_body(spark):
    df = spark.createDataFrame([(None,), ("x",)], "body string")
    got = df.filter(article_text_match(F.col("body"), "")).count()
    assert got == 1


def _lex(spark, rows):
    return spark.createDataFrame(rows, "word string, score double, subjectivity double")


def test_n1_lexicon_mean_std(spark):
    docs = spark.createDataFrame([(1, "gut schlecht foo"), (2, "foo")], "doc_id long, text string")
    lex = _lex(spark, [("gut", 0.4, 0.5), ("schlecht", -0.2, 0.5)])
    got = {r.doc_id: r for r in S.lexicon_sentiment(docs, lex).collect()}
    assert math.isclose(got[1].value, 0.1) and math.isclose(got[1].error, 0.3)
    assert (got[1].hits, got[1].n_tokens) == (2, 3)
    assert (got[2].value, got[2].error) == (0.0, 1.0)


def test_n4_equal_logits(spark):
    df = spark.createDataFrame([([0.0] * 5, [0.0] * 3)], "l5 array<double>, l3 array<double>")
    v5, e5 = S.logits_to_sentiment(F.col("l5"), "stars5")
    v3, e3 = S.logits_to_sentiment(F.col("l3"), "neg_neu_pos3")
    r = df.select(v5, e5, v3, e3).first()
    assert abs(r[0]) < 1e-12 and math.isclose(r[1], math.sqrt(0.5))
    assert abs(r[2]) < 1e-12 and math.isclose(r[3], math.sqrt(2 / 3))


def test_n4_softmax_sums_to_one(spark):
    df = spark.createDataFrame([([1.0, -2.0, 0.5, 3.0, 0.0],)], "l array<double>")
    w = df.select(S.softmax(F.col("l"))).first()[0]
    assert math.isclose(sum(w), 1.0)


def test_n5_inverse_variance(spark):
    df = spark.createDataFrame([(1, 0.2, 0.1), (1, 0.6, 0.2)], "k int, value double, error double")
    r = S.combine_chunks(df, "k").first()
    assert math.isclose(r.value, 0.28, rel_tol=1e-9)
    assert math.isclose(r.error, 0.0894427191, rel_tol=1e-6)
    # the combined error never exceeds the smallest input error
    assert r.error <= 0.1


def test_t2_due_rule(spark):
    from opinio.functions.numeric import power2
    as_of = dt.datetime(2024, 2, 1, 0, 0, 0)
    rows = [(3, as_of - dt.timedelta(hours=7)), (3, as_of - dt.timedelta(hours=7, seconds=1)),
            (14, as_of - dt.timedelta(days=900))]
    df = spark.createDataFrame(rows, "n int, ts timestamp_ntz")
    due = ((F.col("n") < 14) & (F.lit(as_of).cast("timestamp_ntz") >
                                F.timestamp_add("HOUR", (power2(F.col("n")) - 1).cast("int"), F.col("ts"))))
    assert [r[0] for r in df.select(due).collect()] == [False, True, False]


def test_w14_backoff(spark):
    df = spark.createDataFrame([(1,), (30,), (0,), (None,)], "d int")
    assert [r[0] for r in df.select(initial_backoff(F.col("d"))).collect()] == [3, 8, 0, 0]


def test_n15_thresholds(spark):
    df = spark.createDataFrame([(-0.33,), (0.33,), (-0.3301,)], "v double")
    assert [r[0] for r in df.select(S.sentiment_class(F.col("v"))).collect()] == [0, 1, -1]


def test_j9_pair_length_limit(spark):
    a = "x" * 256
    rows = [(1, 0, a, 1), (2, 0, a, 1), (3, 0, "y" * 255, -1), (4, 0, "z" * 256, -1)]
    df = spark.createDataFrame(rows, "id long, sample_no int, text string, label int")
    got = {r.label: r.n_pairs for r in K.pair_counts(df).collect()}
    assert got == {1: 0, -1: 1}


def test_n6_topics(spark):
    text = "alpha beta alpha gamma beta alpha beta delta delta"
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    sw = spark.createDataFrame([("",)], "word string")
    got = [(r.rank, r.topic) for r in TP.topics_top5(docs, sw).orderBy("rank").collect()]
    assert got == [(1, "alpha"), (2, "beta")]  # delta only twice; tie alpha/beta by first position


def test_n6_at_most_five(spark):
    words = " ".join(f"w{i} w{i} w{i}" for i in range(7))
    docs = spark.createDataFrame([(1, words)], "id long, text string")
    sw = spark.createDataFrame([("",)], "word string")
    got = [r.topic for r in TP.topics_top5(docs, sw).orderBy("rank").collect()]
    assert got == ["w0", "w1", "w2", "w3", "w4"]


def test_c1_tree_rules(spark):
    tree = ('[{"body":"root","user":{"username":"a"},"created_at":"2024-01-01T10:00:00","replies":'
            '[{"body":"reply","user":{"username":"b"},"created_at":"2024-01-05T10:00:00","replies":[]}]},'
            '{"body":"anon","created_at":"2024-01-05T10:00:00","replies":'
            '[{"body":"lost","user":{"username":"c"},"created_at":"2024-01-05T10:00:00","replies":[]}]}]')
    docs = spark.createDataFrame([("u", tree)], "url string, tree string")
    flat = CT.flatten_comment_tree(docs)
    rows = {r.body: r for r in flat.collect()}
    assert set(rows) == {"root", "reply"}          # item without user dropped with its subtree
    assert rows["reply"].level == 1 and rows["reply"].parent_external_id == rows["root"].external_id
    kept = CT.comment_date_window(flat, "2024-01-03", "2024-01-31")
    got = {(r.body, r.level, r.parent_external_id) for r in kept.collect()}
    assert got == {("reply", 1, rows["root"].external_id)}


def test_c1_deep_tree(spark):
    node = '{"body":"d5","user":{"username":"u"},"created_at":"x","replies":[]}'
    for i in range(4, -1, -1):
        node = f'{{"body":"d{i}","user":{{"username":"u"}},"created_at":"x","replies":[{node}]}}'
    docs = spark.createDataFrame([("u", f"[{node}]")], "url string, tree string")
    got = sorted((r.body, r.level) for r in CT.flatten_comment_tree(docs).collect())
    assert got == [(f"d{i}", i) for i in range(6)]


def test_c1_titled_tree(spark):
    """Outlet 3: title and author are required, the title leads the (normalised) body."""
    from opinio.functions.strings import nfkd
    tree = ('[{"title":"T","body":"caf\u00e9","author":"a","created_at":"2024-01-01 10:00","replies":'
            '[{"title":"R","body":"r","author":"b","created_at":"2024-01-01 11:00"}]},'
            '{"body":"untitled","author":"c","created_at":"2024-01-01 10:00","replies":'
            '[{"title":"L","body":"lost","author":"d","created_at":"2024-01-01 11:00"}]}]')
    docs = spark.createDataFrame([("u", tree)], "url string, tree string")
    rows = {r.body: r for r in CT.flatten_comment_tree(docs, required=CT.REQUIRED_FIELDS_FAZ,
                                                               title_in_body=True, normalise=nfkd).collect()}
    assert set(rows) == {"T cafe\u0301", "R r"}
    want = spark.range(1).select(external_id_of(F.lit("uaT cafe\u0301"))).first()[0]
    assert rows["T cafe\u0301"].external_id == rows["R r"].parent_external_id == want
    assert (rows["R r"].user, rows["R r"].level) == ("b", 1)


def test_s11_embedded_article(spark):
    from opinio.sources.pages import page_article_extract
    ld = '<script type="application/ld+json">{}</script>'
    pages = [
        (1, ld.format('{"@type":"WebSite"}') + ld.format(
            '{"headline":"H","articleBody":"<p>one</p><p>two</p><p><em>ad</em></p>"}') + "<article><p>page</p></article>"),
        (2, ld.format('{"articleBody":"plain"}') + "<h1>own</h1>"),
        (3, ld.format("{broken") + "<h1>own</h1><article><p>page</p></article>")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: (r.headline, r.body, r.n_paragraphs) for r in page_article_extract(df).collect()}
    assert got == {1: ("H", "one\ntwo", 2), 2: ("own", "plain", 1), 3: ("own", "page", 1)}


def test_s12_comment_page(spark):
    from opinio.sources.pages import comment_page_items

    def item(level, title, author, date, inner=""):
        return (f'<li class="js-lst-Comments_Item lst-Comments_Item lst-Comments_Item-level{level}">'
                f'<p class="js-lst-Comments_CommentTitle lst-Comments_CommentTitle">{title}<br/></p>'
                f'<span class="lst-Comments_CommentInfoNameText">{author}</span>'
                f'<span class="lst-Comments_CommentInfoDateText">{date}</span>'
                f'<p class="lst-Comments_CommentText">text\tof {author}</p>{inner}</li>')
    html = ("<ul>" + item(1, "A", "x", "11.01.2021 - 09:15", item(2, "B", "y", "12.01.2021 - 10:00"))
            + item(1, "C", "z", "yesterday") + "</ul>")
    df = spark.createDataFrame([(7, html), (8, "<p>none</p>"), (9, None)], "page_id long, html string")
    got = [tuple(r) for r in comment_page_items(df).orderBy("pos").collect()]
    assert got == [(7, 0, 0, None, "A", "text of x", "x", "2021-01-11 09:15"),
                   (7, 1, 1, 0, "B", "text of y", "y", "2021-01-12 10:00"),
                   (7, 2, 0, None, "C", "text of z", "z", None)]


def test_s7_csv_keeps_line_breaks(spark):
    rows = spark.createDataFrame([("1", "0", " a\nb|c, d\n", "1", None), ("2", "0", "x", "0", None), ("3", "0", "y", "1", "z")],
                                 "c0 string, c1 string, text string, flag string, extra string")
    assert [r.text for r in K.annotated_csv_filter(rows).collect()] == [" a\nb|c, d\n"]


def test_w12_nfkd(spark):
    from opinio.functions.strings import nfkd
    df = spark.createDataFrame([("\ufb01\u00e9\u2460",), (None,)], "t string")
    assert [r[0] for r in df.select(nfkd("t")).collect()] == ["fie\u03011", None]


def test_w4_unknown_key_dropped(spark):
    uh = spark.createDataFrame([(1, "headline", "string"), (2, "label", "string")],
                               "id int, udf_name string, udf_type string")
    inc = spark.createDataFrame([(1, 5, "replies", "x"), (1, 5, "label", "y" * 80), (1, 5, "label", "y" * 81),
                                 (1, 5, "label", "y" * 80)],
                                "object_type int, object_id long, key string, value string")
    got = I.validate_udfs(inc, uh).collect()
    assert [(r.udf_id, len(r.udf_value)) for r in got] == [(2, 80)]


def test_m15_calendar(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "d date")
    r = df.select(*calendar_columns(F.col("d"))).first()
    assert (r.day_of_week, r.week_of_year, r.year_actual, r.week_of_month) == (1, 1, 2025, 5)
    assert r.day_name == "Monday   " and len(r.month_name) == 9


def test_w8_insert_ignore(spark):
    stored = spark.createDataFrame([("u1", 10)], "url string, pos long")
    batch = spark.createDataFrame([("u1", 1), ("u2", 2), ("u2", 3)], "url string, pos long")
    new = I.insert_ignore(batch, stored, ["url"], order_col="pos")
    assert [(r.url, r.pos) for r in new.collect()] == [("u2", 2)]
    merged = stored.unionByName(new)
    again = I.insert_ignore(batch, merged, ["url"], order_col="pos")
    assert again.count() == 0  # idempotent


def test_t6_guard(spark):
    from opinio.operators.control import run_guard
    from opinio.sources.news_model import NewsModel

    class M(NewsModel):
        def __init__(self, spark, rows):
            self.spark = spark
            self._rows = rows

        @property
        def analyzer_log(self):
            return self.spark.createDataFrame(
                self._rows, "id long, comment_id long, analyzer_id int, start_timestamp timestamp_ntz, "
                            "end_timestamp timestamp_ntz, success boolean")

        @property
        def crawl_log(self):
            return self.spark.createDataFrame([], "id long, source_id int, start_timestamp timestamp_ntz, "
                                                  "end_timestamp timestamp_ntz, success boolean")
    as_of = dt.datetime(2024, 2, 1)
    young = M(spark, [(1, 1, 1, as_of - dt.timedelta(minutes=20), None, False)])
    old = M(spark, [(1, 1, 1, as_of - dt.timedelta(minutes=40), None, False)])
    assert run_guard(young).first().skip_run is True
    assert run_guard(old).first().skip_run is False


def test_n14_split_by_position(spark):
    rows = [(f"k{i}", 1, f"text {i}") for i in range(10)]
    df = spark.createDataFrame(rows, "key string, label int, text string")
    got = {r.position: r.split for r in K.one_hot_split(df).collect()}
    assert got[0] == "test" and got[1] == "val" and all(got[p] == "train" for p in range(2, 10))


def test_c1_outlet3_fields(spark):
    tree = ('[{"title":"t","body":"top","author":"x","created_at":"2024-01-02 10:00","level":0,"replies":'
            '[{"title":"r","body":"reply","author":"y","created_at":"2024-01-02 11:00","level":1}]},'
            '{"body":"no title","author":"z","created_at":"2024-01-02 12:00","level":0}]')
    docs = spark.createDataFrame([("u", tree)], "url string, tree string")
    flat = CT.flatten_comment_tree(docs, required=CT.REQUIRED_FIELDS_FAZ)
    got = sorted((r.body, r.user, r.level) for r in flat.collect())
    assert got == [("reply", "y", 1), ("top", "x", 0)]
