"""File readers with inline fixtures (stop-word CSV, lexicon, pages, JSON)."""

import os
import tempfile

from pyspark.sql import functions as F

from opinio.sources import pages as PG
from opinio.sources.lexicon import parse_lexicon, read_lexicon_files
from opinio.operators.topics import read_stopword_csv


def _write(text: str, name: str) -> str:
    d = tempfile.mkdtemp(prefix="opinio-fixture-")
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as fh:
        fh.write(text)
    return p


def test_s2_stopword_csv_quirks(spark):
    csv = ("#Source: list of common words\n#Number,German,in English\n0,der,the\n0,,\"empty\"\n"
           "0,Montag,Monday\n0.Mittwoch,Wednesday\n0,nächste,next\n")
    words = {r.word for r in read_stopword_csv(spark, _write(csv, "common.csv")).collect()}
    assert words == {"der", "", "montag", "wednesday", "nächste"}
    assert "mittwoch" not in words


def test_s3_lexicon_later_wins(spark):
    neg = "Schlecht|ADJX\t-0.5\tschlechter,schlechtes\nGut|ADJX\t-0.1\n"
    pos = "Gut|ADJX\t0.4\tgute,guter\n"
    lines = read_lexicon_files(spark, [_write(neg, "neg.txt"), _write(pos, "pos.txt")])
    got = {r.word: r.score for r in parse_lexicon(lines).collect()}
    assert got == {"schlecht": -0.5, "schlechter": -0.5, "schlechtes": -0.5, "gut": 0.4, "gute": 0.4, "guter": 0.4}


def test_s10_s11_page_extraction(spark):
    html = ('<html lang="de"><head><title>T &amp; U</title><script>var t="</p>";</script></head><body>'
            '<a href="/a">a</a><a class="x" href="/b">b</a><a href="/a">again</a>'
            '<article><h1>Head</h1><p>One <b>bold</b>.</p><p>Two</p><p><em>ad</em></p><p>also <em>ad</em></p>'
            '</article></body></html>')
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    links = sorted((r.pos, r.link) for r in PG.page_links(df).collect())
    assert links == [(0, "/a"), (1, "/b")]
    r = PG.page_article_extract(df).first()
    assert (r.lang, r.title, r.headline, r.body, r.n_paragraphs) == ("de", "T & U", "Head", "One bold.\nTwo", 2)


def test_s12_s13_dates(spark):
    df = spark.createDataFrame([("05.01.2024 - 10:15",), ("05.01.2024",), ("bad - 1",)], "raw string")
    got = [r[0] for r in df.select(PG.german_datetime(F.col("raw"))).collect()]
    assert got == ["2024-01-05 10:15", None, None]
    ts = spark.createDataFrame([("2024-01-05T10:15:00.123456",), ("2024-01-05T10:15:00",)], "c string")
    got = [str(r[0]) for r in ts.select(PG.api_timestamp(F.col("c"))).collect()]
    assert got == ["2024-01-05 10:15:00.123456", "2024-01-05 10:15:00"]


def test_s12_pages_until_short(spark):
    rows = [("a", p, i) for p, n in ((1, 20), (2, 5), (3, 20)) for i in range(n)] + [("b", 1, i) for i in range(20)]
    df = spark.createDataFrame(rows, "art string, page int, i int")
    got = {(r.art, r.page) for r in PG.pages_until_short(df, "art", "page").select("art", "page").distinct().collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1)}
