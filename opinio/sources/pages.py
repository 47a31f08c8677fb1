"""Stored web pages and API batches as inputs.

The reference fetches listing pages, article pages, comment pages and a
cursor-paged comment API over HTTP. Crawling is not a Spark job; here the
fetched documents are a table (``pages(page_id, url, html)`` or API record
batches) and the extraction runs as column expressions per row -- no
parser library, no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.session import ensure_parallelism

# URL markers of paid articles per outlet (2 = Welt, 3 = FAZ);
# outlet 1 sends an explicit flag.
PAID_MARKERS = {2: "/plus", 3: "/premiumContent"}
COMMENT_PAGE_SIZE = 20   # comment pages hold 20 top-level items
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]

# Structured data of article pages, and the markup of comment pages.
LD_JSON = r"""(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>"""
COMMENT_ITEM = r"""<li[^>]*lst-Comments_Item-level([12])[^>]*>"""
_COMMENT_FIELDS = {"title": ("p", "lst-Comments_CommentTitle"), "body": ("p", "lst-Comments_CommentText"),
                   "author": ("span", "lst-Comments_CommentInfoNameText"),
                   "created_at": ("span", "lst-Comments_CommentInfoDateText")}
LINK_PATTERN = r"""<a\s[^>]*href="([^"]*)\""""


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Article links of a listing page, de-duplicated keeping the first
    occurrence: (page_id, pos, link)."""
    pages = ensure_parallelism(pages, id_col)
    links = pages.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.col(html_col), F.lit(LINK_PATTERN), 1))
                         .alias("pos", "link"))
    return links.groupBy(id_col, "link").agg(F.min("pos").alias("pos")).select(id_col, "pos", "link")


def unescape(s: Column) -> Column:
    out = s
    for a, b in _ENTITIES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_tags(s: Column) -> Column:
    return F.trim(unescape(F.regexp_replace(s, "<[^>]*>", "")))


def drop_trailing_em(paragraphs: Column) -> Column:
    """Welt rule: remove trailing paragraphs that contain <em>, up to the
    last paragraph without one."""
    idx = F.transform(F.sequence(F.lit(1), F.greatest(F.size(paragraphs), F.lit(1))),
                      lambda i: F.when(~F.coalesce(F.element_at(paragraphs, i), F.lit("")).contains("<em"), i)
                      .otherwise(F.lit(0)))
    keep = F.coalesce(F.array_max(idx), F.lit(0))
    return F.slice(paragraphs, 1, keep)


def page_article_extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Language, title, headline and body text of an article page. The
    first structured-data block (ld+json) with an ``articleBody`` gives
    headline and body. Without one, script and style blocks are removed (they
    may contain markup-like text), the headline is the h1 and the body stands
    inside <article>. The body is the text of its <p> blocks (an embedded body
    without any is one block), trailing <em> blocks removed, joined by
    newlines. Malformed structured data counts as none."""
    pages = ensure_parallelism(pages, id_col)
    clean = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?s)<script[^>]*>.*?</script>", ""),
                             r"(?s)<style[^>]*>.*?</style>", "")
    blocks = F.filter(F.regexp_extract_all(F.col(html_col), F.lit(LD_JSON), 1),
                      lambda b: F.get_json_object(b, "$.articleBody").isNotNull())
    embedded = F.get_json_object(F.get(blocks, 0), "$.articleBody")
    article = F.coalesce(embedded, F.regexp_extract(clean, r"(?s)<article[^>]*>(.*)</article>", 1))
    after = F.filter(F.split(article, "<p[ >]"), lambda p, i: i > 0)
    paras = drop_trailing_em(F.when(embedded.isNotNull() & (F.size(after) == 0), F.array(embedded)).otherwise(after))
    texts = F.filter(F.transform(paras, lambda p: strip_tags(p)), lambda t: t != "")
    return pages.select(
        F.col(id_col),
        F.regexp_extract(F.col(html_col), r"<html[^>]*\slang=\"([^\"]*)\"", 1).alias("lang"),
        strip_tags(F.regexp_extract(clean, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        strip_tags(F.coalesce(F.get_json_object(F.get(blocks, 0), "$.headline"),
                              F.regexp_extract(clean, r"(?s)<h1[^>]*>(.*?)</h1>", 1))).alias("headline"),
        F.array_join(texts, "\n").alias("body"),
        F.size(texts).alias("n_paragraphs"))


def german_datetime(raw: Column) -> Column:
    """S12: 'dd.mm.yyyy - HH:MM' -> 'yyyy-mm-dd HH:MM' (NULL if malformed)."""
    parts = F.split(raw, " - ")
    day = F.try_to_date(parts.getItem(0), "dd.MM.yyyy")
    return F.when(day.isNotNull() & (F.size(parts) == 2),
                  F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" "), parts.getItem(1)))


def comment_page_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The comments of stored comment pages, one row each: (id_col, pos,
    level 0 or 1, parent_pos, title, body, author, created_at). A reply's
    parent is the last first-level item before it; the times are normalised
    (``german_datetime``); an item lacking a field has NULL there."""
    html = F.col(html_col)
    levels = F.regexp_extract_all(html, F.lit(COMMENT_ITEM), 1)
    parts = F.filter(F.split(html, COMMENT_ITEM), lambda p, i: i > 0)
    items = pages.select(id_col, F.posexplode(F.arrays_zip(levels.alias("mark"), parts.alias("part"))).alias("pos", "i"))
    level = (F.col("i.mark").cast("int") - 1).alias("level")

    def field(name: str) -> Column:
        tag, css = _COMMENT_FIELDS[name]
        found = F.regexp_extract_all("i.part", F.lit(rf"(?s)<{tag}[^>]*{css}[^>]*>(.*?)</{tag}>"), 1)
        return strip_tags(F.translate(F.get(found, 0), "\n\t", "  "))
    flat = items.select(id_col, "pos", level, *[field(n).alias(n) for n in ("title", "body", "author")],
                        german_datetime(field("created_at")).alias("created_at"))
    before = Window.partitionBy(id_col).orderBy("pos")   # one page's comments
    parent = F.when(F.col("level") == 1, F.last(F.when(F.col("level") == 0, F.col("pos")), ignorenulls=True).over(before))
    return flat.withColumn("parent_pos", parent).select(id_col, "pos", "level", "parent_pos", "title", "body",
                                                        "author", "created_at")


def pages_until_short(items: DataFrame, key_col: str, page_col: str,
                      page_size: int = COMMENT_PAGE_SIZE) -> DataFrame:
    """S12 paging: pages are read in order until the first page with fewer
    than ``page_size`` top-level items (that page included)."""
    counts = items.groupBy(key_col, page_col).agg(F.count(F.lit(1)).alias("_n"))
    last = (counts.filter(F.col("_n") < page_size).groupBy(key_col)
            .agg(F.min(page_col).alias("_last")))
    j = items.join(last, key_col, "left")
    return j.filter(F.col("_last").isNull() | (F.col(page_col) <= F.col("_last"))).drop("_last")


def api_timestamp(created: Column) -> Column:
    """ISO timestamps with or without a fraction."""
    ts = F.coalesce(F.try_to_timestamp(created, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                    F.try_to_timestamp(created, F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    return ts.cast("timestamp_ntz")


def paged_comment_merge(batches: DataFrame, doc_col: str, id_col: str, created_col: str = "created") -> DataFrame:
    """All stored API page batches of a document merged: parsed creation
    time, duplicates across overlapping pages removed (first batch wins), and
    the cursor each next request would use (the document's oldest time)."""
    b = batches.withColumn("created_ts", api_timestamp(F.col(created_col)))
    first = (b.groupBy(doc_col, id_col)
             .agg(F.min_by(F.struct("created_ts", "batch_no"), F.col("batch_no")).alias("_f"))
             .select(doc_col, id_col, F.col("_f.created_ts").alias("created_ts")))
    cursor = first.groupBy(doc_col).agg(F.min("created_ts").alias("cursor"))
    return first.join(cursor, doc_col, "inner")


def paid_filter(listing: DataFrame, source_col: str = "source_id", url_col: str = "url",
                flag_col: str | None = "is_paid") -> DataFrame:
    """F8: drop paid articles: URL markers per outlet, explicit flag otherwise."""
    paid = F.lit(False)
    for sid, marker in PAID_MARKERS.items():
        paid = paid | ((F.col(source_col) == sid) & F.col(url_col).contains(marker))
    if flag_col is not None and flag_col in listing.columns:
        paid = paid | F.coalesce(F.col(flag_col), F.lit(False))
    return listing.filter(~paid)
