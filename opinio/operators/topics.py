"""Topic detection (N6-N8) and stop-word lists.

``topics_top5``: word frequency per text minus common words, the five most
frequent words seen more than twice, ties broken by first occurrence. Plan:
words are counted inside their text (``word_counts``), so neither texts nor
their words are exchanged; common words are removed by a broadcast anti-join
(the list has a fixed size bound), and only words seen 3+ times reach the
per-text ranking window -- a text's window holds at most its own vocabulary.

``centroid_distance``: the mean word vector of a text (ML ``Summarizer``,
JVM-side) and each distinct word's cosine distance to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from opinio.functions.numeric import fround
from opinio.functions.strings import clean_text, clean_tokens, clean_word, non_word_class
from opinio.session import by_repeats, ensure_parallelism, small_batches, write_once

TOP_TOPICS = 5
MIN_COUNT_EXCLUSIVE = 2     # a topic must occur more than twice
COMMON_WORDS = 1000         # size of the corpus-derived common-word list


def read_stopword_csv(spark, path: str) -> DataFrame:
    """The common-words CSV (number, word, translation): the first two
    lines are comments/header; the word is column 2 exactly as a CSV reader
    splits it (a line with a '.' instead of the first comma yields its
    English column; an empty word is kept and later removes empty tokens).
    Words are cleaned like tokens (letters incl. umlauts, lower-cased)."""
    raw = spark.read.text(path)
    lines = raw.filter(~F.col("value").startswith("#"))
    lines = lines.filter(F.col("value") != "Number,German,in English")
    word = F.split(F.col("value"), ",").getItem(1)
    return lines.select(clean_word(F.regexp_replace(word, '"', "")).alias("word")).distinct()


def common_words(texts: DataFrame, id_col: str = "id", text_col: str = "text",
                 top_n: int = COMMON_WORDS) -> DataFrame:
    """Corpus-derived common words: the ``top_n`` words by document frequency
    (ties by word), plus the empty word. A top-k report: bounded output."""
    texts = ensure_parallelism(texts, id_col)
    words = texts.select(F.col(id_col).alias("_d"),
                         F.explode(F.array_distinct(clean_tokens(F.col(text_col), digits=True))).alias("word"))
    df = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    top = df.orderBy(F.col("df").desc(), F.col("word").asc()).limit(top_n).select("word")
    return top.unionByName(texts.sparkSession.createDataFrame([("",)], "word string"))


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text of words parted by single spaces) -> (id, word, cnt, first_pos): each
    distinct word of a text with its count and first place (from 0)."""
    for batch in batches:
        words, counts, first, row = [], [], [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            if text is not None:
                found = text.split(" ")
                of_text = Counter(found)  # in the order of first places
                places = dict(zip(reversed(found), range(len(found) - 1, -1, -1)))
                words.extend(of_text)
                counts.extend(of_text.values())
                first.extend(map(places.__getitem__, of_text))
                row.extend(repeat(at, len(of_text)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row, pa.int32())), pa.array(words, pa.string()), pa.array(counts, pa.int64()),
             pa.array(first, pa.int32())], names=[batch.schema.names[0], "word", "cnt", "first_pos"])


def word_counts(texts: DataFrame, words: Column, id_col: str) -> DataFrame:
    """(id, word, cnt, first_pos) of every id's texts; ``words``: a text's words parted by
    single spaces. A text's words are counted where it lies; only the words of ids that stand in more
    than one row are exchanged and added up (the repeated ids are found from ids alone)."""
    rows = small_batches(texts).select(F.col(id_col), words.alias("_words"))

    schema = StructType([rows.schema[0], *(StructField(*f) for f in (
        ("word", StringType()), ("cnt", LongType()), ("first_pos", IntegerType())))])

    def counted(of: DataFrame) -> DataFrame:
        return of.select(id_col, "_words").mapInArrow(counted_words, schema)

    once, repeated = by_repeats(rows, id_col)
    if repeated is None:
        return counted(once)
    more = counted(repeated).groupBy(id_col, "word").agg(F.sum("cnt").alias("cnt"), F.min("first_pos").alias("first_pos"))
    return counted(once).unionByName(more)


def word_frequency(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, word, cnt, first_pos) of whitespace-split, cleaned words; a
    word that cleaning empties keeps its place."""
    spaced = F.regexp_replace(F.col(text_col), r"\s+", " ")
    return word_counts(ensure_parallelism(texts, id_col), clean_text(spaced, digits=True), id_col)


def topics_top5(texts: DataFrame, stopwords: DataFrame | None = None, id_col: str = "id",
                text_col: str = "text", top: int = TOP_TOPICS, common_n: int = COMMON_WORDS) -> DataFrame:
    """(id, rank, topic, cnt) -- up to five words per text. Without a
    ``stopwords`` table the common words are the corpus's ``common_n`` most
    frequent words by document frequency, derived from the same counts per
    (text, word); each branch counts the texts' words itself."""
    words = F.trim(F.regexp_replace(clean_text(F.col(text_col), digits=True), r"\s+", " "))
    freq = word_counts(ensure_parallelism(texts, id_col), words, id_col).where("word <> ''")
    if stopwords is None:
        dfreq = freq.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
        top_words = dfreq.orderBy(F.col("df").desc(), F.col("word").asc()).limit(common_n).select("word")
        stop = F.broadcast(top_words)          # bounded by common_n rows
    else:
        stop = write_once(stopwords.select("word").distinct(), "stopwords")
    freq = (freq.join(stop, "word", "left_anti")
            .filter(F.col("cnt") > MIN_COUNT_EXCLUSIVE))
    rk = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("cnt").desc(), F.col("first_pos").asc()))
    return (freq.withColumn("rank", rk).filter(F.col("rank") <= top)
            .select(id_col, "rank", F.col("word").alias("topic"), "cnt"))


def topic_rows(topics: DataFrame, lemma_id_fn, run_date: Column) -> tuple[DataFrame, DataFrame]:
    """N7 (re-aimed persistence): topics -> (lemma rows, topic_detector_result
    rows) with deterministic lemma ids (lemma = the topic word, 30 chars)."""
    lem = topics.select(F.substring("topic", 1, 30).alias("lemma"), F.col("article_id"))
    lemmas = lem.select("lemma").distinct().select(lemma_id_fn(F.col("lemma")).alias("id"), "lemma")
    res = (lem.select(F.col("article_id").alias("article_header_id"), F.lit(1).alias("topic_detector_id"),
                      lemma_id_fn(F.col("lemma")).alias("lemma_id"), run_date.alias("run_date")).distinct())
    return lemmas, res


def hashed_vector_lookup(words: DataFrame, vectors: DataFrame, word_col: str = "word") -> DataFrame:
    """Word -> vector through hashed buckets (stand-in for subword-hashed
    word vectors): bucket = md5-derived integer mod the number of vectors;
    the vector whose id equals the bucket. Words whose bucket has no vector
    are dropped."""
    n = vectors.agg(F.count(F.lit(1))).scalar()
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col(word_col)), 1, 15), 16, 10).cast("bigint"), n)
    v = vectors.select(F.col("vec_id").alias("_bucket"), F.col("embedding").alias("vec"))
    return words.withColumn("_bucket", bucket).join(v, "_bucket", "inner").drop("_bucket")


def cosine_distance(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x))
    return F.lit(1.0) - dot / (na * nb)


def centroid_distance(texts: DataFrame, vectors: DataFrame, id_col: str = "id",
                      text_col: str = "text") -> DataFrame:
    """Per text, the centroid of its words' vectors (all occurrences) and
    the cosine distance of each distinct word to it, ascending within a text
    (the farthest word is the last). Words are counted per text first and the
    distinct words of the corpus are looked up once; a vector then goes along
    once per (text, word), weighted by the count."""
    texts = ensure_parallelism(texts, id_col)
    w = texts.select(F.col(id_col), F.explode(F.split(F.col(text_col), r"\s+")).alias("w"))
    w = w.select(id_col, F.regexp_replace(F.col("w"), non_word_class(False, keep_ws=False), "").alias("word"))
    counts = w.groupBy(id_col, "word").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    wv = counts.join(hashed_vector_lookup(counts.select("word").distinct(), vectors), "word", "inner")
    cent = (wv.groupBy(id_col).agg(Summarizer.mean(array_to_vector(F.col("vec")), F.col("_n")).alias("_c"))
            .select(id_col, vector_to_array("_c").alias("centroid")))
    j = wv.join(cent, id_col, "inner")
    vec = F.transform(F.col("vec"), lambda x: x.cast("double"))
    return (j.select(id_col, "word", fround(cosine_distance(vec, F.col("centroid"))).alias("distance"))
            .sortWithinPartitions(id_col, "distance"))
