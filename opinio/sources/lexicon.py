"""Sentiment lexicon files (S3): ``word|POS<TAB>score<TAB>inflection,inflection``.

Several files are read in order (negative, then positive); a word's last
entry wins, inflections carry their headword's score. Later-wins is an
aggregation: ``max_by(score, (file_no, line_no, position))`` per cleaned
word, so no ordering of the whole lexicon is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.functions.strings import clean_word


def read_lexicon_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of each file with (file_no, line_no). Line numbers come from
    ``monotonically_increasing_id`` right after the scan, which increases in
    file order for a single file (splits are read in order)."""
    out = None
    for i, p in enumerate(paths):
        lines = spark.read.text(p).select(F.lit(i).alias("file_no"),
                                          F.monotonically_increasing_id().alias("line_no"),
                                          F.col("value"))
        out = lines if out is None else out.unionByName(lines)
    return out


def parse_lexicon(lines: DataFrame) -> DataFrame:
    """(file_no, line_no, value) -> (word, score) with later entries winning."""
    parts = F.split(F.col("value"), "\t")
    head = F.split(parts.getItem(0), r"\|").getItem(0)
    infl = F.when(F.size(parts) > 2, F.split(parts.getItem(2), ",")).otherwise(F.array())
    words = F.concat(F.array(head), infl)
    e = (lines.filter(F.col("value").contains("|") & (F.size(parts) >= 2))
         .select("file_no", "line_no", parts.getItem(1).try_cast("double").alias("score"),
                 F.posexplode(words).alias("pos", "raw")))
    e = e.select("file_no", "line_no", "pos", "score", clean_word(F.col("raw")).alias("word"))
    e = e.filter(F.col("score").isNotNull() & (F.col("word") != ""))
    return (e.groupBy("word").agg(F.max_by("score", F.struct("file_no", "line_no", "pos")).alias("score")))
