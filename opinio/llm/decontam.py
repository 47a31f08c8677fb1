"""Benchmark decontamination by winnowing (DataFrame functions only).

Words are hashed (64 bits); a k-gram hash combines ``GRAM`` = 5 of them. Of
every ``WINDOW`` = 9 neighbouring k-grams the smallest hash, rightmost among
equals, is a fingerprint, in documents and benchmark items alike. Two equal
runs of ``SPAN`` = 13 words hold the same 9 k-grams, so they choose the same
one: every shared run of at least 13 words meets in the join of fingerprints.
A meeting is then extended word by word to both sides (each fingerprint brings
the 21 word hashes that any 13-word window around it covers), and counts if the
equal run has at least 13 words. Item texts that occur repeatedly are joined once.

Items of 1 to 12 words are one window each: their whole word sequence is looked
up at every document position, for the lengths that occur (12 at most).

Fingerprints of the benchmark are broadcast only if their counted size is
bounded (``broadcast_if_bounded``); beyond that the same join shuffles.

Edge cases: null and wordless texts have no words, are never hit and hit
nothing; repeated documents are each reported; a document's result depends on
its text alone, so a null or repeated doc_id does no harm; a null item_id hits words but is not
listed; no benchmark rows: nothing is contaminated. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import ascii_lower, broadcast_if_bounded, written

SPAN = 13
GRAM = 5
WINDOW = SPAN - GRAM + 1
#: Bytes of a benchmark row that is joined: hash, places and up to 21 word hashes, with overhead.
_ROW_BYTES = 400
_KEY = ["doc_id", "_hash", "_length"]


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def _word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _sequence_hash(h: Column, at: Column, n: int) -> Column:
    """Hash of the ``n`` word hashes from index ``at`` (0-based)."""
    out = F.get(h, at)
    for i in range(1, n):
        out = out.bitwiseXOR(F.shiftleft(F.get(h, at + i), i))
    return out


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, p, fp, lo, near): chosen k-grams of the hash arrays ``h``;
    ``near`` holds the word hashes from ``lo`` = p - 8 to p + 12."""
    i, h, g = F.col("i"), F.col("h"), F.col("g")

    def gram(first: Column, at: Column) -> Column:  # four low bits are left free for a place
        out = first
        for k in range(1, GRAM):
            out = out.bitwiseXOR(F.shiftleft(F.get("h", at + k), k))
        return F.shiftleft(F.shiftright(out, 4), 4)

    grams = rows.where(F.col("n") >= SPAN).withColumn("g", F.transform(F.slice(h, 1, F.col("n") - GRAM + 1), gram))
    spread = grams.select(*keys, "n", "h", "g", F.explode(F.sequence(F.lit(0), F.col("n") - SPAN)).alias("i"))

    def chosen(first: int) -> Column:  # the smallest, rightmost among equals: 8 - offset in the low bits
        return F.least(*[F.get(g, i + first + o).bitwiseOR(F.lit(WINDOW - 1 - o)) for o in range(WINDOW)])

    def place(value: Column, first: int) -> Column:
        return i + first + WINDOW - 1 - value.bitwiseAND(F.lit(15)).cast("int")

    kept = spread.where((i == 0) | (place(chosen(0), 0) != place(chosen(-1), -1)))
    p, value = F.col("p"), F.col("value")
    return (kept.withColumn("value", chosen(0)).withColumn("p", place(value, 0))
            .withColumn("lo", F.greatest(p - WINDOW + 1, F.lit(0)))
            .select(*keys, "n", "p", F.shiftright(value, 4).alias("fp"), "lo",
                    F.slice(h, F.col("lo") + 1, F.least(p + SPAN, F.col("n")) - F.col("lo")).alias("near")))


def _equal_words(step: int, most: int) -> Column:
    """How many words in a row, from (p, q) by ``step``, are equal (the place itself only forwards)."""
    first = 0 if step > 0 else -1
    same = F.transform(F.sequence(F.lit(first), F.lit(first + step * (most - 1)), F.lit(step)), lambda t: F.coalesce(
        F.get("near", F.col("p") - F.col("lo") + t) == F.get("inear", F.col("q") - F.col("ilo") + t), F.lit(False)))
    first_off = F.array_position(same, F.lit(False)).cast("int")
    return F.when(first_off == 0, F.lit(most)).otherwise(first_off - 1)


def _long_hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    marks = written(_fingerprints(items, ["item_class"]).select(
        "item_class", F.col("p").alias("q"), "fp", F.col("lo").alias("ilo"), F.col("near").alias("inear")), "items")
    met = _fingerprints(docs, _KEY).join(broadcast_if_bounded(marks, _ROW_BYTES), "fp")
    run = (met.withColumn("left", _equal_words(-1, WINDOW - 1))
           .withColumn("right", _equal_words(1, SPAN)))
    return (run.where(F.col("left") + F.col("right") >= SPAN)
            .select(*_KEY, "item_class", (F.col("p") - F.col("left")).alias("start"),
                    (F.col("p") + F.col("right")).alias("stop")))


def _short_hits(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    h, i = F.col("h"), F.col("i")
    short = items.where(F.col("n") < SPAN)
    whole = F.coalesce(*[F.when(F.col("n") == n, _sequence_hash(h, F.lit(0), n)) for n in lengths])
    short = short.select("item_class", F.col("n").alias("m"), whole.alias("fp"), F.col("h").alias("ih"))
    tries = F.array(*[F.struct(F.lit(n).alias("m"), _sequence_hash(h, i, n).alias("fp"), F.slice(h, i + 1, n).alias("dh"))
                      for n in lengths])
    spread = (docs.where("n > 0").select(*_KEY, "n", "h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
              .select(*_KEY, "n", "i", F.explode(tries).alias("t")).where(i + F.col("t.m") <= F.col("n"))
              .select(*_KEY, "i", "t.*"))
    return (spread.join(broadcast_if_bounded(short, _ROW_BYTES), ["m", "fp"]).where("dh = ih")
            .select(*_KEY, "item_class", F.col("i").alias("start"), (i + F.col("m")).alias("stop")))


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, classes): equal runs (key, item_class, start, stop) in words, and the
    item ids of each class of equal item texts."""
    hashed = docs.select(*_keys(), _word_hashes(F.col("text")).alias("h")).withColumn("n", F.size("h"))
    items = benchmark.select("item_id", _word_hashes(F.col("text")).alias("h")).withColumn("n", F.size("h")).where("n > 0")
    items = written(items.withColumn("item_class", F.xxhash64("n", "h")), "benchmark")
    texts = items.groupBy("item_class").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    runs = _long_hits(hashed, texts)
    lengths = sorted(r.n for r in items.where(F.col("n") < SPAN).select("n").distinct().collect())  # 12 at most
    if lengths:
        runs = runs.union(_short_hits(hashed, texts, lengths))
    return runs, items.select("item_class", "item_id").where("item_id is not null").distinct()


def _keys() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("_hash"), F.coalesce(F.length("text"), F.lit(-1)).alias("_length")]


def _per_document(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per hit document key: n_hit, items (sorted texts of the ids)."""
    from pyspark.sql import Window
    runs, classes = hits(docs, benchmark)
    runs = written(runs.distinct(), "runs")
    order = Window.partitionBy(*_KEY).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    spans = runs.groupBy(*_KEY, "start").agg(F.max("stop").alias("stop"))
    new = F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(order), F.lit(0)))
    covered = (spans.withColumn("new", F.greatest(new, F.lit(0))).groupBy(*_KEY)
               .agg(F.sum("new").cast("bigint").alias("n_hit")))
    found = runs.select(*_KEY, "item_class").distinct().join(classes, "item_class")
    items = found.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    return covered.join(items, _null_safe(covered, items), "left").select(
        *[covered[k] for k in _KEY], "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _null_safe(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_hash"] == b["_hash"]) & (a["_length"] == b["_length"])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def overlap(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items array<string>, contaminated."""
    counted = docs.select(*_keys(), F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    hit = written(_per_document(docs, benchmark), "hit")
    out = counted.join(hit, _null_safe(counted, hit), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("bigint"))
    return out.select(counted["doc_id"], "n_words", n_hit.alias("n_hit"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      is_contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    hit = written(_per_document(docs, benchmark).select(*_KEY, "n_hit"), "hit")
    same = (docs["doc_id"].eqNullSafe(hit["doc_id"]) & (F.xxhash64(docs["text"]) == hit["_hash"])
            & (F.coalesce(F.length(docs["text"]), F.lit(-1)) == hit["_length"])
            & is_contaminated(hit["n_hit"], F.size(words(docs["text"]))))
    return docs.join(broadcast_if_bounded(hit, 64), same, "left_anti")
