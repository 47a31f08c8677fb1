"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the letter 3-grams of every labelled text (one partial count
per task and language, summed by Spark). A language contains an n-gram if the
n-gram makes up at least ``MIN_RATE`` of its n-grams and at least ``MIN_SHARE``
of the highest rate that any language has for it. ``MIN_RATE`` bounds the
n-grams of a language by ``1 / MIN_RATE`` at any input size, so the model that
is broadcast has a proven bound.

The filters of all languages are stored bit-sliced: slot ``i`` holds one bit a
language, so ``HASHES`` lookups and an AND give the bitmask of all languages
containing an n-gram. A text's hits per language are corrected for the false
positives expected from the filter's fill, and the largest decides.

Edge cases: a null text or one without a letter is ``und`` with score 0; a text
none of whose n-grams is known gets the language with the most training texts
and score 0; ties go to the language with more training texts, then to the
smaller name. No training rows: every text is ``und``. Texts of any length are read
whole, in pieces. Repeated training rows count as often as they occur; rows
with a null text or language are not learned from. Further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import small_batches, written

UNDETERMINED = "und"
MIN_RATE = 1e-5
MIN_SHARE = 0.2
HASHES = 5
BITS_PER_GRAM = 12
_PIECE = 1 << 20
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, _SPACE, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def letter_grams(text: str) -> Iterator[np.ndarray]:
    """The 3-grams (21 bits a code point) of the letters of ``text``, words set
    apart by single spaces, in pieces."""
    letters, carry = _letters(), np.array([_SPACE], np.uint32)
    for i in range(0, len(text), _PIECE):
        piece = text[i:i + _PIECE].encode("utf-32-le", "surrogatepass")
        codes = letters[np.frombuffer(piece, np.uint32)]
        if i + _PIECE >= len(text):
            codes = np.append(codes, np.uint32(_SPACE))
        codes = np.concatenate((carry, codes))
        space = codes == _SPACE
        codes = codes[~(space & np.concatenate(([False], space[:-1])))].astype(np.uint64)
        if len(codes) >= 3:
            yield codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
        carry = codes[-2:].astype(np.uint32)


@dataclass
class LanguageModel:
    """``slots``: (words of 64 languages, slots); languages by training texts."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        n, hits = 0, np.zeros(len(self.languages))
        for grams in letter_grams(text):
            n += len(grams)
            masks = _masks(self.slots, grams)
            for i in range(len(hits)):
                hits[i] += np.count_nonzero(masks[i // 64] & np.uint64(1 << i % 64))
        found = np.maximum(0, (hits - n * self.false_rate) / (1 - self.false_rate))
        best = int(np.argmax(found))
        return self.languages[best], float(np.clip(found[best] / max(n, 1), 0, 1))


def _slot_ids(grams: np.ndarray, n_slots: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram, one array a hash function."""
    z = grams * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    step = z >> np.uint64(32) | np.uint64(1)
    for _ in range(HASHES):
        yield (z >> np.uint64(20)) & np.uint64(n_slots - 1)
        z = z + (step << np.uint64(20))


def _masks(slots: np.ndarray, grams: np.ndarray) -> np.ndarray:
    out = None
    for at in _slot_ids(grams, slots.shape[1]):
        got = slots[:, at]
        out = got if out is None else out & got
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial n-gram counts of a task, by language; key 0 counts its texts."""
    held: dict[str, list[np.ndarray]] = {}
    texts: dict[str, int] = {}
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def fold(lang: str) -> None:
        keys, counts = totals.get(lang, (np.empty(0, np.uint64), np.empty(0, np.int64)))
        new, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        merged, back = np.unique(np.concatenate((keys, new)), return_inverse=True)
        totals[lang] = merged, np.bincount(back, np.concatenate((counts, n)), len(merged)).astype(np.int64)

    def rows(lang: str) -> pa.RecordBatch:
        keys, counts = totals.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)),
                                           pa.array(counts)], names=["lang", "gram", "n"])

    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            texts[lang] = texts.get(lang, 0) + 1
            for grams in letter_grams(text):
                held.setdefault(lang, []).append(grams)
                size[lang] = size.get(lang, 0) + len(grams)
            if size.get(lang, 0) >= _PIECE:
                fold(lang)
                size[lang] = 0
                if len(totals[lang][0]) >= _PIECE:
                    yield rows(lang)
    for lang in list(held):
        fold(lang)
    for lang in list(totals):
        yield rows(lang)
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array(list(texts)), pa.array([0] * len(texts), pa.int64()),
                                          pa.array(list(texts.values()), pa.int64())], names=["lang", "gram", "n"])


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with text and language; gram 0: number of texts."""
    rows = small_batches(docs).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
    return (rows.mapInArrow(_count, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          min_rate: float = MIN_RATE, min_share: float = MIN_SHARE) -> LanguageModel:
    """Learn the filters from all rows of ``docs``. The driver gets at most
    ``1 / min_rate`` n-grams a language."""
    counts = written(gram_counts(docs, text_col, lang_col), "gram-counts")
    grams = counts.where("gram <> 0")
    total = grams.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = grams.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rate.groupBy("gram").agg(F.max("rate").alias("top"))
    chosen = (rate.where(F.col("rate") >= min_rate).join(top, "gram")
              .where(F.col("rate") >= min_share * F.col("top")).select("lang", "gram").toPandas())
    texts = counts.where("gram = 0").toPandas()
    order = sorted(zip(-texts["n"], texts["lang"]))
    return build([lang for _, lang in order], chosen)


def build(languages: list[str], chosen: pd.DataFrame) -> LanguageModel:
    """Bit-sliced filters from (lang, gram) rows."""
    most = int(chosen.groupby("lang").size().max()) if len(chosen) else 1
    n_slots = 1 << max(10, int(np.ceil(np.log2(most * BITS_PER_GRAM))))
    slots = np.zeros(((len(languages) + 63) // 64, n_slots), np.uint64)
    for i, lang in enumerate(languages):
        grams = chosen.loc[chosen["lang"] == lang, "gram"].to_numpy(np.int64).astype(np.uint64)
        for at in _slot_ids(grams, n_slots):
            slots[i // 64, at] |= np.uint64(1 << i % 64)
    fill = np.array([np.count_nonzero(slots[i // 64] & np.uint64(1 << i % 64)) / n_slots
                     for i in range(len(languages))])
    return LanguageModel(languages, slots, fill ** HASHES)


def predict_udf(spark, model: LanguageModel):
    """Column function text -> struct(lang_pred, score); the model is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text",
             out: str = "_language") -> DataFrame:
    """``docs`` with a struct column ``out`` (lang_pred, score)."""
    text: Column = F.col(text_col)
    return small_batches(docs).withColumn(out, predict_udf(docs.sparkSession, model)(text))
