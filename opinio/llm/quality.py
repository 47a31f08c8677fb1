"""Text quality by regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics (logs of lengths, square
roots of shares). Of the labelled training rows Spark sums, per class, the
count, the vectors and their outer products; the driver gets these sums (one
row a class). A class's covariance is its own, shrunk to the pooled one and to
that one's diagonal; its Cholesky factor is kept. A score is the logistic of the
difference of the two Mahalanobis log densities and priors, divided by
``TEMPERATURE`` as neighbouring statistics are not independent.

Edge cases: null and empty texts have the statistics of an empty text and get
its score; repeated label rows count once per distinct value, and a document
labelled both ways counts in both classes; labels other than 0 and 1 are ignored;
a class without training rows: every score is the other class's share (1 or 0; 0.5
if there are no labels at all). Very long texts are read whole. Other columns pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import small_batches, written

FEATURES = ("log_chars", "log_words", "word_length", "long_words", "distinct_words", "repeated_neighbours", "log_lines",
            "distinct_lines", "upper", "digits", "marks", "odd_marks", "white", "top_word", "not_ascii", "sentence_ends")
OWN_SHARE = 0.7
DIAGONAL_SHARE = 0.1
RIDGE = 1e-3
TEMPERATURE = 3.0


@cache
def _classes() -> np.ndarray:
    """Code point -> bits: 1 upper, 2 digit, 4 white, 8 letter, 16 sentence end or comma."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        table[cp] = c.isupper() | c.isdigit() << 1 | c.isspace() << 2 | c.isalpha() << 3 | (c in ".,!?;:") << 4
    return table


def statistics(text: str | None) -> list[float]:
    """The ``FEATURES`` of a whole text."""
    text = text or ""
    kinds = _classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    n = max(1, len(text))
    count = np.bincount(kinds, minlength=32)
    has = lambda bit: sum(int(count[k]) for k in range(32) if k & bit)
    marks = int(sum(count[k] for k in range(32) if not k & 14))
    words = text.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    tally: dict[str, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    same = sum(map(str.__eq__, words[1:], words[:-1]))
    share = lambda k, of: float(np.sqrt(k / of))
    return [float(np.log1p(len(text))), float(np.log1p(len(words))), float(np.log1p(lengths.mean() if len(words) else 0)),
            share(int((lengths > 12).sum()), w), share(len(tally), w), share(same, w), float(np.log1p(len(lines))),
            share(len(set(lines)), max(1, len(lines))), share(has(1), n), share(has(2), n), share(marks, n),
            share(marks - int(count[16]), n), share(has(4), n), share(max(tally.values(), default=0), w),
            share(len(text.encode("utf-8", "surrogatepass")) - len(text), n), share(text.count(".") + text.count("!!"), w)]


def features(text: Column) -> Column:
    """Column: array<double> of the text's statistics."""
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype="object")

    return of(text)


@dataclass
class QualityModel:
    """Means, inverse Cholesky factors and log constants of classes 0 and 1."""

    prior: tuple[float, float]
    means: np.ndarray
    whiteners: np.ndarray
    constants: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rows of features -> scores in 0..1."""
        if min(self.prior) == 0:
            return np.full(len(x), self.prior[1] if sum(self.prior) else 0.5)
        density = [-0.5 * (((x - self.means[c]) @ self.whiteners[c].T) ** 2).sum(axis=1) + self.constants[c]
                   for c in (0, 1)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -500, 500)))


def fit(rows: DataFrame) -> QualityModel:
    """``rows`` (features array<double>, label): all rows with label 0 or 1 are used."""
    d = len(FEATURES)

    def sums(batches):
        total = {c: (0, np.zeros(d), np.zeros((d, d))) for c in (0, 1)}
        for batch in batches:
            x = np.array(batch["features"].tolist(), float).reshape(-1, d)
            for c in (0, 1):
                own = x[(batch["label"] == c).to_numpy()]
                n, s, ss = total[c]
                total[c] = n + len(own), s + own.sum(axis=0), ss + own.T @ own
        yield pd.DataFrame([(c, i, v) for c, (n, s, ss) in total.items()
                            for i, v in enumerate([float(n), *s, *ss.ravel()]) if n], columns=["label", "i", "v"])

    parts = rows.where(F.col("label").isin(0, 1)).select("features", "label").mapInPandas(sums, "label int, i int, v double")
    got = parts.groupBy("label", "i").agg(F.sum("v").alias("v")).toPandas()  # 2 classes of 1 + d + d * d sums
    return solve({c: g.sort_values("i")["v"].to_numpy() for c, g in got.groupby("label")}, d)


def solve(sums: dict[int, np.ndarray], d: int) -> QualityModel:
    n = [float(sums[c][0]) if c in sums else 0.0 for c in (0, 1)]
    prior = tuple(x / sum(n) if sum(n) else 0.0 for x in n)
    means, whiteners, constants = np.zeros((2, d)), np.zeros((2, d, d)), np.zeros(2)
    if min(n) == 0:
        return QualityModel(prior, means, whiteners, constants)
    own = []
    for c in (0, 1):
        means[c] = sums[c][1:d + 1] / n[c]
        own.append(sums[c][d + 1:].reshape(d, d) / n[c] - np.outer(means[c], means[c]))
    pooled = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    pooled = (1 - DIAGONAL_SHARE) * pooled + DIAGONAL_SHARE * np.diag(np.diag(pooled))
    for c in (0, 1):
        factor = np.linalg.cholesky(OWN_SHARE * own[c] + (1 - OWN_SHARE) * pooled + RIDGE * np.eye(d))
        whiteners[c] = np.linalg.inv(factor)
        constants[c] = np.log(prior[c]) - np.log(np.diag(factor)).sum()
    return QualityModel(prior, means, whiteners, constants)


def score(features_col: Column, model: QualityModel) -> Column:
    """Column: the quality score of a feature vector."""
    @F.pandas_udf("double")
    def of(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(-1, len(FEATURES))))

    return of(features_col)


def train_and_score(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality") -> DataFrame:
    """(doc_id, score) of every row of ``docs``; learns from the ``labels`` of the
    rows for which ``training`` (of doc_id) holds. The statistics are computed once."""
    rows = written(small_batches(docs).select("doc_id", features(F.col("text")).alias("features")), "statistics")
    known = labels.where(training).select("doc_id", F.col(label_col).cast("int").alias("label")).distinct()
    model = fit(rows.where(training).join(known, "doc_id").select("features", "label"))
    return rows.select("doc_id", score(F.col("features"), model).alias("score"))
