"""Sentiment scoring.

Lexicon sentiment explodes tokens inside whole-stage codegen, joins them to
the lexicon (written once, so the planner joins it by its real size) and
aggregates per text. (Scoring inside array higher-order functions was
measured ~30x slower: lambda bodies run interpreted and Spark does not
share subexpressions inside them.)

Model scores arrive as logits per text chunk; ``logits_to_sentiment`` turns
them into (value, error) with array functions, and ``inverse_variance``
combines chunks or models. The nearest-neighbour match of J10 scores query
vectors against the broadcast lexicon, a fixed word list whose bytes are
checked, by NumPy matrix products, never materialising query x lexicon pairs
as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinio.functions.numeric import fround
from opinio.functions.strings import clean_tokens
from opinio.session import ensure_parallelism, write_once

NN_LEXICON_BYTES = 64 * 1024 * 1024   # most bytes of lexicon vectors that are broadcast
MATCH_DISTANCE = 0.25               # vector match threshold (cosine distance)
CHUNK_TOKENS = 512                  # model input length

# Stand-in lexicon (the reference's lexicon files are not
# shipped); frequent function words of the four corpus languages. Columns:
# word, polarity score, subjectivity.
STAND_IN_LEXICON = [
    ("der", 0.1, 0.2), ("die", -0.2, 0.3), ("und", 0.3, 0.1), ("in", -0.1, 0.2),
    ("the", 0.2, 0.4), ("and", 0.15, 0.3), ("of", -0.05, 0.1), ("is", 0.25, 0.6),
    ("le", 0.1, 0.2), ("la", -0.1, 0.3), ("de", 0.05, 0.1), ("et", 0.2, 0.5),
    ("el", 0.2, 0.4), ("que", -0.3, 0.7), ("gut", 0.4, 0.8), ("schlecht", -0.2, 0.9),
]

# Output scales of the three model heads.
SCALES = {
    "stars5": [-1.0, -0.5, 0.0, 0.5, 1.0],       # 1..5 stars mapped to [-1, 1]
    "pos_neg_neu3": [1.0, 0.0, -1.0],            # after swapping entries 1 and 2
    "neg_neu_pos3": [-1.0, 0.0, 1.0],
}

# Accuracy thresholds (value < -0.33 negative, < 0.33 neutral).
NEG_BELOW = -0.33
NEU_BELOW = 0.33


def tokens(text: Column) -> Column:
    """Regex split on whitespace runs (leading/trailing blanks give empty
    tokens, as in the reference)."""
    return F.split(text, r"\s+")


def lexicon_join(words: DataFrame, lexicon: DataFrame, cols: list[str]) -> DataFrame:
    """Left join of token rows to the lexicon, which is written once: the
    planner broadcasts it by its real bytes or else shuffles (AQE splits a hot
    word's partition)."""
    return words.join(write_once(lexicon.select("word", *cols), "lexicon"), "word", "left")


def lexicon_sentiment(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text", value_col: str = "score") -> DataFrame:
    """Per text (value, error, hits, n_tokens): mean and population std of
    the scores of the cleaned tokens found in the lexicon; (0, 1) when no
    token is found. Plan: tokens exploded (whole-stage codegen), left join
    to the lexicon, one aggregation per text whose partial step runs in the
    scan task (a text's tokens are produced together), so only one row per
    text and task is shuffled. Words are cleaned once per text, not once per
    token (``clean_tokens``)."""
    docs = ensure_parallelism(docs, id_col)
    # token count and cleaned tokens are computed once per text, below the
    # explode (an expression next to the generator would run once per token)
    per_text = docs.select(F.col(id_col), F.size(tokens(F.col(text_col))).alias("_n"),
                           clean_tokens(F.col(text_col)).alias("_t"))
    words = per_text.select(id_col, "_n", F.explode_outer("_t").alias("word"))
    j = lexicon_join(words, lexicon, [F.col(value_col).alias("_s")])
    agg = j.groupBy(id_col).agg(F.avg("_s").alias("_m"), F.stddev_pop("_s").alias("_sd"),
                                F.count("_s").alias("hits"), F.max("_n").alias("n_tokens"))
    return agg.select(id_col,
                      F.coalesce(fround(F.col("_m")), F.lit(0.0)).alias("value"),
                      F.coalesce(fround(F.col("_sd")), F.lit(1.0)).alias("error"),
                      F.col("hits").cast("int").alias("hits"), F.col("n_tokens").cast("int").alias("n_tokens"))


def polarity_subjectivity(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id",
                          text_col: str = "text") -> DataFrame:
    """N9 (re-aimed): lexical polarity and subjectivity as the mean over the
    lexicon hits of a polarity and a subjectivity column; the error is
    fixed at 1 as in the reference; no hit -> (0, 0)."""
    docs = ensure_parallelism(docs, id_col)
    words = docs.select(F.col(id_col), F.explode_outer(clean_tokens(F.col(text_col))).alias("word"))
    j = lexicon_join(words, lexicon, [F.col("score").alias("_p"), F.col("subjectivity").alias("_q")])
    agg = j.groupBy(id_col).agg(F.avg("_p").alias("_p"), F.avg("_q").alias("_q"))
    return agg.select(id_col, F.coalesce(fround(F.col("_p")), F.lit(0.0)).alias("polarity"),
                      F.coalesce(fround(F.col("_q")), F.lit(0.0)).alias("subjectivity"),
                      F.lit(1.0).alias("error"))


# ---- model outputs ---------------------------------------------------------------
def token_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 size: int = CHUNK_TOKENS, truncate: bool = False) -> DataFrame:
    """Consecutive, non-overlapping pieces of ``size`` tokens covering the
    whole text (``truncate`` keeps only the first piece, as the reference's
    flag does). One output row per piece: (id, chunk, n_tokens, tokens)."""
    docs = ensure_parallelism(docs, id_col)
    toks = tokens(F.col(text_col))
    n_chunks = F.greatest(F.lit(1), F.ceil(F.size(toks) / F.lit(float(size))).cast("int"))
    if truncate:
        n_chunks = F.lit(1)
    t = docs.select(F.col(id_col), toks.alias("_t"), n_chunks.alias("_n"))
    c = t.select(id_col, "_t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("chunk"))
    piece = F.slice(F.col("_t"), F.col("chunk") * size + 1, size)
    return c.select(id_col, "chunk", F.size(piece).alias("n_tokens"), piece.alias("tokens"))


def softmax(logits: Column) -> Column:
    m = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / s)


def logits_to_sentiment(logits: Column, scale: str) -> tuple[Column, Column]:
    """Softmax weights -> expectation over the scale (value) and the
    weighted standard deviation around it (error)."""
    if scale == "pos_neg_neu3":  # the 3-class head lists pos, neg, neu
        logits = F.array(logits[0], logits[2], logits[1])
    w = softmax(logits)
    sc = F.array(*[F.lit(float(x)) for x in SCALES[scale]])
    value = F.aggregate(F.zip_with(w, sc, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    var = F.aggregate(F.zip_with(w, sc, lambda a, b: a * (b - value) * (b - value)), F.lit(0.0),
                      lambda acc, x: acc + x)
    return value, F.sqrt(var)


def inverse_variance(value: Column, error: Column) -> tuple[Column, Column]:
    """N5/G17 (aggregate form): ``sum(v/e^2)/sum(1/e^2)``, error
    ``sqrt(1/sum(1/e^2))``. A zero error makes its rows win outright (mean
    of the zero-error values, error 0) instead of NumPy's inf/nan."""
    zero = error == 0
    n0 = F.sum(F.when(zero, 1).otherwise(0))
    w = F.when(zero, F.lit(None)).otherwise(F.lit(1.0) / (error * error))
    v = F.when(n0 > 0, F.avg(F.when(zero, value))).otherwise(F.sum(value * w) / F.sum(w))
    e = F.when(n0 > 0, F.lit(0.0)).otherwise(F.sqrt(F.lit(1.0) / F.sum(w)))
    return v, e


def inverse_variance_pair(v1: Column, e1: Column, v2: Column, e2: Column) -> tuple[Column, Column]:
    """N5 (row form) for two models of the ensemble."""
    z1, z2 = e1 == 0, e2 == 0
    w1, w2 = F.lit(1.0) / (e1 * e1), F.lit(1.0) / (e2 * e2)
    v = (F.when(z1 & z2, (v1 + v2) / 2).when(z1, v1).when(z2, v2)
         .otherwise((v1 * w1 + v2 * w2) / (w1 + w2)))
    e = F.when(z1 | z2, F.lit(0.0)).otherwise(F.sqrt(F.lit(1.0) / (w1 + w2)))
    return v, e


def combine_chunks(scored: DataFrame, key: str, value_col: str = "value", error_col: str = "error") -> DataFrame:
    """N5 over chunks: one (value, error) per text."""
    v, e = inverse_variance(F.col(value_col), F.col(error_col))
    return scored.groupBy(key).agg(fround(v).alias("value"), fround(e).alias("error"))


def hashed_feature_logits(chunks: DataFrame, key: str, heads: dict[str, tuple[int, int]]) -> DataFrame:
    """Deterministic stand-in scorer (no model files are available): for each
    head ``name -> (n_classes <= 5, first hex digit)``, logit k of a chunk is
    the mean over its tokens of a weight in [-1, 1] taken from three hex digits
    of the token's MD5 (the k-th three counted from the right end of the head's
    3 * n_classes digits). Tokens are exploded and summed per chunk
    (whole-stage codegen, partial aggregation in the scan task). Real models
    plug in through ``pandas_scorer``."""
    t = chunks.select(key, "chunk", F.size("tokens").alias("_n"), F.explode_outer("tokens").alias("_tok"))
    bits = [F.conv(F.substring(F.md5("_tok"), first, 3 * n), 16, 10).cast("bigint").alias(f"_{name}")
            for name, (n, first) in heads.items()]
    t = t.select(key, "chunk", "_n", *bits)

    def weight(name: str, k: int) -> Column:   # thousandths
        return F.shiftright(f"_{name}", 12 * k).bitwiseAND(F.lit(4095)) % 2001 - 1000
    sums = [F.coalesce(F.sum(weight(name, k)), F.lit(0)).alias(f"_{name}_{k}")
            for name, (n, _) in heads.items() for k in range(n)]
    agg = t.groupBy(key, "chunk").agg(F.max("_n").alias("_n"), *sums)
    den = F.greatest(F.col("_n"), F.lit(1))
    return agg.select(key, "chunk", *[F.array(*[F.col(f"_{name}_{k}") / F.lit(1000.0) / den for k in range(n)]).alias(name)
                                      for name, (n, _) in heads.items()])


#: Head -> classes and first hex digit of its weights.
HASHED_HEADS = {"l5": (5, 1), "l3": (3, 16)}


def pandas_scorer(fn, n_classes: int):
    """Wrap a batch model ``fn(list[list[str]]) -> np.ndarray[n, n_classes]``
    for ``mapInPandas`` over chunk rows (Arrow batches, one model load per
    task)."""
    def run(batches):
        for pdf in batches:
            logits = fn(pdf["tokens"].tolist())
            out = pdf.drop(columns=["tokens"]).copy()
            out["logits"] = [list(map(float, r)) for r in np.asarray(logits).reshape(len(pdf), n_classes)]
            yield out
    return run


def model_scores(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """N3-N5 end to end: per chunk two model heads (5-star, 3-class) ->
    (value, error) per head -> combined per text over chunks -> ensemble of
    the two heads: (key, ens_value, ens_error, m1_value, m1_error, m2_value, m2_error)."""
    logits = hashed_feature_logits(chunks, key, HASHED_HEADS)
    v1, e1 = logits_to_sentiment(F.col("l5"), "stars5")
    v2, e2 = logits_to_sentiment(F.col("l3"), "pos_neg_neu3")
    per = logits.select(key, v1.alias("v1"), e1.alias("e1"), v2.alias("v2"), e2.alias("e2"))
    a1, b1 = inverse_variance(F.col("v1"), F.col("e1"))
    a2, b2 = inverse_variance(F.col("v2"), F.col("e2"))
    comb = per.groupBy(key).agg(a1.alias("m1_value"), b1.alias("m1_error"),
                                a2.alias("m2_value"), b2.alias("m2_error"))
    ev, ee = inverse_variance_pair(F.col("m1_value"), F.col("m1_error"), F.col("m2_value"), F.col("m2_error"))
    return comb.select(key, fround(ev).alias("ens_value"), fround(ee).alias("ens_error"),
                       *[fround(F.col(c)).alias(c) for c in ("m1_value", "m1_error", "m2_value", "m2_error")])


# ---- evaluation --------------------------------------------------------------------
def sentiment_class(value: Column) -> Column:
    """N15 thresholds: < -0.33 negative (-1), < 0.33 neutral (0), else 1."""
    return F.when(value < NEG_BELOW, -1).when(value < NEU_BELOW, 0).otherwise(1)


def model_accuracy(pred: DataFrame, model_col: str = "model", truth_col: str = "label",
                   value_col: str = "value") -> DataFrame:
    """Total and per-class accuracy per model (exact sample size)."""
    p = pred.withColumn("_hit", (sentiment_class(F.col(value_col)) == F.col(truth_col)).cast("int"))
    t = F.col(truth_col)

    def cls(c):
        return F.try_divide(F.sum(F.when(t == c, F.col("_hit"))), F.sum(F.when(t == c, 1)).cast("double"))
    return p.groupBy(model_col).agg(
        F.count(F.lit(1)).alias("n"),
        fround(F.sum("_hit") / F.count(F.lit(1))).alias("accuracy"),
        fround(cls(-1)).alias("acc_neg"), fround(cls(0)).alias("acc_neu"), fround(cls(1)).alias("acc_pos"))


def precision_recall_f1(pred: DataFrame, model_col: str = "model", truth_col: str = "label",
                        pred_col: str = "pred", classes=(-1, 0, 1)) -> DataFrame:
    """Per model and class: precision, recall, F1 from the confusion
    counts (one aggregation), plus the model's accuracy."""
    conf = pred.groupBy(model_col, truth_col, pred_col).agg(F.count(F.lit(1)).alias("n"))
    rows = None
    for c in classes:
        r = conf.groupBy(model_col).agg(
            F.lit(c).alias("class"),
            F.sum(F.when((F.col(truth_col) == c) & (F.col(pred_col) == c), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col(truth_col) != c) & (F.col(pred_col) == c), F.col("n")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col(truth_col) == c) & (F.col(pred_col) != c), F.col("n")).otherwise(0)).alias("fn"),
            F.sum(F.when(F.col(truth_col) == F.col(pred_col), F.col("n")).otherwise(0)).alias("correct"),
            F.sum("n").alias("total"))
        rows = r if rows is None else rows.unionByName(r)
    prec = F.try_divide(F.col("tp"), (F.col("tp") + F.col("fp")).cast("double"))
    rec = F.try_divide(F.col("tp"), (F.col("tp") + F.col("fn")).cast("double"))
    f1 = F.try_divide(2 * prec * rec, prec + rec)
    return rows.select(model_col, "class", "tp", "fp", "fn", fround(prec).alias("precision"),
                       fround(rec).alias("recall"), fround(f1).alias("f1"),
                       fround(F.col("correct") / F.col("total")).alias("accuracy"))


# ---- J10 nearest-neighbour match ------------------------------------------------------
NN_SLICE_CELLS = 4_000_000   # query x lexicon similarities held at once (32 MB of doubles)


def _as_matrix(vecs: pd.Series) -> np.ndarray:
    return np.stack(vecs.map(lambda v: np.asarray(v, dtype=np.float64)).to_numpy())


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(mat, axis=1)
    return mat / np.where(norms == 0, 1.0, norms)[:, None]


def nearest_lexicon(queries: DataFrame, lexicon: DataFrame, id_col: str = "qid", vec_col: str = "vec",
                    max_bytes: int = NN_LEXICON_BYTES) -> DataFrame:
    """For every query vector the lexicon entry (lex_id, vec, score) with
    the smallest cosine distance (ties: lowest ``lex_id``), with that distance
    and the entry's score; no rows for an empty lexicon. A lexicon is a word
    list that does not grow with the texts, so it is broadcast as one matrix;
    its bytes are checked first and a ValueError says if it is no such list.
    Query Arrow batches are scored by matrix products, in slices of at most
    ``NN_SLICE_CELLS`` similarities; queries are neither copied nor shuffled."""
    spark = queries.sparkSession
    size = lexicon.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dim")).first()
    if size.n * (size.dim or 0) * 8 > max_bytes:
        raise ValueError(f"{size.n} lexicon vectors of {size.dim} numbers exceed the broadcast bound of {max_bytes} bytes")
    rows = sorted(lexicon.select(F.col("lex_id").cast("long"), "vec", F.col("score").cast("double")).collect())
    schema = T.StructType([queries.schema[id_col], T.StructField("lex_id", T.LongType()),
                           T.StructField("distance", T.DoubleType()), T.StructField("score", T.DoubleType())])
    if not rows:
        return spark.createDataFrame([], schema)
    ids, vecs, scores = zip(*rows)
    shared = spark.sparkContext.broadcast((np.array(ids), _unit_rows(np.array(vecs, np.float64)), np.array(scores)))

    def score(batches):
        ids, mat, scores = shared.value
        step = max(1, NN_SLICE_CELLS // len(ids))
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                part = pdf.iloc[lo:lo + step]
                distance = 1.0 - _unit_rows(_as_matrix(part[vec_col])) @ mat.T
                best = distance.argmin(axis=1)  # the first minimum: the lowest lex_id
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "lex_id": ids[best],
                                    "distance": distance.min(axis=1), "score": scores[best]})
    return queries.select(id_col, vec_col).mapInPandas(score, schema)
