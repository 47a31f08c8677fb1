"""Registered text-analytics queries (N, J9, J10, G13, G15, O4, S7, S8) with oracles.

Texts: ``documents`` (whole texts), the latest article bodies of the news
model, and comment bodies. Vectors: ``embeddings``. Labels: ``labels``.
The sentiment lexicon is a fixed stand-in (the reference's lexicon files are
not shipped); everything else is derived from the tables by Spark.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions.strings import UMLAUT_DIGRAPHS, WORD_CHARS, WORD_CHARS_DIGITS
from opinio.operators import control as C
from opinio.operators import corpus as K
from opinio.operators import sentences as SN
from opinio.operators import scorer as SC
from opinio.operators import sentiment as S
from opinio.operators import topics as TP
from opinio.plans.marts import article_body_last
from opinio.plans.registry import query
from opinio.session import checkpoint_dir, ensure_parallelism, scratch_path, write_once
from opinio.sources.news_model import NewsModel

LEX_SQL = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{w}', {s}e0, {j}e0)" for w, s, j in S.STAND_IN_LEXICON) + ") t(word, score, subjectivity))"


def clean_sql(x: str, digits: bool = False) -> str:
    chars = WORD_CHARS_DIGITS if digits else WORD_CHARS
    return f"lower(regexp_replace({x}, '[^{chars}]+', '', 'g'))"


def _m(spark, sf):
    return NewsModel(spark, sf)


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(S.STAND_IN_LEXICON, "word string, score double, subjectivity double")


def documents(m: NewsModel) -> DataFrame:
    return m.table("documents").select("doc_id", "text")


# ---- N1 / N9 lexicon sentiment ------------------------------------------------------
_N1 = f"""
WITH lex AS {LEX_SQL},
tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents),
hits AS (SELECT t.doc_id, l.score, l.subjectivity FROM tok t JOIN lex l ON l.word = {clean_sql('t.w')}),
agg AS (SELECT doc_id, avg(score) AS m, stddev_pop(score) AS sd, avg(subjectivity) AS subj, count(*) AS n
        FROM hits GROUP BY doc_id)
"""


@query("lexicon_sentiment", _N1 + """
SELECT d.doc_id, CASE WHEN a.n IS NULL THEN 0.0 ELSE round(a.m, 9) END AS value,
       CASE WHEN a.n IS NULL THEN 1.0 ELSE round(a.sd, 9) END AS error,
       CAST(coalesce(a.n, 0) AS INT) AS hits, CAST(len(regexp_split_to_array(d.text, '\\s+')) AS INT) AS n_tokens
FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id""")
def q_lexicon_sentiment(spark, sf):
    return S.lexicon_sentiment(documents(_m(spark, sf)), lexicon(spark))


@query("polarity_subjectivity", _N1 + """
SELECT d.doc_id, CASE WHEN a.n IS NULL THEN 0.0 ELSE round(a.m, 9) END AS polarity,
       CASE WHEN a.n IS NULL THEN 0.0 ELSE round(a.subj, 9) END AS subjectivity, 1.0e0 AS error
FROM documents d LEFT JOIN agg a ON a.doc_id = d.doc_id""")
def q_polarity_subjectivity(spark, sf):
    return S.polarity_subjectivity(documents(_m(spark, sf)), lexicon(spark))


# ---- N3-N5 model outputs ------------------------------------------------------------
@query("token_chunks", """
WITH t AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS tk FROM documents),
c AS (SELECT doc_id, tk, unnest(range(0, greatest(1, CAST(ceil(len(tk) / 512.0) AS INT)))) AS chunk FROM t)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(len(tk[chunk * 512 + 1 : chunk * 512 + 512]) AS INT) AS n_tokens
FROM c""")
def q_token_chunks(spark, sf):
    return S.token_chunks(documents(_m(spark, sf))).select("doc_id", "chunk", "n_tokens")


def _logits(m: NewsModel) -> DataFrame:
    e = m.table("embeddings").select("vec_id", "label", "embedding")
    l5 = F.transform(F.slice("embedding", 1, 5), lambda x: x.cast("double") * 10)
    l3 = F.transform(F.slice("embedding", 6, 3), lambda x: x.cast("double") * 10)
    return e.select("vec_id", "label", l5.alias("l5"), l3.alias("l3"))


def _sm_sql(l: str, scale: list[float]) -> tuple[str, str]:
    """DuckDB value/error of softmax(l) over ``scale``."""
    w = f"list_transform({l}, lambda x: exp(x - list_max({l})) / list_sum(list_transform({l}, lambda y: exp(y - list_max({l})))))"
    sc = "[" + ", ".join(f"{x}e0" for x in scale) + "]"
    value = f"list_sum(list_transform({w}, lambda x, i: x * {sc}[i]))"
    return w, value


_LOGITS_SQL = """
lg AS (SELECT vec_id, label, list_transform(embedding[1:5], lambda x: CAST(x AS DOUBLE) * 10) AS l5,
              list_transform(embedding[6:8], lambda x: CAST(x AS DOUBLE) * 10) AS l3 FROM embeddings),
lg2 AS (SELECT *, [l3[1], l3[3], l3[2]] AS l3s FROM lg)"""


def _vals_sql(heads: tuple = ("stars5", "pos_neg_neu3", "neg_neu_pos3")) -> str:
    parts = []
    for name, col in (("stars5", "l5"), ("pos_neg_neu3", "l3s"), ("neg_neu_pos3", "l3")):
        if name not in heads:
            continue
        w, v = _sm_sql(col, S.SCALES[name])
        sc = "[" + ", ".join(f"{x}e0" for x in S.SCALES[name]) + "]"
        parts.append(f"{v} AS {name}_value")
        parts.append(f"sqrt(list_sum(list_transform({w}, lambda x, i: x * ({sc}[i] - ({v})) * ({sc}[i] - ({v}))))) "
                     f"AS {name}_error")
    return ", ".join(parts)


@query("logits_to_sentiment", f"""
WITH {_LOGITS_SQL},
v AS (SELECT vec_id, label, {_vals_sql()} FROM lg2)
SELECT vec_id, round(stars5_value, 9) AS stars5_value, round(stars5_error, 9) AS stars5_error,
       round(pos_neg_neu3_value, 9) AS pnn3_value, round(pos_neg_neu3_error, 9) AS pnn3_error,
       round(neg_neu_pos3_value, 9) AS nnp3_value, round(neg_neu_pos3_error, 9) AS nnp3_error FROM v""")
def q_logits_to_sentiment(spark, sf):
    lg = _logits(_m(spark, sf))
    a, b = S.logits_to_sentiment(F.col("l5"), "stars5")
    c, d = S.logits_to_sentiment(F.col("l3"), "pos_neg_neu3")
    e, f = S.logits_to_sentiment(F.col("l3"), "neg_neu_pos3")
    return lg.select("vec_id", *[F.round(x, 9).alias(n) for x, n in (
        (a, "stars5_value"), (b, "stars5_error"), (c, "pnn3_value"), (d, "pnn3_error"),
        (e, "nnp3_value"), (f, "nnp3_error"))])


_V_SQL = f"WITH {_LOGITS_SQL}, v AS (SELECT vec_id, label, {_vals_sql()} FROM lg2)"


@query("chunk_combine", _V_SQL + """
SELECT label AS text_id,
  round(sum(stars5_value / (stars5_error * stars5_error)) / sum(1 / (stars5_error * stars5_error)), 9) AS value,
  round(sqrt(1 / sum(1 / (stars5_error * stars5_error))), 9) AS error
FROM v GROUP BY label""")
def q_chunk_combine(spark, sf):
    lg = _logits(_m(spark, sf))
    v, e = S.logits_to_sentiment(F.col("l5"), "stars5")
    per = lg.select(F.col("label").alias("text_id"), v.alias("value"), e.alias("error"))
    return S.combine_chunks(per, "text_id")


@query("ensemble_sentiment", _V_SQL + """
SELECT vec_id,
  round((stars5_value / (stars5_error * stars5_error) + pos_neg_neu3_value / (pos_neg_neu3_error * pos_neg_neu3_error))
        / (1 / (stars5_error * stars5_error) + 1 / (pos_neg_neu3_error * pos_neg_neu3_error)), 9) AS ens_value,
  round(sqrt(1 / (1 / (stars5_error * stars5_error) + 1 / (pos_neg_neu3_error * pos_neg_neu3_error))), 9) AS ens_error,
  round(stars5_value, 9) AS m1_value, round(stars5_error, 9) AS m1_error,
  round(pos_neg_neu3_value, 9) AS m2_value, round(pos_neg_neu3_error, 9) AS m2_error
FROM v""")
def q_ensemble_sentiment(spark, sf):
    lg = _logits(_m(spark, sf))
    v1, e1 = S.logits_to_sentiment(F.col("l5"), "stars5")
    v2, e2 = S.logits_to_sentiment(F.col("l3"), "pos_neg_neu3")
    t = lg.select("vec_id", v1.alias("v1"), e1.alias("e1"), v2.alias("v2"), e2.alias("e2"))
    ev, ee = S.inverse_variance_pair(F.col("v1"), F.col("e1"), F.col("v2"), F.col("e2"))
    return t.select("vec_id", F.round(ev, 9).alias("ens_value"), F.round(ee, 9).alias("ens_error"),
                    F.round("v1", 9).alias("m1_value"), F.round("e1", 9).alias("m1_error"),
                    F.round("v2", 9).alias("m2_value"), F.round("e2", 9).alias("m2_error"))


def _head_sql(name: str) -> str:
    """The logits of a hashed head of one chunk (an aggregate over its tokens' bits)."""
    n = S.HASHED_HEADS[name][0]
    return "[" + ", ".join(f"sum((({name} >> {12 * k}) & 4095) % 2001 - 1000) / 1000.0e0 / count(*)" for k in range(n)) + "]"


def _combined_sql(i: int, head: str) -> str:
    """Inverse-variance mean of a head over the chunks of a text; zero errors win."""
    v, e = f"{head}_value", f"{head}_error"
    zero = f"count(*) FILTER ({e} = 0) > 0"
    return (f"CASE WHEN {zero} THEN avg({v}) FILTER ({e} = 0) ELSE sum({v} / ({e} * {e})) / sum(1 / ({e} * {e})) END AS v{i}, "
            f"CASE WHEN {zero} THEN 0.0e0 ELSE sqrt(1 / sum(1 / ({e} * {e}))) END AS e{i}")


@query("model_scores", """
WITH t AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS tk FROM documents),
tok AS (SELECT doc_id, md5(unnest(tk)) AS h, (generate_subscripts(tk, 1) - 1) // 512 AS chunk FROM t),
""" + "bits AS (SELECT doc_id, chunk, " + ", ".join(
    f"CAST(CAST(('0x' || substr(h, {first}, {3 * n})) AS UBIGINT) AS BIGINT) AS {name}"
    for name, (n, first) in S.HASHED_HEADS.items()) + " FROM tok),\n" + f"""
lg AS (SELECT doc_id, chunk, {_head_sql("l5")} AS l5, {_head_sql("l3")} AS l3 FROM bits GROUP BY doc_id, chunk),
lg2 AS (SELECT *, [l3[1], l3[3], l3[2]] AS l3s FROM lg),
v AS (SELECT doc_id, {_vals_sql()} FROM lg2),
m AS (SELECT doc_id, {_combined_sql(1, "stars5")}, {_combined_sql(2, "pos_neg_neu3")} FROM v GROUP BY doc_id)
SELECT doc_id, round((v1 / (e1 * e1) + v2 / (e2 * e2)) / (1 / (e1 * e1) + 1 / (e2 * e2)), 9) AS ens_value,
       round(sqrt(1 / (1 / (e1 * e1) + 1 / (e2 * e2))), 9) AS ens_error,
       round(v1, 9) AS m1_value, round(e1, 9) AS m1_error, round(v2, 9) AS m2_value, round(e2, 9) AS m2_error
FROM m""")
def q_model_scores(spark, sf):
    """Chunked texts -> stand-in model heads -> per-text combination
    -> ensemble."""
    return S.model_scores(S.token_chunks(documents(_m(spark, sf))))


#: The stand-in linear model: weight of bucket b and class k in thousandths, of 64 buckets and 5 classes.
def _linear_weight(b: int, k: int) -> int:
    return (b * 37 + k * 61) % 401 * 10 - 2000


def linear_model(m: NewsModel) -> SC.Model:
    """The stand-in model's file, written and broadcast on first use in this application."""
    which = (m.spark.sparkContext.applicationId, "linear")
    with _MODEL_LOCK:
        if which not in _MODELS:
            weights = [[_linear_weight(b, k) for k in range(5)] for b in range(64)]
            path = SC.write_model(m.spark, scratch_path(m.spark, f"model-{uuid.uuid4().hex}"), SC.HashedLinear.dumps(weights))
            _MODELS[which] = SC.broadcast_model(m.spark, path)
    return _MODELS[which]


_MODEL_LOCK = threading.Lock()
_MODELS: dict[tuple[str, str], SC.Model] = {}


@query("model_file_scores", """
WITH t AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\s+') AS tk FROM documents),
tok AS (SELECT doc_id, CAST(CAST(('0x' || substr(md5(unnest(tk)), 1, 4)) AS UBIGINT) AS BIGINT) % 64 AS b,
               (generate_subscripts(tk, 1) - 1) // 512 AS chunk FROM t),
""" + "lg AS (SELECT doc_id, chunk, [" + ", ".join(
    f"sum((b * 37 + {k * 61}) % 401 * 10 - 2000) / 1000.0e0 / count(*)" for k in range(5)) + f"""] AS l5
       FROM tok GROUP BY doc_id, chunk),
v AS (SELECT doc_id, {_vals_sql(("stars5",))} FROM lg),
m AS (SELECT doc_id, count(*) AS chunks, {_combined_sql(1, "stars5")} FROM v GROUP BY doc_id)
SELECT doc_id, chunks, round(v1, 9) AS value, round(e1, 9) AS error FROM m""")
def q_model_file_scores(spark, sf):
    """N3-N5 with a model read from a file: chunks are cut and scored inside the batches of texts."""
    m = _m(spark, sf)
    return SC.score_texts(documents(m), linear_model(m))


# ---- N6-N8 topics -------------------------------------------------------------------
def topic_texts(m: NewsModel) -> DataFrame:
    """Latest non-empty body per article, headline + ' ' + body."""
    last = article_body_last(m).filter(F.col("body") != "")
    return last.select(F.col("article_id").alias("id"), F.concat_ws(" ", "headline", "body").alias("text"))


_TEXTS_SQL = """texts AS (SELECT ab.article_id AS id, concat(ab.headline, ' ', ab.body) AS text
  FROM article_body_last_id v JOIN article_body ab ON ab.id = v.last_article_body_id WHERE ab.body <> '')"""


def _common_sql(src: str, top_n: int, name: str = "cw") -> str:
    return (f"{name} AS (SELECT word FROM (SELECT word, count(*) AS df FROM (SELECT DISTINCT id, "
            f"{clean_sql('w', True)} AS word FROM (SELECT id, unnest(regexp_split_to_array(text, '\\s+')) AS w "
            f"FROM {src}) x) y WHERE word <> '' GROUP BY word ORDER BY df DESC, word ASC LIMIT {top_n}) z "
            f"UNION ALL SELECT '')")


_TOPICS_SQL = f"""
WITH {_TEXTS_SQL}, {_common_sql('texts', TP.COMMON_WORDS)},
tok AS (SELECT id, unnest(tk) AS w, generate_subscripts(tk, 1) - 1 AS pos
        FROM (SELECT id, regexp_split_to_array(text, '\\s+') AS tk FROM texts) s),
cl AS (SELECT id, pos, {clean_sql('w', True)} AS word FROM tok),
f AS (SELECT id, word, count(*) AS cnt, min(pos) AS first_pos FROM cl
      WHERE word NOT IN (SELECT word FROM cw) GROUP BY id, word HAVING count(*) > 2),
r AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY cnt DESC, first_pos ASC) AS INT) AS rank,
             word AS topic, cnt FROM f),
topics AS (SELECT * FROM r WHERE rank <= 5)"""


def _topics(m: NewsModel) -> DataFrame:
    return TP.topics_top5(topic_texts(m), None, "id", "text")


@query("topics_top5", _TOPICS_SQL + " SELECT * FROM topics")
def q_topics_top5(spark, sf):
    return _topics(_m(spark, sf))


@query("topic_results_write", _TOPICS_SQL + """
SELECT DISTINCT id AS article_header_id, 1 AS topic_detector_id,
       CAST(CAST(('0x' || substr(md5(substring(topic, 1, 30)), 1, 15)) AS UBIGINT) AS BIGINT) AS lemma_id,
       DATE '2024-02-01' AS run_date FROM topics""")
def q_topic_results_write(spark, sf):
    t = _topics(_m(spark, sf)).withColumnRenamed("id", "article_id")
    _, res = TP.topic_rows(t, C.lemma_id, C.as_of_date())
    return res


@query("word_frequency", f"""
WITH tok AS (SELECT doc_id, unnest(tk) AS w, generate_subscripts(tk, 1) - 1 AS pos
             FROM (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS tk FROM documents) s)
SELECT doc_id, {clean_sql('w', True)} AS word, count(*) AS cnt, CAST(min(pos) AS INT) AS first_pos
FROM tok GROUP BY 1, 2""")
def q_word_frequency(spark, sf):
    return TP.word_frequency(documents(_m(spark, sf)), "doc_id", "text")


@query("topicizer_input", """
WITH labels AS (SELECT object_id AS id, udf_value FROM udf_values WHERE udf_id = 2 AND object_type = 1)
SELECT id, body, headline, udf_value FROM labels JOIN article_body USING (id) WHERE body <> ''""")
def q_topicizer_input(spark, sf):
    """Every labelled body with a text (a fetch size is the caller's ``limit``)."""
    m = _m(spark, sf)
    b = m.article_body.filter(F.col("body") != "").select("id", "body", "headline")
    u = m.udf_values.filter((F.col("object_type") == 1) & (F.col("udf_id") == 2))
    j = b.join(u, b.id == u.object_id, "inner").select("id", "body", "headline", "udf_value")
    return j


def comment_texts(m: NewsModel) -> DataFrame:
    return m.comment.select("id", F.col("body").alias("text"))


def vectors(m: NewsModel) -> DataFrame:
    return m.table("embeddings").select("vec_id", "embedding")


_BUCKET_SQL = ("(CAST(CAST(('0x' || substr(md5({w}), 1, 15)) AS UBIGINT) AS BIGINT) % "
               "(SELECT count(*) FROM embeddings))")


@query("centroid_distance", f"""
WITH tok AS (SELECT id, regexp_replace(unnest(regexp_split_to_array(body, '\\s+')), '[^{WORD_CHARS}]+', '', 'g') AS word
             FROM comment),
wv AS (SELECT t.id, t.word, e.embedding AS vec FROM tok t JOIN embeddings e ON e.vec_id = {_BUCKET_SQL.format(w='t.word')}),
dims AS (SELECT id, unnest(vec) AS x, generate_subscripts(vec, 1) AS k FROM wv),
cent AS (SELECT id, list(cx ORDER BY k) AS c FROM (SELECT id, k, avg(CAST(x AS DOUBLE)) AS cx FROM dims GROUP BY id, k) a
         GROUP BY id),
dw AS (SELECT DISTINCT id, word, vec FROM wv)
SELECT dw.id, dw.word, round(1 - list_dot_product(CAST(dw.vec AS DOUBLE[]), cent.c)
       / (sqrt(list_dot_product(CAST(dw.vec AS DOUBLE[]), CAST(dw.vec AS DOUBLE[]))) * sqrt(list_dot_product(cent.c, cent.c))), 9)
       AS distance
FROM dw JOIN cent ON cent.id = dw.id ORDER BY 1, 3""")
def q_centroid_distance(spark, sf):
    m = _m(spark, sf)
    return TP.centroid_distance(comment_texts(m), vectors(m), "id", "text")


# ---- J10 / N2 vector matching -----------------------------------------------------------
def vector_lexicon(m: NewsModel) -> DataFrame:
    """Vectors of the lexicon's words (a fixed list, whatever the size of
    ``embeddings``), looked up like the words of texts; where words share a
    vector, the first of them counts."""
    words = m.spark.createDataFrame([(i, w, s) for i, (w, s, _) in enumerate(S.STAND_IN_LEXICON)],
                                    "lex_id long, word string, score double")
    found = TP.hashed_vector_lookup(words, vectors(m))
    return (found.groupBy("vec").agg(F.min(F.struct("lex_id", "score")).alias("e"))
            .select("e.lex_id", "vec", "e.score"))


_LEXW_SQL = ("(VALUES " + ", ".join(f"({i}, '{w}', {s}e0)" for i, (w, s, _) in enumerate(S.STAND_IN_LEXICON))
             + ") w(lex_id, word, score)")
_NN_SQL = f"""
lexv AS (SELECT CAST(w.lex_id AS BIGINT) AS lex_id, CAST(e.embedding AS DOUBLE[]) AS vec, CAST(w.score AS DOUBLE) AS score
         FROM {_LEXW_SQL} JOIN embeddings e ON e.vec_id = {_BUCKET_SQL.format(w="w.word")}
         QUALIFY row_number() OVER (PARTITION BY e.embedding ORDER BY w.lex_id) = 1),
""" + """nn AS (SELECT q.{qid} AS qid, l.lex_id, 1 - list_cosine_similarity(q.vec, l.vec) AS distance, l.score,
              row_number() OVER (PARTITION BY q.{qid} ORDER BY 1 - list_cosine_similarity(q.vec, l.vec), l.lex_id) AS rn
       FROM {queries} q, lexv l)"""


@query("vector_lexicon_match", "WITH " + _NN_SQL.format(
    qid="qid", queries="(SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)") + """
SELECT qid, lex_id, round(distance, 9) AS distance, score, distance <= 0.25 AS matched FROM nn WHERE rn = 1""")
def q_vector_lexicon_match(spark, sf):
    m = _m(spark, sf)
    q = m.table("embeddings").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    nn = S.nearest_lexicon(q, vector_lexicon(m), "qid", "vec")
    return nn.select("qid", "lex_id", F.round("distance", 9).alias("distance"), "score",
                     (F.col("distance") <= S.MATCH_DISTANCE).alias("matched"))


def vector_lexicon_sentiment(texts: DataFrame, vecs: DataFrame, lex: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Tokens -> cleaned, stop words dropped -> word vector (hashed
    lookup) -> nearest lexicon vector (J10, once per distinct vector) ->
    scores of matches within 0.25 -> mean / population std per text;
    (0, 1) without a match. ``n_words`` counts the non-stop tokens."""
    from opinio.functions.strings import clean_tokens
    tok = (texts.select("id", F.explode(clean_tokens(F.col("text"))).alias("word"))
           .join(write_once(stopwords.select("word").distinct(), "stopwords"), "word", "left_anti"))
    n = vecs.agg(F.count(F.lit(1))).scalar()
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("word")), 1, 15), 16, 10).cast("bigint"), n)
    tb = tok.withColumn("bucket", bucket)
    qv = (vecs.select(F.col("vec_id").alias("bucket"), F.col("embedding").alias("vec"))
          .join(tb.select("bucket").distinct(), "bucket", "left_semi"))
    nn = S.nearest_lexicon(qv, lex, "bucket", "vec").filter(F.col("distance") <= S.MATCH_DISTANCE)
    scored = tb.join(nn.select("bucket", "score"), "bucket", "left")
    agg = scored.groupBy("id").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"),
                                   F.count("score").alias("hits"), F.count(F.lit(1)).alias("n_words"))
    base = texts.select("id").join(agg, "id", "left")
    return base.select("id", F.coalesce(F.round("m", 9), F.lit(0.0)).alias("value"),
                       F.coalesce(F.round("sd", 9), F.lit(1.0)).alias("error"),
                       F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("n_words", F.lit(0)).alias("n_words"))


@query("vector_lexicon_sentiment", f"""
WITH texts AS (SELECT id, body AS text FROM comment),
{_common_sql('texts', 100, 'sw')},
tok AS (SELECT id, {clean_sql("unnest(regexp_split_to_array(text, '\\s+'))")} AS word FROM texts),
tk AS (SELECT id, word, {_BUCKET_SQL.format(w='word')} AS bucket FROM tok WHERE word NOT IN (SELECT word FROM sw)),
qv AS (SELECT vec_id AS bucket, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
       WHERE vec_id IN (SELECT bucket FROM tk)),
{_NN_SQL.format(qid='bucket', queries='qv')},
m AS (SELECT qid AS bucket, score FROM nn WHERE rn = 1 AND distance <= 0.25),
agg AS (SELECT tk.id, avg(m.score) AS mm, stddev_pop(m.score) AS sd, count(*) AS hits FROM tk JOIN m ON m.bucket = tk.bucket
        GROUP BY tk.id),
nw AS (SELECT id, count(*) AS n_words FROM tk GROUP BY id)
SELECT t.id, coalesce(round(a.mm, 9), 0.0) AS value, coalesce(round(a.sd, 9), 1.0) AS error,
       coalesce(a.hits, 0) AS hits, coalesce(nw.n_words, 0) AS n_words
FROM texts t LEFT JOIN nw ON nw.id = t.id LEFT JOIN agg a ON a.id = t.id""")
def q_vector_lexicon_sentiment(spark, sf):
    m = _m(spark, sf)
    texts = comment_texts(m)
    sw = TP.common_words(texts, "id", "text", top_n=100)
    return vector_lexicon_sentiment(texts, vectors(m), vector_lexicon(m), sw)


# ---- N10 / N11 corpus ---------------------------------------------------------------------
def document_lines(m: NewsModel) -> DataFrame:
    """The corpus's lines, a store table (written once an application)."""
    def lines() -> DataFrame:
        d = ensure_parallelism(m.table("documents").select("doc_id", "text"), "doc_id")
        return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return m.once("document_lines", lines)


_PUNCT_ARR = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in K.PUNCTUATION_TOKENS) + "]"


def _digraph_sql(x: str) -> str:
    for letter, pair in UMLAUT_DIGRAPHS:
        x = f"replace({x}, '{letter}', '{pair}')"
    return x


_CORPUS_SQL = f"""
lines AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d),
sents AS (SELECT doc_id, line_no, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sentence_no
          FROM (SELECT doc_id, line_no, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss
                FROM lines) x),
um AS (SELECT doc_id, line_no, sentence_no, {_digraph_sql('s')} AS s FROM sents),
texts AS (SELECT doc_id AS id, text FROM documents), {_common_sql('texts', TP.COMMON_WORDS)},
stop AS (SELECT DISTINCT {_digraph_sql(clean_sql("CASE WHEN length(word) % 7 = 0 THEN replace(upper(word), 'ß', 'SS') ELSE word END"))}
         AS w FROM cw),
raw_tk AS (SELECT doc_id, line_no, sentence_no,
         list_transform(list_filter(regexp_extract_all(s, '{K.TOKEN_PATTERN}'), lambda t: NOT list_contains({_PUNCT_ARR}, t)),
                        lambda t: regexp_replace(t, '[?.!/;:\\(\\)&+]', '', 'g')) AS tokens FROM um),
tk AS (SELECT doc_id, line_no, sentence_no, list(w ORDER BY p) AS tokens
       FROM (SELECT doc_id, line_no, sentence_no, unnest(tokens) AS w, generate_subscripts(tokens, 1) AS p FROM raw_tk) x
       WHERE w NOT IN (SELECT w FROM stop) GROUP BY ALL),
corpus AS (SELECT doc_id, line_no, CAST(sentence_no AS INT) AS sentence_no, array_to_string(tokens, ' ') AS sentence
           FROM tk WHERE len(tokens) > 1)"""


def stopword_list(m: NewsModel) -> DataFrame:
    """A common-words CSV (two comment lines, 'number,word,translation'
    rows, an empty word, lines with '.' instead of the first comma, whose
    second column is the translation) built from the corpus's most common
    words, read back; the file is written once an application."""
    def words() -> DataFrame:
        texts = documents(m).withColumnRenamed("doc_id", "id")
        cw = TP.common_words(texts, "id", "text", top_n=TP.COMMON_WORDS).filter(F.col("word") != "")
        rows = cw.select(F.when(F.length("word") % 7 == 0, F.concat(F.lit("0."), F.col("word"), F.lit(","), F.upper("word")))
                         .otherwise(F.concat(F.lit("0,"), F.col("word"), F.lit(","), F.upper("word"))).alias("value"))
        head = m.spark.createDataFrame([("#Source: corpus common words",), ("#Number,German,in English",),
                                        ('0,,"empty"',)], "value string")
        path = scratch_path(m.spark, f"stopwords-{uuid.uuid4().hex}")
        head.unionByName(rows).write.text(path)
        return TP.read_stopword_csv(m.spark, path)
    return m.once("stopword_list", words)


def _corpus(m: NewsModel) -> DataFrame:
    c = K.corpus_preprocess(document_lines(m), ["doc_id", "line_no"], umlauts=True, punctuation=True,
                            stopwords=stopword_list(m))
    return c


@query("corpus_preprocess", f"WITH {_CORPUS_SQL} SELECT doc_id, CAST(line_no AS INT) AS line_no, sentence_no, sentence FROM corpus")
def q_corpus_preprocess(spark, sf):
    return _corpus(_m(spark, sf))


@query("corpus_text_files", f"WITH {_CORPUS_SQL} SELECT sentence AS value FROM corpus")
def q_corpus_text_files(spark, sf):
    """The corpus's lines as text files, preprocessed line by line into text files."""
    m = _m(spark, sf)
    base = scratch_path(spark, f"line-job-{uuid.uuid4().hex}")
    document_lines(m).select("text").write.text(f"{base}/in")
    return K.preprocess_text_files(spark, f"{base}/in", f"{base}/out", umlauts=True, stopwords=stopword_list(m))


_BIGRAM_SQL = f"""{_CORPUS_SQL},
st AS (SELECT doc_id, line_no, sentence_no, list_filter(string_split(sentence, ' '), lambda t: t <> '') AS t FROM corpus),
pairs AS (SELECT t[i] AS a, t[i + 1] AS b FROM (SELECT t, unnest(range(1, len(t))) AS i FROM st WHERE len(t) > 1) x),
bi AS (SELECT a, b, count(*) AS cnt FROM pairs GROUP BY a, b),
uni AS (SELECT w, count(*) AS c FROM (SELECT unnest(t) AS w FROM st) u GROUP BY w),
vocab AS (SELECT (SELECT count(*) FROM uni) + (SELECT count(*) FROM bi) AS v),
ph AS (SELECT bi.a, bi.b, bi.cnt, CAST(bi.cnt - 5 AS DOUBLE) / ua.c / ub.c * (SELECT v FROM vocab) AS score
       FROM bi JOIN uni ua ON ua.w = bi.a JOIN uni ub ON ub.w = bi.b),
phrases AS (SELECT a, b, cnt, round(score, 9) AS score FROM ph WHERE score > 10)"""


@query("bigram_counts", f"WITH {_BIGRAM_SQL} SELECT a, b, cnt FROM bi")
def q_bigram_counts(spark, sf):
    return K.bigram_counts(_corpus(_m(spark, sf)))


@query("bigram_phrases", f"WITH {_BIGRAM_SQL} SELECT * FROM phrases")
def q_bigram_phrases(spark, sf):
    return K.bigram_phrases(_corpus(_m(spark, sf)))


@query("bigram_rewrite", f"""WITH {_BIGRAM_SQL},
z AS (SELECT doc_id, line_no, sentence_no, pos, t[pos + 1] AS a, t[pos + 2] AS b
      FROM (SELECT *, unnest(range(0, len(t))) AS pos FROM st) s),
zc AS (SELECT z.*, (p.a IS NOT NULL) AS cand FROM z LEFT JOIN phrases p ON p.a = z.a AND p.b = z.b),
zs AS (SELECT *, coalesce(max(CASE WHEN NOT cand THEN pos END) OVER (PARTITION BY doc_id, line_no, sentence_no
         ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1, 0) AS st0 FROM zc),
zt AS (SELECT *, cand AND (pos - st0) % 2 = 0 AS taken FROM zs),
zp AS (SELECT *, coalesce(lag(taken) OVER (PARTITION BY doc_id, line_no, sentence_no ORDER BY pos), false) AS prev_taken FROM zt)
SELECT doc_id, CAST(line_no AS INT) AS line_no, sentence_no,
       string_agg(CASE WHEN taken THEN a || '_' || b ELSE a END, ' ' ORDER BY pos) AS sentence
FROM zp WHERE NOT prev_taken GROUP BY doc_id, line_no, sentence_no""")
def q_bigram_rewrite(spark, sf):
    c = write_once(_corpus(_m(spark, sf)), "corpus")
    return K.bigram_rewrite(c, K.bigram_phrases(c, stored=True), ["doc_id", "line_no"])


# ---- N12-N17 labelled corpus ----------------------------------------------------------------
def posts_and_annotations(m: NewsModel) -> tuple[DataFrame, DataFrame]:
    """Posts from documents (headline = first line, body = the rest) and
    consolidated annotations from labels (toxic -> negative, quality ->
    positive, otherwise neutral)."""
    d = m.table("documents").select("doc_id", "text")
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    posts = d.select(F.col("doc_id").alias("id"), head.alias("headline"),
                     F.substr("text", F.length(head) + 2).alias("body"))
    lab = m.table("labels")
    cat = (F.when(F.col("toxic") == 1, "SentimentNegative").when(F.col("quality") == 1, "SentimentPositive")
           .otherwise("SentimentNeutral"))
    ann = lab.select(F.col("doc_id").alias("id"), cat.alias("category"), F.lit(1).alias("value"))
    return posts, ann


_SAMPLES_SQL = """
posts AS (SELECT doc_id AS id, split_part(text, chr(10), 1) AS headline,
                 substring(text, length(split_part(text, chr(10), 1)) + 2) AS body FROM documents),
ann AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS label FROM labels),
j AS (SELECT p.*, a.label FROM posts p JOIN ann a ON a.id = p.id),
samples AS (SELECT * FROM (
   SELECT id, 0 AS sample_no, CASE WHEN headline NOT IN ('', chr(10), chr(13), chr(13) || chr(10), chr(9), ' ')
          THEN concat(headline, ' ', body) END AS text, label FROM j
   UNION ALL SELECT id, 1, body, label FROM j) s
   WHERE text IS NOT NULL AND text NOT IN ('', chr(10), chr(13), chr(13) || chr(10), chr(9), ' '))"""


def samples(m: NewsModel) -> DataFrame:
    posts, ann = posts_and_annotations(m)
    return K.labelled_corpus(posts, ann)


def keyed_samples(m: NewsModel) -> DataFrame:
    s = samples(m)
    return s.withColumn("key", F.concat_ws(":", F.col("id").cast("string"), F.col("sample_no").cast("string")))


@query("corpus_label_join", f"WITH {_SAMPLES_SQL} SELECT id, sample_no, text, label FROM samples")
def q_corpus_label_join(spark, sf):
    return samples(_m(spark, sf))


@query("class_distribution", f"""WITH {_SAMPLES_SQL},
c AS (SELECT label, count(*) AS n FROM samples GROUP BY label)
SELECT label, n, (SELECT min(n) FROM c) AS min_class FROM c""")
def q_class_distribution(spark, sf):
    """Class counts and the smallest class (one aggregation, folded
    without a cross join through a window over the <= 3 class rows)."""
    from pyspark.sql import Window
    c = samples(_m(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("min_class", F.min("n").over(Window.partitionBy()))


_PAIRS_ORACLE = f"""WITH {_SAMPLES_SQL},
it AS (SELECT id, sample_no, label, length(text) AS len FROM samples WHERE length(text) < 512)
SELECT a.label, count(*) AS n_pairs FROM it a JOIN it b ON a.label = b.label
  AND (a.id, a.sample_no) < (b.id, b.sample_no) AND a.len + b.len < 512 GROUP BY a.label"""


@query("pair_augmentation", _PAIRS_ORACLE)
def q_pair_augmentation(spark, sf):
    """J9 (re-aimed): exact number of same-label pairs shorter than 512
    characters, counted from length histograms (the oracle enumerates)."""
    return K.pair_counts(samples(_m(spark, sf))).filter(F.col("n_pairs") > 0).select("label", "n_pairs")


_BALANCE_SQL = f"""{_SAMPLES_SQL},
ks AS (SELECT *, concat_ws(':', CAST(id AS VARCHAR), CAST(sample_no AS VARCHAR)) AS key FROM samples),
orig AS (SELECT label, count(*) AS n_orig FROM ks GROUP BY label),
it AS (SELECT label, text, key, length(text) AS len, md5(text) AS h FROM ks WHERE length(text) < 512),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY len, h, key) - 1 AS idx FROM it),
sizes AS (SELECT label, (SELECT max(n_orig) FROM orig) - n_orig AS need FROM orig),
allp AS (SELECT a.label, sizes.need, a.text AS ta, b.text AS tb, a.key AS ka, b.key AS kb,
                row_number() OVER (PARTITION BY a.label ORDER BY b.idx - a.idx, a.idx) AS pn
         FROM rk a JOIN sizes ON sizes.label = a.label AND sizes.need > 0
         JOIN rk b ON b.label = a.label AND b.idx > a.idx AND a.len + b.len < 512),
gen AS (SELECT label, concat_ws(' ', ta, tb) AS text, concat('g:', ka, '|', kb) AS key, 'generated' AS origin
        FROM allp WHERE pn <= need),
balanced AS (SELECT label, text, concat('o:', key) AS key, 'original' AS origin FROM ks UNION ALL SELECT * FROM gen)"""


@query("class_balance", f"WITH {_BALANCE_SQL} SELECT * FROM balanced")
def q_class_balance(spark, sf):
    return K.class_balance(keyed_samples(_m(spark, sf)))


_ONE_HOT_SQL = f"""WITH {_BALANCE_SQL}
SELECT key, label, text,
       [CASE WHEN label = -1 THEN 1.0e0 ELSE 0.0e0 END, CASE WHEN label = 0 THEN 1.0e0 ELSE 0.0e0 END,
        CASE WHEN label = 1 THEN 1.0e0 ELSE 0.0e0 END] AS labels,
       row_number() OVER (ORDER BY md5(text), key) - 1 AS position,
       CASE WHEN (row_number() OVER (ORDER BY md5(text), key) - 1) % 10 = 0 THEN 'test'
            WHEN (row_number() OVER (ORDER BY md5(text), key) - 1) % 10 = 1 THEN 'val' ELSE 'train' END AS split
FROM balanced"""


@query("one_hot_split", _ONE_HOT_SQL)
def q_one_hot_split(spark, sf):
    return K.one_hot_split(K.class_balance(keyed_samples(_m(spark, sf))))


def _predictions(spark, m: NewsModel) -> DataFrame:
    """Both scorers' values per sample with its label. Three branches read
    the samples, so they are written once (``checkpoint()`` into the shared
    folder) instead of re-joining labels and documents per branch."""
    checkpoint_dir(spark)
    s = keyed_samples(m).checkpoint(eager=True)
    lex = lexicon(spark)
    n1 = S.lexicon_sentiment(s, lex, "key", "text").select("key", F.lit("lexicon").alias("model"), "value")
    n9 = (S.polarity_subjectivity(s, lex, "key", "text")
          .select("key", F.lit("polarity").alias("model"), F.col("polarity").alias("value")))
    return n1.unionByName(n9).join(s.select("key", "label"), "key", "inner")


_PRED_SQL = f"""{_SAMPLES_SQL},
ks AS (SELECT *, concat_ws(':', CAST(id AS VARCHAR), CAST(sample_no AS VARCHAR)) AS key FROM samples),
lex AS {LEX_SQL},
tok AS (SELECT key, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM ks),
hits AS (SELECT t.key, l.score FROM tok t JOIN lex l ON l.word = {clean_sql('t.w')}),
agg AS (SELECT key, avg(score) AS m FROM hits GROUP BY key),
pred AS (SELECT ks.key, ks.label, m.model, coalesce(round(a.m, 9), 0.0) AS value
         FROM ks CROSS JOIN (SELECT 'lexicon' AS model UNION ALL SELECT 'polarity') m LEFT JOIN agg a ON a.key = ks.key),
cls AS (SELECT *, CASE WHEN value < -0.33 THEN -1 WHEN value < 0.33 THEN 0 ELSE 1 END AS pred_class FROM pred)"""


@query("model_accuracy", f"""WITH {_PRED_SQL}
SELECT model, count(*) AS n, round(sum(CASE WHEN pred_class = label THEN 1 ELSE 0 END) / count(*), 9) AS accuracy,
  round(sum(CASE WHEN label = -1 AND pred_class = label THEN 1 WHEN label = -1 THEN 0 END)
        / CAST(sum(CASE WHEN label = -1 THEN 1 END) AS DOUBLE), 9) AS acc_neg,
  round(sum(CASE WHEN label = 0 AND pred_class = label THEN 1 WHEN label = 0 THEN 0 END)
        / CAST(sum(CASE WHEN label = 0 THEN 1 END) AS DOUBLE), 9) AS acc_neu,
  round(sum(CASE WHEN label = 1 AND pred_class = label THEN 1 WHEN label = 1 THEN 0 END)
        / CAST(sum(CASE WHEN label = 1 THEN 1 END) AS DOUBLE), 9) AS acc_pos
FROM cls GROUP BY model""")
def q_model_accuracy(spark, sf):
    return S.model_accuracy(_predictions(spark, _m(spark, sf)))


@query("precision_recall_f1", f"""WITH {_PRED_SQL},
cl AS (SELECT * FROM (VALUES (-1), (0), (1)) t(c)),
cnt AS (SELECT m.model, cl.c AS class,
          sum(CASE WHEN label = cl.c AND pred_class = cl.c THEN 1 ELSE 0 END) AS tp,
          sum(CASE WHEN label <> cl.c AND pred_class = cl.c THEN 1 ELSE 0 END) AS fp,
          sum(CASE WHEN label = cl.c AND pred_class <> cl.c THEN 1 ELSE 0 END) AS fn,
          sum(CASE WHEN label = pred_class THEN 1 ELSE 0 END) AS correct, count(*) AS total
        FROM cls m CROSS JOIN cl GROUP BY m.model, cl.c),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN NULL ELSE tp / CAST(tp + fp AS DOUBLE) END AS p,
              CASE WHEN tp + fn = 0 THEN NULL ELSE tp / CAST(tp + fn AS DOUBLE) END AS r FROM cnt)
SELECT model, CAST(class AS INT) AS class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(fn AS BIGINT) AS fn, round(p, 9) AS precision, round(r, 9) AS recall,
       round(CASE WHEN p + r = 0 THEN NULL ELSE 2 * p * r / (p + r) END, 9) AS f1,
       round(correct / CAST(total AS DOUBLE), 9) AS accuracy FROM pr""")
def q_precision_recall_f1(spark, sf):
    p = _predictions(spark, _m(spark, sf)).withColumn("pred", S.sentiment_class(F.col("value")))
    return S.precision_recall_f1(p)


@query("train_classifier")
def q_train_classifier(spark, sf):
    """N17 (re-aimed): TF-IDF + multinomial logistic regression on the train
    split, predictions for the test split (rows-only)."""
    data = K.one_hot_split(K.class_balance(keyed_samples(_m(spark, sf))))
    return K.train_classifier(data)


@query("dataset_sink_roundtrip", f"SELECT labels, text AS text_input, split FROM ({_ONE_HOT_SQL}) o")
def q_dataset_sink_roundtrip(spark, sf):
    """JSON datasets per split written and read back."""
    data = K.one_hot_split(K.class_balance(keyed_samples(_m(spark, sf))))
    return K.dataset_sink_roundtrip(data)


@query("annotated_csv_filter", f"""WITH {_SAMPLES_SQL}
SELECT CAST(id AS VARCHAR) AS c0, CAST(sample_no AS VARCHAR) AS c1, text, '1' AS flag, CAST(NULL AS VARCHAR) AS extra
FROM samples WHERE label = 1 AND sample_no = 0""")
def q_annotated_csv_filter(spark, sf):
    """S7: '|'-quoted annotated CSV round trip and row filter."""
    s = keyed_samples(_m(spark, sf))
    rows = s.select(F.col("id").cast("string").alias("c0"), F.col("sample_no").cast("string").alias("c1"),
                    "text", F.when(F.col("label") == 1, "1").otherwise("0").alias("flag"),
                    F.when(F.col("sample_no") == 0, F.lit(None)).otherwise(F.lit("x")).alias("extra"))
    return K.annotated_csv_filter(rows)


# ---- S2 / S3 readers over files derived from the tables ------------------------------
def benchmark_vocabulary(m: NewsModel) -> DataFrame:
    from opinio.functions.strings import clean_tokens
    b = m.table("benchmark").select(F.explode(clean_tokens(F.col("text"))).alias("word"))
    return b.filter(F.length("word") >= 2).distinct()


_VOCAB_SQL = ("vocab AS (SELECT DISTINCT w AS word FROM (SELECT unnest(list_filter(regexp_split_to_array("
              f"{clean_sql('text').replace('[^A-Za-züäößÄÖÜ]+', '[^A-Za-züäößÄÖÜ\\s]+')}, '\\s+'), lambda t: t <> '')) AS w "
              "FROM benchmark) x WHERE length(w) >= 2)")


@query("lexicon_parse", f"""
WITH {_VOCAB_SQL},
e AS (SELECT length(word) % 2 AS file_no, word, CASE WHEN length(word) % 2 = 0 THEN -1 ELSE 1 END
             * ((length(word) % 5) + 1) / 10.0e0 AS score FROM vocab),
allw AS (SELECT file_no, word, score FROM e UNION ALL SELECT file_no, word || 'x', score FROM e)
SELECT word, arg_max(score, file_no) AS score FROM allw GROUP BY word""")
def q_lexicon_parse(spark, sf):
    """S3: two lexicon files in the 'word|POS<TAB>score<TAB>inflections'
    format (negative file: even-length words, positive file: odd-length
    words of the benchmark texts; one inflection each) parsed with
    later-file-wins."""
    import uuid
    from opinio.session import scratch_path
    from opinio.sources.lexicon import parse_lexicon, read_lexicon_files
    v = benchmark_vocabulary(_m(spark, sf))
    base = scratch_path(spark, f"lexicon-{uuid.uuid4().hex}")
    paths = []
    for f_no in (0, 1):
        sign = -1 if f_no == 0 else 1
        score = (F.length("word") % 5 + 1) / F.lit(10.0) * sign
        line = F.concat(F.col("word"), F.lit("|NN\t"), score.cast("string"), F.lit("\t"),
                        F.concat(F.col("word"), F.lit("x")))
        path = f"{base}/file{f_no}"
        v.filter(F.length("word") % 2 == f_no).select(line.alias("value")).write.text(path)
        paths.append(path)
    return parse_lexicon(read_lexicon_files(spark, paths))


@query("stopword_scan", f"""
WITH texts AS (SELECT doc_id AS id, text FROM documents), {_common_sql('texts', TP.COMMON_WORDS)},
read_word AS (SELECT CASE WHEN length(word) % 7 = 0 THEN replace(upper(word), 'ß', 'SS') ELSE word END AS w FROM cw)
SELECT DISTINCT {clean_sql('w')} AS word FROM read_word""")
def q_stopword_scan(spark, sf):
    return stopword_list(_m(spark, sf))


# ---- N10 learned sentence boundaries --------------------------------------------------------
_OPENING_SQL, _CLOSING_SQL = (chars.replace("'", "''") for chars in (SN.OPENING, SN.CLOSING))
_CORE = "regexp_replace({x}, '^[" + _OPENING_SQL.replace("{", "{{") + "]+|[" + _CLOSING_SQL.replace("}", "}}") + "]+$', '', 'g')"


def _end_sql(c: str) -> str:
    return (f"CASE WHEN ends_with({c}, '..') THEN 'e' WHEN ends_with({c}, '.') THEN '.' "
            f"WHEN ends_with({c}, '!') OR ends_with({c}, '?') THEN '!' ELSE '' END")


def _type_sql(c: str) -> str:
    t = f"lower(regexp_replace({c}, '[.,;:!?]+$', ''))"
    return f"CASE WHEN regexp_matches({t}, '^[0-9][0-9.,]*$') THEN '##' ELSE {t} END"


def _case_sql(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^\\p{{Lu}}') THEN 'u' WHEN regexp_matches({c}, '^\\p{{Ll}}') THEN 'l' ELSE 'o' END"


def _kind_sql(typ: str, end: str, abbreviation: str) -> str:
    return (f"CASE WHEN {end} <> '.' THEN {end} WHEN {typ} = '##' THEN 'n' WHEN regexp_matches({typ}, '^\\p{{L}}$') THEN 'i' "
            f"WHEN {abbreviation} THEN 'a' ELSE 'p' END")


def _llr_sql(a: str, b: str, both: str, total: str) -> str:
    def term(x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN ({x}) * ln({x}) ELSE 0 END"
    cells = [both, f"{a} - {both}", f"{b} - {both}", f"{total} - {a} - {b} + {both}", total]
    margins = [a, f"{total} - {a}", b, f"{total} - {b}"]
    return f"2 * ({' + '.join(map(term, cells))} - ({' + '.join(map(term, margins))}))"


_SENTENCE_SQL = f"""
lines AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) d),
cut AS (SELECT regexp_extract_all(text, '[^{SN.BLANK}]+') AS t FROM lines),
near AS (SELECT t[i] AS cur, CASE WHEN i > 1 THEN t[i - 1] END AS prev, CASE WHEN i < len(t) THEN t[i + 1] END AS nxt
         FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM cut) x),
cored AS (SELECT {_CORE.format(x='cur')} AS c, {_CORE.format(x='prev')} AS p, {_CORE.format(x='nxt')} AS f FROM near),
tagged AS (SELECT {_type_sql('c')} AS typ, {_end_sql('c')} AS ending, {_case_sql('c')} AS letter,
                  p IS NOT NULL AND {_end_sql('p')} = '' AS mid, f IS NOT NULL AS followed,
                  {_type_sql('f')} AS next_typ, {_case_sql('f')} AS next_case FROM cored),
types AS (SELECT typ, count(*) AS n, count(*) FILTER (ending = '.') AS n_dot, count(*) FILTER (letter = 'l') AS n_lower,
                 count(*) FILTER (letter = 'u' AND mid) AS n_upper_mid FROM tagged WHERE typ <> '' GROUP BY typ),
whole AS (SELECT sum(n)::DOUBLE AS total, sum(n_dot)::DOUBLE AS dots FROM types),
abbreviation AS (SELECT typ FROM (SELECT typ, n_dot::DOUBLE AS k, (n - n_dot)::DOUBLE AS r, dots / total AS share,
       length(replace(typ, '.', ''))::DOUBLE AS letters, length(typ) - length(replace(typ, '.', '')) AS inside
     FROM types, whole WHERE n_dot > 0 AND regexp_matches(typ, '\\p{{L}}') AND NOT regexp_matches(typ, '^\\p{{L}}$') AND dots < total) x
  WHERE 2 * (k * (ln({SN.PERIOD_SHARE}e0) - ln(share)) + CASE WHEN r > 0 THEN r * (ln({1 - SN.PERIOD_SHARE!r}e0) - ln(1 - share)) ELSE 0 END)
        * exp(-letters) * (inside + 1) * pow(letters, -r) >= {SN.ABBREVIATION_SCORE}e0),
pairs AS (SELECT typ, ending, next_typ, next_case, count(*) AS c,
                 {_kind_sql('typ', 'ending', 'typ IN (SELECT typ FROM abbreviation)')} AS kind
          FROM tagged WHERE ending <> '' AND followed GROUP BY ALL),
breaks AS (SELECT coalesce(sum(c), 0)::DOUBLE AS b FROM pairs WHERE kind IN ('p', '!')),
starter AS (SELECT key FROM (SELECT next_typ AS key, sum(c)::DOUBLE AS ab, any_value(types.n)::DOUBLE AS n, any_value(b) AS a, any_value(total) AS total
      FROM pairs JOIN types ON types.typ = next_typ, breaks, whole WHERE kind IN ('p', '!') AND next_case = 'u' GROUP BY next_typ) x
  WHERE ab * total > a * n AND {_llr_sql('a', 'n', 'ab', 'total')} >= {SN.STARTER_RATIO}),
collocation AS (SELECT key FROM (SELECT concat_ws(' ', p.typ, p.next_typ) AS key, sum(c)::DOUBLE AS ab, any_value(x.n_dot)::DOUBLE AS a,
             any_value(y.n)::DOUBLE AS n, any_value(total) AS total
      FROM pairs p JOIN types x ON x.typ = p.typ JOIN types y ON y.typ = p.next_typ, whole
      WHERE kind IN ('a', 'i', 'n') AND p.next_typ <> '' GROUP BY p.typ, p.next_typ) z
  WHERE ab > 1 AND ab * total > a * n AND {_llr_sql('a', 'n', 'ab', 'total')} >= {SN.COLLOCATION_RATIO}),
opener AS (SELECT typ FROM types WHERE n_lower > 0 AND n_upper_mid = 0 AND n > n_lower),
segs AS (SELECT doc_id, line_no, unnest(ss) AS seg, generate_subscripts(ss, 1) AS i
         FROM (SELECT doc_id, line_no, string_split(regexp_replace(regexp_replace(text, '[{SN.BLANK}]+$', ''),
                 '([.!?][{_CLOSING_SQL}]*[{SN.BLANK}]+)', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM lines) x),
met AS (SELECT *, {_CORE.format(x=f"regexp_extract(lag(seg) OVER w, '([^{SN.BLANK}]+)[{SN.BLANK}]*$', 1)")} AS a,
               {_CORE.format(x=f"regexp_extract(seg, '^[{SN.BLANK}]*([^{SN.BLANK}]+)', 1)")} AS b
        FROM segs WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY i)),
judged AS (SELECT *, {_type_sql('a')} AS typ, {_type_sql('b')} AS next_typ, {_case_sql('b')} AS letter, {_end_sql('a')} AS ending FROM met),
kinds AS (SELECT *, {_kind_sql('typ', 'ending', 'typ IN (SELECT typ FROM abbreviation)')} AS kind FROM judged),
ended AS (SELECT *, CASE WHEN i = 1 THEN false WHEN kind IN ('p', '!') THEN true
                         WHEN concat_ws(' ', typ, next_typ) IN (SELECT key FROM collocation) THEN false
                         WHEN kind = 'n' THEN letter <> 'l'
                         ELSE letter = 'u' AND (next_typ IN (SELECT key FROM starter) OR next_typ IN (SELECT typ FROM opener)) END AS cut FROM kinds),
numbered AS (SELECT doc_id, line_no, i, seg, sum(cut::INT) OVER (PARTITION BY doc_id, line_no ORDER BY i) AS sentence_no FROM ended),
sentences AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, CAST(sentence_no AS INT) AS sentence_no,
    regexp_replace(string_agg(seg, '' ORDER BY i), '^[{SN.BLANK}]+|[{SN.BLANK}]+$', '', 'g') AS sentence FROM numbered GROUP BY ALL)"""


@query("sentence_split", f"WITH {_SENTENCE_SQL} SELECT * FROM sentences WHERE sentence <> ''")
def q_sentence_split(spark, sf):
    """Boundaries learned from the corpus's own lines, then split."""
    lines = document_lines(_m(spark, sf))
    return SN.split_sentences(lines, ["doc_id", "line_no"], SN.learn_boundaries(lines))
