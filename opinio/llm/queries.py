"""The ``opN_<name>`` queries: each operator on its whole table with production
parameters, plus the DuckDB SQL where SQL can express the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.llm import (arc, bpe, decontam, langid, pieces, pii, quality, simhash, squares, token_rollup, topk, urlrep,
                        whitening)
from opinio.llm.common import held_out, is_training
from opinio.session import scratch_path

#: Fixed rules of the url filter.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block")]
QUALITY_THRESHOLD = 0.7
#: Tokenizer versions of the rollup query, as patterns of one token.
TOKENIZERS = {"words-1": r"[^ \t\n\r]+", "pieces-1": r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]"}
NEW_TOKENIZERS = {"pieces-2": r"[A-Za-z]+|[0-9]|[^A-Za-z0-9 \t\n\r]"}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    """Default place of the byte-level vocabulary: the installed package's file."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_model() -> str:
    """Default place of the piece model: the installed package's file."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs.where(is_training(F.col("doc_id"))))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_language.lang_pred", "_language.score")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrep.judge(_read(spark, sf_dir, "pages"), URL_RULES)


def change_feed(docs: DataFrame) -> list[tuple[int, DataFrame, dict[str, str]]]:
    """Stand-in change feed: all documents arrive; some are deleted, some
    revised; that batch is delivered again; a new tokenizer version counts the live documents."""
    seq, kind = F.lit(0).cast("bigint").alias("seq"), F.pmod("doc_id", F.lit(10))
    columns = ["doc_id", "source", "lang"]
    arrive = docs.select(seq, F.lit("upsert").alias("op"), *columns, "text")
    revised = F.when(kind == 7, F.concat("text", F.lit(" one more line.\n2 tokens"))).otherwise(F.col("text")).alias("text")
    change = docs.where(kind.isin(3, 7)).select(seq, F.when(kind == 3, "delete").otherwise("upsert").alias("op"), *columns, revised)
    live = docs.where(kind != 3).select(seq, F.lit("upsert").alias("op"), *columns, revised)
    return [(1, arrive, TOKENIZERS), (2, change, TOKENIZERS), (2, change, TOKENIZERS), (3, live, NEW_TOKENIZERS)]


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, f"llm-rollup-{uuid.uuid4().hex}")
    for batch, changes, patterns in change_feed(_read(spark, sf_dir, "documents")):
        counters = {v: token_rollup.pattern_counter(p) for v, p in patterns.items()}
        token_rollup.apply_batch(spark, root, batch, changes, counters)
    return token_rollup.totals(spark, root)


def _sha256(data: Column) -> Column:
    return F.sha2(data, 256)


def op6_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    ranks_path = ranks_path or vocabulary()
    return encoded_digests(_read(spark, sf_dir, "documents"), ranks_path)


def encoded_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    decoded = bpe.encode(docs, ranks_path, decoded="decoded")
    return decoded.select("doc_id", "n_tokens", _sha256(F.col("ids")).alias("ids_sha256"),
                          _sha256(F.col("decoded")).alias("decoded_sha256"))


def legacy_pages(pages: DataFrame) -> DataFrame:
    """Stand-in rows of a legacy archive: a page's html and a capture date."""
    date = F.date_format(F.timestamp_seconds(F.lit(1_000_000_000) + F.coalesce("page_id", F.lit(0))), "yyyyMMddHHmmss")
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").alias("key"), "url", date.alias("date"), body.alias("body"))


def op7_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, f"llm-archives-{uuid.uuid4().hex}")
    arc.write_arc(legacy_pages(_read(spark, sf_dir, "pages")), f"{root}/arc")
    arc.convert(spark, f"{root}/arc", f"{root}/warc", min_bytes=0)
    records = arc.with_references(arc.read_warc(spark, f"{root}/warc", payloads=False))
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlap(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        _sha256(F.array_join("items", ",").cast("binary")).alias("items_sha256"), "contaminated")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.col("pii.base")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, _sha256(_joined(base).cast("binary")).alias("base_sha256"),
                        _joined(F.col("pii.spans")).alias("spans"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.train_and_score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"),
                                     is_training(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= QUALITY_THRESHOLD, 1).otherwise(0).alias("predicted"))


def planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of about every tenth text, by the id's crc32, the words from a
    place on repeat the first ``p`` of them; the other texts and null ids stay."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n, a = F.size("words").cast("bigint"), F.col("a")
    rows = rows.withColumn("a", F.when(F.size("words") > 0, F.col("g") % n))
    rows = rows.withColumn("p", 1 + F.floor((n - a) / (3 + F.col("g") % 8)))
    period = F.slice("words", a.cast("int") + 1, F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(period, F.ceil((n - a) / F.col("p")).cast("int")))
    repeated = F.slice(F.concat(F.slice("words", F.lit(1), a.cast("int")), tail), F.lit(1), n.cast("int"))
    return rows.select("doc_id", F.when(a.isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = squares.find_runs(planted_repeats(_read(spark, sf_dir, "documents")))
    runs = F.col("repeats.runs")
    longest = F.array_max(F.transform(runs, lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform(runs, lambda r: F.concat(
        F.concat_ws(",", *(r[name].cast("string") for name in ("start", "length", "period"))), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size(runs).cast("bigint").alias("n_runs"), longest.alias("best"),
                        _sha256(listed.cast("binary")).alias("runs_sha256"),
                        _sha256(F.col("repeats.collapsed").cast("binary")).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(length * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.fit_and_whiten(_read(spark, sf_dir, "embeddings"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    model_path = model_path or piece_model()
    encoded = pieces.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), model_path)
    decoded = pieces.decode(encoded.select("doc_id", "pieces.n_tokens", "pieces.ids"), model_path)
    return decoded.select("doc_id", "n_tokens", _sha256(F.col("ids")).alias("ids_sha256"),
                          _sha256(F.col("decoded").cast("binary")).alias("decoded_sha256"))


_DUCK_HOST = "coalesce(translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_DUCK_PATH = "coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '')"


def _weight_sql(level: str, out: str) -> str:
    return f"""{out} AS (
  SELECT CASE WHEN n IS NULL OR m = n THEN 1.0 WHEN g = 0 OR g = n THEN 100.0
              ELSE (SELECT CASE WHEN rho > 0 THEN least(100.0, greatest(1.0, 1 / rho - 1)) ELSE 100.0 END FROM (
                SELECT ((gg / n - (g / n) * (g / n)) / ((g / n) * (1 - g / n)) - (m - 1) / n) / (1 - m / n) AS rho)) END AS w
  FROM (SELECT sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS g, count(*)::DOUBLE AS m,
               sum(good::DOUBLE * good / n) AS gg FROM {level} WHERE n > 0))"""


OP4_SQL = f"""
WITH urls AS (SELECT page_id, {_DUCK_HOST} AS host, {_DUCK_PATH} AS path FROM pages),
rules(rule, verdict) AS (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}),
parts AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rule_host, substr(rule, strpos(rule, '/')) AS rule_path FROM rules),
fits AS (SELECT host, path, arg_min(struct_pack(rule := rule, verdict := verdict), (-length(rule), rule)) AS best
  FROM (SELECT DISTINCT host, path FROM urls) JOIN parts
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path),
ruled AS (SELECT u.*, best.rule AS rule, best.verdict AS said FROM urls u LEFT JOIN fits USING (host, path)),
counted AS (SELECT host, count(said) AS n, count(*) FILTER (said = 'allow') AS good FROM ruled GROUP BY host),
suffixed AS (SELECT *, string_split(host, '.') AS labels FROM counted),
named AS (SELECT *, CASE WHEN len(labels) > 2 AND length(labels[-1]) = 2 AND labels[-2] IN ('ac','co','com','edu','gov','net','org')
                         THEN 2 ELSE 1 END AS k FROM suffixed),
hosts AS (SELECT host, n, good, array_to_string(labels[-k:], '.') AS suffix, array_to_string(labels[-(k + 1):], '.') AS domain FROM named),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY ALL),
{_weight_sql("suffixes", "ws")}, {_weight_sql("domains", "wd")}, {_weight_sql("hosts", "wh")},
overall AS (SELECT (sum(good) + 1.0) / (sum(n) + 2.0) AS mean FROM hosts),
s AS (SELECT suffix, (good + mean * w) / (n + w) AS mean FROM suffixes, ws, overall),
d AS (SELECT domain, (good + mean * w) / (n + w) AS mean FROM domains JOIN s USING (suffix), wd),
h AS (SELECT host, (good + mean * w) / (n + w) AS mean, n + w AS size FROM hosts JOIN d USING (domain), wh)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN mean + {urlrep.Z} * sqrt(mean * (1 - mean) / (size + 1)) < {urlrep.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN h USING (host)
"""

OP3_SQL = """
WITH v AS (SELECT vec_id::BIGINT AS vec_id, [floor(64 * e::DOUBLE) FOR e IN embedding] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.x, c.x)::BIGINT AS score,
         (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.x, c.x) DESC, c.vec_id))::INTEGER AS rank
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
WHERE rank <= 20
"""


def _counts_sql(versions: dict[str, str], text: str, where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT source, lang, '{v}' AS tokenizer, coalesce(len(regexp_extract_all({text}, '{p}')), 0) AS n_tokens FROM documents WHERE {where}"
        for v, p in versions.items())


_REVISED = "CASE WHEN doc_id % 10 = 7 THEN text || ' one more line.' || chr(10) || '2 tokens' ELSE text END"
OP5_SQL = f"""
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n_tokens)::BIGINT AS n_tokens
FROM ({_counts_sql(TOKENIZERS | NEW_TOKENIZERS, _REVISED, "doc_id % 10 <> 3")}) GROUP BY source, lang, tokenizer
"""

_DUCK_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""
OP8_SQL = f"""
WITH items AS (SELECT item_id, {_DUCK_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, list_slice(w, i, i + 12) AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM item_windows),
docs AS (SELECT doc_id, {_DUCK_WORDS} AS w FROM documents),
doc_windows AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs JOIN sizes ON len(w) >= k)),
found AS (SELECT doc_id, i, k, item_id FROM doc_windows JOIN item_windows USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_simhash_dedup, op3_topk_search, op4_url_filter, op5_token_counts,
                                    op6_byte_bpe, op7_arc_to_warc, op8_decontamination, op9_pii, op10_quality,
                                    op11_periodic_runs, op12_whitening, op13_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": OP3_SQL, "op4_url_filter": OP4_SQL, "op5_token_counts": OP5_SQL,
            "op8_decontamination": OP8_SQL}
