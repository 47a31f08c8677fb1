"""Ingest: validation, versioning and insert-or-ignore merges.

The reference validates one Python object at a time through setters and
writes row by row in chunks of 100. Here an incoming batch is a DataFrame:
every rule is a boolean column, invalid rows carry their reasons
(``array_compact`` of the failed rules), and writes are set operations
producing the rows to append or the next version of a table.

Shuffles: validation is narrow except the source lookup (broadcast of the
fixed source dimension); de-duplication is one aggregation on the natural
key with map-side ``min_by`` (a hot key costs one row per map task), and
"ignore existing" is one anti-join on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.functions.hashing import content_hash
from opinio.functions.strings import remove_nul
from opinio.operators.ids import dense_ids
from opinio.session import write_once
from opinio.sources.runs import Change, RunStore

# The reference's length limits.
MAX_URL_LENGTH = 2048      # url must be strictly shorter
MAX_HEADLINE_LENGTH = 200  # headline may be this long
MAX_UDF_LENGTH = 80        # attribute value may be this long

# URL shape accepted by the header validation: scheme, dotted host (or
# localhost / IPv4), optional port, then any non-blank path/query/fragment.
URL_PATTERN = (r"^(https?|ftp)://([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
               r"(:[0-9]{1,5})?([/?#][^ \t\r\n]*)?$")


def _reasons(rules: dict[str, Column]) -> Column:
    """Names of failed rules (a NULL rule counts as failed)."""
    return F.array_compact(F.array(*[F.when(F.coalesce(ok, F.lit(False)), F.lit(None))
                                     .otherwise(F.lit(name)) for name, ok in rules.items()]))


def with_validation(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All rules evaluated; valid only if none failed."""
    r = _reasons(rules)
    return df.withColumn("reasons", r).withColumn("is_valid", F.size("reasons") == 0)


def validate_headers(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """Url valid and shorter than 2048; source id positive and known;
    mandatory url / obsolete / source_id (obsolete defaults to false)."""
    known = write_once(sources.select(F.col("id").alias("_known_source")), "sources")
    df = (incoming.withColumn("obsolete", F.coalesce(F.col("obsolete"), F.lit(False)))
          .join(known, F.col("source_id") == F.col("_known_source"), "left"))
    rules = {
        "url_missing": F.col("url").isNotNull(),
        "url_invalid": F.col("url").rlike(URL_PATTERN),
        "url_too_long": F.length("url") < MAX_URL_LENGTH,
        "source_missing": F.col("source_id").isNotNull(),
        "source_not_positive": F.col("source_id") > 0,
        "source_unknown": F.col("_known_source").isNotNull(),
    }
    return with_validation(df, rules).drop("_known_source")


def validate_bodies(incoming: DataFrame) -> DataFrame:
    """Headline at most 200 characters, article id positive, counter
    non-negative (0 only as the default), timestamps truncated to seconds;
    every mandatory field present."""
    ts = F.date_trunc("second", F.col("proc_timestamp"))
    if dict(incoming.dtypes).get("proc_timestamp") == "timestamp_ntz":
        ts = ts.cast("timestamp_ntz")  # date_trunc yields TIMESTAMP; keep the input's type
    df = (incoming.withColumn("proc_counter", F.coalesce(F.col("proc_counter"), F.lit(0)))
          .withColumn("proc_timestamp", ts))
    rules = {
        "article_missing": F.col("article_id").isNotNull(),
        "article_not_positive": F.col("article_id") > 0,
        "headline_missing": F.col("headline").isNotNull(),
        "headline_too_long": F.length("headline") <= MAX_HEADLINE_LENGTH,
        "body_missing": F.col("body").isNotNull(),
        "timestamp_missing": F.col("proc_timestamp").isNotNull(),
        "counter_negative": F.col("proc_counter") >= 0,
    }
    return with_validation(df, rules)


def validate_comments(incoming: DataFrame) -> DataFrame:
    """NUL characters removed from the body; level >= 0; body id > 0;
    mandatory article_body_id, external_id, level, body, proc_timestamp."""
    df = incoming.withColumn("body", remove_nul(F.col("body")))
    rules = {
        "body_id_missing": F.col("article_body_id").isNotNull(),
        "body_id_not_positive": F.col("article_body_id") > 0,
        "external_id_missing": F.col("external_id").isNotNull(),
        "level_missing": F.col("level").isNotNull(),
        "level_negative": F.col("level") >= 0,
        "body_missing": F.col("body").isNotNull(),
        "timestamp_missing": F.col("proc_timestamp").isNotNull(),
    }
    return with_validation(df, rules)


def validate_udfs(incoming: DataFrame, udf_header: DataFrame) -> DataFrame:
    """Attribute key must name a known field (unknown keys such as
    'replies' are dropped silently), value at most 80 characters; the key
    is mapped to its id; duplicates collapse (set semantics)."""
    uh = write_once(udf_header.select(F.col("id").alias("udf_id"), F.col("udf_name").alias("key")), "udf-fields")
    ok = (incoming.join(uh, "key", "inner")
          .filter(F.col("value").isNotNull() & (F.length("value") <= MAX_UDF_LENGTH)))
    return ok.select("udf_id", "object_type", "object_id", F.col("value").alias("udf_value")).distinct()


def body_version_diff(incoming: DataFrame, latest: DataFrame) -> DataFrame:
    """Compare each incoming body with the latest stored version of its
    article: a new version when headline or body differs (or nothing is
    stored); else the stored row is kept and only its counter is bumped.
    Fingerprints are compared, so the wide text is hashed once per side
    (``latest`` may hold ``text_hash`` instead of the texts)."""
    hashed = F.col("text_hash") if "text_hash" in latest.columns else content_hash(F.col("headline"), F.col("body"))
    old = latest.select(F.col("id").alias("old_id"), "article_id",
                        F.col("proc_counter").alias("old_counter"), hashed.alias("old_hash"))
    new = incoming.withColumn("new_hash", content_hash(F.col("headline"), F.col("body")))
    j = new.join(old, "article_id", "left")
    changed = F.col("old_id").isNull() | (F.col("new_hash") != F.col("old_hash"))
    return j.select("article_id", "old_id", changed.alias("insert"),
                    F.when(changed, F.col("proc_counter") + 1)
                     .otherwise(F.col("old_counter") + 1).alias("new_counter"),
                    "headline", "body", "proc_timestamp")


def body_upsert(bodies: DataFrame, diff: DataFrame) -> DataFrame:
    """The rows of article_body that a batch changes. Articles whose text
    is unchanged give an ``update`` row: the stored row's id and its bumped
    counter (texts and time stay as stored and are NULL here). Changed or new
    articles give an ``insert`` row with counter + 1; new ids continue after
    the current max id in article order (one new version per article per
    batch). No stored text is read: only the max id is."""
    start = bodies.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    new = diff.filter(F.col("insert")).select("article_id", "headline", "body", "proc_timestamp",
                                              F.col("new_counter").alias("proc_counter"))
    added = dense_ids(new, ["article_id"], start).withColumn("op", F.lit("insert"))
    bumped = diff.filter(~F.col("insert")).select(
        F.lit("update").alias("op"), F.col("old_id").alias("id"), "article_id",
        *[F.lit(None).cast(diff.schema[c].dataType).alias(c) for c in ("headline", "body", "proc_timestamp")],
        F.col("new_counter").alias("proc_counter"))
    return bumped.unionByName(added.select(*bumped.columns))


def apply_body_upsert(bodies: DataFrame, changes: DataFrame) -> DataFrame:
    """The next version of article_body: stored rows with the counters of
    ``changes`` (joined on ids), and its new rows."""
    bump = changes.filter("op = 'update'").select("id", F.col("proc_counter").alias("_bumped"))
    kept = bodies.join(bump, "id", "left").withColumn("proc_counter", F.coalesce("_bumped", "proc_counter"))
    return kept.select(*bodies.columns).unionByName(changes.filter("op = 'insert'").select(*bodies.columns))


def first_wins(df: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """In-batch insert-or-ignore: the first row (lowest ``order_col``) per
    key. ``min_by`` aggregates map-side, so a hot key costs one row per map
    task in the shuffle."""
    cols = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.min_by(F.struct(*cols), F.col(order_col)).alias("_r"))
            .select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols]))


def insert_ignore(incoming: DataFrame, existing: DataFrame, key: list[str],
                  order_col: str | None = None) -> DataFrame:
    """W8 (``ON CONFLICT DO NOTHING``): rows to append -- first in batch
    wins, stored rows win over new ones."""
    batch = first_wins(incoming, key, order_col) if order_col else incoming.dropDuplicates(key)
    return batch.join(existing.select(*key), key, "left_anti")


def mark_obsolete(headers: DataFrame, ids: DataFrame) -> DataFrame:
    """``UPDATE article_header SET obsolete = true WHERE id IN ids``."""
    hit = ids.select(F.col("id").alias("_hit")).distinct()
    j = headers.join(hit, headers.id == hit._hit, "left")
    return j.select(*[F.when(F.col("_hit").isNotNull(), F.lit(True)).otherwise(F.col("obsolete")).alias(c)
                      if c == "obsolete" else F.col(c) for c in headers.columns])


def resolve_ids(keys: DataFrame, table: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """Natural key -> generated id, by an equi-join on the key."""
    return keys.join(table.select(*key, id_col), key, "left")


def cascade_delete_articles(headers: DataFrame, bodies: DataFrame, comments: DataFrame,
                            topic_results: DataFrame, article_ids: DataFrame) -> dict[str, DataFrame]:
    """The declared ON DELETE CASCADE chain as anti-joins: articles ->
    bodies -> comments, and articles -> topic results. Returns the
    surviving tables."""
    dead = article_ids.select(F.col("id").alias("_dead")).distinct()
    dead_bodies = (bodies.join(dead, bodies.article_id == dead._dead, "left_semi")
                   .select(F.col("id").alias("_dead_body")))
    return {
        "article_header": headers.join(dead, headers.id == dead._dead, "left_anti"),
        "article_body": bodies.join(dead, bodies.article_id == dead._dead, "left_anti"),
        "comment": comments.join(dead_bodies, comments.article_body_id == dead_bodies._dead_body, "left_anti"),
        "topic_detector_result": topic_results.join(
            dead, topic_results.article_header_id == dead._dead, "left_anti"),
    }


def fk_violations(checks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Spark does not enforce keys, so each declared foreign key becomes
    an anti-join report: (constraint, child rows whose parent is missing).
    ``checks`` = (name, child, fk column, parent, key column); NULL foreign
    keys are not violations (as in SQL)."""
    out = None
    for name, child, fk, parent, pk in checks:
        p = parent.select(F.col(pk).alias("_pk")).distinct()
        bad = (child.filter(F.col(fk).isNotNull())
               .join(p, F.col(fk) == p._pk, "left_anti")
               .agg(F.count(F.lit(1)).alias("n_violations"))
               .select(F.lit(name).alias("fk_constraint"), "n_violations"))
        out = bad if out is None else out.unionByName(bad)
    return out


def ingest_batch(headers: DataFrame, bodies: DataFrame, latest_bodies: DataFrame, stored_headers: DataFrame,
                 sources: DataFrame, udf_header: DataFrame, article_udfs: DataFrame) -> dict[str, DataFrame]:
    """One ingest run in the reference's order -- articles whose body is
    invalid are marked obsolete, new headers are inserted (insert-ignore on
    url), bodies are version-diffed (insert or counter bump), and attribute
    values are written only for articles that got a new body version.
    ``article_udfs`` holds (article_id, key, value). Returns the row sets
    to write, keyed by stage."""
    vb = validate_bodies(bodies)
    obsolete = vb.filter(~F.col("is_valid")).select(F.col("article_id").alias("id")).distinct()
    vh = validate_headers(headers, sources).filter("is_valid").drop("reasons", "is_valid")
    new_headers = insert_ignore(vh, stored_headers, ["url"], order_col="pos")
    diff = body_version_diff(vb.filter("is_valid"), latest_bodies)
    new_versions = diff.filter(F.col("insert")).select("article_id")
    udfs = (validate_udfs(article_udfs.withColumnRenamed("article_id", "object_id")
                          .withColumn("object_type", F.lit(1)), udf_header)
            .join(new_versions.withColumnRenamed("article_id", "object_id"), "object_id", "left_semi"))
    return {"obsolete_marked": obsolete, "new_headers": new_headers,
            "new_bodies": diff.filter(F.col("insert")), "bumped_bodies": diff.filter(~F.col("insert")),
            "new_udfs": udfs}


def ingest_run(store: RunStore, run: int, headers: DataFrame, bodies: DataFrame, sources: DataFrame,
               udf_header: DataFrame, article_udfs: DataFrame) -> bool:
    """W13 as one atomic run over a ``RunStore`` with the tables ``article_header`` (key id),
    ``article_body`` (id) and ``udf_values`` (object_id): the row sets of ``ingest_batch`` are written
    once, then every touched bucket of the tables is rewritten in the reference's order and the run's
    marker ends it. Returns False, and does nothing, if the run is complete already."""
    if store.is_complete(run):
        return False
    old_headers, old_bodies = store.read("article_header"), store.read("article_body")
    newest = old_bodies.groupBy("article_id").agg(F.max("id").alias("id"))
    # Hashed where they lie (a semi-join would be moved below the hash), so no stored text is exchanged.
    hashes = old_bodies.select("id", "article_id", "proc_counter", content_hash(F.col("headline"), F.col("body")).alias("text_hash"))
    latest = hashes.join(newest.select("id").distinct(), "id")
    batch = ingest_batch(headers, bodies, latest, old_headers, sources, udf_header, article_udfs)
    bumped = batch["bumped_bodies"]  # their texts stay as stored
    batch["bumped_bodies"] = bumped.withColumns({c: F.lit(None).cast(bumped.schema[c].dataType)
                                                 for c in ("headline", "body", "proc_timestamp")})
    stages = {name: write_once(df, name) for name, df in batch.items()}

    def header_change() -> Change:
        start = old_headers.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
        new = write_once(dense_ids(stages["new_headers"], ["pos"], start).select(*old_headers.columns), "headers")
        marked = stages["obsolete_marked"]
        return Change(marked.select("id").unionByName(new.select("id")),
                      lambda stored: mark_obsolete(stored, marked).unionByName(new))

    def body_change() -> Change:
        diff = stages["new_bodies"].unionByName(stages["bumped_bodies"])
        changes = write_once(body_upsert(old_bodies, diff), "bodies")
        return Change(changes.select("id"), lambda stored: apply_body_upsert(stored, changes))

    def udf_change() -> Change:
        new = stages["new_udfs"]
        return Change(new.select("object_id"), lambda stored: stored.unionByName(
            insert_ignore(new.select(*stored.columns), stored, stored.columns)))

    return store.commit(run, {"article_header": header_change, "article_body": body_change, "udf_values": udf_change})
