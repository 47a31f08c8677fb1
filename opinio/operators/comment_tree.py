"""Comment trees.

Raw comment pages arrive as nested JSON: items with ``body``, ``user``,
``created_at`` and ``replies`` (same shape, any depth). ``flatten_comment_tree``
parses them as Variant and expands one tree level per step (explode of
``replies``), so work per step is proportional to the comments on that level
and no tree is ever gathered in one place. Items lacking a required field
are dropped together with their subtree, exactly like the reference's
recursive walk; each emitted row carries its level and its parent's
external id.

``thread_levels`` answers the same question for stored comments (parent id
pointers): depth and root per comment by pointer jumping, O(log depth)
joins. Both loops cut lineage with ``checkpoint()`` into the cluster's
checkpoint directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.functions.hashing import comment_external_id
from opinio.session import checkpoint_dir

# Fields an item must carry to be kept (outlet 1 / outlet 3).
REQUIRED_FIELDS = ("body", "user", "created_at")
REQUIRED_FIELDS_FAZ = ("body", "title", "author", "created_at")
MAX_LEVELS = 10_000  # guard against malformed (cyclic) input only


def _item_fields(item):
    """Fields of one comment item; outlet 1 nests the user name under
    ``user.username``, outlet 3 gives a plain ``author`` (and a ``title``)."""
    author = F.try_variant_get(item, "$.author", "string")
    return {
        "body": F.try_variant_get(item, "$.body", "string"),
        "title": F.try_variant_get(item, "$.title", "string"),
        "author": author,
        "user": F.coalesce(F.try_variant_get(item, "$.user.username", "string"), author),
        "created_at": F.try_variant_get(item, "$.created_at", "string"),
    }


def flatten_comment_tree(docs: DataFrame, url_col: str = "url", tree_col: str = "tree",
                         required: tuple[str, ...] = REQUIRED_FIELDS, title_in_body: bool = False,
                         normalise=None) -> DataFrame:
    """One row per kept comment: url, external_id, parent_external_id,
    level, body, user, created_at (``tree_col`` holds the JSON text). With
    ``title_in_body`` (outlet 3 stores comments so) the body is
    ``title + ' ' + body``; ``normalise`` (a column function such as W12's
    ``nfkd``) is applied to the body before the external id is formed."""
    checkpoint_dir(docs.sparkSession)
    items = docs.select(F.col(url_col).alias("url"),
                        F.explode(F.try_variant_get(F.parse_json(F.col(tree_col)), "$", "array<variant>"))
                        .alias("item"),
                        F.lit(None).cast("bigint").alias("parent_external_id"),
                        F.lit(0).alias("level"))
    out = None
    for _ in range(MAX_LEVELS):
        f = _item_fields(F.col("item"))
        body = F.concat_ws(" ", f["title"], f["body"]) if title_in_body else f["body"]
        keep = F.lit(True)
        for name in required:
            keep = keep & f[name].isNotNull()
        kept = (items.select("url", "item", "parent_external_id", "level",
                             (normalise(body) if normalise else body).alias("body"), f["user"].alias("user"),
                             f["created_at"].alias("created_at"), keep.alias("keep"))
                .filter("keep").drop("keep")
                .withColumn("external_id", comment_external_id(F.col("url"), F.col("user"), F.col("body")))
                .checkpoint(eager=True))
        rows = kept.select("url", "external_id", "parent_external_id", "level", "body", "user", "created_at")
        out = rows if out is None else out.unionByName(rows)
        items = kept.select("url",
                            F.explode(F.try_variant_get(F.col("item"), "$.replies", "array<variant>")).alias("item"),
                            F.col("external_id").alias("parent_external_id"),
                            (F.col("level") + 1).alias("level"))
        if items.isEmpty():
            return out
    raise ValueError("comment tree deeper than MAX_LEVELS")


def comment_date_window(comments: DataFrame, start: str, end: str, created_col: str = "created_at") -> DataFrame:
    """keep a comment when the first ten characters of its creation
    time fall in [start, end]; applied per row after flattening, so a
    dropped parent does not drop its replies."""
    day = F.substring(F.col(created_col), 1, 10)
    return comments.filter((day >= F.lit(start)) & (day <= F.lit(end)))


def top_level_comments(comments: DataFrame, parent_col: str = "parent_id") -> DataFrame:
    """only records without a parent."""
    return comments.filter(F.col(parent_col).isNull())


def thread_levels(comments: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """C1 for stored comments: (id, root_id, depth). A parent id that points
    to no stored comment ends the chain (that comment is a root).

    Pointer jumping: every row keeps a pointer to its furthest known
    ancestor and the hops to it; each join doubles the distance covered, so
    a thread of depth d needs about log2(d) joins. A hot root only skews the
    probe side of the join, which AQE splits."""
    checkpoint_dir(comments.sparkSession)
    c = comments.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    ids = c.select(F.col("id").alias("pid"))
    state = (c.join(ids, c.parent == ids.pid, "left")
             .select("id",
                     F.col("pid").alias("anc"),
                     F.when(F.col("pid").isNull(), F.col("id")).alias("root"),
                     F.when(F.col("pid").isNull(), F.lit(0)).otherwise(F.lit(1)).alias("depth"))
             .checkpoint(eager=True))
    for _ in range(64):
        if state.filter(F.col("anc").isNotNull()).isEmpty():
            return state.select("id", F.col("root").alias("root_id"), "depth")
        t = state.select(F.col("id").alias("t_id"), F.col("anc").alias("t_anc"),
                         F.col("root").alias("t_root"), F.col("depth").alias("t_depth"))
        j = state.join(t, state.anc == t.t_id, "left")
        moving = F.col("anc").isNotNull()
        state = j.select(
            "id",
            F.when(moving, F.col("t_anc")).alias("anc"),
            F.when(moving, F.col("t_root")).otherwise(F.col("root")).alias("root"),
            F.when(moving, F.col("depth") + F.col("t_depth")).otherwise(F.col("depth")).alias("depth"),
        ).checkpoint(eager=True)
    raise ValueError("parent pointers contain a cycle")
