"""Helpers shared by the llm operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.session import BYTES_A_BATCH, TEXTS_A_BATCH, scratch_path, small_batches  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back:
    later branches read the files, a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, row_bytes: int, limit: int = 64 << 20) -> DataFrame:
    """Hint a broadcast only if the counted rows fit ``limit`` bytes at
    ``row_bytes`` each; otherwise the same join shuffles (AQE splits skew)."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, equals 2 (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def is_training(doc_id: Column) -> Column:
    """Rows a model may learn from: a non-null id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)
