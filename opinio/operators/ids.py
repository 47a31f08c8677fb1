"""Distributed consecutive ids and running totals (no one-task window).

``row_number() OVER (ORDER BY k)`` or ``sum(x) OVER (ORDER BY k)`` without
PARTITION BY moves every row into one task. The functions here give the
same numbers with a bounded plan: range-partition by the order key, total
each partition (one row per partition), prefix-sum those totals in a window
over at most ``numPartitions`` rows, broadcast the offsets and add the
in-partition running value. Range bounds are sampled from the data, so a plan
that ranged the rows once for the totals and once for the rows would cut them
differently; the ranged rows and their partition number are therefore written
once to the shared folder and both branches read that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.session import write_once


def running_total(df: DataFrame, order_cols: list[str], value: Column, out_col: str,
                  partitions: int | None = None, inclusive: bool = True,
                  partition_cols: list[str] | None = None) -> DataFrame:
    """Add ``out_col`` = sum of ``value`` over all rows up to this row in
    ``order_cols`` order (keys must be unique); ``inclusive=False`` excludes
    the row itself. With ``partition_cols`` the sum restarts per group: the
    global prefix minus the group's starting offset (one small aggregation),
    so a large group is still spread over many tasks."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (partition_cols or []) + order_cols
    ranged = write_once(df.withColumn("_v", value).repartitionByRange(n, *keys)
                        .withColumn("_pid", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_pid").agg(F.sum("_v").alias("_t"))
    w_all = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(w_all), F.lit(0)).alias("_off"))
    frame = Window.partitionBy("_pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_v").over(frame), F.lit(0))
    out = (ranged.withColumn("_loc", local).join(F.broadcast(offsets), "_pid", "inner")
           .withColumn("_ex", F.col("_off") + F.col("_loc")))
    if partition_cols:
        start = out.groupBy(*partition_cols).agg(F.min("_ex").alias("_gs"))
        out = out.join(start, partition_cols, "inner").withColumn("_ex", F.col("_ex") - F.col("_gs"))
    total = F.col("_ex") + F.col("_v") if inclusive else F.col("_ex")
    out = out.withColumn(out_col, total)
    return out.drop("_v", "_pid", "_t", "_off", "_loc", "_ex", "_gs")


def dense_ids(df: DataFrame, order_cols: list[str], start: Column | int = 0,
              id_col: str = "id", partitions: int | None = None) -> DataFrame:
    """Number rows 1..n in ``order_cols`` order (keys must be unique) and add
    ``start``; returns ``df`` with ``id_col`` first."""
    start_col = start if isinstance(start, Column) else F.lit(start)
    out = running_total(df, order_cols, F.lit(1).cast("bigint"), "_rn", partitions)
    out = out.withColumn(id_col, (start_col + F.col("_rn")).cast("bigint"))
    return out.select(id_col, *[c for c in df.columns if c != id_col])
