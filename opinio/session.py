"""Spark session helpers.

On a cluster the session is created by the platform; these helpers only
fill in settings that are still unset, so a cluster configuration always
wins over the defaults used in tests and the local bench.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session zone (dates derived from
# timestamps must not depend on the host), AQE for runtime re-planning and
# skew splitting, Arrow for the few pandas UDFs.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "opinio",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return the active session or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master or os.environ.get("OPINIO_MASTER", "local[8]"))
    conf = dict(_DEFAULTS)
    conf["spark.driver.memory"] = os.environ.get("OPINIO_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Only when it is unset
    and the master is local (tests, the bench) a fresh scratch folder is
    created and registered; on a cluster an unset folder is an error, so
    lineage cuts and written tables never land on a machine-local disk.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    if sc_dir:
        return sc_dir
    if conf_dir:
        spark.sparkContext.setCheckpointDir(conf_dir)
        return spark.sparkContext.getCheckpointDir() or conf_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS / object store)")
    local = tempfile.mkdtemp(prefix="opinio-ckpt-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder below the shared checkpoint directory for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def write_once(df, name: str):
    """Write ``df`` below the shared checkpoint folder and read it back, for jobs
    that read one result in several branches, and for dimensions: of a written
    table the planner knows the bytes, so it broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles beyond."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Largest list of words that a plan carries as literals (some ten thousand; planning time grows with them).
LITERAL_BYTES = 256 << 10


def literal_set(df, column: str, limit: int | None = None) -> list[str] | None:
    """The distinct values of a string column for ``isin`` (a hash set inside the
    expression: no join, no exchange), or None if they take more than ``limit`` bytes
    (counted before anything is collected); the caller joins then."""
    from pyspark.sql import functions as F
    distinct = write_once(df.select(F.col(column).alias("v")).where(F.col(column).isNotNull()).distinct(), "literals")
    size = distinct.agg(F.sum(F.octet_length("v") + 16).alias("b")).first()["b"] or 0
    if size > (LITERAL_BYTES if limit is None else limit):
        return None
    return sorted(r["v"] for r in distinct.collect())


def ensure_parallelism(df, *key_cols: str):
    """Spread a small input before CPU-heavy per-row work (tokenising text).

    The decision uses Catalyst's size estimate of the plan (no job runs):
    an input estimated at ``defaultParallelism x maxPartitionBytes`` or more
    already arrives in enough splits and is returned unchanged -- no extra
    shuffle at scale. A smaller one (e.g. a single row group read by one
    task) is hash-partitioned by ``key_cols`` to the default parallelism; a
    later aggregation or window on the same key then reuses that
    partitioning instead of adding its own exchange."""
    spark = df.sparkSession
    target = spark.sparkContext.defaultParallelism
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if estimate >= target * split_bytes:
        return df
    return df.repartition(target, *key_cols) if key_cols else df.repartition(target)


def by_repeats(df, *key_cols: str):
    """``df`` as (rows whose keys stand once, rows whose keys repeat or None if none does); nulls are
    keys. Only keys are counted and exchanged, and joined if any repeats."""
    from functools import reduce

    from pyspark.sql import functions as F
    twice = write_once(df.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                       .select(*[F.col(c).alias(f"_k_{c}") for c in key_cols], F.lit(True).alias("_twice")), "repeated-keys")
    if twice.isEmpty():
        return df, None
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in key_cols])
    marked = df.join(twice, same, "left")
    return (marked.where(F.col("_twice").isNull()).select(*df.columns), marked.where(F.col("_twice")).select(*df.columns))


#: Whole texts that go to a Python worker at once, by number and by bytes (a longer text goes alone).
TEXTS_A_BATCH = 200
BYTES_A_BATCH = 2 << 20


def _number(setting: str) -> int:
    """A plain number or a size like ``64m``."""
    digits, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", setting.lower()).groups()
    return int(digits) << 10 * " kmgt".index(unit or " ")


def small_batches(df):
    """``df``, whose session from now on hands Python at most ``TEXTS_A_BATCH`` rows
    and ``BYTES_A_BATCH`` bytes at once: the defaults of 10,000 rows of any size suit
    numbers, not whole texts. Spark reads the settings when the plan runs, so they
    can't be confined to one DataFrame; a session's own lower values stay."""
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", TEXTS_A_BATCH), ("maxBytesPerBatch", BYTES_A_BATCH)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < _number(conf.get(key)) <= most:
            conf.set(key, str(most))
    return df


def sizing_conf(input_bytes: int, cores: int, partition_bytes: int = 256 * 1024 * 1024) -> dict:
    """Shuffle / split settings for a job over ``input_bytes`` on ``cores``
    executor cores: enough shuffle partitions that each holds about
    ``partition_bytes`` (at least two waves of tasks), scan splits of the same
    size, and AQE left to coalesce small partitions and split skewed ones."""
    parts = max(2 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
    }
