"""Store tables bucketed by their natural key (co-located merges).

Every ingest run anti-joins a small incoming batch against a large stored
table on its natural key (url, external id, attribute tuple). Written with
``bucketBy`` on that key, the stored side is already hash-partitioned and
sorted; the join then shuffles only the incoming batch into the table's
buckets instead of re-shuffling the whole store on every run. ``KeyedStore``
adds Bloom filters of the stored keys, so a run reads only the folders that may
hold a key of its batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinio.session import write_once

# Natural keys of the store tables (unique constraints of the reference).
NATURAL_KEYS = {
    "article_header": ["url"],
    "comment": ["external_id"],
    "udf_values": ["udf_id", "object_type", "object_id", "udf_value"],
    "crawl_dates_proc": ["source_id", "date_processed"],
}


def save_bucketed(df: DataFrame, name: str, key_cols: list[str], buckets: int, mode: str = "overwrite") -> None:
    """Write ``df`` as a catalog table bucketed and sorted by ``key_cols``."""
    df.write.mode(mode).bucketBy(buckets, *key_cols).sortBy(*key_cols).saveAsTable(name)


def read_store(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


#: Bits of one filter block (the span of Spark's bitmap functions), and bits set per key.
BLOCK_BITS, KEY_BITS = 32768, 4


class KeyedStore:
    """Natural keys of a stored table, kept for insert-or-ignore and id look-ups.

    Two catalog tables below ``path`` (a shared folder):

    * ``<name>``: the key columns and ``payload`` columns (such as the generated id), in folders
      ``part=P`` and bucketed by the key, so a join on the key reads the folders it needs and
      exchanges only the batch;
    * ``<name>_filter``: Bloom filters, one 4 KB block per ``block`` (``part`` = block mod parts) and
      ``append``. Readers OR the appends of a block. A key sets four bits of one block.

    ``fresh`` tests a batch's keys against the filter blocks: keys outside are new and never meet the
    stored keys; the others are anti-joined with the folders they fall into, and no other folder is
    read. A false positive costs a look, never a row. ``append`` writes the filter before the keys, so
    a run lost between the two leaves false positives only.

    ``blocks`` (a multiple of ``parts``) is chosen for the keys to come: 2048 keys a block
    give 16 bits a key and under 1 in 400 false positives; more keys a block only cost reads.
    Keys: null components never equal a stored key (as in SQL), and rows of a batch whose keys are
    equal or null alike count as one. Key columns may not be named part, block or end in ``_fs``.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, key: list[str],
                 parts: int = 16, buckets: int = 8, blocks: int = 64):
        if blocks % parts:
            raise ValueError("blocks must be a multiple of parts")
        if {"part", "block"} & {c.lower() for c in key} or any(c.endswith("_fs") for c in key):
            raise ValueError("part, block and names ending in _fs belong to the layout")
        self.spark, self.name, self.path, self.key = spark, name, path.rstrip("/"), list(key)
        self.parts, self.buckets, self.blocks = parts, buckets, blocks

    # ---- layout ----------------------------------------------------------------------
    def _hash(self) -> Column:
        return F.xxhash64(*self.key)

    def _placed(self, rows: DataFrame) -> DataFrame:
        block = F.pmod(self._hash(), F.lit(self.blocks)).cast("int")
        return rows.withColumn("block", block).withColumn("part", F.col("block") % self.parts)

    def _bits(self) -> list[Column]:
        return [F.pmod(F.xxhash64(*self.key, F.lit(i)), F.lit(BLOCK_BITS)).cast("int") for i in range(KEY_BITS)]

    def _exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def _save(self, rows: DataFrame, name: str, by: list[str]) -> None:
        """Append; each bucket is written by one task, so an append makes at most parts x buckets files."""
        (rows.repartition(self.buckets, *by).write.mode("append").option("path", f"{self.path}/{name}")
         .partitionBy("part").bucketBy(self.buckets, *by).sortBy(*by).saveAsTable(name))

    # ---- reads and writes --------------------------------------------------------------
    def append(self, rows: DataFrame) -> None:
        """Add stored rows (key columns and payload). Repeated keys are harmless to ``fresh``."""
        placed = self._placed(rows)
        bit = F.explode(F.array(*self._bits())).alias("bit")
        filters = (placed.select("part", "block", bit).groupBy("part", "block")
                   .agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits")))
        self._save(filters.select("block", "bits", "part"), f"{self.name}_filter", ["block"])
        self._save(placed.drop("block"), self.name, self.key)

    def stored(self, parts: list[int] | None = None) -> DataFrame:
        """The stored rows, or those of some folders (partition filters)."""
        rows = self.spark.table(self.name)
        return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("part")

    def filters(self) -> DataFrame:
        """(block, bits): one filter a block; merging the appends needs no exchange (bucketed by block)."""
        return self.spark.table(f"{self.name}_filter").groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))

    def judged(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``part`` and ``maybe_fs``: whether the filter cannot rule out that the key is stored."""
        def is_set(bit: str) -> Column:
            byte = F.conv(F.hex(F.substring("bits", F.floor(F.col(bit) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
            return F.getbit(byte, F.col(bit) % 8) == 1
        bits = [f"_bit{i}_fs" for i in range(KEY_BITS)]
        rows = self._placed(keys).select("*", *[b.alias(n) for b, n in zip(self._bits(), bits)])
        hit = is_set(bits[0])
        for b in bits[1:]:
            hit = hit & is_set(b)
        whole = F.lit(True)
        for c in self.key:
            whole = whole & F.col(c).isNotNull()
        return (rows.join(self.filters().hint("merge"), "block", "left")
                .select(*keys.columns, "part", (whole & F.coalesce(hit, F.lit(False))).alias("maybe_fs")))

    def fresh(self, keys: DataFrame, order_col: str) -> DataFrame:
        """(key..., order_col) of the batch rows to insert: per key the row of lowest ``order_col``, if
        the key is not stored. Give the key and a row number only; join other columns afterwards."""
        first = keys.groupBy(*self.key).agg(F.min(order_col).alias(order_col))
        if not self._exists():
            return first
        judged = write_once(self.judged(first), "judged-keys")
        maybe = judged.where("maybe_fs")
        touched = sorted(r["part"] for r in maybe.select("part").distinct().collect())   # at most ``parts`` numbers
        out = [*self.key, order_col]
        new = judged.where(~F.col("maybe_fs")).select(*out)
        if not touched:
            return new
        known = self.stored(touched).select(*self.key).hint("merge")
        return new.unionByName(maybe.select(*out).join(known, self.key, "left_anti"))

    def resolve(self, keys: DataFrame) -> DataFrame:
        """``keys`` with the stored payload (null where the key is not stored): the batch alone is
        exchanged. Stored keys must be unique."""
        return keys.join(self.stored().hint("merge"), self.key, "left")
