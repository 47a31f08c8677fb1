"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprint: 64 bits over XXH64 of all word shingles; a bit is 1 if set in
more than half of them. Equal fingerprints collapse first, so a large group of
copies is one row from then on.

Links (Hamming distance <= ``MAX_BITS`` = 3): a fingerprint is mapped to the
bit counts of its 32 two-bit segments. The Manhattan distance of two such
vectors never exceeds the Hamming distance, so it is a lower bound. Of the two
16-segment halves one has a Manhattan distance of at most 1, and two vectors
at distance 1 differ by one in a single segment. The grid range join therefore
keys a cell by (half, its 16 counts): each fingerprint stands in its own cell
and looks into its own cell and the cells one count up; pairs that meet are
verified exactly by ``bit_count(a xor b)``. Work grows with the fingerprints
(27 rows each), not with their square.

Cells in which many fingerprints meet (near copies of one text) are cut into
blocks; every pair of blocks is a task of its own that compares exactly and
returns a spanning forest of its links, never all pairs. Both ways give the
same components. Components: ``components.py``.

Edge cases: a null or wordless text has fingerprint zero and is linked like any
other; a text with fewer words than a shingle is one shingle. Repeated rows keep
one row each. Null ids get a component like others; component_id is the smallest
non-null id in it (null if there is none). An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import UPPER, broadcast_if_bounded, small_batches, written
from opinio.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Pairs that may meet in a cell before it is cut into blocks of BLOCK rows.
CELL_PAIRS = 1024
BLOCK = 2048
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    ones, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 14):
        at = zip(starts[i:min(n, i + (1 << 14))].tolist(), (last[i:i + (1 << 14)] - 1).tolist())
        hashes = np.array([h(joined[a:b], SEED) for a, b in at], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """Column: signed 64-bit SimHash of a text."""
    @F.pandas_udf("bigint")
    def simhash_of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t, shingle) for t in texts], dtype="int64")

    return simhash_of(text)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _cells(fps: DataFrame) -> DataFrame:
    """(half, cell, own, fp): the own cell and the cells one count up."""
    field = F.lit(0x55555555)
    halves = []
    for half, bits in enumerate((F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32))):
        counts = bits - F.shiftright(bits, 1).bitwiseAND(field.cast("bigint"))
        up = [F.when(F.shiftright(counts, 2 * i).bitwiseAND(F.lit(3)) < 2, counts + F.lit(1 << 2 * i))
              for i in range(16)]
        halves.append(F.struct(F.lit(half).alias("half"), counts.alias("own"), F.array(counts, *up).alias("cells")))
    per_half = fps.select("fp", F.explode(F.array(*halves)).alias("h"))
    return (per_half.select("fp", "h.half", "h.own", F.explode("h.cells").alias("cell")).where("cell is not null")
            .select("half", "cell", (F.col("cell") == F.col("own")).alias("own"), "fp"))


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints of a block pair."""
    rest, out = np.unique(fps).view(np.uint64), []  # unsigned: a bit count of signed numbers is that of their magnitude
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo:
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            out += [(x.astype(np.int64), y) for y in rest[near].astype(np.int64)]
            todo += list(rest[near])
            rest = rest[~near]
    return out


def links(fps: DataFrame, max_bits: int = MAX_BITS, cell_pairs: int = CELL_PAIRS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints ``fp`` (distinct) that
    a chain of Hamming distances <= ``max_bits`` (at most 3) connects."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves guarantee a Manhattan distance of at most 1 only up to 3 bits")
    cells = written(_cells(fps), "simhash-cells")
    size = (cells.groupBy("half", "cell").agg(F.count("*").alias("looking"), F.sum(F.col("own").cast("int")).alias("owned"))
            .where("looking > 1 and owned > 0"))
    met = written(cells.join(size, ["half", "cell"]), "simhash-met")
    few = met.where(F.col("looking") * F.col("owned") <= cell_pairs)
    a = few.select("half", "cell", "own", F.col("fp").alias("a"))
    b = few.where("own").select("half", "cell", F.col("fp").alias("b"))
    near = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits) & (~F.col("own") | (F.col("a") < F.col("b")))
    pairs = a.join(b, (a["half"] == b["half"]) & (a["cell"] == b["cell"]) & near).select("a", "b")

    def blocks(n: Column) -> Column:
        return F.ceil(n / block).cast("int")

    # a row that looks into a cell goes to its own block against all blocks of owners, and the other way round
    many = met.where(F.col("looking") * F.col("owned") > cell_pairs).select(
        "half", "cell", "own", "fp", blocks(F.col("looking")).alias("nl"), blocks(F.col("owned")).alias("no"))
    at = F.xxhash64("fp", F.lit(1))
    looking = many.select("half", "cell", F.pmod(at, F.col("nl")).alias("l"),
                          F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("o"), "fp")
    owners = many.where("own").select("half", "cell", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("l"),
                                      F.pmod(at, F.col("no")).alias("o"), "fp")

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(group["fp"].to_numpy(np.int64), max_bits), columns=["a", "b"], dtype="int64")

    rows = looking.select("half", "cell", F.col("l").cast("bigint"), F.col("o").cast("bigint"), "fp").union(
        owners.select("half", "cell", F.col("l").cast("bigint"), F.col("o").cast("bigint"), "fp"))
    return pairs.union(rows.groupBy("half", "cell", "l", "o").applyInPandas(forest, "a bigint, b bigint"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: (doc_id, fp long, component_id)."""
    rows = written(small_batches(docs).select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp")),
                   "simhash")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = _with_roots(fps, max_bits)
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _with_roots(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fps`` (distinct ``fp``) with the root fingerprint of each one's component."""
    roots = written(connected_components(links(fps.select("fp"), max_bits)), "simhash-roots")
    return fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, all columns: that with the smallest id (rows without
    an id come last; one id on several texts: the smaller fingerprint, then text digest); of rows equal
    in id and text the smallest by all columns. Decided on (id, text digest), without texts."""
    rows = written(small_batches(docs).select(F.col(id_col).alias("doc_id"), F.md5(F.col(text_col)).alias("digest"),
                                              fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    cells = written(rows.groupBy("doc_id", "digest", "fp").agg(F.count("*").alias("n")), "simhash-rows")
    classes = _with_roots(cells.select("fp").distinct(), max_bits).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp", "digest", "n")
    first = cells.join(classes, "fp").groupBy("root").agg(F.min(order).alias("k"))
    kept = written(first.select("k.doc_id", "k.digest", "k.n"), "simhash-kept")

    def chosen(keys: DataFrame) -> DataFrame:
        same = docs[id_col].eqNullSafe(keys["doc_id"]) & F.md5(docs[text_col]).eqNullSafe(keys["digest"])
        return docs.join(keys, same, "left_semi")

    repeated = chosen(broadcast_if_bounded(kept.where("n > 1"), 64))
    one = repeated.groupBy(F.col(id_col), F.md5(F.col(text_col))).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return chosen(kept.where("n = 1")).unionByName(one)
