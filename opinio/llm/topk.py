"""Exact top-k inner-product search on a pivot-distance index.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm
(queries: 0), so that the largest inner product is the smallest distance:
|q - x|^2 = |q|^2 + M^2 - 2 q.x. Each row is keyed by its nearest pivot and its
distance to it, and range-partitioned by that key into shards of about
``SHARD`` rows (equal keys are split by id, so copies fill no shard).

A query first searches its own shard, which bounds its k-th distance r. By the
triangle inequality a row at distance d of pivot p can only be nearer if
|dist(q, p) - d| <= r; chunks of queries are joined by pivot with the rings
(shard, pivot, d range) that they may need, and each (chunk, shard) pair is a
task: it goes through the sorted annuli from the nearest on, lowers r as it
finds rows, and skips every annulus beyond r. Pivots come from a sample of
``SAMPLE`` rows (they decide the cost, never the result); all rows are indexed.

Edge cases: null vectors, vectors with a null or non-finite component (also
after scaling) and rows without id take no part; shorter vectors count as filled
with zeros; rows of a repeated id all stay (each is a candidate of the others, and a query
of its own with ranks from 1); ties go to the smaller id; scores beyond a long saturate; no rows or no queries: an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinio.llm.common import written

PIVOTS = 32
SAMPLE = 4096
SHARD = 8192
CHUNK_SHARDS = 5
ANNULUS = 256
_EXACT = float(2**53)


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id long, x array<double>): floor(scale * x) of the rows that take part."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double") * F.lit(float(scale)))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")

    floors = F.transform("x", lambda v: F.when(F.abs(v) < _EXACT, F.floor(v).cast("double")).otherwise(v))
    return rows.where(~F.coalesce(bad, F.lit(True))).select("vec_id", floors.alias("x"))


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, v in enumerate(rows):
        out[i, :len(v)] = v
    return out


def _inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64."""
    if not len(q) or not len(x) or np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT:
        return (q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q).dot(whole(x).T), -2**63, 2**63 - 1).astype(np.int64)


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.column_stack((x, last))
    return np.sqrt(np.maximum(0, (full**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * full @ pivots.T))


def _pick(x: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots."""
    chosen = [0]
    near = ((x - x[0])**2).sum(1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]])**2).sum(1))
    return x[chosen]


class _Best:
    """The k best (score, smaller id first) of each query of a chunk."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.n, self.k, self.floor = n, k, floor.copy()
        self.q, self.id, self.s = (np.empty(0, np.int64) for _ in range(3))

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray, allowed: np.ndarray) -> None:
        """scores: rows for the queries ``q``, columns for ``ids``."""
        row, col = np.nonzero((scores >= self.floor[q][:, None]) & allowed)
        self.q = np.concatenate((self.q, q[row]))
        self.id = np.concatenate((self.id, ids[col]))
        self.s = np.concatenate((self.s, scores[row, col]))
        order = np.lexsort((self.id, ~self.s, self.q))  # ~s: descending, without overflow
        self.q, self.id, self.s = self.q[order], self.id[order], self.s[order]
        count = np.bincount(self.q, minlength=self.n)
        rank = np.arange(len(self.q)) - np.repeat(np.cumsum(count) - count, count)
        kth = rank == self.k - 1
        self.floor[self.q[kth]] = np.maximum(self.floor[self.q[kth]], self.s[kth])
        keep = rank < self.k
        self.q, self.id, self.s = self.q[keep], self.id[keep], self.s[keep]


_LEAST = np.iinfo(np.int64).min


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: float = 64.0, pivots: int = PIVOTS, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): the ``k`` rows with the
    largest inner product for each row for which ``is_query`` (of vec_id) holds, itself excluded."""
    rows = scaled(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "vectors")  # row numbers stay as written
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"), F.max(square).alias("m")).first()
    dim, most = size.dim or 0, size.m or 0.0
    some = rows.orderBy(F.xxhash64("vec_id"), "row").limit(sample).toPandas()  # bounded by ``sample``

    def lift(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, most - (x**2).sum(1)))

    base = _matrix(some["x"], dim)
    points = _pick(np.column_stack((base, lift(base))), pivots) if len(base) else np.zeros((1, dim + 1))

    @F.pandas_udf("pivot int, dist double")
    def key(xs: pd.Series) -> pd.DataFrame:
        x = _matrix(xs, dim)
        d = _distances(x, lift(x), points)
        return pd.DataFrame({"pivot": d.argmin(1).astype(np.int32), "dist": d.min(1)})

    keyed = rows.withColumn("at", key("x")).select("row", "vec_id", "x", "at.pivot", "at.dist")
    shards = max(1, -(-size.n // shard))
    index = written(keyed.repartitionByRange(shards, "pivot", "dist", "row")
                    .withColumn("shard", F.spark_partition_id()), "index")

    def reach(q: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Distance beyond which no row scores ``floor`` or more (some slack for rounding)."""
        norms = (q**2).sum(1)
        with np.errstate(invalid="ignore", over="ignore"):
            r = np.sqrt(np.maximum(0, norms + most - 2.0 * floor)) * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(norms + most))
        return np.where(floor == _LEAST, np.inf, r)

    def seed(group: pd.DataFrame) -> pd.DataFrame:
        """The queries of a shard with the bounds that their own shard gives."""
        x, ids, row = _matrix(group["x"], dim), group["vec_id"].to_numpy(), group["row"].to_numpy()
        own = np.flatnonzero(group["query"].to_numpy(bool))
        best = _Best(len(own), k, np.full(len(own), _LEAST))
        for lo in range(0, len(x), ANNULUS * 4):
            part = slice(lo, lo + ANNULUS * 4)
            _add(best, np.arange(len(own)), x[own], row[own], x[part], ids[part], row[part])
        r = reach(x[own], best.floor)[:, None]
        d = _distances(x[own], np.zeros(len(own)), points)
        lists = {n: pd.Series(list(v), dtype="object") for n, v in (("x", x[own]), ("low", d - r), ("high", d + r))}
        return pd.DataFrame({"query_row": row[own], "query_id": ids[own], "x": lists["x"], "floor": best.floor, "low": lists["low"],
                             "high": lists["high"], "chunk": group["shard"].to_numpy()[own] // CHUNK_SHARDS})

    asked = index.withColumn("query", F.coalesce(is_query, F.lit(False)))
    queries = written(asked.groupBy("shard").applyInPandas(
        seed, "query_row bigint, query_id bigint, x array<double>, floor bigint, low array<double>, high array<double>, chunk int"), "queries")
    rings = index.groupBy("shard", "pivot").agg(F.min("dist").alias("from"), F.max("dist").alias("to"))
    needs = (queries.select("chunk", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "b"))
             .groupBy("chunk", "pivot").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high")))
    pairs = written(rings.join(needs, "pivot").where("not (from > high) and not (to < low)")
                    .select("chunk", "shard").distinct(), "pairs")

    def expand(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """One chunk of queries against one shard, annulus by annulus."""
        q, qids, qrows = _matrix(asked["x"], dim), asked["query_id"].to_numpy(), asked["query_row"].to_numpy()
        best = _Best(len(q), k, asked["floor"].to_numpy(np.int64))
        held = held.sort_values(["pivot", "dist"])
        x, ids, row = _matrix(held["x"], dim), held["vec_id"].to_numpy(), held["row"].to_numpy()
        pivot, dist = held["pivot"].to_numpy(), held["dist"].to_numpy()
        to_pivot = _distances(q, np.zeros(len(q)), points)
        cuts = [0, *(np.flatnonzero(np.diff(pivot)) + 1), len(x)]
        rings = [(i, min(i + ANNULUS, b)) for a, b in zip(cuts[:-1], cuts[1:]) for i in range(a, b, ANNULUS)]
        gaps = [np.maximum(dist[a] - to_pivot[:, pivot[a]], to_pivot[:, pivot[a]] - dist[b - 1]) for a, b in rings]
        for gap, (a, b) in sorted(zip(gaps, rings), key=lambda g: (g[0].min(initial=np.inf), g[1])):
            near = np.flatnonzero(~(gap > reach(q, best.floor)))
            if len(near):
                _add(best, near, q[near], qrows[near], x[a:b], ids[a:b], row[a:b])
        return pd.DataFrame({"query_row": qrows[best.q], "query_id": qids[best.q], "vec_id": best.id, "score": best.s})

    left = queries.join(pairs, "chunk").select("chunk", "shard", "query_row", "query_id", "x", "floor")
    right = index.join(pairs, "shard").select("chunk", "shard", "row", "vec_id", "x", "pivot", "dist")
    found = (left.groupBy("chunk", "shard").cogroup(right.groupBy("chunk", "shard"))
             .applyInPandas(expand, "query_row bigint, query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _add(best: _Best, at: np.ndarray, q: np.ndarray, qrows: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    best.add(at, ids, _inner(q, x), qrows[:, None] != rows)  # a query row is no candidate of its own
