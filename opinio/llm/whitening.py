"""Embedding whitening by QDWH spectral divide-and-conquer.

Vectors are whitened over the *fit list*, each distinct vector once: centred, projected on the
leading eigenvectors of the covariance V (divisor n) and divided by the square roots of their
eigenvalues.

1. Distinct vectors are found by one shuffle of the vectors (map-side duplicates go first,
   so a vector that a third of all rows hold costs a row a task) and written.
2. Tasks add up counts and exact integer sums per dimension; a second pass adds up the
   products of the centred vectors. Only d * d sums reach the driver (d dimensions, checked against
   ``MAX_DIMENSIONS``).
3. The driver splits V. The polar factor of V - shift, by the QR- and Cholesky-based dynamically
   weighted Halley iteration (QDWH), has the eigenvalues 1 and -1; half of it plus half of the
   identity is the projector on the eigenvectors above the shift. Orthonormal bases of its
   range and of the rest give two smaller symmetric matrices, split in turn until one dimension
   is left or all eigenvalues agree to rounding. The shift is the mean eigenvalue,
   which lies between them; if it meets one, the projector shows it and the shift is moved.
   Subspaces beyond the asked components are not split.
4. Sums, axes and scales (small) go to the tasks with the function that projects the
   rows; no row is shuffled again. ``identity_error`` comes from one more pass over the fit list.

Edge cases: null vectors and those that hold null, NaN or infinite entries take no part; nor do those
of another length than most distinct vectors have (ties: the longer). Repeated rows
and ids give their rows each. Equal eigenvalues: any orthonormal axes of their space, the same for all rows.
An axis without variance (below rounding of the largest) gives ``whitened`` 0 and does not count in
``identity_error``. An empty table gives an empty result. ``deviation`` is exact, null where it
exceeds a long. Other columns, also those named like the result's, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinio.llm.common import written

COMPONENTS = 16
MAX_DIMENSIONS = 4096
#: Entries become floor(SCALE * entry) + OFFSET.
SCALE = 64
OFFSET = 1_000_000
_EPS = np.finfo(float).eps
_SHIFTS = (0.0, 0.03, -0.03, 0.11, -0.11, 0.23, -0.23, 0.37, -0.37)
_ROWS = 2048

SCHEMA = ("component int, n bigint, deviation bigint, whitened double, explained double")


# ---- dense symmetric matrices on the driver -----------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of symmetric ``a``, by QDWH."""
    d = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / (np.sqrt(d) * np.linalg.norm(np.linalg.inv(x), 1))
    except np.linalg.LinAlgError:
        low = _EPS
    low = min(1.0, max(low, _EPS))  # a lower bound of the smallest singular value
    eye = np.eye(d)
    for _ in range(60):
        root = np.cbrt(4 * (1 - low**2) / low**4)
        wa = np.sqrt(1 + root) + 0.5 * np.sqrt(8 - 4 * root + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, eye)))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:d] @ q[d:].T
        else:
            factor = np.linalg.cholesky(eye + wc * x.T @ x)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        new = (new + new.T) / 2
        step = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        if step <= np.cbrt(_EPS) * 1e-2 and 1 - low < 1e-12:
            break
    return x


def _range(projector: np.ndarray, rank: int, draw: np.random.Generator) -> np.ndarray:
    basis = draw.standard_normal((len(projector), rank))
    for _ in range(3):
        basis, _ = np.linalg.qr(projector @ basis)
    return basis


def _split(a: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """Orthonormal columns, the first ``k`` of which span the eigenvectors of the larger
    eigenvalues; None if no shift parts them (they agree to rounding)."""
    d = len(a)
    mean = np.trace(a) / d
    spread = np.linalg.norm(a - mean * np.eye(d)) / np.sqrt(d)
    for share in _SHIFTS:
        sign = polar_factor(a - (mean + share * spread) * np.eye(d))
        rank = round((np.trace(sign) + d) / 2)
        if 0 < rank < d and np.linalg.norm(sign @ sign - np.eye(d)) < 1e-10 * d:
            above = _range((np.eye(d) + sign) / 2, rank, draw)
            below = _range((np.eye(d) - sign) / 2, d - rank, draw)
            basis, upper = np.linalg.qr(np.hstack((above, below)))
            return basis * np.sign(np.diag(upper)), rank
    return None


def eigenvectors(v: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of symmetric ``v``, the ``wanted`` first."""
    wanted = len(v) if wanted is None else min(wanted, len(v))
    draw, size = np.random.default_rng(7), np.linalg.norm(v)
    found: list[np.ndarray] = []

    def divide(a: np.ndarray, basis: np.ndarray) -> None:
        if len(found) >= wanted:
            return
        parts = None
        if len(a) > 1 and np.linalg.norm(a - np.trace(a) / len(a) * np.eye(len(a))) > 4 * _EPS * size:
            parts = _split(a, draw)
        if parts is None:
            found.extend(basis.T)
            return
        for half in (parts[0][:, :parts[1]], parts[0][:, parts[1]:]):
            inner = half.T @ a @ half
            divide((inner + inner.T) / 2, basis @ half)

    divide(v, np.eye(len(v)))
    axes = np.array(found).reshape(-1, len(v)).T
    axes = axes / np.linalg.norm(axes, axis=0)
    values = np.einsum("ij,ik,kj->j", axes, v, axes)
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], axes[:, order]


# ---- passes over the vectors ---------------------------------------------------

def whole_vectors(rows: DataFrame, vector: str, *keep: str) -> DataFrame:
    """``keep`` and ``x`` (array<bigint>: floor(SCALE * entry) + OFFSET) of the rows
    whose vector holds finite entries only."""
    entries = F.col(vector).cast("array<double>")
    bad = F.exists(entries, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = F.transform(entries, lambda e: F.floor(e * F.lit(float(SCALE))) + F.lit(OFFSET))
    return rows.where(F.col(vector).isNotNull() & ~bad).select(*keep, x.alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Whitener:
    """n, exact sums S, axes (columns), eigenvalues and the trace of V."""

    n: int
    sums: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def d(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the integer part is taken off exactly first."""
        return (x - self.sums // self.n) - (self.sums % self.n) / self.n

    def positive(self) -> np.ndarray:
        if not len(self.values):
            return np.zeros(0, dtype=bool)
        return self.values > self.d * _EPS * max(self.values[0], 0.0)

    def project(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.positive(), 1 / np.sqrt(np.where(self.positive(), self.values, 1.0)), 0.0)
        return self.centred(x) @ self.axes * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2, exact."""
        largest = int(np.abs(x).max(initial=0)) * self.n + int(np.abs(self.sums).max(initial=0))
        if largest < 1 << 62:
            off = x * self.n - self.sums
            if self.d * int(np.abs(off).max(initial=0)) ** 2 < 1 << 63:
                return (off * off).sum(axis=1).tolist()
        exact = x.astype(object) * self.n - self.sums.astype(object)
        return [v if v < 1 << 63 else None for v in map(int, (exact * exact).sum(axis=1))]


def _products(rows: DataFrame, d: int, part) -> np.ndarray:
    """Sum over all rows of ``part(x).T @ part(x)``: each task emits its upper triangle once."""
    def sums(batches):
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for i in range(0, len(x), _ROWS):
                z = part(x[i:i + _ROWS])
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    got = rows.select("x").mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((int(got["i"].max()) + 1,) * 2) if len(got) else np.zeros((0, 0))
    out[got["i"], got["j"]] = got["v"]
    return np.triu(out) + np.triu(out, 1).T


def fit(vectors: DataFrame, components: int = COMPONENTS) -> tuple[Whitener, float] | None:
    """The whitener of the distinct ``x`` of ``vectors`` and its identity error (largest absolute entry of
    the whitened fit list's covariance minus the identity); None without vectors."""
    distinct = written(vectors.select("x").distinct(), "whitening-fit")
    lengths = distinct.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return None
    d, n = lengths["d"], lengths["count"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions: the covariance of more than {MAX_DIMENSIONS} does not go to the driver")
    fit_list = distinct.where(F.size("x") == d)

    def totals(batches):
        total = np.zeros(d, dtype=np.int64)
        for batch in batches:
            total += _matrix(batch.column(0), d).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(total)], ["i", "s"])

    rows = fit_list.mapInArrow(totals, "i int, s bigint").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    whitener = Whitener(n, np.array([r["s"] for r in rows], dtype=np.int64), np.zeros((d, 0)), np.zeros(0), 0.0)
    v = _products(fit_list, d, whitener.centred) / n
    values, axes = eigenvectors(v, components)
    whitener = Whitener(n, whitener.sums, axes, values, float(np.trace(v)))
    own = whitener.positive()
    if not own.any():
        return whitener, 0.0
    spread = _products(fit_list, d, lambda x: np.hstack((whitener.project(x)[:, own], np.ones((len(x), 1))))) / n
    covariance = spread[:-1, :-1] - np.outer(spread[-1, :-1], spread[-1, :-1])
    return whitener, float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(rows: DataFrame, whitener: Whitener, key: str) -> DataFrame:
    """(key, component, n, deviation, whitened, explained) of every row of (key, x) and component."""
    d, c = whitener.d, len(whitener.values)
    share = whitener.values / whitener.trace if whitener.trace > 0 else np.zeros(c)

    def project(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, _ROWS):
                part = batch.slice(i, _ROWS)
                x = _matrix(part.column(1), d)
                places = pa.array(np.repeat(np.arange(len(x)), c))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(places), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * c, whitener.n)), pa.array(whitener.deviations(x), pa.int64()).take(places),
                     pa.array(whitener.project(x).ravel()), pa.array(np.tile(share, len(x)))],
                    ["key", "component", "n", "deviation", "whitened", "explained"])

    kind = rows.schema[key].dataType.simpleString()
    own = rows.where(F.size("x") == d).select(F.col(key).alias("key"), "x")
    return own.mapInArrow(project, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def fit_and_whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a whole vector."""
    vectors = whole_vectors(rows, vector, key)
    fitted = fit(vectors, components)
    if fitted is None:
        kind = rows.schema[key].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"{key} {kind}, {SCHEMA}, identity_error double")
    return whiten(vectors, fitted[0], key).withColumn("identity_error", F.lit(fitted[1]))
