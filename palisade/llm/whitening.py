"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers x = floor(scale * c). The fit list holds every distinct vector once; n and the sums S are exact. Rows are
centred exactly, as (n * x - S) / n with the division last, and never stored: every pass reads the fit list, centres a block, solves
it against the triangular factors found so far and adds up its Gram matrix. The first factor is the Cholesky factor of the Gram
matrix plus a small multiple of the identity, so that it exists however ill-conditioned the vectors are; the next passes
orthogonalise again until the Gram matrix is the identity on the span of the vectors. The factors' product R holds all that the
covariance does (V = R'R / n): its singular value decomposition gives the components and their eigenvalues without squaring the
condition of the vectors. A Gram matrix is as large as the vectors are long, whatever the number of rows; a task sends one, and
they are added up 16 at a time in the order of the tasks, so reruns over the same partitions agree.

The error reported is measured: a last pass takes the covariance of the whitened fit list.

Vectors that are null or hold null or non-finite entries take no part. Entries beyond 64 bits are held at the end of that range, as
is a deviation. Vectors of each length are fitted on their own. A component without variance (all vectors equal in its direction,
up to rounding) has no scale: its whitened value is null, its share 0 (null when no component varies). Vectors without entries
have no components and so no rows. Equal vectors count once in the fit and get a row each, as do repeated and null ids. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import cut_lineage

FAN_IN = 16
BLOCK = 4 << 20  # bytes of vectors that a task holds as a matrix
ROUNDS = 12
LOW, HIGH = -(2**63), 2**63 - 1


@dataclass
class Fit:
    """Size and sums of the fit list, and per component its direction, eigenvalue and share of the variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    rounds: int
    error: float | None = None

    @property
    def varies(self) -> np.ndarray:
        return self.eigenvalues > 0

    def projector(self) -> np.ndarray:
        """Centred rows times this are the whitened values; 0 where nothing varies."""
        scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.eigenvalues, 1)), 0)
        return self.directions * scale


def integral(rows: DataFrame, embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The valid rows with ``x``, their vector in integers."""
    entry = lambda c: c.cast("double")
    odd = lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf"))
    valid = rows.where(F.col(embedding).isNotNull() & ~F.exists(embedding, odd))
    return valid.withColumn("x", F.transform(embedding, lambda c: F.floor(F.lit(scale) * entry(c)).cast("bigint")))


def blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    step = max(1, BLOCK // (8 * dim))
    for a in range(0, batch.num_rows, step):
        part = batch.slice(a, step)
        yield part, np.asarray(pc.list_flatten(part.column("x"))).reshape(-1, dim)


def scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in 64 bits if they suffice, else in Python integers."""
    most = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))))
    if n * most + max(map(abs, sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return scaled(x, n, sums).astype(np.float64) / n


def added(partial: DataFrame, size: int) -> np.ndarray:
    """Sum of the matrices (part, data) of ``size`` numbers, 16 at a time, in the order of the parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, np.zeros(size)
        for batch in batches:
            for i, data in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if part not in (None, i // FAN_IN):
                    yield _row(part, total)
                    total = np.zeros(size)
                part = i // FAN_IN
                total = total + np.frombuffer(data.as_py(), "<f8")
        if part is not None:
            yield _row(part, total)

    parts = partial.sparkSession.sparkContext.defaultParallelism
    while True:
        partial = cut_lineage(partial)
        last = partial.agg(F.max("part")).first()[0]
        if last is None:
            return np.zeros(size)
        if last < FAN_IN:
            break
        dealt = partial.withColumn("_g", F.floor(F.col("part") / FAN_IN)).repartition(min(parts, last // FAN_IN + 1), "_g")
        partial = dealt.sortWithinPartitions("_g", "part").select("part", "data").mapInArrow(add, "part int, data binary")
    # At most FAN_IN matrices, the size of each fixed by the vectors' length.
    rows = sorted(partial.collect(), key=lambda r: r.part)
    return sum((np.frombuffer(bytes(r.data), "<f8") for r in rows), np.zeros(size))


def _row(part: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "data": pa.array([values.astype("<f8").tobytes()], pa.binary())})


def gram_pass(fit_list: DataFrame, dim: int, columns: int, rows_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Gram matrix of the rows that ``rows_of`` makes of blocks of the fit list, summed over all tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((columns, columns))
        for batch in batches:
            for _, x in blocks(batch, dim):
                y = rows_of(x)
                total += y.T @ y
        yield _row(TaskContext.get().partitionId(), total.ravel())

    return added(fit_list.select("x").mapInArrow(task, "part int, data binary"), columns * columns).reshape(columns, columns)


def exact_sums(fit_list: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number and sums of the vectors: high and low halves are added apart, so no sum leaves 64 bits."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dim, np.int64), np.zeros(dim, np.int64)
        for batch in batches:
            for _, x in blocks(batch, dim):
                n, high, low = n + len(x), high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0)
        yield pa.RecordBatch.from_pydict({"place": np.arange(dim), "n": np.full(dim, n), "high": high, "low": low})

    found = fit_list.select("x").mapInArrow(task, "place bigint, n bigint, high bigint, low bigint")
    rows = found.groupBy("place").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("place").collect()
    return (rows[0].n if rows else 0), [(r.high << 32) + r.low for r in rows]


def qr_factor(fit_list: DataFrame, n: int, sums: list[int], tolerance: float = 1e-12) -> tuple[np.ndarray, np.ndarray, int]:
    """(R, G, rounds) with centred rows = Q R and G = Q'Q, which is the identity on the rows' span."""
    dim = len(sums)
    factors: list[np.ndarray] = []

    def rows_of(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums)
        for f in factors:
            y = np.linalg.solve(f.T, y.T).T
        return y

    r = np.eye(dim)
    for done in range(ROUNDS):
        gram = gram_pass(fit_list, dim, dim, rows_of)
        size = np.linalg.eigvalsh(gram)
        if size[-1] <= 0:
            return r, gram, done
        if done and np.all((np.abs(size - 1) < tolerance * dim) | (size < tolerance * dim)):
            return r, gram, done
        shift = 0.0 if done and size[0] > 0.5 else 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps * size[-1]
        # A direction that stays flat keeps its shift; it has no share in R.
        factors.append(np.linalg.cholesky(gram + min(shift, size[-1]) * np.eye(dim)).T)
        r = factors[-1] @ r
    return r, gram_pass(fit_list, dim, dim, rows_of), ROUNDS


def fit(fit_list: DataFrame, dim: int, components: int) -> Fit:
    n, sums = exact_sums(fit_list, dim)
    r, gram, rounds = qr_factor(fit_list, n, sums)
    # What orthogonality lacks after the last round goes into the factor: V = R' G R / n.
    value, vector = np.linalg.eigh(gram)
    _, sigma, directions = np.linalg.svd((vector * np.sqrt(np.maximum(value, 0))).T @ r)
    flat = sigma <= sigma[0] * dim * np.finfo(float).eps * 8
    eigenvalues = np.where(flat, 0, sigma**2 / max(n, 1))
    total = eigenvalues.sum()
    k = min(components, dim)
    out = Fit(n, sums, directions[:k].T, eigenvalues[:k], eigenvalues[:k] / total if total else np.full(k, np.nan), rounds)
    if out.varies.any():
        w = out.projector()[:, out.varies]
        m = w.shape[1]
        # With a column of ones the Gram matrix holds the sums, too.
        g = gram_pass(fit_list, dim, m + 1, lambda x: np.column_stack([centred(x, n, sums) @ w, np.ones(len(x))])) / n
        out.error = float(np.abs(g[:m, :m] - np.outer(g[m, :m], g[m, :m]) - np.eye(m)).max())
    return out


def applied(rows: DataFrame, dim: int, found: Fit) -> DataFrame:
    k = len(found.eigenvalues)
    w, varies = found.projector(), np.tile(found.varies, BLOCK)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in blocks(batch, dim):
                d = scaled(x, found.n, found.sums)
                if d.dtype != object and dim * int(np.abs(d).max(initial=0)) ** 2 < 2**62:
                    deviation = (d * d).sum(1)
                else:
                    deviation = np.array([min(sum(int(v) ** 2 for v in row), HIGH) for row in d], np.int64)
                z = (d.astype(np.float64) / found.n @ w).ravel()
                m = len(x)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": part.column("id").take(pa.array(np.repeat(np.arange(m), k))), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
                    "n": np.full(m * k, found.n), "deviation": np.repeat(deviation, k), "whitened": pa.array(z, mask=~varies[: m * k]),
                    "explained": pa.array(np.tile(found.explained, m), from_pandas=True),
                    "identity_error": pa.array([found.error] * (m * k), pa.float64())})

    return rows.select("id", "x").mapInArrow(
        task, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every valid row and each of its first components."""
    valid = integral(rows.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("vector")), "vector", scale).select("id", "x")
    fit_lists = cut_lineage(valid.select("x").distinct())
    out = None
    # A pass per length of vectors; a table of embeddings has one.
    for dim in sorted(r[0] for r in fit_lists.select(F.size("x")).distinct().collect() if r[0]):
        of_length = F.size("x") == dim
        one = applied(valid.where(of_length), dim, fit(fit_lists.where(of_length), dim, components))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = rows.sparkSession.createDataFrame(
            [], "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    return out
