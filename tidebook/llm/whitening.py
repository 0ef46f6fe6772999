"""Whitening of embeddings by refined eigenvectors of their covariance.

Entries are put on a grid, ``x = floor(256 * c)`` as whole numbers, so sums and distances are exact. The fit list holds each
distinct vector once. Its covariance is summed by Spark, row by row of the matrix; what reaches the driver is one matrix of the vectors' length squared,
whatever the number of rows.

Eigenvectors. A single-precision solver gives a first guess. ``refined`` corrects it by matrix products only, in
double and at last in extended precision (the iteration of Ogita and Aishima): with R = I - X'X, S = X'AX and l = S_ii / (1 - R_ii),
X becomes X + XE, where E_ij = (S_ij + l_j R_ij) / (l_j - l_i) for eigenvalues that are further apart than the error bound d =
2(|S - diag l| + |A||R|), and R_ij / 2 for others. The error is squared by each step. Eigenvalues within d of
their neighbours form a cluster, in which that step only restores orthogonality; each cluster is then solved by itself as the small problem
X_k'(A - m)X_k, m being the mean of its eigenvalues, whose gaps are large against its norm.

Result. ``whitened`` is the centred vector projected on a unit eigenvector, over the root of its eigenvalue. The largest
difference of its covariance from the identity is measured over the fit list in one more pass, not taken for granted.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; a null key is kept; entries beyond the range of longs count as its ends;
vectors of each length are fitted by themselves (one matrix a length is kept), and an empty vector has no component and no row; repeated
rows are each returned and fitted once; equal eigenvalues get some orthonormal vectors of their space; components of no variance (up to ``FLAT`` of the trace, such as all of
a single vector) have ``whitened`` and ``explained`` 0 and are left out of ``identity_error``; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, table, written

SCALE, COMPONENTS, FLAT, STEPS, ROWS = 256.0, 4, 1e-13, 12, 4096


class Fit(NamedTuple):
    """The fit of one vector length: number and sums of its vectors, unit components as columns, their variances and the sum of all variances."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float


def clusters(values: np.ndarray, bound: float) -> list[np.ndarray]:
    """Indexes of the sets of two or more values that hang together by steps of at most ``bound``."""
    order = np.argsort(values)
    parts = np.split(order, np.flatnonzero(np.diff(values[order]) > bound) + 1)
    return [p for p in parts if len(p) > 1]


def step(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One correction in the precision of ``a``: the new vectors, eigenvalues, the bound below which these count as clustered, and the size of the correction."""
    eye = np.eye(len(a), dtype=a.dtype)
    r, s = eye - x.T @ x, x.T @ a @ x
    values = np.diag(s) / (1 - np.diag(r))
    bound = 2 * float(np.sqrt(((s - np.diag(values)) ** 2).sum()) + np.sqrt((a**2).sum()) * np.sqrt((r**2).sum()))
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > bound
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    return x + x @ e, values, bound, float(np.abs(e).max())


def refined(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of the symmetric matrix ``a`` and their unit eigenvectors as columns, from a guess in single precision."""
    size = float(np.abs(a).max()) if a.size else 0.0
    if size == 0:
        return np.zeros(len(a)), np.eye(len(a))
    a = (a + a.T) / (2 * size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    for kind, enough in ((np.float64, 1e-13), (np.longdouble, 1e-17)):
        a, x = a.astype(kind), x.astype(kind)
        for _ in range(STEPS):
            x, values, bound, moved = step(a, x)
            if moved < enough:
                break
            for k in clusters(values, bound):
                inner = x[:, k].T @ (a @ x[:, k] - values[k].mean() * x[:, k])
                x[:, k] = x[:, k] @ np.linalg.eigh((inner + inner.T).astype(np.float64) / 2)[1]
    for _ in range(2):  # the last corrections restore orthogonality alone
        x = x + x @ (np.eye(len(a), dtype=x.dtype) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return (values[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def grid(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the indexes of the usable vectors of that length and their entries as whole numbers."""
    if pa.types.is_large_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        flat = column.take(pa.array(at)).flatten()
        v = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
        good = np.isfinite(v).all(axis=1)
        v = np.floor(SCALE * v[good])
        x = np.clip(v, -(2.0**63), 2.0**63 - 1025).astype(np.int64)
        x[v >= 2.0**63] = np.iinfo(np.int64).max
        yield at[good], x


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in the fewest bytes an entry that hold all its entries, after one byte that says how many; equal for equal rows only."""
    out: list[bytes] = [b""] * len(x)
    need = np.zeros(len(x), np.int64)
    for k, kind in enumerate((np.int8, np.int16, np.int32)):
        info = np.iinfo(kind)
        need += (x.min(axis=1) < info.min) | (x.max(axis=1) > info.max)
    for k, kind in enumerate("bhiq"):
        rows = np.flatnonzero(need == k)
        for i, row in zip(rows.tolist(), x[rows].astype(f"<{kind}")):
            out[i] = kind.encode() + row.tobytes()
    return out


def unpacked(rows: pa.Array) -> Iterator[np.ndarray]:
    """The matrices of whole numbers in a column of ``packed`` rows, by length."""
    groups: dict[tuple[int, int], list[bytes]] = {}
    for r in rows.to_pylist():
        groups.setdefault((r[0], len(r)), []).append(r)
    for (kind, _), found in groups.items():
        yield np.stack([np.frombuffer(r, f"<{chr(kind)}", offset=1) for r in found]).astype(np.int64)


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums, exact at any size."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(l) for h, l in zip(high.sum(axis=0), low.sum(axis=0))]


def fit_list(df: DataFrame, vector: str) -> DataFrame:
    """Rows ``(x)``: each distinct vector of whole numbers once, packed. Copies are dropped before the shuffle and again after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for _, x in grid(batch.column(0)) for r in packed(x)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["x"])

    return df.select(F.col(vector).alias("__v")).transform(bounded).mapInArrow(run, "x binary").distinct()


def sums(points: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number and exact column sums of the vectors of each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for x in unpacked(batch.column(0)):
                n, s = total.get(x.shape[1], (0, [0] * x.shape[1]))
                total[x.shape[1]] = (n + len(x), [a + b for a, b in zip(s, exact_sums(x))])
        for dim, (n, s) in total.items():
            columns = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([Decimal(v) for v in s], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["dim", "i", "n", "s"])

    found = points.mapInArrow(run, "dim int, i int, n long, s decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(found.collect()):  # one row a dimension, not one a vector
        out.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))
    return out


def mean_of(n: int, total: list[int]) -> np.ndarray:
    """The means as doubles, each rounded once."""
    return np.array([s / n for s in total])


def added(parts: DataFrame, width: str) -> DataFrame:
    """Sums of the arrays ``row`` (little-endian doubles) by ``(dim, i)``, each key in one task of its own share; memory is one matrix at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, i, row in zip(*(batch.column(c).to_pylist() for c in ("dim", "i", "row"))):
                v = np.frombuffer(row)
                total[dim, i] = total[dim, i] + v if (dim, i) in total else v
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k].tobytes() for k in keys], pa.binary())], names=["dim", "i", "row"])

    return parts.repartition(width).mapInArrow(run, "dim int, i int, row binary") if width == "dim" else parts.repartition("dim", width).mapInArrow(run, "dim int, i int, row binary")


def matrices(rows: DataFrame) -> dict[int, np.ndarray]:
    """The matrix of each length from its rows."""
    found: dict[int, list[tuple[int, bytes]]] = {}
    for r in rows.collect():  # the rows of one matrix a length
        found.setdefault(r["dim"], []).append((r["i"], bytes(r["row"])))
    return {dim: np.stack([np.frombuffer(row) for _, row in sorted(parts)]) for dim, parts in found.items()}


def scatter(points: DataFrame, totals: dict[int, tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """The covariance of each length: centred in double precision, multiplied, summed over all vectors and divided by their number."""
    means = {dim: mean_of(n, s) for dim, (n, s) in totals.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in unpacked(batch.column(0)):
                c = x - means[x.shape[1]]
                total[x.shape[1]] = total.get(x.shape[1], 0.0) + c.T @ c
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in m], pa.binary())], names=["dim", "i", "row"])

    found = matrices(added(points.mapInArrow(run, "dim int, i int, row binary"), "i"))
    return {dim: m / totals[dim][0] for dim, m in found.items()}


def projected(x: np.ndarray, fit: Fit) -> np.ndarray:
    """Whitened vectors, one column a component; 0 where a component has no variance."""
    flat = fit.variances <= FLAT * fit.trace
    out = (x - mean_of(fit.n, fit.sums)) @ fit.axes
    return np.where(flat, 0.0, out / np.sqrt(np.where(flat, 1.0, fit.variances)))


def identity_errors(points: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """The largest entry of the whitened fit list's covariance minus the identity, by length; tasks centre by their own means, which are merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in unpacked(batch.column(0)):
                w = projected(x, fits[x.shape[1]])
                mean = w.mean(axis=0)
                parts = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([0], pa.int32()), pa.array([parts.tobytes()], pa.binary())], names=["dim", "i", "row"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dim, row in zip(batch.column("dim").to_pylist(), batch.column("row").to_pylist()):
                k, v = fits[dim].axes.shape[1], np.frombuffer(row)
                n, mean, m = v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k)
                if dim in held:
                    n0, mean0, m0 = held[dim]
                    d = mean - mean0
                    n, mean, m = n0 + n, mean0 + d * (n / (n0 + n)), m0 + m + np.outer(d, d) * (n0 * n / (n0 + n))
                held[dim] = (n, mean, m)
        for dim, (n, mean, m) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([0], pa.int32()), pa.array([np.concatenate([[n], mean, m.ravel()]).tobytes()], pa.binary())], names=["dim", "i", "row"])

    kind = "dim int, i int, row binary"
    # merged once in every task of the scan, then by length: a length's group has one small row a task
    found = points.mapInArrow(run, kind).mapInArrow(merge, kind).repartition("dim").mapInArrow(merge, kind)
    out = {}
    for r in found.collect():  # one row a length
        fit, v = fits[r["dim"]], np.frombuffer(bytes(r["row"]))
        k = fit.axes.shape[1]
        use = fit.variances > FLAT * fit.trace
        cov = v[1 + k :].reshape(k, k)[np.ix_(use, use)] / v[0]
        out[r["dim"]] = float(np.abs(cov - np.eye(len(cov))).max(initial=0.0))
    return out


def deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """The sum of (n x - S)^2 of each row, exact: n^2 xx - 2n xS + SS, whose dot products are whole numbers."""
    n, s = fit.n, fit.sums
    most, widest = int(max(x.max(initial=0), -int(x.min(initial=0)))), max(map(abs, s))
    square = sum(v * v for v in s)
    if x.shape[1] * most * max(most, widest) < 2**63:
        own, cross = np.einsum("ij,ij->i", x, x), x @ np.array(s, np.int64)
        return [n * n * a - 2 * n * b + square for a, b in zip(own.tolist(), cross.tolist())]
    return [sum((n * a - b) ** 2 for a, b in zip(row, s)) for row in x.tolist()]


def fitted(points: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length, from the fit list."""
    totals = sums(points)
    out = {}
    for dim, v in scatter(points, totals).items():
        values, axes = refined(v)
        out[dim] = Fit(*totals[dim], axes[:, :components], np.maximum(values[:components], 0.0), float(np.trace(v)))
    return out


def whitened(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Rows ``(key, component, n, deviation, whitened, explained, identity_error)`` of every usable vector and its first ``components``.

    ``deviation`` is a decimal of 38 digits (null beyond them).
    """
    points = written(fit_list(df, vector), "fit")
    fits = fitted(points, components)
    errors = identity_errors(points, fits)
    schema = pa.schema([("__key", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                for at, x in grid(batch.column("__v")):
                    if not len(at):
                        continue
                    fit = fits[x.shape[1]]
                    k, rows = fit.axes.shape[1], len(x)
                    deviation = [Decimal(v) if v < 10**38 else None for v in deviations(x, fit)]
                    share = np.where(fit.variances > FLAT * fit.trace, fit.variances / max(fit.trace, 1e-300), 0.0)
                    columns = [
                        batch.column("__key").take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                        pa.array(np.full(rows * k, fit.n)), pa.array([d for d in deviation for _ in range(k)], pa.decimal128(38, 0)),
                        pa.array(projected(x, fit).ravel()), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, errors[x.shape[1]])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    rows = df.select(F.col(key).cast("long").alias("__key"), F.col(vector).alias("__v")).where("__v IS NOT NULL")
    out = rows.transform(bounded).mapInArrow(run, "__key long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("__key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings; a deviation beyond longs is null."""
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
