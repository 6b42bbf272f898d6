"""Whitening of vectors by principal components, fitted in mixed precision.

The fit list is each distinct whole-numbered vector once. Its size and sums are exact; so is its covariance, since
vectors are centred at the nearest whole mean before they are multiplied, and what that leaves of the mean is taken off in
whole numbers too (n*G - r*r', over n*n). Tasks sum products of the rows that they hold, Spark adds the tasks' sums up,
and only a matrix of dims x dims comes to the driver.

There, eigenvectors start in float32 and are corrected by the refinement of Ogita and Aishima: with X the vectors,
R = I - X'X and S = X'VX, the correction E has (s_ij + l_j r_ij) / (l_j - l_i) for eigenvalues l that are apart, r_ij / 2
for others, and X grows to X + XE. Products are float64 and, in the last rounds, long double. Eigenvalues too close to
tell apart form clusters; a cluster's directions are turned by a solve of its own small matrix, shifted by the
cluster's mean, so that its own differences aren't lost against the whole; then the refinement goes on. Equal
eigenvalues stay a cluster, and any basis of it is right.

Cases: a row whose vector is null or empty, or holds a null or non-finite component or one beyond MOST after scaling,
takes no part; all others are answered, repeated ones and those without an id too. Vectors of each length are whitened
apart. Components without variance (below RANK of the largest) can't be scaled to one and are left out, so a single
distinct vector gives no rows. A deviation beyond a long is null. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

#: Components after scaling are below this in size.
MOST = 1 << 40
#: Rounds of refinement in float64, at most, and then in long double.
ROUNDS, LAST_ROUNDS = 12, 2
#: Of the largest eigenvalue: what counts as none.
RANK = 1e-13
#: Numbers of a batch in a task.
AT_ONCE = 1 << 20


@dataclass
class Whitening:
    """The fit for vectors of one length: n distinct ones, whole sums, unit components in columns with their eigenvalues."""

    dims: int
    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, v: np.ndarray) -> np.ndarray:
        """v - mean, with the mean's whole part taken off in whole numbers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (v - whole).astype(np.float64) - np.array([s % self.n / self.n for s in self.sums])

    def whitened(self, v: np.ndarray) -> np.ndarray:
        return self.centred(v) @ self.components / np.sqrt(self.eigenvalues)

    def deviations(self, v: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n*v - sum)^2, exactly."""
        whole, rest = (np.array([f(s, self.n) for s in self.sums], np.int64) for f in (int.__floordiv__, int.__mod__))
        off = v - whole
        if (int(np.abs(off).max(initial=0)) * self.n + self.n) ** 2 * self.dims < 2**63:
            return ((off * self.n - rest) ** 2).sum(1).tolist()
        exact = ((off.astype(object) * self.n - rest.astype(object)) ** 2).sum(1)
        return [x if x < 2**63 else None for x in exact.tolist()]


# Eigenvectors


def corrected(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[list[int]], float]:
    """One step: better vectors, their eigenvalues, clusters of eigenvalues too close to be told apart, and how much
    the step changed."""
    r, s = np.eye(x.shape[1], dtype=x.dtype) - x.T @ x, x.T @ (v @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    size = lambda m: float(np.sqrt((m * m).sum()))
    apart = 2 * (size(s - np.diag(values)) + float(np.abs(values).max(initial=0)) * size(r))
    gap = values[None, :] - values[:, None]
    far = np.abs(gap) > max(apart, float(np.finfo(x.dtype).eps) * float(np.abs(values).max(initial=0)))
    e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
    order = np.argsort(-values, kind="stable")
    clusters, now = [], [int(order[0])]
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        if far[a, b]:
            clusters.append(now)
            now = []
        now.append(b)
    clusters.append(now)
    return x + x @ e, values, [sorted(c) for c in clusters if len(c) > 1], size(e)


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Columns that nearly are orthonormal, made so."""
    for _ in range(2):
        x = x + x @ (np.eye(x.shape[1], dtype=x.dtype) - x.T @ x) / 2
    return x


def solved_inside(v: np.ndarray, x: np.ndarray, values: np.ndarray, cluster: list[int]) -> np.ndarray:
    """The cluster's directions, turned by the eigenvectors of its own matrix around the cluster's mean."""
    q = orthonormal(x[:, cluster])
    mean = values[cluster].mean()
    small = q.T @ (v @ q - mean * q)
    small = (small + small.T) / 2
    top = np.abs(small).max()
    if not top:
        return q
    _, turn = np.linalg.eigh((small / top).astype(np.float64))
    return q @ orthonormal(turn[:, ::-1].astype(x.dtype))


def refined_eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors in columns) of a symmetric matrix, by falling eigenvalue."""
    scale = np.abs(v).max(initial=0)
    if not scale:
        return np.zeros(len(v)), np.eye(len(v))
    _, x = np.linalg.eigh((v / scale).astype(np.float32))
    for kind, rounds, enough in ((np.float64, ROUNDS, 1e-13), (np.longdouble, LAST_ROUNDS, 0.0)):
        m, x, before = (v / scale).astype(kind), x.astype(kind), np.inf
        for _ in range(rounds):
            x, values, clusters, change = corrected(m, x)
            for cluster in clusters:
                x[:, cluster] = solved_inside(m, x, values, cluster)
            if change <= enough or not clusters and change >= before:
                break
            before = change
    x = orthonormal(x)  # what rounding left between eigenvalues a rounding apart
    # Each vector's own quotient is right to twice its digits.
    values = (x * (m @ x)).sum(0) / (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    x = x * np.where(x[np.abs(x).argmax(0), np.arange(x.shape[1])] < 0, -1, 1)  # the largest entry is positive
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)


# Sums over the fit list


def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(rows, dims, matrix): runs of rows of one length."""
    for batch in batches:
        lists = batch.column("v")
        flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes = np.diff(offsets)
        for dims in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == dims)
            step = max(1, AT_ONCE // dims)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                yield batch.take(pa.array(part)), dims, flat[offsets[part][:, None] + np.arange(dims)]


def summed(fit: DataFrame, make) -> dict[int, list[tuple[int, np.ndarray]]]:
    """For each length, the sums over the fit list of make(dims, matrix), a list of arrays of numbers: each task sums
    its own rows, then Spark the tasks' by place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for _, dims, v in vectors_of(batches):
            now = make(dims, v)
            held[dims] = held[dims] + now if dims in held else now
        for dims, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dims] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["dims", "line", "values"])

    parts = fit.mapInArrow(work, "dims int, line int, values array<double>").select("dims", "line", F.posexplode("values").alias("place", "value"))
    rows = parts.groupBy("dims", "line", "place").agg(F.sum("value").alias("value")).groupBy("dims", "line").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("values"))
    out: dict[int, list] = {}
    for r in rows.select("dims", "line", "values.value").orderBy("dims", "line").collect():  # dims x dims numbers
        out.setdefault(r.dims, []).append(np.array(r.value))
    return out


def whole_rows(df: DataFrame, vector_column: str, scale: float, *keep: str) -> DataFrame:
    """The columns to keep and v, the vector in whole numbers, of rows that take part."""
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST))
    rows = df.select(*keep, F.col(vector_column).cast("array<double>").alias("e")).filter((F.size("e") > 0) & usable)
    return rows.select(*keep, F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def exact_sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length, how many vectors, and their sums by dimension, as whole numbers."""
    high = 1 << 20  # two parts of a component, each of whose sums a double holds

    def parts(dims: int, v: np.ndarray) -> np.ndarray:
        upper, lower = v // high, v % high
        return np.stack([upper.sum(0), lower.sum(0), np.full(dims, len(v))]).astype(np.float64)

    return {dims: (int(n[0]), [int(a) * high + int(b) for a, b in zip(upper, lower, strict=True)]) for dims, (upper, lower, n) in summed(fit, parts).items()}


def fit_whitening(fit: DataFrame, most: int) -> list[Whitening]:
    """The fits, one for each length, of a table of distinct whole-numbered vectors v."""
    sums = exact_sums(fit)
    middle = {d: np.array([(2 * s + n) // (2 * n) for s in t], np.int64) for d, (n, t) in sums.items()}

    def products(dims: int, v: np.ndarray) -> np.ndarray:
        y = (v - middle[dims]).astype(np.float64)
        return y.T @ y

    fits = []
    for dims, lines in summed(fit, products).items():
        n, total = sums[dims]
        rest = [s - n * int(m) for s, m in zip(total, middle[dims], strict=True)]
        whole = np.array([[n * int(g) - a * b for g, b in zip(line, rest, strict=True)] for line, a in zip(lines, rest, strict=True)], object)
        v = np.array([[x / (n * n) for x in line] for line in whole], np.float64)  # of whole numbers, rounded once
        values, vectors = refined_eigen(v)
        keep = np.flatnonzero(values > RANK * max(values.max(initial=0), 0))[:most]
        fits.append(Whitening(dims, n, total, vectors[:, keep], values[keep], float(np.trace(v))))
    return with_errors(fit, [f for f in fits if len(f.eigenvalues)])


def with_errors(fit: DataFrame, fits: list[Whitening]) -> list[Whitening]:
    """The fits with the largest entry of their whitened vectors' covariance minus the identity, measured on the fit list."""
    by = {f.dims: f for f in fits}
    first = lambda d, v: by[d].whitened(v).sum(0)[None, :] if d in by else np.zeros((0, 0))
    means = {d: lines[0] / by[d].n for d, lines in summed(fit, first).items()}

    def products(dims: int, v: np.ndarray) -> np.ndarray:
        if dims not in by:
            return np.zeros((0, 0))
        w = by[dims].whitened(v) - means[dims]
        return w.T @ w

    for dims, lines in summed(fit, products).items():
        f = by[dims]
        f.identity_error = float(np.abs(np.stack(lines) / f.n - np.eye(len(f.eigenvalues))).max())
    return fits


def whiten(df: DataFrame, components: int = 16, scale: float = 64.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): of every row, its first whitened components,
    numbered from 1."""
    with Scratch(df.sparkSession, "whitening") as s:
        fit = s.write(whole_rows(df, vector_column, scale).select("v").distinct(), "distinct")
        fits = {f.dims: f for f in fit_whitening(fit, components)}
    kind = df.schema[id_column].dataType.simpleString()
    names = [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, dims, v in vectors_of(batches):
            if dims not in fits:
                continue
            f = fits[dims]
            k, n = len(f.eigenvalues), len(v)
            again = lambda x, t: pa.array(np.tile(x, n), t)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("id").take(pa.array(np.repeat(np.arange(n), k))),
                    again(np.arange(1, k + 1), pa.int32()),
                    pa.array(np.full(n * k, f.n), pa.int64()),
                    pa.array(f.deviations(v), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                    pa.array(f.whitened(v).ravel(), pa.float64()),
                    again(f.eigenvalues / f.trace, pa.float64()),
                    pa.array(np.full(n * k, f.identity_error), pa.float64()),
                ],
                names=names,
            )

    rows = whole_rows(df.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector")), "vector", scale, "id")
    return rows.mapInArrow(work, f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
