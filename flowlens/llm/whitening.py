"""Whitening of embeddings: projection on the leading components of their covariance, each to unit variance.

Vectors become whole numbers, so sums are exact whatever the order of addition.
Tasks add up their own rows' d x d products, centred first; Spark adds the tasks'
matrices entry by entry.  The driver then holds one d x d matrix, d the length
of a vector: Householder reflections make it tridiagonal, counts of sign
changes in Sturm sequences bisect its leading eigenvalues, inverse iteration
finds their vectors, made orthogonal within clusters.  A d x k matrix goes back
to the tasks.  Nothing that grows with the rows leaves the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import cut

#: Components given for each row.
COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: A larger entry is as good as infinite: up to here the sums of a batch fit 64 bits.
LARGEST = float(1 << 33)
#: Eigenvalues up to this share of the largest count as zero: rank is lacking there, and nothing can have unit variance.
RANK = 1e-12
EPS = float(np.finfo(float).eps)


# ---------------------------------------------------------------- eigenvectors of a symmetric matrix


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder: diagonal, subdiagonal and the unit reflectors u_j (zero above place j + 1) with Q = H_0 H_1 ... and Q'AQ tridiagonal."""
    a = a.copy()
    n, reflectors = len(a), []
    for j in range(n - 2):
        x = a[j + 1 :, j]
        u = np.zeros(n)
        u[j + 1 :] = x
        u[j + 1] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(u)
        if size > 0:
            u /= size
            p = a @ u
            q = 2 * (p - (u @ p) * u)
            a -= np.outer(u, q) + np.outer(q, u)
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def counts_below(diagonal: np.ndarray, sub: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm: how many eigenvalues of the tridiagonal matrix lie below each number in ``at``."""
    tiny = EPS * max(1e-300, np.abs(diagonal).max(initial=0) + np.abs(sub).max(initial=0))
    q = diagonal[0] - at
    count = (q < 0).astype(int)
    for d, e in zip(diagonal[1:], sub):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d - at - e * e / q
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, sub: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling: all are bisected side by side between Gershgorin's bounds until their ends are neighbours."""
    n = len(diagonal)
    reach = np.zeros(n)
    reach[1:] += np.abs(sub)
    reach[:-1] += np.abs(sub)
    lo, hi = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max())
    hi += EPS * np.abs(hi) + 1e-300
    place = n - np.arange(k)  # the i-th largest has n - i - 1 eigenvalues below it
    for _ in range(200):
        middle = (lo + hi) / 2
        if np.all((middle <= lo) | (middle >= hi)):
            break
        above = counts_below(diagonal, sub, middle) < place
        lo, hi = np.where(above, middle, lo), np.where(above, hi, middle)
    return (lo + hi) / 2


def solve(diagonal: np.ndarray, sub: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a pivot of zero is taken as a tiny one."""
    n = len(diagonal)
    tiny = EPS * max(1e-300, np.abs(diagonal).max(initial=0) + np.abs(sub).max(initial=0))
    main, upper, second, x = diagonal - shift, np.append(sub, 0.0), np.zeros(n), b.copy()
    low = sub.copy()
    for i in range(n - 1):
        if abs(low[i]) > abs(main[i]):
            main[i], low[i] = low[i], main[i]
            upper[i], main[i + 1] = main[i + 1], upper[i]
            second[i], upper[i + 1] = upper[i + 1], 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        if abs(main[i]) < tiny:
            main[i] = tiny
        f = low[i] / main[i]
        main[i + 1] -= f * upper[i]
        upper[i + 1] -= f * second[i]
        x[i + 1] -= f * x[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in range(n - 1, -1, -1):
        x[i] = (x[i] - (upper[i] * x[i + 1] if i + 1 < n else 0) - (second[i] * x[i + 2] if i + 2 < n else 0)) / main[i]
        if abs(x[i]) > 1e150:  # the direction counts, not the length
            x[i:] /= abs(x[i])
            x[:i] /= 1e150
    return x


def eigenvectors(diagonal: np.ndarray, sub: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix, a column for each value (falling): inverse iteration.

    Values nearer than 1e-3 of the matrix's size are a cluster: within it each
    vector is made orthogonal to those before it in every step, and equal shifts
    are set apart by a few units in the last place.
    """
    n, norm = len(diagonal), np.abs(diagonal).max(initial=0) + 2 * np.abs(sub).max(initial=0)
    out, start, shift = np.zeros((n, len(values))), 0, np.inf
    draw = np.random.default_rng(0)
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            start = i
        shift = min(value, shift - 4 * EPS * norm) if i > start else value
        x = draw.standard_normal(n)
        for _ in range(steps):
            x = solve(diagonal, sub, shift, x / np.linalg.norm(x))
            for _ in range(2):
                x /= np.abs(x).max()
                x -= out[:, start:i] @ (out[:, start:i].T @ x)
            x /= np.linalg.norm(x)
        out[:, i] = x
    return out


def components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a symmetric matrix, falling, and their unit vectors as columns, the largest entry of each positive."""
    n = len(matrix)
    k = min(k, n)
    scale = np.abs(matrix).max(initial=0)
    if n == 0 or scale == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, sub, reflectors = tridiagonal(matrix / scale)
    values = leading_eigenvalues(diagonal, sub, k)
    vectors = eigenvectors(diagonal, sub, values)
    for u in reversed(reflectors):
        vectors -= 2 * np.outer(u, u @ vectors)
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    return values * scale, vectors


# ---------------------------------------------------------------- over rows


def matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A list column of equally long lists as a matrix."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vectors_of(rows: DataFrame, id: str, vector: str) -> DataFrame:
    """(vec_id, x) of rows with a vector of finite entries; x = floor(1024 c) + 100000."""
    c = F.col(f"`{vector}`")
    usable = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long") + SHIFT)
    return rows.filter(c.isNotNull() & (F.size(c) > 0)).filter(usable).select(F.col(f"`{id}`").alias("vec_id"), x.alias("x"))


def sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension. A batch's sums fit 64 bits, all of them need more."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = matrix_of(batch, "x").sum(0)
                yield pa.RecordBatch.from_pydict({"i": np.arange(-1, len(own)), "s": np.concatenate([[batch.num_rows], own])})

    each = vectors.select("x").mapInArrow(add, "i long, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    got = {r["i"]: int(r["s"]) for r in each.collect()}  # a row a dimension
    return got.get(-1, 0), [got[i] for i in range(len(got) - 1)]


def covariance(rows: DataFrame, name: str, n: int, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """d x d covariance, divisor n, of entries less ``whole`` and ``rest``, which are their means or near them.

    Tasks' matrices are added by Spark, entry by entry; what the centre misses the mean by is taken off at the end.
    """
    d = len(whole)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, off = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch, name) - whole - rest
                total, off = total + x.T @ x, off + x.sum(0)
        yield pa.RecordBatch.from_pydict({"i": np.arange(d * d + d), "s": np.concatenate([total.ravel(), off])})

    out = np.zeros(d * d + d)
    for r in rows.select(name).mapInArrow(products, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():  # d * d + d rows
        out[r["i"]] = r["s"]
    square, off = out[: d * d].reshape(d, d) / n, out[d * d :] / n
    return (square + square.T) / 2 - np.outer(off, off)


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S) ** 2 per row, exact; None beyond 64 bits."""
    mean = np.array([s / n for s in total])
    far = n * (np.abs(x - mean).max(initial=0) + 1)
    if far * far * x.shape[1] < 1 << 62 and n * np.abs(x).max(initial=0) < 1 << 62:
        own = n * x - np.array(total, dtype="int64")
        return (own * own).sum(1).tolist()
    own = x.astype(object) * n - np.array(total, dtype=object)  # numbers of any size
    return [v if v < 1 << 63 else None for v in (own * own).sum(1).tolist()]


def whiten(rows: DataFrame, k: int = COMPONENTS, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each usable vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error).

    Rows whose vector is null, empty, or holds null or non-finite entries are
    dropped, and those of another length than the commonest one (ties: the longer),
    which share no space with the rest. Repeated vectors and ids each count. There
    are as many components as dimensions if those are fewer than k. A component
    without variance (single rows, equal rows, dependent dimensions) cannot have
    unit variance and is left out; with none, or without rows, the result is empty.
    ``deviation`` is null if it is beyond 64 bits. The lengths of vectors bound what the
    driver holds: d * d numbers. Entries beyond 2 ** 33 count as not finite, since
    sums of their whole numbers could not be told to be exact. Further columns are not read.
    """
    spark = rows.sparkSession
    every = vectors_of(rows, id, vector)
    lengths = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    empty = empty.withColumn("vec_id", F.col("vec_id").cast(every.schema["vec_id"].dataType))
    if not lengths:
        return empty
    vectors = every.filter(F.size("x") == lengths[0]["d"])
    n, total = sums(vectors)
    whole, rest = np.array([s // n for s in total], dtype="int64"), np.array([(s % n) / n for s in total])
    cov = covariance(vectors, "x", n, whole, rest)
    values, axes = components(cov, k)
    kept = values > RANK * max(values[0], 0)
    values, axes, trace = values[kept], axes[:, kept], float(np.trace(cov))
    if not len(values):
        return empty
    shared = spark.sparkContext.broadcast((whole, rest, axes / np.sqrt(values)))  # d * (k + 2) numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, part, scaled = shared.value
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch, "x")
                w = (x - base - part) @ scaled
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype="int32") * w.shape[1], w.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(x, n, total), pa.int64()), lists], ["vec_id", "deviation", "w"])

    kind = every.schema["vec_id"].dataType.simpleString()
    done = cut(vectors.mapInArrow(project, f"vec_id {kind}, deviation long, w array<double>"))
    zero = np.zeros(len(values))
    error = float(np.abs(covariance(done, "w", n, zero, zero) - np.eye(len(values))).max())
    table = F.array(*(F.struct(F.lit(i + 1).alias("component"), F.lit(float(e / trace)).alias("explained")) for i, e in enumerate(values)))
    each = F.explode(F.arrays_zip(table.alias("c"), F.col("w").alias("w")))
    out = done.select("vec_id", "deviation", each.alias("p"))
    return out.select("vec_id", F.col("p.c.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("p.w").alias("whitened"), F.col("p.c.explained").alias("explained"), F.lit(error).alias("identity_error"))
