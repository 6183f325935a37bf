"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 13).

Every entry c becomes the long floor(256 c).  The fit list holds each distinct vector once.  Its covariance is never
formed: a pass over the fit table computes Cᵀ(CQ) for the centred rows C and a block Q of a few columns, as sums per
dimension that Spark adds up, so the driver holds dimension x block numbers whatever the number of rows.  A few passes
of block Lanczos bracket the spectrum; then each round runs a Chebyshev polynomial of the covariance over the block
(one pass a degree, by its three-term recurrence), which damps the eigenvalues between the lower bound and the block's
smallest Ritz value, orthonormalises by QR and takes the Rayleigh-Ritz pairs of the block.  Rounds end when the
wanted pairs are certified: residuals |Vu - eu| at rounding level, or no longer falling while under ``CERTIFIED``.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, rows with a null id are not;
vectors shorter than the longest count as followed by zeros; values beyond a long stay at its bounds, and a deviation
beyond it is null; a component whose eigenvalue is zero (up to rounding) has a null ``whitened`` and ``explained`` 0
(null if the trace is 0), and ``identity_error`` covers the others (null if there is none); equal eigenvalues share any
basis of their space; repeated rows each get their rows; further columns are ignored; an empty table, or one without a
vector of an entry, gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, written

SCALE = 256
COMPONENTS = 4
#: Columns of the iterated block: the wanted ones and guards, which speed up the filter.
BLOCK = 24
DEGREE = 8
ROUNDS = 200
#: Residuals relative to the largest eigenvalue: the goal, and what a run that stopped falling must have.
ROUNDING, CERTIFIED = 4e-15, 1e-11
#: Eigenvalues up to this share of the trace count as zero.
ZERO = 1e-12
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class NotCertified(ArithmeticError):
    """The iteration did not reach certified residuals."""


# -- integer vectors ------------------------------------------------------------------------------

def integers(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows that remain, and their integer vectors."""
    at, out = [], []
    offs = column.offsets.to_numpy()
    flat = column.values
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values) | flat.is_null().to_numpy(zero_copy_only=False))])
    keep = (bad[offs[1:]] == bad[offs[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        x = np.floor(values * SCALE)
    x = np.where(np.isnan(x), 0, x)
    big = np.abs(x) >= 2.0 ** 63
    whole = np.where(big, 0, x).astype(np.int64)
    whole[big] = np.where(x[big] > 0, HIGH, LOW)
    for i in np.flatnonzero(keep):
        at.append(i)
        out.append(whole[offs[i]:offs[i + 1]])
    return np.array(at, np.int64), out


def packed(x: np.ndarray) -> bytes:
    """The vector without its last zeros in the smallest integer type, after that type's width."""
    n = np.flatnonzero(x)
    x = x[:n[-1] + 1] if len(n) else x[:0]
    top = max(int(x.max()), -1 - int(x.min())) if len(x) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a binary column as a matrix of d columns."""
    out = np.zeros((len(column), d), np.int64)
    if not len(column):
        return out
    _, ob, db = column.buffers()
    offs = np.frombuffer(ob, np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(db, np.uint8)
    size, width = np.diff(offs), data[offs[:-1]].astype(np.int64)
    for key in np.unique(size * 16 + width):
        rows = np.flatnonzero(size * 16 + width == key)
        n, w = int(key) // 16 - 1, int(key) % 16
        if n:
            raw = data[offs[rows][:, None] + np.arange(1, n + 1)]
            out[rows, :n // w] = np.ascontiguousarray(raw).view(f"<i{w}")
    return out


def _encode(batches):
    for batch in batches:
        _, vectors = integers(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([packed(v) for v in vectors], pa.binary()),
                                          pa.array([len(v) for v in vectors], pa.int32())], names=["x", "size"])


def fit_list(embeddings: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Each distinct integer vector once, as a written table: ``x`` (packed), ``size``."""
    vectors = in_tasks(embeddings.select(F.col(f"`{embedding}`").cast("array<double>").alias("embedding")), _encode,
                       "x binary, size int")
    return written(vectors.groupBy("x").agg(F.max("size").alias("size")), "whiten-fit")


# -- passes ---------------------------------------------------------------------------------------

def summed(fit: DataFrame, d: int, rows_of, k: int, exact: bool = False) -> list:
    """The sum over all tasks of ``rows_of(matrix)`` (d' x k) for the rows of each batch, added up by Spark."""
    kind, arrow = ("decimal(38,0)", pa.decimal128(38, 0)) if exact else ("double", pa.float64())

    def task(batches):
        total = None
        for batch in batches:
            part = rows_of(unpacked(batch.column(0), d))
            total = part if total is None else total + part
        if total is not None:
            cols = [pa.array([int(v) for v in c], pa.int64()).cast(pa.decimal128(19, 0)).cast(arrow) if exact else pa.array(c) for c in total.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *cols], names=["i", *(f"c{j}" for j in range(k))])

    schema = ", ".join(["i int", *(f"c{j} {kind}" for j in range(k))])
    parts = in_tasks(fit.select("x"), task, schema)
    out = parts.groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)]).collect()
    return [list(r)[1:] for r in sorted(out, key=lambda r: r["i"])]


def sums(fit: DataFrame, d: int) -> list[int]:
    """Exact sums per dimension."""
    def halves(x):  # two halves of 32 bits, so that no sum of a task overflows
        return np.stack([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)], 1)
    return [(int(high) << 32) + int(low) for high, low in summed(fit, d, halves, 2, exact=True)]


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int):
    """The pass Q -> VQ = Cᵀ(CQ) / n."""
    def times(q: np.ndarray) -> np.ndarray:
        def part(x):
            c = x - mean
            return c.T @ (c @ q)
        return np.array(summed(fit, len(mean), part, q.shape[1])) / n
    return times


# -- the iteration --------------------------------------------------------------------------------

def lanczos_bounds(times, q: np.ndarray, steps: int) -> tuple[float, float]:
    """(lower, upper) bounds of the spectrum from a block Krylov space."""
    basis, images = [q], []
    for _ in range(steps):
        images.append(times(basis[-1]))
        w = images[-1]
        for _ in range(2):
            for b in basis:
                w = w - b @ (b.T @ w)
        left, s, _ = np.linalg.svd(w, full_matrices=False)
        left = left[:, s > 1e-10 * max(np.linalg.norm(images[-1], 2), 1e-300)]
        if not left.shape[1] or len(basis) == steps:
            break
        basis.append(left)
    b, v = np.hstack(basis[:len(images)]), np.hstack(images)
    h = b.T @ v
    e, u = np.linalg.eigh((h + h.T) / 2)
    r = np.linalg.norm(v @ u - (b @ u) * e, axis=0)
    return max(0.0, e[0] - r[0]), e[-1] + r[-1]


def chebyshev(times, q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of the given degree that is small on [low, high] and one at ``top``, applied to q."""
    centre, half = (high + low) / 2, (high - low) / 2
    sigma = first = half / (top - centre)
    before, now = q, (times(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def leading_pairs(times, d: int, wanted: int, block: int = BLOCK, degree: int = DEGREE, seed: int = 13) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors, largest residual) of the ``wanted`` largest eigenvalues, certified."""
    rng = np.random.default_rng(seed)
    k = min(d, max(block, wanted + 1))
    wanted = min(wanted, d)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    low, high = (0.0, np.inf) if k == d else lanczos_bounds(times, q[:, :max(1, k // 4)], 5)
    last = np.inf
    for _ in range(ROUNDS):
        v = times(q)
        h = q.T @ v
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        residual = np.linalg.norm(v @ u - (q @ u) * e, axis=0)[:wanted].max()
        top = max(e[0], 0.0)
        q = q @ u
        if residual <= ROUNDING * top or (residual >= last / 2 and residual <= CERTIFIED * top) or top == 0:
            return np.maximum(e[:wanted], 0), q[:, :wanted], residual
        last = min(last, residual)
        if k < d and e[-1] > low and e[0] > e[-1]:
            low = min(low, e[-1])
            q = chebyshev(times, q, low, e[-1], max(e[0], min(high, 2 * e[0])), degree)
        else:  # the block is the whole space, or its pairs are all alike
            q = v
        q = np.linalg.qr(q)[0]
        q = np.linalg.qr(q)[0]
    raise NotCertified(f"residual {last} after {ROUNDS} rounds, largest eigenvalue {top}")


@dataclass
class Whitening:
    """A fitted transform; ``values`` holds nan where an eigenvalue is zero."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    identity_error: float | None
    residual: float


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE) -> Whitening | None:
    """The whitening of a written fit list, or None if it has no vector or no dimension."""
    facts = fit.agg(F.count(F.lit(1)), F.max("size")).first()
    n, d = facts[0], facts[1] or 0
    if not n or not d:
        return None
    total = sums(fit, d)
    mean = np.array([s / n for s in total])
    trace = sum(r[0] for r in summed(fit, d, lambda x: ((x - mean) ** 2).sum(0)[:, None], 1)) / n
    times = covariance_times(fit, mean, n)
    e, v, residual = leading_pairs(times, d, components, block, degree)
    real = e > ZERO * trace
    values = np.where(real, e, np.nan)
    error = None
    if real.any():
        w = v[:, real] / np.sqrt(e[real])
        moments = np.array(summed(fit, d, lambda x: _moments((x - mean) @ w), w.shape[1]))
        centre = moments[-1] / n
        error = float(np.abs(moments[:-1] / n - np.outer(centre, centre) - np.eye(w.shape[1])).max())
    return Whitening(n, total, v, values, [(float(x / trace) if r else 0.0) if trace else None for x, r in zip(e, real)], error, residual)


def _moments(w: np.ndarray) -> np.ndarray:
    """WᵀW, and the sums of W as the last row."""
    return np.vstack([w.T @ w, w.sum(0)])


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n x - S)^2, null where a long cannot hold one."""
    far = max((abs(s) for s in total), default=0) + n * int(max(-int(x.min(initial=0)), int(x.max(initial=0))))
    if far * far * max(1, x.shape[1]) <= HIGH:
        return (((n * x - np.array(total, np.int64)) ** 2).sum(1)).tolist()
    exact = (((n * x.astype(object) - np.array(total, object)) ** 2).sum(1)).tolist()
    return [v if v <= HIGH else None for v in exact]


def transform(embeddings: DataFrame, w: Whitening, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row per remaining row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    narrow = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    d, k = len(w.sums), w.components.shape[1]
    mean = np.array([s / w.n for s in w.sums])

    def task(batches):
        for batch in batches:
            at, vectors = integers(batch.column(1))
            if not len(at):
                continue
            x = np.zeros((len(at), d), np.int64)
            for row, v in zip(x, vectors):
                row[:len(v)] = v
            white = ((x - mean) @ w.components / np.sqrt(w.values)).ravel()
            n = len(at)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                pa.array(np.full(n * k, w.n), pa.int64()), pa.array(deviations(x, w.n, w.sums), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(white, pa.float64(), mask=np.isnan(white)), pa.array(w.explained * n, pa.float64()),
                pa.array([w.identity_error] * (n * k), pa.float64())], names=NAMES)

    return in_tasks(narrow, task, f"vec_id {narrow.schema['vec_id'].dataType.simpleString()}, {REST}")


NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
REST = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS,
           block: int = BLOCK, degree: int = DEGREE) -> DataFrame:
    """Fit on the distinct vectors and transform all rows."""
    w = fit_whitening(fit_list(embeddings, embedding), components, block, degree)
    if w is None:
        kind = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"))
        return kind.limit(0).selectExpr("vec_id", *[f"cast(null as {t}) as {c}" for c, t in (x.split() for x in REST.split(", "))])
    return transform(embeddings, w, vec_id, embedding)
