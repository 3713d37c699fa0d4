"""Operator 11: embedding whitening by shifted CholeskyQR.

Entries are made whole numbers, ``x = floor(scale * c)``, and the model is fitted to the
distinct vectors. With A the centred rows (each column scaled to unit norm), every
pass over the fit list sums a Gram matrix: tasks centre their rows, put them through the triangular
solves of the factors found so far and multiply; Spark adds the tasks' matrices up row by row.
The driver takes the Cholesky factor R of that matrix (d x d, whatever the number of rows). The
first matrix of ill-conditioned rows has no factor that can be trusted, so a shift of its diagonal
comes first: the rows are then nearly orthogonal after the solve, and further passes without a shift
make them so up to rounding. The factors compose to A = Q R, and the singular values and right
vectors of R (by one-sided Jacobi rotations, which keep small values accurate) are those of A.
So components of variances far apart come out right where the covariance matrix itself,
whose condition is the square, has lost them.

Defined cases: rows whose vector is null or holds a null or non-finite entry are left out; a vector
shorter than the longest counts as padded with zeros; equal vectors are one in the fit list and all
get their row; constant columns have no part in a component; a column that others span (to 1e-11)
is expressed by them; components of variance zero (a fit list of one vector, say) don't exist and
give no row, so there may be fewer than ``k``; an entry beyond the range of a long is cut to it (2^62); a
deviation beyond a long is null; null ids and repeated rows are kept; an empty table gives no row.
Other columns are ignored. Bounds: d x d matrices of doubles, one for each task of a pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.tables import pick, written

SCALE = 256
K = 4
MAX_PASSES = 12
#: Gram matrices this near to the identity end the passes
NEAR = 1e-11
#: a unit column that is nearer than this to the columns before it is spanned by them
SPANNED = 1e-11
ROWS = 8192
_LIMIT = float(1 << 62)


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` (array of long) of the rows whose vector is whole and finite."""
    rows = pick(embeddings, [(id_col, "long"), (vec_col, "array<double>")]).toDF("vec_id", "c")
    odd = F.exists("c", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bounded = F.transform("c", lambda c: F.floor(F.least(F.greatest(c * float(scale), F.lit(-_LIMIT)), F.lit(_LIMIT))))
    return rows.where(F.col("c").isNotNull() & ~odd).select("vec_id", bounded.alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of longs, short ones padded with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(np.asarray(column.offsets).astype(np.int64))
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


@dataclass
class Centre:
    """Number and column sums (exact) of the fit list."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.floors = np.array([min(max(s // self.n, -(1 << 62)), 1 << 62) for s in self.sums], np.int64)
        self.rests = np.array([s - int(f) * self.n for s, f in zip(self.sums, self.floors)], np.int64)

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S modulo 2^64, and as doubles of full precision (of the exact value where a long holds it)."""
        near = x - self.floors
        exact = near * np.int64(self.n) - self.rests
        rough = near.astype(np.float64) * float(self.n) - self.rests.astype(np.float64)
        return exact, np.where(np.abs(rough) < _LIMIT, exact.astype(np.float64), rough)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.deviations(x)[1] / self.n

    def squares(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - S)^2; null beyond a long. Products modulo 2^64 are exact if the sum fits."""
        exact, rough = self.deviations(x)
        sizes = (rough * rough).sum(axis=1)
        total = (exact * exact).sum(axis=1)
        out: list[int | None] = total.tolist()
        for i in np.flatnonzero(sizes > 2.0**63 * (1 - 1e-9)):
            whole = sum((int(v) * self.n - s) ** 2 for v, s in zip(x[i], self.sums))
            out[i] = whole if whole < 1 << 63 else None
        return out


def centre(fit: DataFrame, dims: int) -> Centre:
    """Exact sums: tasks add up whole numbers, Spark adds decimals."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            x = _matrix(batch.column("x"), dims)
            n += len(x)
            low, high = (x & 0xFFFFFF).sum(axis=0), (x >> 24).sum(axis=0)
            sums = [s + (int(h) << 24) + int(v) for s, h, v in zip(sums, high, low)]
        yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(list(map(str, sums)))], names=["j", "n", "s"])

    per = fit.select("x").mapInArrow(task, "j int, n long, s string")
    rows = per.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return Centre(rows[0]["n"], [int(r["s"]) for r in sorted(rows, key=lambda r: r["j"])])


def gram(fit: DataFrame, dims: int, width: int, rows_of) -> np.ndarray:
    """Sum of Y'Y (width x width) over the fit list, where ``rows_of`` makes Y of a matrix of longs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                y = rows_of(_matrix(batch.column("x").slice(i, ROWS), dims))
                total += y.T @ y
        flat = pa.ListArray.from_arrays(np.arange(width + 1, dtype=np.int32) * width, total.ravel())
        yield pa.record_batch([pa.array(range(width), pa.int32()), flat], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("row").flatten().to_numpy().reshape(-1, width)):
                sums[i] = sums[i] + row if i in sums else row.copy()
        values = np.concatenate(list(sums.values())) if sums else np.empty(0)
        flat = pa.ListArray.from_arrays(np.arange(len(sums) + 1, dtype=np.int32) * width, values)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), flat], names=["i", "row"])

    out = "i int, row array<double>"
    dealt = fit.select("x").mapInArrow(task, out).repartition("i")  # a row of the matrix is added up in one task
    total = np.zeros((width, width))
    for r in dealt.mapInArrow(added, out).collect():
        total[r["i"]] += r["row"]
    return (total + total.T) / 2


def _solved(rows: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverses of upper triangular factors, in turn, by back substitution on blocks of columns."""
    for r in factors:
        out, d, step = np.empty_like(rows), len(r), 32
        for a in range(0, d, step):
            b = min(a + step, d)
            part = rows[:, a:b] - out[:, :a] @ r[:a, a:b]
            out[:, a:b] = np.linalg.solve(r[a:b, a:b].T, part.T).T
        rows = out
    return rows


def _factor(g: np.ndarray, shift: float) -> np.ndarray | None:
    """Upper triangular R with R'R = g + shift I, if g is definite enough."""
    try:
        r = np.linalg.cholesky(g + shift * np.eye(len(g))).T
    except np.linalg.LinAlgError:
        return None
    return r if np.isfinite(r).all() else None


def cholesky_qr(fit: DataFrame, at: Centre, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``R`` (rank x dims) and the rank's columns, with R'R = A'A for the centred rows A of the fit list."""
    norms = np.sqrt(np.maximum(np.diag(gram(fit, dims, dims, at.centred)), 0))
    keep = np.flatnonzero(norms > 0)
    unit = np.float64(2.0**-53)
    while len(keep):
        factors: list[np.ndarray] = []
        composed, spanned = np.eye(len(keep)), None
        for _ in range(MAX_PASSES):
            g = gram(fit, dims, len(keep), lambda x: _solved(at.centred(x)[:, keep] / norms[keep], factors))  # noqa: B023
            r = None
            if factors and np.linalg.eigvalsh(g)[0] > 1e-8:
                r = _factor(g, 0.0)
            settled = r is not None and np.abs(g - np.eye(len(g))).max() <= NEAR
            if r is None:
                m, d = float(at.n), len(keep)
                r = _factor(g, 11 * (m * d + d * (d + 1)) * unit * np.linalg.norm(g, 2))
            composed = r @ composed
            factors.append(r)
            low = np.abs(np.diag(composed))
            if low.min() <= SPANNED:
                spanned = np.flatnonzero(low <= SPANNED)
                break
            if settled:
                break
        if spanned is None:
            return _with_spanned(fit, at, dims, keep, norms, factors, composed)
        keep = np.delete(keep, spanned)
    return np.zeros((0, dims)), keep


def _with_spanned(fit, at, dims, keep, norms, factors, composed) -> tuple[np.ndarray, np.ndarray]:
    """The factor over all columns: those of ``keep`` from the composed factors, the others from Q'A."""
    out = np.zeros((len(keep), dims))
    out[:, keep] = composed * norms[keep]
    rest = np.flatnonzero((norms > 0) & ~np.isin(np.arange(dims), keep))
    if len(rest):
        width = len(keep) + len(rest)

        def both(x: np.ndarray) -> np.ndarray:
            c = at.centred(x)
            return np.hstack([_solved(c[:, keep] / norms[keep], factors), c[:, rest] / norms[rest]])

        out[:, rest] = gram(fit, dims, width, both)[: len(keep), len(keep) :] * norms[rest]
    return out, keep


def jacobi_svd(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Falling singular values and right vectors (columns) of ``r`` by one-sided Jacobi rotations,
    disjoint pairs of columns at a time."""
    d = r.shape[1]
    even = d + d % 2
    u, v = np.zeros((r.shape[0], even)), np.eye(even)
    u[:, :d] = r
    ring = np.arange(even)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(even - 1):
            a, b = ring[: even // 2], ring[even // 2 :][::-1]
            p, q = u[:, a], u[:, b]
            aa, bb, ab = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            scale = np.sqrt(aa) * np.sqrt(bb)
            turn = (np.abs(ab) > 1e-15 * scale) & (scale > 1e-250)  # columns of rounding errors stay
            worst = max(worst, float((np.abs(ab)[turn] / scale[turn]).max(initial=0.0)))
            half = np.where(turn, (bb - aa) / np.where(turn, 2 * ab, 1), 0)
            t = np.where(turn, np.where(half >= 0, 1, -1) / (np.abs(half) + np.hypot(1, half)), 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (u, v):
                m[:, a], m[:, b] = c * m[:, a] - s * m[:, b], s * m[:, a] + c * m[:, b]
            ring = np.concatenate([ring[:1], np.roll(ring[1:], 1)])
        if worst <= 1e-15 * max(r.shape):
            break
    values = np.sqrt((u * u).sum(axis=0))[:d] if even == d else np.sqrt((u * u).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order], v[:d, order]


@dataclass
class Whitening:
    """Fitted model: components are columns of ``axes`` by falling ``variances``."""

    dims: int
    at: Centre | None
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.at.centred(x) @ self.axes / np.sqrt(self.variances)


def fit_whitening(vectors: DataFrame, k: int = K) -> Whitening:
    """Fit to the distinct ``x`` of ``vectors``; at most ``k`` components."""
    dims = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if not dims:
        return Whitening(0, None, np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    fit = written(vectors.select(padded.alias("x")).distinct(), "whitening-fit")
    at = centre(fit, dims)
    r, keep = cholesky_qr(fit, at, dims)
    values, axes = jacobi_svd(r) if len(keep) else (np.zeros(0), np.zeros((dims, 0)))
    variances = values * values / at.n
    real = min(k, len(keep), int((values > 1e-13 * values.max(initial=0.0)).sum()) if len(keep) else 0)
    axes = axes[:, :real] / np.linalg.norm(axes[:, :real], axis=0)
    model = Whitening(dims, at, axes, variances[:real], float(variances.sum()), 0.0)
    if real:
        model.identity_error = float(np.abs(gram(fit, dims, real, model.rows) / at.n - np.eye(real)).max())
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each component."""
    k = len(model.variances)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for i in range(0, batch.num_rows if k else 0, ROWS):
                some = batch.slice(i, ROWS)
                x = _matrix(some.column("x"), model.dims)
                m = len(x)
                ids = np.repeat(np.arange(m), k)
                yield pa.record_batch([
                    some.column("vec_id").take(pa.array(ids)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.at.n)),
                    pa.array(model.at.squares(x), pa.int64()).take(pa.array(ids)), pa.array(model.rows(x).ravel()),
                    pa.array(np.tile(model.variances / model.trace, m)), pa.array(np.full(m * k, model.identity_error)),
                ], names=names)

    return vectors.select("vec_id", "x").mapInArrow(task, schema)


def whitened(embeddings: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    vectors = whole_vectors(embeddings, scale=scale)
    return whiten(vectors, fit_whitening(vectors, k))
