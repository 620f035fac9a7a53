"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Vectors are read as whole numbers, so sums are exact and so is the covariance as long as
its sums stay below 2^53.  What reaches the driver is one matrix of dimension by dimension
numbers, whatever the number of vectors.  There the covariance is shifted, the polar
factor of the shifted matrix (its sign) gives the projector on the eigenvectors above the
shift, and both invariant subspaces are split again until the parts are single
components.  The leading components are broadcast and every vector is projected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Whole numbers beyond this are no coordinates: sums of a slice must stay within 64 bits.
LARGEST = 1 << 48
#: Vectors handled at once.
SLICE_ROWS = 8192
#: A component counts if its variance is above this share of the total, times the dimension.
RANK_SHARE = 1e-14
_EPS = np.finfo(np.float64).eps


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by the dynamically weighted Halley iteration.

    ``low`` bounds the smallest singular value from below and sets the weights; it starts at
    rounding level, from which six or seven rounds reach one.  A round with a large weight
    goes by QR, later ones by Cholesky.
    """
    n = len(a)
    eye = np.eye(n)
    x = a / np.linalg.norm(a, 2)
    low = _EPS
    for _ in range(12):
        square = low * low
        gamma = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + gamma)
        wa = root + np.sqrt(8 - 4 * gamma + 8 * (2 - square) / (square * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))[0]
            step = (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        else:
            half = np.linalg.inv(np.linalg.cholesky(eye + wc * x.T @ x))
            step = (wa - wb / wc) * (x @ half.T @ half)
        new = wb / wc * x + step
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        low = min(1.0, low * (wa + wb * square) / (1 + wc * square))
        if moved <= np.cbrt(_EPS) * 0.1 and 1 - low < 1e-8:
            break
    return x


def _range_of(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement.

    The columns with most weight span the range; two more products with the projector
    wash out what the choice of columns has let in.
    """
    order = np.argsort(-np.diag(projector), kind="stable")
    basis = np.linalg.qr(projector[:, order])[0]
    for _ in range(2):
        upper = np.linalg.qr(projector @ basis[:, :rank])[0]
        rest = basis[:, rank:] - upper @ (upper.T @ basis[:, rank:])
        lower = np.linalg.qr(rest - projector @ rest)[0]
        basis = np.hstack([upper, lower])
    return basis[:, :rank], basis[:, rank:]


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces above and below a shift; None for a multiple of the identity.

    A shift that hits an eigenvalue leaves no projector; other shifts between the extreme
    eigenvalues are tried then.
    """
    n = len(a)
    middle, spread = np.trace(a) / n, np.linalg.norm(a - np.trace(a) / n * np.eye(n)) / np.sqrt(n)
    for shift in (np.median(np.diag(a)), *(middle + spread * t for t in (0.0, 0.31, -0.31, 0.083, -0.083, 0.73, -0.73, 0.011, -0.011))):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved) > 0:
            continue
        projector = (polar(moved) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if 0 < rank < n and np.linalg.norm(projector @ projector - projector) < 1e-8:
            return _range_of(projector, rank)
    return None


def components(covariance: np.ndarray, most: int) -> Iterator[tuple[float, np.ndarray]]:
    """(eigenvalue, unit eigenvector) by falling eigenvalue, the first ``most`` of them.

    The subspace above a shift is split before the one below, which stays whole once
    ``most`` components have come.  The largest entry of a vector is positive.
    """
    size = np.linalg.norm(covariance)
    found: list[tuple[float, np.ndarray]] = []

    def descend(basis: np.ndarray) -> None:
        if len(found) >= most:
            return
        inner = basis.T @ covariance @ basis
        inner = (inner + inner.T) / 2
        n = len(inner)
        # Equal up to rounding: any basis of the subspace will do.
        flat = np.linalg.norm(inner - np.trace(inner) / n * np.eye(n)) <= 4 * _EPS * size
        parts = None if n == 1 or flat else _split(inner)
        if parts is None:
            found.extend((float(v @ covariance @ v), v) for v in basis.T)
            return
        for part in parts:
            descend(np.linalg.qr(basis @ part)[0])

    if size > 0:
        descend(np.eye(len(covariance)))
    for value, vector in sorted(found, key=lambda f: -f[0])[:most]:
        yield value, vector * np.sign(vector[np.abs(vector).argmax()])


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dimension, rows, their vectors) for pieces of batches with vectors of one length."""
    for batch in batches:
        lengths = batch.column("x").value_lengths().to_numpy()
        for dim in np.unique(lengths).tolist():
            rows = batch.take(pa.array(np.flatnonzero(lengths == dim)))
            for k in range(0, len(rows), SLICE_ROWS):
                part = rows.slice(k, SLICE_ROWS)
                yield dim, part, _matrix(part.column("x"))


def _summed(rows: DataFrame, partial: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """Per dimension the sum over all slices of ``partial(dimension, vectors)``, a matrix.

    Each task sends its matrices row by row; the rows are dealt by (dimension, row) and
    added up as they stream by, so a task holds no more than the rows dealt to it.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for dim, _, vectors in _slices(batches):
            part = partial(dim, vectors)
            total[dim] = part if dim not in total else total[dim] + part
        for dim, matrix in total.items():
            yield pa.RecordBatch.from_pydict(
                {"dim": pa.array([dim] * len(matrix), pa.int32()), "nth": pa.array(range(len(matrix)), pa.int32()), "v": pa.array(list(matrix), pa.list_(pa.float64()))}
            )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for dim, nth, v in zip(batch.column("dim").to_pylist(), batch.column("nth").to_pylist(), batch.column("v")):
                v = v.values.to_numpy()
                total[dim, nth] = v if (dim, nth) not in total else total[dim, nth] + v
        for (dim, nth), v in total.items():
            yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "nth": pa.array([nth], pa.int32()), "v": pa.array([v], pa.list_(pa.float64()))})

    schema = "dim int, nth int, v array<double>"
    got = rows.select("x").mapInArrow(local, schema).repartition("dim", "nth").mapInArrow(merged, schema).toArrow()
    out: dict[int, dict[int, np.ndarray]] = {}
    for dim, nth, v in zip(got["dim"].to_pylist(), got["nth"].to_pylist(), got["v"]):
        out.setdefault(dim, {})[nth] = v.values.to_numpy()
    return {dim: np.stack([rows[k] for k in range(len(rows))]) for dim, rows in out.items()}


def projected(vectors: np.ndarray, onto: np.ndarray) -> np.ndarray:
    """``vectors @ onto`` coordinate by coordinate: a matrix product rounds by how many rows it gets."""
    out = np.zeros((len(vectors), onto.shape[1]))
    for k in range(len(onto)):
        out += vectors[:, k : k + 1] * onto[k]
    return out


def _whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the usable vectors as whole numbers."""
    whole: Column = F.transform(F.col(vector_col).cast("array<double>"), lambda c: F.floor(F.lit(float(SCALE)) * c) + F.lit(SHIFT))
    finite = F.expr(f"`{vector_col}` is not null and size(`{vector_col}`) > 0 and forall(`{vector_col}`, c -> c is not null and not isnan(c) and abs(c) < {LARGEST // SCALE - SHIFT}D)")
    return vectors.filter(finite).select(F.col(id_col).alias("id"), whole.alias("x"))


def whiten(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is decimal(38,0), exact; the rest as the contract of the query says.
    Vectors that are null, empty, or hold a null, non-finite or absurdly large number
    (beyond 2^38) are left out.  Vectors of each length are a population of their own.
    Repeated rows count each time, null ids stay.  Components without variance (beyond the
    rank, or all of them where vectors are equal) do not come out; an empty table gives an
    empty result.  Other columns are ignored.
    """
    rows = _whole_vectors(vectors, id_col, vector_col)
    spark = vectors.sparkSession
    schema = f"vec_id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    # Sums in two halves of the bits: each stays exact in a double up to 2^53.
    def sums(dim: int, x: np.ndarray) -> np.ndarray:
        s = x.sum(axis=0)
        return np.stack([np.full(dim, float(len(x))), (s >> 24).astype(np.float64), (s & 0xFFFFFF).astype(np.float64)])

    total = {d: (int(m[0, 0]), [(int(hi) << 24) + int(lo) for hi, lo in zip(m[1], m[2])]) for d, m in _summed(rows, sums).items()}
    if not total:
        return spark.createDataFrame([], schema)
    # x less the whole part of its mean is exact; what is left of the mean is taken off the sums.
    base = {d: np.array([s // n for s in t], np.int64) for d, (n, t) in total.items()}
    rest = {d: [s % n for s in t] for d, (n, t) in total.items()}

    def products(dim: int, x: np.ndarray) -> np.ndarray:
        y = (x - base[dim]).astype(np.float64)
        return y.T @ y

    basis: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for dim, product in _summed(rows, products).items():
        n, r = total[dim][0], rest[dim]
        cov = np.array([[float(Fraction(int(p), n) - Fraction(a * b, n * n)) for p, b in zip(line, r)] for line, a in zip(product, r)])
        trace = float(np.trace(cov))
        kept = [(e, v) for e, v in components(cov, min(most, dim)) if e > RANK_SHARE * dim * trace]
        if kept:
            values = np.array([e for e, _ in kept])
            basis[dim] = (np.stack([v for _, v in kept], axis=1) / np.sqrt(values), values / trace, np.array([a / n for a in r]))
    if not basis:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((total, base, rest, basis))

    def project(dim: int, x: np.ndarray) -> np.ndarray:
        _, base, _, basis = shared.value
        onto, _, left = basis[dim]
        return projected((x - base[dim]).astype(np.float64) - left, onto)

    def spread(dim: int, x: np.ndarray) -> np.ndarray:
        if dim not in shared.value[3]:
            return np.zeros((0, 0))
        w = project(dim, x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    error = {}
    for dim, m in _summed(rows, spread).items():
        n, k = total[dim][0], m.shape[1]
        mean = m[k] / n
        error[dim] = float(np.abs(m[:k] / n - np.outer(mean, mean) - np.eye(k)).max())

    kind = pa.decimal128(38, 0)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, base, rest, basis = shared.value
        for dim, part, x in _slices(batches):
            if dim not in basis:
                continue
            n, k = total[dim][0], basis[dim][0].shape[1]
            y = x - base[dim]
            off = np.array(rest[dim], object)
            # Whole numbers that may pass 64 bits are left to Python.
            safe = dim * (n * (float(np.abs(y).max(initial=0)) + 1)) ** 2 < 2.0**62
            apart = n * y - off.astype(np.int64) if safe else n * y.astype(object) - off
            deviation = (apart * apart).sum(axis=1)
            many = np.repeat(np.arange(len(part)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id").take(pa.array(many)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(len(many), n, np.int64)),
                    (pa.array(deviation).cast(kind) if safe else pa.array([int(d) if d < 10**38 else None for d in deviation], kind)).take(pa.array(many)),
                    pa.array(project(dim, x).ravel()),
                    pa.array(np.tile(basis[dim][1], len(part))),
                    pa.array(np.full(len(many), error[dim])),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(emit, schema)
