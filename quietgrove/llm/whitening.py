"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Entries become whole numbers ``floor(scale * c) + shift``. A row is centred as ``(n * x - S) / n``
with the exact integer difference, so a common offset costs no digits, whatever its size.

For the centred matrix X the method builds orthonormal v's and u's with ``X v_j = beta_(j-1)
u_(j-1) + alpha_j u_j`` and ``X' u_j = alpha_j v_j + beta_j v_(j+1)``. A step is one pass over the
stored rows: each task forms its entries of ``X v`` and, as ``X'`` is linear, at once its share of
``X' (X v)``; tasks return as many numbers as a row has, which are added in a tree whose root is the
driver. A vector u has an entry per row of the table and is never stored: it is kept as the
coefficients w with ``u = X w``. Every new u and v is reorthogonalised against all before it; if
that shortens a u much, the product is taken again on the corrected coefficients and
reorthogonalised once more. Where a Krylov space ends (equal eigenvalues, dependent entries), the
method goes on with a random combination of rows that is orthogonal to all v's.

Up to ``FULL`` dimensions the bidiagonal matrix is completed, so its singular value decomposition
holds every component. Beyond, steps go on until the wanted singular vectors have converged, and,
after a random restart that may uncover repeated eigenvalues, have converged to the same values.

Defined cases: rows whose vector is null or empty, holds null or non-finite entries, or has another
length than most (the longer one where two are equally frequent) are left out; a null key stays;
repeated rows count each time. Components of zero variance (to rounding) cannot be whitened and are
left out, so equal vectors give an empty result, as does an empty table. Scaled entries are limited
to +-2**62, deviations to the range of a long. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator, Optional

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietgrove.scratch import Scratch

#: Dimensions up to which every component is found.
FULL = 512
#: Rows and entries of a stored block, at most.
BLOCK_ROWS = 1_024
BLOCK_ENTRIES = 1 << 19
#: Partial sums that are added in one place.
FAN_IN = 1_024
#: Part of the largest singular value below which a number is rounding.
ROUNDING = 1e-13
_LIMIT = 2 ** 62
_LONG = 2 ** 63 - 1
_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("x", pa.binary())])
_RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
           "identity_error double")


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def _differences(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - S``, exact: as long integers where they fit, else as Python's."""
    top = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
    if n * top + max(abs(s) for s in sums) <= _LONG:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _differences(x, n, sums).astype(np.float64) / n


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum of squared differences of each row."""
    d = _differences(x, n, sums)
    top = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
    if d.shape[1] * top * top <= _LONG:
        d = d.astype(np.int64)
        return (d * d).sum(axis=1)
    d = d.astype(object)
    return np.minimum((d * d).sum(axis=1), _LONG).astype(np.int64)


def _packer(dim: int):
    """Rows (vec_id, x) to blocks."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // dim))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i8")
                ids = pa.ListArray.from_arrays([0, part.num_rows], part.column("vec_id"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], schema=_BLOCK)

    return pack


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[Optional[pa.Array], np.ndarray]]:
    for batch in batches:
        ids = batch.column("ids") if "ids" in batch.schema.names else None
        for i, x in enumerate(batch.column("x")):
            own = ids[i].values if ids is not None else None
            yield own, np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim)


_PARTIAL = pa.schema([("part", pa.binary())])


def _one(total: Optional[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], schema=_PARTIAL)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.frombuffer(p.as_buffer()) for b in batches for p in b.column("part")]
    yield from _one(sum(parts) if parts else None)


class _Rows:
    """The stored, centred matrix, as something that can be multiplied."""

    def __init__(self, blocks: DataFrame, dim: int, n: int, sums: list[int]):
        self.blocks, self.dim, self.n, self.sums = blocks.select("x"), dim, n, sums
        self.tasks = self.blocks.rdd.getNumPartitions()

    def total(self, share: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum over all blocks of ``share(centred rows)``, added in a tree."""
        dim, n, sums = self.dim, self.n, self.sums

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for _, x in _blocks(batches, dim):
                own = share(_centred(x, n, sums))
                total = own if total is None else total + own
            yield from _one(total)

        level, left = self.blocks.mapInArrow(parts, "part binary"), self.tasks
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            level = level.repartition(left).mapInArrow(_add, "part binary")
        return sum(np.frombuffer(r["part"]) for r in level.collect())

    def product(self, w: np.ndarray) -> tuple[np.ndarray, float]:
        """``X' X w`` and the squared length of ``X w``."""
        def share(c: np.ndarray) -> np.ndarray:
            t = c @ w
            return np.append(c.T @ t, t @ t)

        out = self.total(share)
        return out[:-1], float(out[-1])


def _orthogonal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = x - basis @ (basis.T @ x)
    return x


def bidiagonalise(rows: _Rows, wanted: int, seed: int = 12, full: int = FULL
                  ) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred matrix, falling, and its right singular vectors (columns).

    The matrix must not be zero. Vanishing singular values may be left out.
    """
    d, rng = rows.dim, np.random.default_rng(seed)

    def direction(basis: np.ndarray, largest: float) -> Optional[np.ndarray]:
        """A random combination of rows, orthogonal to the v's; None if they span the rows.

        (A direction that no row has would cost nothing in ``X w`` and so grow in w unseen.)
        """
        probe = _orthogonal(rng.standard_normal(d), basis)
        z, square = rows.product(probe / np.linalg.norm(probe))
        v = _orthogonal(z, basis)
        if square <= (ROUNDING * largest) ** 2 or not v.any():
            return None
        return v / np.linalg.norm(v)

    v_all, w_all, z_all = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))
    alphas, betas, confirmed = [], [], None
    v, beta = direction(v_all, 0.0), 0.0
    while True:
        w = v - beta * w_all[:, -1] if beta else v
        z, square = rows.product(w)
        for again in range(2):
            # what is left of X w after its projection on all u's; X' of the u's is known
            h = w_all.T @ z
            left = square - h @ h
            w, z = w - w_all @ h, z - z_all @ h
            if again or left > 0.5 * square:
                break
            z, square = rows.product(w)
        largest = max([*alphas, *betas, np.sqrt(max(square, 0.0))])
        alpha = np.sqrt(left) if left > (ROUNDING * largest) ** 2 else 0.0
        w, z = (w / alpha, z / alpha) if alpha else (np.zeros(d), np.zeros(d))
        v_all, w_all, z_all = (np.column_stack([a, b]) for a, b in ((v_all, v), (w_all, w), (z_all, z)))
        alphas.append(alpha)
        steps = len(alphas)
        rest = _orthogonal(z, v_all)
        beta = float(np.linalg.norm(rest))
        if beta <= ROUNDING * max([*alphas, *betas]):
            beta = 0.0
        band = np.diag(alphas) + np.diag(betas, 1)
        if steps == d:
            break
        if steps >= min(d, wanted) and d > full and steps % 4 == 0 or not beta and d > full:
            left_vectors, values, _ = np.linalg.svd(band)
            top = values[:wanted]
            if len(top) == wanted and (beta * np.abs(left_vectors[-1, :wanted]) <= ROUNDING * values[0]).all():
                if confirmed is not None and np.allclose(top, confirmed, rtol=1e-12, atol=ROUNDING * values[0]):
                    break
                confirmed, beta = top, 0.0
        v = rest / beta if beta else direction(v_all, max(alphas))
        if v is None:
            break
        betas.append(beta)
    _, values, right = np.linalg.svd(band)
    return values, v_all @ right.T


@dataclass
class Whitening:
    """Fitted on ``n`` rows with per-entry sums; columns of ``components`` are unit vectors."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    scale: int
    shift: int
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.components / np.sqrt(self.variances)

    def transform(self, df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """A row for each usable row of ``df`` and component."""
        rows = scaled(df, key, vector, self.scale, self.shift).where(F.size("x") == self.dim)
        return self._applied(rows.mapInArrow(_packer(self.dim), "ids array<long>, x binary"))

    def _applied(self, blocks: DataFrame) -> DataFrame:
        model, k = self, len(self.variances)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _blocks(batches, model.dim):
                centred = _centred(x, model.n, model.sums)
                each = len(x) * k
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(each, model.n, np.int64)),
                    pa.array(np.repeat(_deviation(x, model.n, model.sums), k)),
                    pa.array(model.project(centred).ravel()),
                    pa.array(np.tile(model.variances / model.trace, len(x))),
                    pa.array(np.full(each, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        return blocks.mapInArrow(apply, _RESULT)


def scaled(df: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """``vec_id`` and whole-number ``x`` of the usable rows."""
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"),
                     F.col(f"`{vector}`").cast("array<double>").alias("v")).where(usable(F.col("v")))
    limit = F.lit(_LIMIT)
    return rows.select("vec_id", F.transform("v", lambda c: F.greatest(-limit, F.least(
        limit, F.floor(c * F.lit(float(scale))))) + F.lit(shift)).alias("x"))


def _fitted(df: DataFrame, components: int, key: str, vector: str, scale: int, shift: int
            ) -> tuple[Optional[Whitening], Optional[DataFrame]]:
    scratch = Scratch(df.sparkSession)
    rows = scaled(df, key, vector, scale, shift)
    usual = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.desc("size")).first()
    if usual is None:
        return None, None
    dim, n = usual["size"], usual["n"]
    rows = rows.where(F.size("x") == dim)
    blocks = scratch.save(rows.mapInArrow(_packer(dim), "ids array<long>, x binary"))
    sums = _sums(blocks, dim)
    x = _Rows(blocks, dim, n, sums)
    trace = float(x.total(lambda c: np.array([(c * c).sum()]))[0]) / n
    if trace == 0.0:
        return None, None
    values, vectors = bidiagonalise(x, min(components, dim))
    keep = values[:components] > ROUNDING * np.sqrt(dim) * values[0]
    vectors = vectors[:, :components][:, keep]
    # either sign will do: the largest entry is made positive
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    model = Whitening(n, sums, vectors, values[:components][keep] ** 2 / n, trace, scale, shift)
    model.identity_error = _identity_error(x, model)
    return model, blocks


def _sums(blocks: DataFrame, dim: int) -> list[int]:
    """Exact sum of each entry. A number is added as three parts of 21 bits, so no sum overflows."""
    parts = 3

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, dim), dtype=np.int64)
        for _, x in _blocks(batches, dim):
            low, middle, high = x & 0x1FFFFF, (x >> 21) & 0x1FFFFF, x >> 42
            total += np.stack([low.sum(axis=0), middle.sum(axis=0), high.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts * dim)), pa.array(total.ravel())],
                                         names=["at", "total"])

    found = blocks.select("x").mapInArrow(add, "at long, total long").groupBy("at").agg(
        F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).collect()
    total = {r["at"]: int(r["total"]) for r in found}
    return [sum(total[p * dim + i] << (21 * p) for p in range(parts)) for i in range(dim)]


def _identity_error(x: _Rows, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance less the identity."""
    k = len(model.variances)

    def share(c: np.ndarray) -> np.ndarray:
        y = model.project(c)
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    total = x.total(share) / model.n
    mean = total[k * k:]
    return float(np.abs(total[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding",
                  scale: int = 64, shift: int = 1_000_000) -> Optional[Whitening]:
    """Whitening of the rows of ``df``; None if they have no variance."""
    return _fitted(df, components, key, vector, scale, shift)[0]


def whiten(df: DataFrame, components: int = 32, key: str = "vec_id", vector: str = "embedding",
           scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """Fit on all rows and whiten them: ``vec_id, component, n, deviation, whitened, explained,
    identity_error``."""
    model, blocks = _fitted(df, components, key, vector, scale, shift)
    if model is None:
        return df.sparkSession.createDataFrame([], _RESULT)
    return model._applied(blocks)
