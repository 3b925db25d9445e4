"""Whitening of embeddings by their leading principal components, found by a block Jacobi-Davidson method.

The covariance is never formed. It is known by its products with blocks of vectors alone: every task centres its
vectors, multiplies them with the block and back, Spark adds the tasks' products up (one row for each dimension).

1. The fit list (each distinct vector once) is settled; its number n, sums S and spread come from one pass. A centred entry is
   (n * x - S) / n, the numerator exact.
2. Subspace Rayleigh-Ritz: the covariance restricted to an orthonormal basis gives the wanted Ritz pairs and a few guards. A
   leading pair whose residual is at double precision is locked, that is taken out of the search space for good.
3. For each of the others the correction equation, projected onto what is orthogonal to locked and current Ritz vectors, is
   solved roughly by a few steps of MINRES, all equations in step, so that a step is one distributed product for all of them.
   The corrections enlarge the basis; a full basis is cut back to the best Ritz vectors.
4. When all wanted pairs are locked and no guard's value is larger, rows are projected, a task's rows at a time, and the
   whitened fit list's covariance is measured by one more pass.

The driver holds a few dozen vectors of one dimension's length; neither vectors of the table nor a square of the dimension reach it
(of up to 96 dimensions the basis may fill the space).

Defined cases: a row whose vector is null or empty, or holds a null or non-finite entry, is left out; a null vec_id stays. Repeated rows are
returned each, and fitted once. Vectors of different lengths are whitened by themselves, length by length. Components whose
eigenvalue is 0 to double precision can't be whitened and are left out, so fewer distinct vectors than components, or a single one, give fewer
rows, or none. An empty table gives no rows. A deviation beyond a long is an error. Extra columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _common as c

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Ritz pairs beyond the wanted ones that are improved along with them.
GUARDS = 8
#: MINRES steps for one correction.
INNER = 4
#: Vectors of a basis, in blocks, before it is cut back.
BLOCKS = 6
ROUNDS = 500
#: Rows that a task centres at once.
ROWS = 2048
_EPS = float(np.finfo(float).eps)


def shifted(df: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id, x: floor(scale * c) + offset of each entry as long, of the rows whose entries are all finite."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("long") + offset).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


class Fit:
    """The fit list (x; settled) of one length: its size n and sums; products with its covariance."""

    def __init__(self, vectors: DataFrame, dim: int):
        self.vectors, self.dim = vectors, dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(dim, np.int64)
            for batch in batches:
                n, total = n + batch.num_rows, total + _matrix(batch.column("x"), dim).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(np.full(dim, n)), pa.array(total)], names=["at", "n", "s"])

        got = vectors.transform(c.in_arrow, run, "at long, n long, s long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow().sort_by("at")
        self.n, self.sums = int(got.column("n")[0].as_py()), got.column("s").to_numpy()
        self.products = 0

    def _summed(self, width: int, make: Callable[[np.ndarray], np.ndarray], rows: int) -> np.ndarray:
        """The sum over all vectors of make(centred rows), a matrix of rows x width."""
        dim, n, sums = self.dim, self.n, self.sums

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rows, width))
            for batch in batches:
                x = _matrix(batch.column("x"), dim)
                for at in range(0, len(x), ROWS):
                    total += make(deviations(x[at : at + ROWS], n, sums) / n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), *[pa.array(total[:, k]) for k in range(width)]], names=["at", *[f"s{k}" for k in range(width)]])

        names = [f"s{k}" for k in range(width)]
        parts = self.vectors.transform(c.in_arrow, run, "at long, " + ", ".join(f"{x} double" for x in names))
        got = parts.groupBy("at").agg(*[F.sum(x).alias(x) for x in names]).toArrow().sort_by("at")
        return np.column_stack([got.column(x).to_numpy() for x in names])

    def product(self, block: np.ndarray) -> np.ndarray:
        """The covariance times block (dim x width)."""
        self.products += 1
        return self._summed(block.shape[1], lambda y: y.T @ (y @ block), self.dim) / self.n

    def trace(self) -> float:
        return float(self._summed(1, lambda y: (y * y).sum(axis=0)[:, None], self.dim).sum()) / self.n

    def identity_error(self, project: np.ndarray) -> float:
        """The largest entry of the covariance of y @ project minus the identity; the mean of y is exactly 0."""
        width = project.shape[1]
        got = self._summed(width, lambda y: (w := y @ project).T @ w, width) / self.n
        return float(np.abs(got - np.eye(width)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact."""
    most = int(max(x.max(initial=0), -x.min(initial=0), 1))
    if n * most + int(np.abs(sums).max(initial=0)) >= 2**63:
        raise OverflowError("n * x exceeds a long")
    return n * x - sums


def _orthogonal(block: np.ndarray, *to: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to the orthonormal bases `to`; directions that are lost in rounding are left out."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        for basis in to:
            block = block - basis @ (basis.T @ block)
    if not block.shape[1]:
        return block
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    block = u[:, s > 1e-8]
    for _ in range(2):
        for basis in to:
            block = block - basis @ (basis.T @ block)
    return np.linalg.qr(block)[0] if block.shape[1] else block


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions of product(x) = right, column by column, each by `steps` steps of MINRES for symmetric operators.

    product takes all columns at once. A column that is solved, or can't go on, keeps what it has.
    """
    live = lambda x: np.where(np.abs(x) > 0, x, 1.0)
    beta = np.linalg.norm(right, axis=0)
    x, v_old, v = np.zeros_like(right), np.zeros_like(right), right / live(beta)
    w_old = w = np.zeros_like(right)
    cos_old = cos = np.ones(right.shape[1])
    sin_old = sin = np.zeros(right.shape[1])
    eta, off, going = beta.copy(), np.zeros(right.shape[1]), beta > 0
    for _ in range(steps):
        if not going.any():
            break
        z = product(v)
        alpha = (v * z).sum(axis=0)
        z = z - alpha * v - off * v_old
        off_next = np.linalg.norm(z, axis=0)
        # the rotations of the two steps before, then the one that zeroes off_next
        r3, r2 = sin_old * off, cos * cos_old * off + sin * alpha
        head = cos * alpha - sin * cos_old * off
        r1 = np.hypot(head, off_next)
        going = going & (r1 > 0)
        cos_old, sin_old = cos, sin
        cos, sin = np.where(going, head / live(r1), 1.0), np.where(going, off_next / live(r1), 0.0)
        w_next = (v - r3 * w_old - r2 * w) / live(r1)
        w_old, w = w, w_next
        x = x + np.where(going, cos * eta, 0.0) * w
        eta = -sin * eta
        going = going & (off_next > _EPS * np.maximum(1, np.abs(alpha)))
        v_old, v, off = v, z / live(off_next), off_next
    return x


def eigenpairs(product: Callable[[np.ndarray], np.ndarray], dim: int, components: int = COMPONENTS, guards: int = GUARDS, inner: int = INNER, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors (columns) of a symmetric operator without negative eigenvalues.

    product(block) multiplies it with a block of columns. A vector's largest entry is positive. A residual is at double precision when it
    is a few roundings of the largest eigenvalue, or when it is below 1e-12 of it and two rounds no longer halve it.
    """
    wanted = need = min(components, dim)
    block = min(wanted + guards, dim)
    basis = _orthogonal(np.random.default_rng(12).normal(size=(dim, block)))
    image = product(basis)
    values, locked = np.zeros(0), np.zeros((dim, 0))
    scale, best, stalled = 0.0, np.inf, 0
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, ritz_image = basis @ s, image @ s
        scale = max([scale, *theta[:1]])
        residual = ritz_image - ritz * theta
        norm = np.linalg.norm(residual, axis=0)
        lead = norm[0] if len(norm) else 0.0
        stalled = stalled + 1 if lead > best / 2 else 0
        limit = 4 * np.sqrt(dim) * _EPS * scale
        if stalled >= 2 and lead <= 1e-12 * scale:
            limit = max(limit, 2 * lead)
        ok = norm[: need - locked.shape[1]] <= limit
        n = len(ok) if ok.all() else int(ok.argmin())
        values, locked = np.append(values, theta[:n]), np.column_stack([locked, ritz[:, :n]])
        theta, ritz, ritz_image, residual = theta[n:], ritz[:, n:], ritz_image[:, n:], residual[:, n:]
        best, stalled = (np.inf, 0) if n else (min(best, lead), stalled)
        if locked.shape[1] == need:
            if not len(theta) or theta[0] <= values.min() + limit:
                break
            need += 1  # a guard's value has overtaken a locked one: it is wanted, the smallest goes in the end
        if ritz.shape[1] + block > blocks * block:
            ritz, ritz_image = ritz[:, : 2 * block], ritz_image[:, : 2 * block]
        now, shift = ritz[:, :block], theta[:block]
        known = np.column_stack([locked, now])
        away = lambda t, known=known: t - known @ (known.T @ t)
        corrections = minres(lambda t, away=away, shift=shift: away(product(away(t)) - away(t) * shift), -away(residual[:, :block]), inner)
        more = _orthogonal(corrections, locked, ritz)
        if more.shape[1]:
            basis, image = np.column_stack([ritz, more]), np.column_stack([ritz_image, product(more)])
        else:  # the basis fills the space, or all corrections are rounding: its images are made anew
            basis = _orthogonal(ritz, locked)
            image = product(basis)
    else:
        raise ArithmeticError("the residuals don't reach double precision")
    order = np.argsort(-values, kind="stable")[:wanted]
    values, locked = values[order], locked[:, order]
    most = np.abs(locked).argmax(axis=0)
    return values, locked * np.sign(locked[most, np.arange(wanted)])


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projected(rows: DataFrame, fit: Fit, project: np.ndarray, explained: np.ndarray, error: float) -> DataFrame:
    dim, n, sums, width = fit.dim, fit.n, fit.sums, project.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, every = batch.column("vec_id"), _matrix(batch.column("x"), dim)
            for at in range(0, len(every), ROWS):
                d = deviations(every[at : at + ROWS], n, sums)
                exact = d if float(np.abs(d).max(initial=0)) ** 2 * dim < 2.0**62 else d.astype(object)
                squares = (exact * exact).sum(axis=1)
                if squares.max() >= 2**63:
                    raise OverflowError("a deviation exceeds a long")
                which = np.repeat(np.arange(at, at + len(d)), width)
                out = [ids.take(pa.array(which)), np.tile(np.arange(1, width + 1, dtype=np.int32), len(d)), np.full(len(which), n), np.repeat(squares.astype(np.int64), width), ((d / n) @ project).ravel(), np.tile(explained, len(d)), np.full(len(which), error)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return rows.transform(c.in_arrow, run, _SCHEMA)


def whitened(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row (vec_id, x) and component."""
    vectors = c.settle(rows.select("x").distinct(), "fit")
    out = rows.sparkSession.createDataFrame([], _SCHEMA)
    for (dim,) in vectors.select(F.size("x").alias("dim")).distinct().orderBy("dim").collect():  # a row for each length
        fit = Fit(vectors.where(F.size("x") == dim), dim)
        values, axes = eigenpairs(fit.product, dim, components)
        there = values > dim * _EPS * values[0]
        if there.any():
            project = axes[:, there] / np.sqrt(values[there])
            part = _projected(rows.where(F.size("x") == dim), fit, project, values[there] / fit.trace(), fit.identity_error(project))
            out = out.unionByName(part)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(shifted(c.table(spark, sf_dir, "embeddings")))
