"""Embedding whitening by spectrum slicing.

The covariance of all vectors is summed exactly in integers by Spark; what goes on in the driver depends on the number of
dimensions alone. There the number of eigenvalues above a shift is the number of positive pivots of an LDL' factorisation
of the shifted covariance, so halving intervals isolates each leading eigenvalue. Rayleigh quotient iteration converges
on it cubically, and counts on both sides of the result certify that it has the number that it is given."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = 2.0**53  # whole numbers up to here are exact as doubles
ROWS = 2048  # vectors that a task works on at once
EPS = float(np.finfo(float).eps)


class Factor:
    """LDL' of a symmetric matrix with Bunch-Kaufman pivoting: its inertia, and solutions of linear systems."""

    def __init__(self, matrix: np.ndarray) -> None:
        a = np.array(matrix, float)
        n = len(a)
        self.lower, self.perm, self.blocks = np.eye(n), np.arange(n), []
        self.tiny = EPS * max(np.abs(a).max(initial=0.0), 1e-250)
        alpha, k = (1 + 17**0.5) / 8, 0
        while k < n:
            size, pivot = self._pivot(a, k, alpha)
            last = k + size - 1
            if pivot != last:
                order = np.arange(n)
                order[[last, pivot]] = order[[pivot, last]]
                a = a[np.ix_(order, order)]
                self.perm = self.perm[order]
                self.lower[[last, pivot], :k] = self.lower[[pivot, last], :k]
            block = a[k : k + size, k : k + size].copy()
            if size == 1 and abs(block[0, 0]) < self.tiny:
                block[0, 0] = -self.tiny  # an eigenvalue at the shift counts as not above it
            under = a[k + size :, k : k + size]
            factor = np.linalg.solve(block, under.T).T
            self.lower[k + size :, k : k + size] = factor
            a[k + size :, k + size :] -= factor @ under.T
            self.blocks.append((k, block))
            k += size

    @staticmethod
    def _pivot(a: np.ndarray, k: int, alpha: float) -> tuple[int, int]:
        """Size of the next pivot block, and the row to bring to its end."""
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        if abs(a[k, k]) >= alpha * most:
            return 1, k
        r = k + 1 + int(below.argmax())
        row = np.abs(a[r, k:])
        row[r - k] = 0
        widest = row.max()
        if abs(a[k, k]) * widest >= alpha * most**2:
            return 1, k
        if abs(a[r, r]) >= alpha * widest:
            return 1, r
        return 2, r

    def positive(self) -> int:
        """Eigenvalues above 0, by Sylvester's law of inertia; a block of two has one on each side."""
        return sum(1 if len(b) == 2 else int(b[0, 0] > 0) for _, b in self.blocks)

    def solve(self, right: np.ndarray) -> np.ndarray:
        x = right[self.perm].astype(float)
        n = len(x)
        for i in range(n):
            x[i] -= self.lower[i, :i] @ x[:i]
        for k, block in self.blocks:
            x[k : k + len(block)] = np.linalg.solve(block, x[k : k + len(block)])
        for i in reversed(range(n)):
            x[i] -= self.lower[i + 1 :, i] @ x[i + 1 :]
        out = np.empty(n)
        out[self.perm] = x
        return out


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are above a shift."""
    return Factor(matrix - shift * np.eye(len(matrix))).positive()


def slice_spectrum(matrix: np.ndarray, most: int) -> list[tuple[float, float, int]]:
    """Disjoint intervals (low, high, eigenvalues in it), from the top, that hold the leading eigenvalues.

    Each holds one, but for eigenvalues too close for the arithmetic to part."""
    radius = np.abs(matrix).sum(1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - radius).min()), float((np.diag(matrix) + radius).max())
    close = 64 * EPS * max(abs(low), abs(high), 1e-300)
    found, todo, over = [], [(low - close, high + close, len(matrix), 0)], 0
    while todo and over < most:
        a, b, n_a, n_b = todo.pop()  # n_a eigenvalues above a
        if n_a == n_b:
            continue
        if b - a <= close or (n_a - n_b == 1 and b - a <= 0.25 * max(abs(a), abs(b))):
            found.append((a, b, n_a - n_b))
            over = n_a
            continue
        middle = (a + b) / 2
        n = above(matrix, middle)
        todo += [(a, middle, n_a, n), (middle, b, n, n_b)]
    return found


def _apart(x: np.ndarray, from_: list[np.ndarray]) -> np.ndarray:
    """x without what it has of unit vectors, as a unit vector; twice, for rounding."""
    for _ in range(2):
        x = x / np.abs(x).max()
        for v in from_:
            x = x - (v @ x) * v
        x = x / np.linalg.norm(x)
    return x


def isolated(matrix: np.ndarray, low: float, high: float, known: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """The eigenvalue between low and high, which holds one, and its unit vector, by Rayleigh quotient iteration.

    Inverse iteration at the middle gives the start; should the iteration leave the interval, counts halve it first."""
    unit, n = np.eye(len(matrix)), len(matrix)
    norm = float(np.abs(matrix).sum(1).max())
    top = above(matrix, high)
    for _ in range(80):
        middle = (low + high) / 2
        factor = Factor(matrix - middle * unit)
        x = _apart(np.cos(np.arange(1, n + 1) ** 2.0) + 1e-3, known)
        for _ in range(3):
            x = _apart(factor.solve(x), known)
        value = float(x @ matrix @ x)
        for _ in range(12):
            if np.linalg.norm(matrix @ x - value * x) <= 4 * EPS * norm or not low <= value <= high:
                break
            x = _apart(Factor(matrix - value * unit).solve(x), known)
            value = float(x @ matrix @ x)
        left = np.linalg.norm(matrix @ x - value * x)
        if low <= value <= high and left <= 1e3 * EPS * norm:
            return value, x
        if factor.positive() > top:
            low = middle
        else:
            high = middle
    raise ArithmeticError("an eigenvalue could not be isolated")


def clustered(matrix: np.ndarray, low: float, high: float, n: int, known: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
    """n eigenvalues that the arithmetic cannot part, and orthogonal vectors of their space, by inverse iteration of a block."""
    factor = Factor(matrix - (low + high) / 2 * np.eye(len(matrix)))
    block: list[np.ndarray] = []
    for i in range(n):
        x = _apart(np.cos((i + 2) * np.arange(1, len(matrix) + 1) ** 2.0) + 1e-3, [*known, *block])
        for _ in range(4):
            x = _apart(factor.solve(x), [*known, *block])
        block.append(x)
    space = np.stack(block, 1)
    values, turn = np.linalg.eigh(space.T @ matrix @ space)  # n by n
    return [(float(values[i]), space @ turn[:, i]) for i in reversed(range(n))]


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; each certified by counts.

    Eigenvalues that rounding cannot tell from 0 are left out."""
    pairs: list[tuple[float, np.ndarray]] = []
    size = float(np.abs(matrix).sum(1).max(initial=0.0))
    margin = 256 * EPS * size
    for low, high, n in slice_spectrum(matrix, most) if size else []:
        known = [v for _, v in pairs]
        pairs += [isolated(matrix, low, high, known)] if n == 1 else clustered(matrix, low, high, n, known)
    pairs = [p for p in sorted(pairs, key=lambda p: -p[0]) if p[0] > margin][:most]
    for i, (value, _) in enumerate(pairs):
        if above(matrix, value + margin) > i or above(matrix, value - margin) <= i:
            raise ArithmeticError(f"the eigenvalue given number {i + 1} is not that one")
    vectors = np.stack([v for _, v in pairs], 1) if pairs else np.zeros((len(matrix), 0))
    return np.array([v for v, _ in pairs]), vectors


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    bad = F.exists(vector, lambda c: F.coalesce(F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")), F.lit(True)))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def scaled(rows: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """id and x, the whole numbers floor(scale * c) + offset of each usable vector."""
    whole = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset).cast("long"))
    return rows.where(usable(F.col(vector_col))).select(F.col(id_col).alias("id"), whole.alias("x"))


def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches (id, x) and their vectors as rows of long numbers."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False)
            yield part, x.reshape(part.num_rows, -1)


def exact_product(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers, exactly, as Python numbers: by floating point in slices that stay exact, if there are such."""
    top = int(np.abs(y).max(initial=0))
    rows = int(EXACT // max(top, 1) ** 2)
    if not rows:
        z = y.astype(object)
        return z.T @ z
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), rows):
        z = y[at : at + rows].astype(float)
        total += (z.T @ z).astype(np.int64).astype(object)
    return total


def _summed(partial: DataFrame, keys: list[str]) -> list:
    """Partial sums by task, added up by Spark; as many rows as there are keys, which follow from the dimensions."""
    return partial.groupBy(*keys).agg(F.sum("value").alias("value")).collect()


def sums(xs: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, exactly. Vectors must have one length; see `of_one_length`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for _, x in matrices(batches):
            n += len(x)
            own = x.astype(object).sum(0) if np.abs(x).max(initial=0) > 2**50 else x.sum(0).astype(object)
            total = own if total is None else total + own
        if n:
            values = [Decimal(n), *map(Decimal, total.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(values) - 1), pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["dim", "value"])

    found = {r["dim"]: int(r["value"]) for r in _summed(xs.mapInArrow(add, "dim int, value decimal(38,0)"), ["dim"])}
    return found.get(-1, 0), [found[i] for i in range(len(found) - 1)]


def covariance(xs: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """Covariance of all vectors, divisor n. They are centred on whole numbers next to the mean before they are multiplied, so every sum is exact."""
    centre = np.array([(2 * s + n) // (2 * n) for s in total])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = None
        for _, x in matrices(batches):
            own = exact_product(x - centre)
            both = own if both is None else both + own
        if both is not None:
            i, j = np.triu_indices(len(centre))
            values = pa.array([Decimal(v) for v in both[i, j]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), values], ["i", "j", "value"])

    out = np.zeros((len(total), len(total)))
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]
    for r in _summed(xs.mapInArrow(multiply, "i int, j int, value decimal(38,0)"), ["i", "j"]):
        i, j = r["i"], r["j"]
        out[i, j] = out[j, i] = (n * int(r["value"]) - rest[i] * rest[j]) / (n * n)  # of whole numbers, rounded once
    return out


def projected(xs: DataFrame, n: int, total: list[int], matrix: np.ndarray, kind: str) -> DataFrame:
    """id, deviation (exact: the sum over dimensions of (n x - S)^2) and the whitened components as an array."""
    centre = np.array([(2 * s + n) // (2 * n) for s in total])
    rest = [s - n * int(c) for s, c in zip(total, centre, strict=True)]  # n x - S is n (x - centre) - rest
    shift = np.array([r / n for r in rest])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in matrices(batches):
            y = x - centre
            top = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest), default=0)
            whole = n * (y if top**2 * y.shape[1] < 2**63 else y.astype(object)) - np.array(rest, np.int64 if top < 2**63 else object)
            far = pa.array([Decimal(int(v)) for v in (whole * whole).sum(1)], pa.decimal128(38, 0))
            white = (y - shift) @ matrix
            lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, max(matrix.shape[1], 1))[: len(white) + 1] if matrix.shape[1] else np.zeros(len(white) + 1, np.int32), white.ravel())
            yield pa.RecordBatch.from_arrays([part.column(0), far, lists], ["id", "deviation", "whitened"])

    return xs.mapInArrow(project, f"id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, n: int, width: int) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity, from the vectors themselves."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for _, z in matrices(batches):
            z = np.hstack((z, np.ones((len(z), 1))))
            total += z.T @ z
        i, j = np.triu_indices(width + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "value"])

    both = np.zeros((width + 1, width + 1))
    for r in _summed(white.select("id", "whitened").mapInArrow(multiply, "i int, j int, value double"), ["i", "j"]):
        both[r["i"], r["j"]] = both[r["j"], r["i"]] = r["value"]
    mean = both[:width, width] / n
    return float(np.abs(both[:width, :width] / n - np.outer(mean, mean) - np.eye(width)).max())


def whiten(
    rows: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Whitened leading components of every usable vector, fitted on all of them.

    One row for each vector and component: id_col, component (from 1, by falling eigenvalue), n (vectors), deviation
    (decimal), whitened, explained (the eigenvalue's share of the trace) and identity_error. Entries c are taken as
    floor(scale * c) + offset. Null vectors, empty ones, and those that hold null, NaN or an infinite entry take no part,
    nor do vectors of another length than most have (of equally common lengths, the longer). Fewer components come out
    where fewer dimensions vary, and none if all vectors are equal or none is left. Repeated rows count as often as they
    occur; ids may be null. Other columns of rows do not matter. A number too large for a long ends the job."""
    kind = rows.schema[id_col].dataType.simpleString()
    xs = scaled(rows, id_col, vector_col, scale, offset)
    schema = f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = xs.groupBy(F.size("x").alias("d")).count().agg(F.max_by("d", F.struct("count", "d")).alias("d")).first()["d"]
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    xs = xs.where(F.size("x") == lengths)
    n, total = sums(xs)
    cov = covariance(xs, n, total)
    values, vectors = leading(cov, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    white = projected(xs, n, total, vectors / np.sqrt(values), kind)
    error = identity_error(white, n, len(values))
    share = F.element_at(F.array(*[F.lit(float(v)) for v in values / np.trace(cov)]), F.col("_i") + 1)
    out = white.select("id", "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    return out.select(
        F.col("id").alias(id_col), (F.col("_i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        share.alias("explained"), F.lit(error).alias("identity_error"),
    )
