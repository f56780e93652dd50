"""Whitening of embeddings onto leading components that are found by slicing the spectrum of their covariance.

Entries become whole numbers, so that equal vectors are equal to the bit: the fit list is each distinct vector once. Its
sums are exact, and its covariance adds up products of centred entries inside tasks and then by rows of the matrix.

The covariance is one small matrix. How many of its eigenvalues lie above a number is the number of positive pivots of the
L D L' factors of the matrix shifted by it (Sylvester's law). Bisection by such counts isolates each leading eigenvalue; Rayleigh
quotient iteration then converges on its vector, and is taken if the quotient, give or take its residual, lies in the isolated
interval: so the counts vouch for the component's number. Eigenvalues that no bisection can part (ties) are solved as a block.

Scale: one shuffle, of the distinct vectors; every other pass adds up at most a matrix for each task. The driver holds matrices
of (dimensions x dimensions); with very wide vectors (thousands of entries) it, and not the number of rows, sets the limit.

Components have a positive eigenvalue (above 1e-11 of the trace): of a list without spread, or of fewer distinct vectors than
components, only those are given, and a list of one vector has none. Nulls: a null vector, or one with a null, infinite or
undefined entry, takes no part; an id may be null or repeated. A shorter vector counts as filled up with zeros. Tied
eigenvalues give any orthonormal vectors of their space, the same for all rows. An empty table gives no rows. Further columns
stay out, whatever their names.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matrix import lists_of, matrix_sum
from ..functions.shared import keep
from .vectors import usable

SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues below this part of the trace count as none.
LEAST = 1e-11
#: Intervals below this part of the matrix's norm aren't parted further: what they hold is solved as a block.
TIED = 1e-10


def whole(column: str = "embedding") -> Column:
    """floor(64 c) + 1,000,000 of each entry c."""
    return F.transform(column, lambda c: F.floor(SCALE * c.cast("double")) + OFFSET)


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` lie above ``shift``: the positive pivots of L D L' = v - shift.

    Pivots are of one or two rows, the largest entries deciding (Bunch and Kaufman), so that factors of an indefinite matrix stay small.
    """
    a, k, found = v - shift * np.eye(len(v)), 0, 0
    ratio = (1 + np.sqrt(17)) / 8
    while k < len(a):
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        width, swap = 1, k
        if most > 0 and abs(a[k, k]) < ratio * most:
            r = k + 1 + int(below.argmax())
            other = np.abs(a[k:, r])
            other[r - k] = 0
            if abs(a[k, k]) * other.max() < ratio * most**2:
                width, swap = (1, r) if abs(a[r, r]) >= ratio * other.max() else (2, r)
        to = k + width - 1
        if swap != to:
            a[[to, swap]] = a[[swap, to]]
            a[:, [to, swap]] = a[:, [swap, to]]
        rest = slice(k + width, None)
        if width == 1:
            pivot = a[k, k]
            found += pivot > 0
            if pivot:
                a[rest, rest] -= np.outer(a[rest, k], a[rest, k] / pivot)
        else:
            block = a[k : k + 2, k : k + 2]
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            found += 1 if det < 0 else 2 * (block[0, 0] > 0)
            inverse = np.array([[block[1, 1], -block[0, 1]], [-block[0, 1], block[0, 0]]]) / det
            a[rest, rest] -= a[rest, k : k + 2] @ inverse @ a[rest, k : k + 2].T
        k += width
    return int(found)


class Slices:
    """Counts of eigenvalues above the shifts tried so far, in order, and intervals between them."""

    def __init__(self, v: np.ndarray):
        self.v, self.norm = v, float(np.abs(v).sum(axis=1).max(initial=0.0))
        self.shifts = [(-self.norm - 1, len(v)), (self.norm * (1 + 1e-9) + 1e-300, 0)]

    def around(self, j: int) -> tuple[tuple[float, int], tuple[float, int]]:
        """The narrowest tried interval that holds the j-th largest eigenvalue: (low, count above) and (high, count above)."""
        return max(x for x in self.shifts if x[1] >= j), min(x for x in self.shifts if x[1] < j)

    def halve(self, j: int) -> None:
        (low, _), (high, _) = self.around(j)
        middle = (low + high) / 2
        insort(self.shifts, (middle, above(self.v, middle)))


def _solve(v: np.ndarray, shift: float, y: np.ndarray, norm: float) -> np.ndarray:
    """(v - shift)^-1 y at length 1, a step aside where the matrix is singular."""
    for aside in (0.0, 1e-15, 1e-13):
        try:
            x = np.linalg.solve(v - (shift + aside * norm) * np.eye(len(v)), y)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(x).all():
            return np.linalg.qr(x)[0] if x.ndim > 1 else x / np.linalg.norm(x)
    return y


def _quotient(v: np.ndarray, start: float, norm: float, random: np.random.Generator) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from two inverse steps at ``start``: eigenvalue, vector, residual."""
    y = random.standard_normal(len(v))
    for _ in range(2):
        y = _solve(v, start, y, norm)
    value, residual = float(y @ v @ y), np.inf
    for _ in range(12):
        x = _solve(v, value, y, norm)
        new = float(x @ v @ x)
        left = float(np.linalg.norm(v @ x - new * x))
        if left >= residual / 2 and residual <= 1e-12 * norm:
            break
        y, value, residual = x, new, left
    return value, y, residual


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, with unit vectors as columns; only those above ``LEAST`` of the trace."""
    slices, random = Slices(v), np.random.default_rng(13)
    cut = LEAST * float(np.trace(v))
    k = min(k, above(v, cut)) if cut > 0 else 0
    values, vectors = np.zeros(k), np.zeros((len(v), k))
    j = 1
    while j <= k:
        (low, upto), (high, before) = slices.around(j)
        if upto - before == 1:
            value, y, residual = _quotient(v, (low + high) / 2, slices.norm, random)
            if residual <= 1e-11 * slices.norm and low < value - residual and value + residual < high:
                values[j - 1], vectors[:, j - 1] = value, y
                j += 1
                continue
        if high - low > TIED * slices.norm:
            slices.halve(j)
            continue
        y = random.standard_normal((len(v), upto - before))
        for _ in range(4):
            y = _solve(v, (low + high) / 2, y, slices.norm)
        inside, turn = np.linalg.eigh(y.T @ v @ y)
        take = slice(before, min(upto, k))
        values[take], vectors[:, take] = inside[::-1][: k - before], (y @ turn)[:, ::-1][:, : k - before]
        j = upto + 1
    if k:  # neighbours that nearly tie are square to each other only about as well as they are parted
        square, r = np.linalg.qr(vectors)
        vectors = square * np.sign(np.diag(r))
    return values, vectors


@dataclass
class Whitening:
    """Distinct vectors, their sums, eigenvalues and vectors of their covariance, its trace, and how far whitened rows are from the identity."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def turn(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, from the exact n x - S."""
        return (self.n * x - self.sums) / self.n


def _ints(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of whole numbers; a shorter one is filled up with what an entry of 0 gives."""
    flat, size = np.asarray(column.flatten(), np.int64), np.asarray(column.value_lengths(), np.int64)
    out = np.full((len(size), width), OFFSET, np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def fit(rows: DataFrame, k: int = 16, column: str = "embedding") -> Whitening:
    """The whitening of the distinct vectors of ``rows``."""
    distinct = keep(rows.filter(usable(column)).select(whole(column).alias("x")).distinct())
    n, width, least = distinct.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min(F.size("x"))).first()
    width = width or 0
    if n and least < width:  # filled up, some may be equal
        filled = F.concat("x", F.array_repeat(F.lit(OFFSET).cast("long"), width - F.size("x")))
        distinct = keep(distinct.select(filled.alias("x")).distinct())
        n = distinct.count()
    if not n or not width:
        return Whitening(n, np.zeros(width, np.int64), np.zeros(0), np.zeros((width, 0)), 0.0)
    sums = np.zeros(width, np.int64)
    for r in distinct.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s")).collect():
        sums[r["i"]] = r["s"]
    model = Whitening(n, sums, np.zeros(0), np.zeros((width, 0)), 0.0)

    def products(b: pa.RecordBatch) -> np.ndarray:
        c = model.centred(_ints(b["x"], width))
        return c.T @ c

    v = matrix_sum(distinct, products, (width, width)) / n
    values, vectors = leading((v + v.T) / 2, k)
    model = Whitening(n, sums, values, vectors, float(np.trace(v)))
    if not len(values):
        return model

    def whitened(b: pa.RecordBatch) -> np.ndarray:
        z = model.centred(_ints(b["x"], width)) @ model.turn
        return np.vstack([z.T @ z, z.sum(axis=0)])

    own = matrix_sum(distinct, whitened, (len(values) + 1, len(values))) / n
    model.identity_error = float(np.abs(own[:-1] - np.outer(own[-1], own[-1]) - np.eye(len(values))).max())
    return model


def whiten(rows: DataFrame, model: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, deviation, whitened (one entry per component) of every row with a usable vector.

    A vector of the rows may not be longer than the fitted ones. A deviation beyond 64 bits is an error.
    """
    sent, width = rows.sparkSession.sparkContext.broadcast(model), len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            x = _ints(b["x"], width)
            apart = m.n * x - m.sums
            if len(x) and (apart.astype(float) ** 2).sum(axis=1).max(initial=0.0) >= 2.0**63:
                raise ArithmeticError("a deviation exceeds 64 bits")
            yield pa.RecordBatch.from_arrays([b[key], pa.array((apart * apart).sum(axis=1)), lists_of((apart / m.n) @ m.turn)], names=[key, "deviation", "whitened"])

    kind = rows.schema[key].dataType.simpleString()
    found = rows.filter(usable(column)).select(key, whole(column).alias("x"))
    return found.mapInArrow(run, f"{key} {kind}, deviation long, whitened array<double>")
