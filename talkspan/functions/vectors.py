"""Vector expressions.

Vectors are `array<bigint>` in fixed point (1e6 per unit). Integer sums do not depend on the order
in which a shuffle delivers rows, so hour and block vectors are the same on every run and cluster.
Cosines are scale free, which makes the fixed-point factor invisible in every score.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000
UNROLLED = 64


def fixed_point(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * float(SCALE) + F.lit(0.5)))


def fixed(value: Column, places: int) -> Column:
    """Half-up rounding by plain arithmetic, the same in every engine."""
    unit = float(10**places)
    return F.floor(value * F.lit(unit) + F.lit(0.5)) / F.lit(unit)


def sum_vectors(vec: Column, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: element-wise sum. One plain `sum` per dimension, so it combines map-side."""
    return F.array(*[F.sum(vec[i] if weight is None else vec[i] * weight) for i in range(dim)])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once, however often the body mentions it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def dot_of(a: Column, b: Column, dim: int) -> Column:
    """`dot` for a known length. Written out it compiles to plain arithmetic, which pays off when
    there are many rows; long vectors keep the array form, whose size does not grow."""
    if dim > UNROLLED:
        return dot(a, b)
    total = F.lit(0.0)
    for i in range(dim):
        total = total + a[i].cast("double") * b[i].cast("double")
    return total


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 when either vector is zero or missing."""
    return ratio(dot(a, b), norm(a) * norm(b))


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is 0 or missing."""
    return F.coalesce(num / F.nullif(den, F.lit(0.0)), F.lit(0.0))


def unit(a: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    length = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return let(length, lambda n: F.transform(a, lambda x: x.cast("double") / n))


def softmax(scores: Column) -> Column:
    """Softmax of an array of scores."""

    def weights(s: Column) -> Column:
        return let(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))

    def shares(w: Column) -> Column:
        return let(F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x), lambda t: F.transform(w, lambda x: x / t))

    return let(let(scores, weights), shares)


def matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A small constant matrix as one foldable literal."""
    body = json.dumps([[float(x) for x in row] for row in rows])
    return F.from_json(F.lit(body), "array<array<double>>")


def cosines(vec: Column, unit_rows: Column) -> Column:
    """Cosine of `vec` with every row of a constant matrix of unit (or zero) rows."""
    return let(norm(vec), lambda n: F.transform(unit_rows, lambda row: ratio(dot(vec, row), n)))


def unit_rows(rows: Sequence[Sequence[float]]) -> np.ndarray:
    """Rows scaled to length one, zero rows kept."""
    m = np.asarray(rows, dtype=np.float64)
    lengths = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(lengths == 0, 1.0, lengths)


def softmax_rows(scores: np.ndarray) -> np.ndarray:
    """Softmax along the last axis."""
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
