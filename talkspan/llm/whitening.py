"""Whitening of whole-number vectors: equal vectors are grouped, fitted by their multiplicity, whitened once and joined back.

`steps` turns embeddings into whole numbers, so that equal vectors can be found by grouping. The distinct vectors, with how
many rows each has, are written; everything numeric is about them. `fit` takes the counts (or one each) as weights: exact
sums give the centre, and a second pass multiplies centred vectors, W Z'Z, block by block, one matrix per task; the matrices
are added row by row. Eigenvectors of the d x d covariance are worked out on the driver. Each distinct vector is then
whitened once, and rows meet their vector again by a 128-bit hash.

Scale: rows with the vector of a third of all rows are one distinct vector, combined before it is moved. On the way back the
vectors with at least one in `HOT` of all rows (no more than `HOT` of them, so they are broadcast) are dealt out under several
keys. A task holds one Arrow batch and one d x d matrix; the driver gets one such matrix, whatever the number of tasks.

Defined results: a vector that is null or holds a null or non-finite entry has no rows; where vectors differ in length, those
of the length that most rows have (of equals, the longer) remain; repeated rows and null ids have rows of their own; an empty
table gives none. Components whose eigenvalue is below `LEAST_SHARE` of the largest are left out: nothing varies along them.
Sums that pass 64 bits are worked out with Python's whole numbers, and a deviation that does not fit into a long is an error.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar
from talkspan.llm import store

COMPONENTS = 32
HOT = 1000
LEAST_SHARE = 1e-10
_LARGE = 1 << 62


def steps(rows: DataFrame, vector: str = "embedding", scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """`rows` with `x`: floor(scale * entry) + offset for each entry; rows without a whole vector are left out."""
    c = F.col(vector)
    sound = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(math.inf)))
    x = F.transform(c, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long") + F.lit(offset))
    return rows.where(c.isNotNull() & (F.size(c) > 0)).where(sound).withColumn("x", x)


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """`high, low, x, weight`: the different vectors of column `x`, their hash, and how many rows have each."""
    found = rows.groupBy("x").agg(F.count(F.lit(1)).alias("weight"))
    found = store.written(found.select(*_hash(), "x", "weight"), "distinct-vectors")
    sizes = found.groupBy(F.size("x").alias("d")).agg(F.sum("weight").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return found if most is None else found.where(F.size("x") == most["d"])


def _hash():
    return F.xxhash64(F.lit(1), "x").alias("high"), F.xxhash64(F.lit(2), "x").alias("low")


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(column))
    return lists.flatten().to_numpy(False).reshape(batch.num_rows, -1)


def _weights(batch: pa.RecordBatch, by_rows: bool) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("weight")).to_numpy(False) if by_rows else np.ones(batch.num_rows, np.int64)


@dataclass(frozen=True)
class Centre:
    """`sums` of `n` vectors: exact whole numbers, or numbers with a fraction."""

    n: int
    sums: list

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as the nearest whole numbers and the rest, so that whole numbers are centred without loss."""
        if isinstance(self.sums[0], int):
            near = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
            return np.array(near), np.array([(s - q * self.n) / self.n for s, q in zip(self.sums, near)])
        mean = np.array(self.sums) / self.n
        return np.zeros(len(mean), np.int64), mean


def centre(vectors: DataFrame, column: str, by_rows: bool = True) -> Centre:
    """Weighted sums of a column of equally long vectors."""
    whole = isinstance(vectors.schema[column].dataType.elementType, T.LongType)
    kind = "decimal(38,0)" if whole else "double"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, w = _matrix(batch, column), _weights(batch, by_rows)
            if whole and int(np.abs(x).max()) * int(w.sum()) >= _LARGE:
                x, w = x.astype(object), w.astype(object)
            part = (x * w[:, None]).sum(axis=0)
            sums = (part.astype(object) if whole else part) if sums is None else sums + part
            n += int(w.sum())
        if n:
            values = [Decimal(int(s)) for s in (n, *sums)] if whole else [float(s) for s in (n, *sums)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(values) - 1), pa.int32()), pa.array(values, pa.decimal128(38, 0) if whole else pa.float64())],
                ["i", "s"])

    ar.bounded_batches(vectors.sparkSession)
    parts = vectors.select(column, "weight").mapInArrow(partial, f"i int, s {kind}")
    rows = sorted(parts.groupBy("i").agg(F.sum("s").alias("s")).collect())  # one row per dimension
    sums = [int(r["s"]) if whole else r["s"] for r in rows]
    return Centre(int(sums[0]), sums[1:]) if sums else Centre(0, [])


def covariance(vectors: DataFrame, column: str, at: Centre, by_rows: bool = True) -> np.ndarray:
    """The weighted covariance, divisor n, of vectors that are centred before they are multiplied."""
    near, rest = at.parts()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(near), len(near)))
        for batch in batches:
            if batch.num_rows:
                z = (_matrix(batch, column) - near).astype(np.float64) - rest
                total += (z * _weights(batch, by_rows)[:, None]).T @ z
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(near)), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())], ["i", "row"])

    def added(own: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x.as_buffer(), "<f8") for x in own.column("row")]
        row = np.array([math.fsum(v) for v in zip(*rows)])  # the same in whatever order the parts come
        return pa.table({"i": own.column("i")[:1], "row": pa.array([row.astype("<f8").tobytes()], pa.binary())})

    ar.bounded_batches(vectors.sparkSession)
    parts = vectors.select(column, "weight").mapInArrow(partial, "i int, row binary")
    rows = sorted(tuple(r) for r in parts.groupBy("i").applyInArrow(added, "i int, row binary").collect())
    return np.stack([np.frombuffer(row, "<f8") for _, row in rows]) / at.n


@dataclass(frozen=True)
class Whitening:
    """Centre, the leading eigenvalues by falling size with their unit eigenvectors as columns, and the trace."""

    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(vectors: DataFrame, components: int = COMPONENTS, by_rows: bool = True) -> Whitening | None:
    """The whitening of distinct vectors, with their counts (or one each) as weights; None where there are none."""
    at = centre(vectors, "x", by_rows)
    if not at.n:
        return None
    v = covariance(vectors, "x", at, by_rows)
    values, columns = np.linalg.eigh((v + v.T) / 2)
    values, columns = values[::-1], columns[:, ::-1]
    keep = np.flatnonzero(values[:components] > LEAST_SHARE * values[0])
    columns = columns[:, keep]
    top = np.abs(columns).argmax(axis=0)  # of either sign, that with a positive largest entry
    return Whitening(at, values[keep], columns * np.sign(columns[top, np.arange(len(keep))]), float(np.trace(v)))


def _deviations(x: np.ndarray, at: Centre) -> np.ndarray:
    """Sum over dimensions of (n * x - S) ** 2, exact."""
    bound = max(max(abs(int(x.max())), abs(int(x.min()))) * at.n, max(map(abs, at.sums)))
    if bound < _LARGE:
        diff = x * at.n - np.array(at.sums)
        if int(np.abs(diff).max()) ** 2 * x.shape[1] < _LARGE:
            return (diff * diff).sum(axis=1)
    diff = x.astype(object) * at.n - np.array(at.sums, object)
    out = (diff * diff).sum(axis=1)
    if max(out) >= 1 << 63:
        raise OverflowError("a deviation does not fit into 64 bits")
    return out.astype(np.int64)


def whitened_vectors(vectors: DataFrame, model: Whitening) -> DataFrame:
    """`high, low, weight, deviation, whitened` of the distinct vectors, each worked out once."""
    near, rest = model.centre.parts()
    turn = model.vectors / np.sqrt(model.values)

    def kernel(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch, "x") if batch.num_rows else np.zeros((0, len(near)), np.int64)
        out = ((x - near).astype(np.float64) - rest) @ turn
        return {"deviation": _deviations(x, model.centre) if len(x) else np.zeros(0, np.int64),
                "whitened": ar.list_array(pa.array(out.reshape(-1)), np.full(len(x), turn.shape[1]))}

    fields = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    return ar.arrow_map(vectors, kernel, fields, ["high", "low", "weight"], None)


def identity_error(found: DataFrame, by_rows: bool = True) -> float:
    """The largest absolute entry of the covariance of `whitened` minus the identity."""
    at = centre(found, "whitened", by_rows)
    v = covariance(found, "whitened", at, by_rows)
    return float(np.abs(v - np.eye(len(v))).max())


@dataclass(frozen=True)
class Whitened:
    """`rows` (the wanted columns, `deviation` and `whitened` of each row), the model, and how far from the identity the
    covariance of the whitened vectors is."""

    rows: DataFrame
    model: Whitening | None
    error: float


def whiten(rows: DataFrame, columns: list[str], components: int = COMPONENTS, by_rows: bool = True) -> Whitened:
    """Whitens the vectors `x` of all rows; `columns` of `rows` are kept."""
    vectors = distinct_vectors(rows)
    model = fit(vectors, components, by_rows)
    if model is None or not len(model.values):
        nothing = rows.where(F.lit(False)).select(
            *columns, F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
        return Whitened(nothing, model, 0.0)
    found = store.written(whitened_vectors(vectors, model), "whitened-vectors")
    return Whitened(_joined_back(rows, columns, found), model, identity_error(found, by_rows))


def _joined_back(rows: DataFrame, columns: list[str], found: DataFrame) -> DataFrame:
    n = found.agg(F.sum("weight")).first()[0]
    salts = F.greatest(F.ceil(F.col("weight") * HOT / n), F.lit(1)).cast("int").alias("salts")
    # at most HOT vectors have this share of all rows
    hot = F.broadcast(found.where(F.col("weight") * HOT >= n).select("high", "low", salts))
    kept = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    keyed = rows.select(kept, *_hash(), F.monotonically_increasing_id().alias("at")).join(hot, ["high", "low"], "left")
    salt = F.pmod(F.xxhash64("at"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    dealt = found.select("high", "low", "deviation", "whitened", F.explode(F.sequence(
        F.lit(0), F.when(F.col("weight") * HOT >= n, salts - 1).otherwise(0))).alias("salt"))
    out = keyed.select("row", "high", "low", salt).join(dealt, ["high", "low", "salt"])
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "deviation", "whitened")
