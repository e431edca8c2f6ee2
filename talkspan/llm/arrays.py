"""Whole texts as flat arrays: what the text scanning operators share.

A task receives Arrow batches and works on blocks: consecutive rows with at most `BLOCK` bytes of text, or one longer
row. The texts of a block stand behind each other in one byte array, each closed by a newline byte, so a scan is a
few array steps over the block however many rows it holds. Temporary arrays are bounded by the block, not by the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BLOCK = 1 << 20
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_LIMIT = 16 << 20
_STEP = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

Kernel = Callable[[pa.RecordBatch], dict]


def arrow_map(df: DataFrame, kernel: Kernel, fields: list[T.StructField], keep: list[str] | None = None,
              text: str | None = "text") -> DataFrame:
    """`df` with the columns `fields` that `kernel` works out from a slice of rows.

    `keep` names the columns of `df` that stay (default: all). An input column that carries the name of a new one is
    replaced by it. `text` names the column by whose bytes batches are cut into slices.
    """
    new = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name not in new and (keep is None or f.name in keep)]
    schema = T.StructType(kept + fields)
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = arrow or to_arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, text):
                made = kernel(part)
                columns = [
                    made[f.name] if f.name in made else part.column(part.schema.get_field_index(f.name)) for f in arrow
                ]
                columns = [
                    (c if isinstance(c, pa.Array) else pa.array(c)).cast(f.type) for c, f in zip(columns, arrow)
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            made = columns = part = batch = None
        given_back()

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def given_back() -> None:
    """Free memory of this worker goes back to the machine. Workers outlive their tasks, and what one stage has freed would
    count against the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim is not None:
        trim(0)


def bounded_batches(spark) -> None:
    """Arrow batches also end by bytes, so that rows with long texts do not gather in one batch."""
    if int(spark.conf.get(ARROW_BYTES).rstrip("b")) > ARROW_LIMIT:
        spark.conf.set(ARROW_BYTES, str(ARROW_LIMIT))


def slices(batch: pa.RecordBatch, text: str | None, limit: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with at most `limit` bytes of text, one row at least."""
    if text is None or batch.num_rows == 0:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


@dataclass
class Block:
    """The bytes of some texts, each closed by a newline byte; `starts` has n + 1 entries."""

    data: np.ndarray
    starts: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Set flags of each text."""
        return np.add.reduceat(flags, self.starts[:-1], dtype=np.int64) if self.n else np.zeros(0, np.int64)

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that a byte position belongs to."""
        return np.searchsorted(self.starts, positions, "right") - 1


def block_of(texts: pa.Array) -> Block:
    large = pa.large_string()
    joined = pc.binary_join_element_wise(texts.cast(large), pa.scalar("", large), pa.scalar("\n", large))
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    buffer = joined.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
    return Block(data, offsets - offsets[0] if len(joined) else np.zeros(1, np.int64))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A flag per byte value; ranges are inclusive."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    change = np.flatnonzero(padded[1:] != padded[:-1])
    return change[::2], change[1::2]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base & _MASK, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)


_BASE = 0xD6E8FEB86659FD93
_UP, _DOWN = _powers(_BASE, _STEP), _powers(pow(_BASE, -1, 1 << 64), _STEP)


def value_table(n: int = 256) -> np.ndarray:
    """A fixed random 64-bit value for each symbol."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64)) * np.uint64(_ODD))


def span_hashes(values: np.ndarray, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each span of `symbols`, by differences of one running sum worked out in steps."""
    points = np.concatenate([starts, ends])
    order = np.argsort(points, kind="stable")
    ranked = points[order]
    sums = np.zeros(len(points), np.uint64)
    total, scale = np.uint64(0), 1
    with np.errstate(over="ignore"):
        for at in range(0, len(symbols), _STEP):
            part = symbols[at : at + _STEP]
            running = np.cumsum(values[part] * _UP[: len(part)])
            a, b = np.searchsorted(ranked, (at, at + len(part)), "right")
            sums[order[a:b]] = total + np.uint64(scale) * running[ranked[a:b] - at - 1]
            total = total + np.uint64(scale) * running[-1]
            scale = scale * pow(_BASE, _STEP, 1 << 64) & _MASK
        down = pow(pow(_BASE, -1, 1 << 64), _STEP, 1 << 64)
        coarse = _powers(down, len(symbols) // _STEP + 1)
        n = len(starts)
        shift = _DOWN[starts % _STEP] * coarse[starts // _STEP]
        return mixed((sums[n:] - sums[:n]) * shift + (ends - starts).astype(np.uint64))


def window_hashes(items: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive items."""
    n = len(items) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= np.uint64(_BASE)
            out += items[k : k + n]
    return mixed(out)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the positions inside any of the spans."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change)[:n] > 0


def list_array(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths over flat values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)
