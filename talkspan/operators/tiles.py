"""Cosines of rows with any number of topics, as products of blocks of rows and tiles of topics.

Rows are dealt to blocks by the hash of their key, topics to tiles by their number, and a task multiplies one block by
one tile. A row is copied once per tile, not once per topic, a topic once per block. `similarities` has one row per pair;
`top_topics` returns the k best of each row with their softmax over all topics. It moves rows and topics by the
`ROWS_TOGETHER` and `TOPICS_TOGETHER`, multiplies those block by tile in the task, and moves k rows and two sums for each
such piece: up to `TOPICS_TOGETHER` topics a row moves once.

Keys identify rows. A vector that is null, or zero, has cosine 0 with everything; nulls inside a vector count as 0.
Topics without a number, or with one outside 0..n_topics-1, are left out. Without rows or topics nothing is returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.functions import vectors as vx
from talkspan.operators.scoring import cosine_rows, list_matrix

PAIRS_IN_TASK = 1 << 20  # rows that one product may return
ROWS_IN_BLOCK = 8_192
TOPICS_IN_TILE = 4_096
ROWS_TOGETHER = 16_384  # rows that move together, where only the best of a product are returned: several blocks
TOPICS_TOGETHER = 32_768  # the same of topics: several tiles
LEAST_PIECES = 16  # pieces that rows are dealt to if they have that many blocks, so that few rows keep more than one task busy
NUMBERS_AT_ONCE = 1 << 20  # of a product in memory, where only its best are returned
PLACES = 1e9  # cosines are compared after rounding to nine places
OWN = ("_block", "_tile", "_topic", "_vec")


def _rows(df: DataFrame, keys: tuple[str, ...]) -> int:
    return df.select(*keys).count() if keys else 0


def _products(
    df: DataFrame,
    topics: DataFrame,
    n_topics: int,
    keys: tuple[str, ...],
    vec: str,
    in_block: int,
    in_tile: int,
    work: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], pa.Table],
    fields: list[T.StructField],
    n_rows: int | None = None,
) -> DataFrame:
    """`work(keys, vectors, unit topics, topic numbers)` for each block and tile, topics in the order of their numbers."""
    clash = {*OWN, *(f.name for f in fields)} & set(keys)
    if not keys or clash:
        raise ValueError(f"keys must be given, and not be called {sorted(clash)}")
    n_tiles = max(-(-n_topics // in_tile), 1)
    n_blocks = max(-(-(_rows(df, keys) if n_rows is None else n_rows) // in_block), 1)
    block = F.pmod(F.xxhash64(*keys), F.lit(n_blocks)).cast("int")
    left = df.select(
        *keys, F.col(vec).alias("_vec"), block.alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("_tile")
    )
    number = F.col("topic_idx")
    right = topics.where((number >= 0) & (number < n_topics)).select(
        number.cast("long").alias("_topic"),
        F.col("vec").alias("_vec"),
        F.floor(number / in_tile).cast("int").alias("_tile"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"),
    )
    schema = T.StructType([*[df.schema[k] for k in keys], *fields])
    names, key_names = schema.fieldNames(), list(keys)

    def run(rows: pa.Table, tile: pa.Table) -> pa.Table:
        key_part = rows.select(key_names)
        if rows.num_rows == 0 or tile.num_rows == 0:
            return work(key_part.slice(0, 0), np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0, np.int64))
        tile = tile.sort_by("_topic")
        widths = [len(v) for v in (next((x for x in t["_vec"] if x.is_valid), None) for t in (rows, tile)) if v is not None]
        dim = max(widths, default=1)
        out = work(
            key_part, list_matrix(rows["_vec"], dim), vx.unit_rows(list_matrix(tile["_vec"], dim)), tile["_topic"].to_numpy()
        )
        return out.select(names)

    dealt = left.groupBy("_block", "_tile").cogroup(right.groupBy("_block", "_tile"))
    return dealt.applyInArrow(run, schema)


def similarities(
    df: DataFrame, topics: DataFrame, n_topics: int, *keys: str, vec: str = "vec", in_block: int = 1_024, in_tile: int = 1_024
) -> DataFrame:
    """`keys, topic_idx, sim` for every row and topic (`topic_idx, vec`)."""
    if in_block * in_tile > PAIRS_IN_TASK:
        raise ValueError(f"a product returns at most {PAIRS_IN_TASK} rows")

    def work(rows: pa.Table, vecs: np.ndarray, unit: np.ndarray, numbers: np.ndarray) -> pa.Table:
        here = np.repeat(np.arange(len(vecs)), len(numbers))
        sims = cosine_rows(vecs, unit).ravel() if len(vecs) else np.zeros(0)
        out = rows.take(pa.array(here))
        out = out.append_column("topic_idx", pa.array(np.tile(numbers, len(vecs)).astype(np.int32)))
        return out.append_column("sim", pa.array(sims))

    fields = [T.StructField("topic_idx", T.IntegerType()), T.StructField("sim", T.DoubleType())]
    return _products(df, topics, n_topics, keys, vec, in_block, in_tile, work, fields)


def _best(sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, in no order: by nine decimal places, then the first."""
    n = sims.shape[1]
    if k >= n:
        return np.tile(np.arange(n), (len(sims), 1))
    order = np.floor(sims * PLACES + 0.5).astype(np.int64) * n + (n - 1 - np.arange(n))
    return np.argpartition(order, n - k, axis=1)[:, n - k :]


def _tile(sims: np.ndarray, numbers: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each row: the largest cosine, the sum of exponentials below it, the k best and their topics."""
    most = sims.max(axis=1)
    best = _best(sims, min(k, len(numbers)))
    return most, np.exp(sims - most[:, None]).sum(axis=1), np.take_along_axis(sims, best, axis=1), numbers[best]


def _joined(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """What `_tile` gives for the topics of both."""
    most = np.maximum(one[0], two[0])
    total = one[1] * np.exp(one[0] - most) + two[1] * np.exp(two[0] - most)
    near, at = (np.concatenate([x, y], axis=1) for x, y in zip(one[2:], two[2:]))
    best = np.lexsort((at, -np.floor(near * PLACES + 0.5)), axis=1)[:, :k]
    return most, total, np.take_along_axis(near, best, axis=1), np.take_along_axis(at, best, axis=1)


def top_topics(
    df: DataFrame,
    topics: DataFrame,
    n_topics: int,
    k: int,
    *keys: str,
    vec: str = "vec",
    in_block: int = ROWS_IN_BLOCK,
    in_tile: int = TOPICS_IN_TILE,
) -> DataFrame:
    """`keys, rank, topic_idx, sim, p`: the k nearest topics of each row, and the softmax over the cosines with all topics.

    Cosines are compared to nine places, equal ones by topic number. Each tile gives its k best, its largest cosine and
    the sum of exponentials below it; the tiles of a row are put together by rescaling those sums to the largest of all,
    first in the task that holds neighbouring tiles, then over tasks.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")

    def work(rows: pa.Table, vecs: np.ndarray, unit: np.ndarray, numbers: np.ndarray) -> pa.Table:
        kept = min(k, len(numbers))
        most, total = np.empty(len(vecs)), np.empty(len(vecs))
        near, at = np.empty((len(vecs), kept)), np.empty((len(vecs), kept), np.int32)
        tiles = np.flatnonzero(np.diff(numbers // in_tile)) + 1
        edges = [0, *tiles.tolist(), len(numbers)] if len(numbers) else [0]
        step = max(min(NUMBERS_AT_ONCE // max(np.diff(edges).max(initial=1), 1), in_block), 1)
        for i in range(0, len(vecs), step):
            some, parts = slice(i, i + step), None
            for a, b in zip(edges, edges[1:]):
                one = _tile(cosine_rows(vecs[some], unit[a:b]), numbers[a:b], k)
                parts = one if parts is None else _joined(parts, one, k)
            most[some], total[some], near[some], at[some] = parts
        offsets = pa.array(np.arange(len(vecs) + 1, dtype=np.int32) * np.int32(kept))
        out = rows
        for name, column in (("most", pa.array(most)), ("total", pa.array(total))):
            out = out.append_column(name, column)
        out = out.append_column("at", pa.ListArray.from_arrays(offsets, pa.array(at.ravel())))
        return out.append_column("near", pa.ListArray.from_arrays(offsets, pa.array(near.ravel())))

    fields = [
        T.StructField("most", T.DoubleType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("at", T.ArrayType(T.IntegerType())),
        T.StructField("near", T.ArrayType(T.DoubleType())),
    ]
    n_rows = _rows(df, keys)
    rows_together = max(min(ROWS_TOGETHER, -(-n_rows // LEAST_PIECES)), in_block)
    topics_together = max(TOPICS_TOGETHER // in_tile, 1) * in_tile
    tiles = _products(df, topics, n_topics, keys, vec, rows_together, topics_together, work, fields, n_rows)
    pairs = F.zip_with(
        "at",
        "near",
        lambda t, s: F.struct((-F.floor(s * PLACES + 0.5)).alias("neg"), t.alias("topic_idx"), s.alias("sim")),
    )
    rows = tiles.groupBy(*keys).agg(
        F.max("most").alias("top"),
        F.array_sort(F.collect_list(F.struct(F.col("at")[0].alias("tile"), "most", "total"))).alias("parts"),
        F.flatten(F.collect_list(pairs)).alias("found"),
    )
    weight = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["total"] * F.exp(x["most"] - F.col("top")))
    ranked = rows.select(*keys, "top", weight.alias("weight"), F.posexplode(F.slice(F.array_sort("found"), 1, k)).alias("r", "x"))
    return ranked.select(
        *keys, (F.col("r") + 1).alias("rank"), "x.topic_idx", "x.sim", (F.exp(F.col("x.sim") - F.col("top")) / F.col("weight")).alias("p")
    )
