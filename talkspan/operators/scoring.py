"""Probability of every topic for a text.

Array form (`p` has one entry per topic, in topic order) is one narrow projection per text. The long
form is that of `tiles`, for topic lists too large for a plan constant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.functions import vectors as vx
from talkspan.operators.topics import TopicSpace


# Up to this many topic numbers per row the JVM form is as fast as the matrix product (measured).
NATIVE_NUMBERS = 1_000


def list_matrix(column: pa.Array, dim: int, missing: float = 0.0) -> np.ndarray:
    """Arrow list column of equal-length vectors as a (rows, dim) matrix. A null list, or a null in a list, is filled
    with `missing`, so every row keeps its place."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    given = column.drop_null().flatten().fill_null(missing)
    rows = given.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if column.null_count == 0:
        return rows
    out = np.full((len(column), dim), float(missing))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = rows
    return out


def cosine_rows(vecs: np.ndarray, unit_topics: np.ndarray) -> np.ndarray:
    """(n, dim) x (topics, dim) -> (n, topics); zero vectors score 0."""
    lengths = np.sqrt((vecs * vecs).sum(axis=1, keepdims=True))
    return (vecs @ unit_topics.T) / np.where(lengths == 0, 1.0, lengths)


def with_cosines(df: DataFrame, space: TopicSpace, vec: str = "vec", out: str = "sims") -> DataFrame:
    """Adds the array of cosines between `vec` and every topic: one matrix product per Arrow batch."""
    rows, dim, index = space.rows, space.dim, df.columns.index(vec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sims = cosine_rows(list_matrix(batch.column(index), dim), rows)
            offsets = np.arange(0, sims.size + 1, rows.shape[0], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sims.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, out])

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.mapInArrow(run, schema)


def with_cosines_native(df: DataFrame, space: TopicSpace, vec: str = "vec", out: str = "sims") -> DataFrame:
    """The same through array expressions in the JVM; preferable for short vectors."""
    return df.withColumn(out, vx.cosines(F.col(vec), space.literal()))


def with_direct_p(df: DataFrame, space: TopicSpace, vec: str = "vec") -> DataFrame:
    """Direct mode: softmax over the cosines. Adds `p`."""
    cosines = with_cosines if space.rows.size > NATIVE_NUMBERS else with_cosines_native
    return cosines(df, space, vec).withColumn("p", vx.softmax(F.col("sims"))).drop("sims")


def long_p(df: DataFrame, *keys: str) -> DataFrame:
    """Array form to rows `keys, topic_idx, p`."""
    return df.select(*keys, F.posexplode("p").alias("topic_idx", "p"))


def softmax_long(scores: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """Softmax over the rows of each key: `keys, topic_idx, p`."""
    per_key = W.partitionBy(*keys)
    weight = F.exp(F.col(score) - F.max(score).over(per_key))
    return scores.withColumn("_w", weight).select(
        *keys, "topic_idx", (F.col("_w") / F.sum("_w").over(per_key)).alias("p")
    )


def most_likely(p: Column) -> Column:
    """Index of the highest probability, the lowest index on ties. Nine places are compared, as everywhere."""
    return vx.let(
        F.transform(p, lambda x: F.floor(x * F.lit(1e9) + F.lit(0.5))),
        lambda units: (F.array_position(units, F.array_max(units)) - 1).cast("int"),
    )


def topic_name(index: Column, names) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)


def top_topics(df: DataFrame, space: TopicSpace, k: int, *keys: str) -> DataFrame:
    """Exact k nearest topics of each vector: `keys, rank, topic_idx, sim`, ties by topic order."""
    ranked = F.transform(
        F.array_sort(
            F.transform(F.col("sims"), lambda s, i: F.struct((-s).alias("neg"), i.alias("topic_idx")))
        ),
        lambda x: F.struct(x["topic_idx"].alias("topic_idx"), (-x["neg"]).alias("sim")),
    )
    top = with_cosines_native(df, space).select(*keys, F.posexplode(F.slice(ranked, 1, k)).alias("r", "x"))
    return top.select(*keys, (F.col("r") + 1).alias("rank"), "x.topic_idx", "x.sim")


def nearest_to_topics(df: DataFrame, space: TopicSpace, k: int, key: str) -> DataFrame:
    """Exact k nearest vectors of each topic. The window keeps k rows per topic on the map side."""
    sims = with_cosines_native(df, space).select(key, F.posexplode("sims").alias("topic_idx", "sim"))
    order = W.partitionBy("topic_idx").orderBy(F.desc("sim"), key)
    return sims.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
