"""Message tables derived from the parquet sample tables (events, documents, embeddings).

Events say who wrote when and where, documents lend the text, embeddings the message vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.functions import vectors as vx

START, END = "2024-01-01", "2024-01-30"
DIM = 64
N_LABELS = 10
SPREAD = 7919


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _partner(n: int):
    return (F.col("event_id") * SPREAD) % F.lit(n)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("chatroom"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("sender"),
        "ts",
        "event_id",
    )


def messages(spark: SparkSession, sf_dir: str, *own: Column) -> DataFrame:
    """`row_id, chatroom, sender, ts, text, prompt`, with whole document texts. `own` are named columns worked out of a
    text: once per document, before its messages get it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *own)
    n = docs.count()
    return (
        _events(spark, sf_dir)
        .withColumn("doc_id", _partner(n))
        .join(docs.hint("merge"), "doc_id")
        .select(
            "row_id", "chatroom", "sender", "ts", "text", F.lit("").alias("prompt"),
            *[c for c in docs.columns if c not in ("doc_id", "text")],
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`vec_id, label, vec` in fixed point."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", vx.fixed_point(F.col("embedding")).alias("vec")
    )


def message_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`row_id, vec`."""
    vecs = vectors(spark, sf_dir)
    n = vecs.count()
    return (
        table(spark, sf_dir, "events")
        .select(F.col("event_id").alias("row_id"), _partner(n).alias("vec_id"))
        .join(vecs.select("vec_id", "vec"), "vec_id")
        .select("row_id", "vec")
    )


def label_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten topics, the centroids of the labels: `topic_idx, name, vec`."""
    return (
        vectors(spark, sf_dir)
        .groupBy("label")
        .agg(vx.sum_vectors(F.col("vec"), DIM).alias("vec"))
        .select(
            F.col("label").alias("topic_idx"),
            F.concat(F.lit("label_"), F.col("label")).alias("name"),
            "vec",
        )
    )
