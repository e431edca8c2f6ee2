"""Frames that are read more than once, and how much of a frame a Python worker gets at a time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BATCH_BYTES = 16 << 20


def _folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local session without that setting uses a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="talkspan-")


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is run in here gives its shuffle files back as it ends, not when the driver happens to collect its garbage: for
    jobs whose rows are stored or small. Frames made in here and run again later work their shuffles out anew."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, name: str, schema: T.StructType | None = None) -> DataFrame:
    """The rows of `df` as a table in that folder: worked out once, now, and read by column as often as needed (with
    `schema`, as those types, which must be stored alike)."""
    path = f"{_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def checkpointing(spark: SparkSession) -> SparkContext:
    """The context of a session, with that folder for its checkpoints."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_folder(spark))
    return context


def cut(df: DataFrame) -> DataFrame:
    """The rows of `df` without their history, kept in the folder named by spark.checkpoint.dir: every later reader gets
    them from there, whichever executors are lost. Only a local session without that setting uses a temporary folder."""
    checkpointing(df.sparkSession)
    return df.checkpoint()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches end by bytes too: rows that hold whole bags of words would fill memory by the ten thousand."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
