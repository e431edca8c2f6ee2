"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.sql import select

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so that both engines report the same types."""
    small = (T.ByteType, T.ShortType, T.IntegerType)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Registers a query, with the SQL of the same result where SQL can state it."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: _plain(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = select(sql, extra)
        return fn

    return add
