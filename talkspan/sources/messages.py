"""Message tables: reading, checking, date filters, the hour calendar."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.sources import csv_records

REQUIRED = ("Chatroom", "Sender", "Timestamp", "Text")


def read_csv(spark: SparkSession, path: str, bad_times: str = "fail") -> DataFrame:
    """Chat export with a header and quoted, possibly multi-line text. All columns as strings.

    Files are read in splits (see `csv_records`), so a large export keeps as many tasks busy as it has splits.
    """
    return from_raw(csv_records.numbered(csv_records.read(spark, path)), bad_times, "row_id")


def require_columns(df: DataFrame, needed=REQUIRED) -> DataFrame:
    """Fails at analysis time, without a job, when a column is missing."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("no messages")
    return df


def parse_ts(text: Column) -> Column:
    """Timestamp without zone; unreadable values become null."""
    return text.try_cast("timestamp_ntz")


def with_prompt(df: DataFrame, name: str = "prompt") -> DataFrame:
    """The optional prompt column, empty when the input has none."""
    return df if name in df.columns else df.withColumn(name, F.lit(""))


def from_raw(raw: DataFrame, bad_times: str = "fail", sequence: str | None = None) -> DataFrame:
    """A frame in export form (any reader) as `messages`.

    Order is meaning, since texts are joined in it: `sequence` names a whole-number column that gives it, otherwise
    `row_id` grows along partitions and rows. A time that can't be read is an error, or with `bad_times="keep"` a null
    that `unreadable` reports; a missing time is a null either way.
    """
    if bad_times not in ("fail", "keep"):
        raise ValueError("bad_times is 'fail' or 'keep'")
    require_columns(raw)
    df = with_prompt(raw, "Prompt")
    told = F.col("Timestamp").cast("string")
    ts = parse_ts(told)
    if bad_times == "fail":
        complaint = F.raise_error(F.concat(F.lit("unreadable message time: "), told)).cast("timestamp_ntz")
        ts = F.when(told.isNotNull() & ts.isNull(), complaint).otherwise(ts)
    row_id = F.monotonically_increasing_id() if sequence is None else F.col(sequence).cast("long")
    return df.select(
        row_id.alias("row_id"),
        F.col("Chatroom").alias("chatroom"),
        F.col("Sender").alias("sender"),
        ts.alias("ts"),
        F.col("Text").alias("text"),
        F.coalesce(F.col("Prompt"), F.lit("")).alias("prompt"),
    )


def unreadable(messages: DataFrame) -> DataFrame:
    """Messages without a time. No date range holds them, so a run that keeps bad times reports them here."""
    return messages.where(F.col("ts").isNull())


def between_dates(messages: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends inclusive, either optional. Plain comparisons on `ts`, so they reach the scan."""
    if start is not None:
        messages = messages.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        after = (date.fromisoformat(end) + timedelta(days=1)).isoformat()
        messages = messages.where(F.col("ts") < F.lit(after).cast("timestamp_ntz"))
    return messages


def date_bounds(messages: DataFrame) -> DataFrame:
    """One row `start_date, end_date` of the data."""
    return messages.agg(
        F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date")
    )


def effective_range(
    messages: DataFrame, start: str | None = None, end: str | None = None
) -> tuple[str, str]:
    """The given range when both ends are given, else the range of the data (one small job)."""
    if start is not None and end is not None:
        return start, end
    row = date_bounds(messages).first()
    if row is None or row["start_date"] is None:
        raise ValueError("no messages in the date range")
    return row["start_date"].isoformat(), row["end_date"].isoformat()


def hour_index(ts: Column, start: str) -> Column:
    """Hours since midnight of the first calendar day."""
    days = F.datediff(F.to_date(ts), F.lit(start).cast("date"))
    return days * 24 + F.hour(ts)


def n_days(start: str, end: str) -> int:
    return (date.fromisoformat(end) - date.fromisoformat(start)).days + 1


def with_hours(messages: DataFrame, start: str, end: str) -> DataFrame:
    """Adds `hour_idx` and keeps the calendar days start..end."""
    inside = between_dates(messages, start, end)
    return inside.withColumn("hour_idx", hour_index(F.col("ts"), start).cast("int"))


def users(messages: DataFrame) -> DataFrame:
    return messages.select("sender").distinct()


def volume(messages: DataFrame, start: str, end: str) -> DataFrame:
    """One row: messages, distinct users, calendar hours."""
    return messages.agg(
        F.count(F.lit(1)).alias("total_messages"), F.countDistinct("sender").alias("total_users")
    ).withColumn("total_hours", F.lit(n_days(start, end) * 24).cast("long"))


def topics_frame(spark: SparkSession, names) -> DataFrame:
    """Ordered topic names as `topic_idx, name`."""
    schema = T.StructType(
        [T.StructField("topic_idx", T.IntegerType()), T.StructField("name", T.StringType())]
    )
    return spark.createDataFrame(list(enumerate(names)), schema)
