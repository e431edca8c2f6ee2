"""Messages to (sender, hour) cells.

Everything numeric about a cell is a combinable aggregate, so a sender or an hour holding a third of
all messages is reduced on the map side first. After that a sender has at most 24 rows per calendar
day, however many messages were sent.

Ordered text cannot be reduced that way. It is built in slices of consecutive `row_id`s: one slice of
a cell holds at most `SLICE_ROWS` messages, so the ordered collection never sees more, and the second
level only joins finished slices. Messages are dealt by cell first, so a text moves once for both levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspan.functions import text as tx
from talkspan.functions import vectors as vx

SLICE_ROWS = 65_536
CELL = ("sender", "hour_idx")


def with_words(
    messages: DataFrame, stop_words=None, null_text: str | None = None, words: Column | None = None
) -> DataFrame:
    """Adds cleaned `words`; a ready-made words column may be given instead."""
    text = tx.message_text(F.col("text"), null_text)
    return messages.withColumn("words", tx.clean_words(text, stop_words) if words is None else words)


def _stats(messages: DataFrame) -> list[Column]:
    counted = "n_words" in messages.columns
    n_words = F.col("n_words") if counted else F.size("words").cast("long")
    return [
        F.count(F.lit(1)).alias("n_msgs"),
        F.sum(n_words).alias("n_words"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    ]


def hour_stats(messages: DataFrame) -> DataFrame:
    """Per cell: messages, words, first and last time. Needs `hour_idx`, and `words` or `n_words`."""
    return messages.groupBy(*CELL).agg(*_stats(messages))


def hour_vectors(messages: DataFrame, dim: int) -> DataFrame:
    """`hour_stats` plus the sum of the message vectors `vec` (fixed point)."""
    total = vx.sum_vectors(F.col("vec"), dim).alias("vec")
    return messages.groupBy(*CELL).agg(*_stats(messages), total)


def hour_word_counts(messages: DataFrame, words: str = "words") -> DataFrame:
    """Bag of words per cell in long form: `sender, hour_idx, word, n`."""
    long = messages.select(*CELL, F.explode(words).alias("word"))
    return long.groupBy(*CELL, "word").agg(F.count(F.lit(1)).alias("n"))


def active(hours: DataFrame) -> DataFrame:
    """Cells with at least one cleaned word."""
    return hours.where(F.col("n_words") > 0)


def with_ordinal(hours: DataFrame) -> DataFrame:
    """Position of an active cell among its sender's active cells, from 1."""
    order = W.partitionBy("sender").orderBy("hour_idx")
    return hours.withColumn("ord", F.row_number().over(order))


def _slice(row_id: Column) -> Column:
    return F.floor(row_id / F.lit(SLICE_ROWS)).cast("long")


def _in_order(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("row_id", *cols)))


def hour_slices(messages: DataFrame) -> DataFrame:
    """First level: `sender, hour_idx, slice, text, lead, n_msgs`, in row order, and `words` if the messages have them.

    Empty texts at the head of a cell vanish, later ones leave a blank; `lead` counts the empty texts
    a slice starts with, so that the second level can tell.
    """
    own = [c for c in ("text", "words") if c in messages.columns]
    dealt = messages.select(*CELL, "row_id", "ts", *own).repartition(*CELL)
    grouped = dealt.groupBy(*CELL, _slice(F.col("row_id")).alias("slice")).agg(
        F.count(F.lit(1)).alias("n_msgs"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        _in_order(*own).alias("rows"),
    )
    texts = F.filter(F.col("rows.text"), lambda t: t.isNotNull())
    lead = F.aggregate(
        F.col("texts"),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("open")),
        lambda acc, t: F.struct(
            (acc["n"] + F.when(acc["open"] & (t == ""), 1).otherwise(0)).alias("n"),
            (acc["open"] & (t == "")).alias("open"),
        ),
        lambda acc: acc["n"],
    )
    return (
        grouped.withColumn("texts", texts)
        .withColumn("empty", lead)
        .select(
            *CELL,
            "slice",
            "n_msgs",
            "first_ts",
            "last_ts",
            *[F.flatten("rows.words").alias(c) for c in own if c == "words"],
            F.size("texts").alias("n_texts"),
            F.least(F.col("empty"), F.greatest(F.size("texts") - 1, F.lit(0))).alias("lead"),
            F.array_join(
                F.slice("texts", F.col("empty") + 1, F.greatest(F.size("texts"), F.lit(1))), " "
            ).alias("text"),
        )
    )


def hour_texts(messages: DataFrame, stop_words=None) -> DataFrame:
    """Cells with `words` and the joined original `text`, in row order.

    Messages without a column `words` get the cleaned words of the joined text, which are those of its messages: lists of
    words are several times as large as their text, and need not move with it.
    """
    slices = hour_slices(messages)
    given = "words" in slices.columns
    pieces = F.array_sort(
        F.collect_list(F.struct("slice", "n_texts", "lead", "text", *["words"] * given))
    )
    joined = F.aggregate(
        F.filter(F.col("pieces"), lambda p: p["n_texts"] > 0),
        F.lit(""),
        lambda acc, p: F.when(acc == "", p["text"]).otherwise(
            F.concat(acc, F.lit(" "), F.repeat(F.lit(" "), p["lead"]), p["text"])
        ),
    )
    cells = slices.groupBy(*CELL).agg(
        F.sum("n_msgs").alias("n_msgs"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        pieces.alias("pieces"),
    )
    whole = cells.withColumn("text", joined)
    words = F.flatten("pieces.words") if given else tx.clean_words(F.col("text"), stop_words)
    return whole.select(*CELL, "n_msgs", "first_ts", "last_ts", words.alias("words"), "text").withColumn(
        "n_words", F.size("words").cast("long")
    )


def distinct_texts(hours: DataFrame) -> DataFrame:
    """Distinct non-empty texts of active cells, keyed by hash: `text_hash, text`."""
    kept = hours.where((F.col("n_words") > 0) & (F.col("text") != ""))
    return kept.select(tx.text_key(F.col("text")).alias("text_hash"), "text").dropDuplicates(["text_hash"])


def vocabulary(messages: DataFrame, words: str = "words") -> DataFrame:
    """Distinct words with their counts."""
    return (
        messages.select(F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
