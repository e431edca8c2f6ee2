"""Blocks to segments: bounds, duration, topic name, transcript.

A transcript can be as long as a sender's whole history, so it exists in two forms. `transcript_parts`
is the scalable one: numbered parts of at most one slice of one hour each, nothing left out.
`transcripts` joins the parts into one string per segment, the form the CSV file needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.functions import text as tx
from talkspan.operators.blocks import BLOCK_KEY, block_hours
from talkspan.operators.checkpoints import BATCH_BYTES, bounded_batches, freed_shuffles
from talkspan.operators.hours import CELL, SLICE_ROWS, _in_order, _slice
from talkspan.operators.metrics import lines_in

HOT_MESSAGES = SLICE_ROWS
TASK_MESSAGES = 32_768
TASK_LOTS = 8


def line_slices(messages: DataFrame, null_text: str | None = None) -> DataFrame:
    """Transcript lines per cell in slices: `sender, hour_idx, slice, lines, n_lines`.

    Messages are dealt by cell and not by slice: joins by cell find the slices where they are, and texts move once.
    """
    text = tx.message_text(F.col("text"), null_text)
    line = tx.transcript_line(F.col("sender"), F.col("chatroom"), F.col("ts"), text)
    return (
        messages.select(*CELL, "row_id", "chatroom", "ts", "text")
        .repartition(*CELL)
        .select(*CELL, "row_id", line.alias("line"))
        .groupBy(*CELL, _slice(F.col("row_id")).alias("slice"))
        .agg(_in_order("line").alias("rows"))
        .select(*CELL, "slice", F.array_join("rows.line", "\n").alias("lines"), F.size("rows").alias("n_lines"))
    )


def transcript_parts(blocks: DataFrame, messages: DataFrame, null_text: str | None = None) -> DataFrame:
    """`BLOCK_KEY, pos, slice, lines`: the lines of each block in (pos, slice) order.

    Messages are reduced to slices before the join, so a cell with very many messages meets the
    block rows as a few rows per topic instead of as its messages.
    """
    return block_hours(blocks).join(line_slices(messages, null_text), list(CELL)).select(
        *BLOCK_KEY, "pos", "slice", "lines", "n_lines"
    )


def transcripts(parts: DataFrame) -> DataFrame:
    """One `chat_summary` per block."""
    return parts.groupBy(*BLOCK_KEY).agg(
        F.array_sort(F.collect_list(F.struct("pos", "slice", "lines"))).alias("ordered")
    ).select(*BLOCK_KEY, F.array_join("ordered.lines", "\n").alias("chat_summary"))


def cell_lines(messages: DataFrame, null_text: str | None = None) -> DataFrame:
    """`sender, hour_idx, n_msgs, n_lines`: messages of a cell, and the lines they take in a transcript."""
    text = tx.message_text(F.col("text"), null_text)
    line = tx.transcript_line(F.col("sender"), F.col("chatroom"), F.col("ts"), text)
    return messages.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_msgs"), F.sum(lines_in(line)).cast("long").alias("n_lines")
    )


def captured(blocks: DataFrame, hours: DataFrame, lines: str | None = None) -> DataFrame:
    """One row: messages counted once per block, and messages counted once however many blocks hold
    their cell. Needs the cells' `n_msgs`. `lines` names a column of lines to count once per block."""
    cells = block_hours(blocks).groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_blocks"))
    own = ["n_msgs"] if lines is None else ["n_msgs", lines]
    joined = cells.join(hours.select(*CELL, *own), list(CELL))

    def total(x: Column) -> Column:
        return F.coalesce(F.sum(x), F.lit(0))

    found = [
        total(F.col("n_msgs") * F.col("n_blocks")).alias("messages_captured"),
        total(F.col("n_msgs")).alias("distinct_messages_captured"),
    ]
    if lines is not None:
        found.append(total(F.col(lines) * F.col("n_blocks")).alias("lines_captured"))
    return joined.agg(*found)


def bounds(blocks: DataFrame) -> DataFrame:
    """Adds `duration_s`; first and last message times count in whole seconds. All of it on zone-less times: a session
    zone with a clock change would add or drop an hour."""
    whole = {c: tx.plain_time(F.col(c)).cast("timestamp_ntz") for c in ("start_ts", "end_ts")}
    seconds = F.expr("CAST(CAST(end_ts - start_ts AS INTERVAL SECOND) AS BIGINT)")
    return blocks.withColumns(whole).withColumn("duration_s", seconds)


def named(blocks: DataFrame, names) -> DataFrame:
    """Adds the topic name; the topic list is a run parameter."""
    return blocks.withColumn("topic", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("topic_idx") + 1))


def segments(blocks: DataFrame, names) -> DataFrame:
    """Typed segments without transcript."""
    return named(bounds(blocks), names).select(
        *BLOCK_KEY, "threshold", "topic", "start_ts", "end_ts", "duration_s", "n_hours", "n_msgs", "p", "hour_idxs"
    )


def _by_cells(runs: DataFrame, messages: DataFrame, null_text: str | None, how: str) -> DataFrame:
    """`sender, hour_idxs, own, chat_summary` of runs of hours. Texts move to their cells, then lines to the runs, so a
    sender's messages are spread over tasks."""
    hours = runs.select("sender", "hour_idxs", "own", F.posexplode("hour_idxs").alias("pos", "hour_idx"))
    rows = hours.join(line_slices(messages, null_text), list(CELL), how).groupBy("sender", "hour_idxs").agg(
        F.any_value("own").alias("own"),
        F.array_sort(F.collect_list(F.struct("pos", "slice", "lines"))).alias("ordered"),
    )
    return rows.select("sender", "hour_idxs", "own", F.array_join("ordered.lines", "\n").alias("chat_summary"))


class _Run:
    """A run of hours that waits for its last one; `row` of `table` is what it came with."""

    __slots__ = ("table", "row", "hours", "first", "last")

    def __init__(self, table: pa.RecordBatch, row: int, hours: list) -> None:
        self.table, self.row, self.hours = table, row, hours
        known = [h for h in hours if h is not None]
        self.first, self.last = (min(known), max(known)) if known else (-1, -1)


class _Lines:
    """The lines of a sender's cells, kept while an open run holds them."""

    def __init__(self, every: bool) -> None:
        self.every = every
        self.open: list[_Run] = []
        self.cells: dict[int, list | str] = {}
        self.done: list[tuple[_Run, str]] = []
        self.size = 0

    def text(self, hour: int) -> str:
        lines = self.cells[hour]
        if not isinstance(lines, str):
            self.cells[hour] = lines = "\n".join(x for x in lines if x is not None)
        return lines

    def until(self, hour: int | None) -> None:
        """Closes the runs that end before `hour`, all of them without it."""
        still = []
        for run in self.open:
            if hour is not None and run.last >= hour:
                still.append(run)
                continue
            lines = [self.text(h) for h in run.hours if h in self.cells]
            if lines or self.every:
                self.done.append((run, "\n".join(lines)))
                self.size += sum(map(len, lines))
        if len(still) < len(self.open) or not still:
            first = min((run.first for run in still), default=None)
            self.cells = {h: x for h, x in self.cells.items() if h >= first} if still else {}
        self.open = still

    def rows(self) -> pa.RecordBatch:
        tables = list({id(run.table): run.table for run, _ in self.done}.values())
        starts, n = {}, 0
        for table in tables:
            starts[id(table)], n = n, n + table.num_rows
        at = pa.array([starts[id(run.table)] + run.row for run, _ in self.done], pa.int64())
        kept = pa.concat_batches(tables).take(at)
        texts = pa.array([text for _, text in self.done], pa.string())
        self.done, self.size = [], 0
        return pa.RecordBatch.from_arrays([*kept.columns, texts], names=["sender", "hour_idxs", "own", "chat_summary"])


def _by_senders(runs: DataFrame, messages: DataFrame, total: int, null_text: str | None, how: str) -> DataFrame:
    """What `_by_cells` gives, in one pass over the messages of a sender in the order of hours: a text moves once, however
    many runs hold it. A task keeps the lines of the runs that are open."""
    spark = messages.sparkSession
    said = messages.dropna(subset=list(CELL)).select(
        "sender", F.col("hour_idx").alias("hour"), F.lit(True).alias("said"), "row_id", "chatroom", "ts", "text"
    )
    begun = runs.where(F.size("hour_idxs") > 0).select(
        "sender", F.array_min("hour_idxs").alias("hour"), F.lit(False).alias("said"), "hour_idxs", "own"
    )
    both = said.unionByName(begun, allowMissingColumns=True)
    n_tasks, usual = -(-total // TASK_MESSAGES), int(spark.conf.get("spark.sql.shuffle.partitions"))
    lot = F.pmod(F.xxhash64("sender"), F.lit(TASK_LOTS * max(n_tasks, usual))).cast("int")
    both = both.withColumn("lot", lot)
    dealt = both.repartition(n_tasks, "lot") if n_tasks > usual else both.repartition("lot")
    text = tx.message_text(F.col("text"), null_text)
    line = F.when(F.col("said"), tx.transcript_line(F.col("sender"), F.col("chatroom"), F.col("ts"), text))
    rows = dealt.select("lot", "sender", "hour", "said", "row_id", line.alias("line"), "hour_idxs", "own")
    rows = rows.sortWithinPartitions("lot", "sender", "hour", "said", "row_id", "line")  # so lots come in that order
    every = how == "left"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sender, hour = _Lines(every), None, None
        for batch in batches:
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            senders, hours, said = (column[c].to_pylist() for c in ("sender", "hour", "said"))
            table = pa.RecordBatch.from_arrays([column[c] for c in ("sender", "hour_idxs", "own")], names=["sender", "hour_idxs", "own"])
            table = table.filter(pc.invert(column["said"]))
            own, lines, n = table.column(1).to_pylist(), column["line"], 0
            for i, at in enumerate(hours):
                if senders[i] != sender:
                    if sender is not None and (senders[i] is None or senders[i] < sender):
                        raise ValueError("the senders of a lot are out of order")
                    found.until(None)
                    sender, hour = senders[i], at
                elif at != hour:
                    if hour is not None and (at is None or at < hour):
                        raise ValueError("the hours of a sender are out of order")
                    found.until(at)
                    hour = at
                if not said[i]:
                    found.open.append(_Run(table, n, own[n]))
                    n += 1
                elif found.open:
                    found.cells.setdefault(at, []).append(lines[i].as_py())
                if found.size > BATCH_BYTES:
                    yield found.rows()
            if found.done:
                yield found.rows()
        found.until(None)
        if found.done:
            yield found.rows()

    bounded_batches(spark)
    kinds = {f.name: f for f in runs.schema.fields}
    schema = T.StructType([kinds[c] for c in ("sender", "hour_idxs", "own")]).add("chat_summary", T.StringType())
    return rows.groupBy("lot").applyInArrow(run, schema)


def _whole(blocks: DataFrame, messages: DataFrame, null_text: str | None, how: str) -> DataFrame:
    """Adds `chat_summary` to rows with `sender` and `hour_idxs`. Rows of the same hours (a topic each) share it: it is put
    together once, the other columns travel along, and the rows are worked out once.

    Senders of more than `HOT_MESSAGES` messages are spread by cells, the others read one by one; messages are counted
    for that, now."""
    own = [c for c in blocks.columns if c not in ("sender", "hour_idxs")]
    runs = blocks.groupBy("sender", "hour_idxs").agg(F.collect_list(F.struct(*own)).alias("own"))
    many = F.col("sender").isNotNull() & (F.col("n") > HOT_MESSAGES)
    with freed_shuffles(messages.sparkSession):
        counts = messages.groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
        told = counts.agg(F.sum("n").alias("total"), F.collect_list(F.when(many, F.col("sender"))).alias("hot")).first()
    total, hot = told["total"] or 0, told["hot"]  # a name per HOT_MESSAGES messages at most
    if hot:
        busy = F.coalesce(F.col("sender").isin(hot), F.lit(False))
        joined = _by_senders(runs.where(~busy), messages.where(~busy), total, null_text, how).unionByName(
            _by_cells(runs.where(busy), messages.where(busy), null_text, how)
        )
    else:
        joined = _by_senders(runs, messages, total, null_text, how)
    return joined.select("sender", "hour_idxs", "chat_summary", F.explode("own").alias("own")).select(
        "sender", "hour_idxs", "own.*", "chat_summary"
    ).select(*blocks.columns, "chat_summary")


def block_transcripts(blocks: DataFrame, messages: DataFrame, null_text: str | None = None) -> DataFrame:
    """`BLOCK_KEY, chat_summary`: what `transcripts` makes of the blocks' parts, with a text moved once per run of hours
    and not once per topic. Blocks without messages are left out."""
    return _whole(blocks.select(*BLOCK_KEY, "hour_idxs"), messages, null_text, "inner").drop("hour_idxs")


def with_transcripts(segs: DataFrame, messages: DataFrame, null_text: str | None = None) -> DataFrame:
    """Adds `chat_summary` as one string per segment."""
    return _whole(segs, messages, null_text, "left")


def csv_form(segs: DataFrame) -> DataFrame:
    """The nine string columns of the result file."""
    return segs.select(
        F.col("sender").alias("User"),
        tx.plain_time(F.col("start_ts"), 1, 10).alias("Start Date"),
        tx.plain_time(F.col("start_ts"), 12, 8).alias("Start Time"),
        tx.plain_time(F.col("end_ts"), 1, 10).alias("End Date"),
        tx.plain_time(F.col("end_ts"), 12, 8).alias("End Time"),
        tx.duration_text(F.col("duration_s")).alias("Time Duration"),
        F.col("topic").alias("Topic"),
        F.col("p").cast("string").alias("Probability"),
        F.col("chat_summary").alias("Chat Summary"),
    )
