"""Exhaustive search: every run of consecutive active hours of a sender is scored.

The number of spans is quadratic in a sender's hours, so spans are scored where the hours are and
only reduced results leave the task: one row per start hour, or sums per threshold. The work is dealt
by (sender, range of `START_HOURS` start hours): a range gets the hours from its first start on, so a
sender with very many hours is worked on by many tasks, at the price of one more copy of an hour row
for every `START_HOURS` hours before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspan.functions import vectors as vx
from talkspan.operators.blocks import PLACES, _units
from talkspan.operators.hours import with_ordinal
from talkspan.operators.scoring import cosine_rows, list_matrix
from talkspan.operators.topics import TopicSpace

START_HOURS = 256
START_SCHEMA = (
    "sender string, topic_idx int, start_ord int, n_spans int, n_passing int, best_p double, best_end int"
)
SWEEP_SCHEMA = "threshold double, n_segments bigint, n_msgs bigint, sum_p double"


def _per_range(
    batches: Iterator[pa.RecordBatch], dim: int, handle: Callable[[str, int, np.ndarray, np.ndarray], pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    """Cuts sorted hour batches at range borders and hands over (sender, range, vectors, messages)."""
    name: tuple[str, int] | None = None
    vecs: list[np.ndarray] = []
    msgs: list[np.ndarray] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        senders = batch.column("sender").to_pylist()
        ranges = batch.column("start_range").to_numpy(zero_copy_only=False)
        keys = list(zip(senders, ranges.tolist()))
        m = list_matrix(batch.column("vec"), dim)
        n = batch.column("n_msgs").to_numpy(zero_copy_only=False)
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if keys[a] != name:
                if name is not None:
                    yield handle(*name, np.concatenate(vecs), np.concatenate(msgs))
                name, vecs, msgs = keys[a], [], []
            vecs.append(m[a:b])
            msgs.append(n[a:b])
    if name is not None:
        yield handle(*name, np.concatenate(vecs), np.concatenate(msgs))


def _span_p(prefix: np.ndarray, start: int, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the spans that begin at `start`, one row per end hour."""
    return vx.softmax_rows(cosine_rows(prefix[start + 1 :] - prefix[start], rows))


def running(hours: DataFrame, dim: int) -> DataFrame:
    """Running sums per sender in hour order: `prefix` vector and `msgs_so_far`. The vector of a span
    is the difference of two prefixes."""
    so_far = W.partitionBy("sender").orderBy("ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    return hours.select(
        "sender",
        "ord",
        F.sum("n_msgs").over(so_far).alias("msgs_so_far"),
        F.array(*[F.sum(F.col("vec")[i]).over(so_far) for i in range(dim)]).alias("prefix"),
    )


def _sorted_hours(hours: DataFrame) -> DataFrame:
    """Hours with every start range that needs them, sorted by range and hour."""
    own = F.floor((F.col("ord") - 1) / F.lit(START_HOURS)).cast("int")
    dealt = with_ordinal(hours.select("sender", "hour_idx", "n_msgs", "vec")).select(
        "sender", "ord", "n_msgs", "vec", F.explode(F.sequence(F.lit(0), own)).alias("start_range")
    )
    order = ("sender", "start_range", "ord")
    return dealt.repartition("sender", "start_range").sortWithinPartitions(*order)


def span_starts(hours: DataFrame, space: TopicSpace, threshold: float) -> DataFrame:
    """Per start hour and topic: spans scored, spans passing, the best probability and where that
    span ends (the shortest on ties)."""
    rows, dim, unit = space.rows, space.dim, _units(threshold)

    def handle(name: str, start_range: int, vecs: np.ndarray, msgs: np.ndarray) -> pa.RecordBatch:
        n, n_topics, skip = min(len(vecs), START_HOURS), len(rows), start_range * START_HOURS
        prefix = np.vstack([np.zeros((1, dim)), np.cumsum(vecs, axis=0)])
        passing = np.empty((n, n_topics), dtype=np.int32)
        best = np.empty((n, n_topics))
        end = np.empty((n, n_topics), dtype=np.int32)
        for i in range(n):
            p = _span_p(prefix, i, rows)
            rounded = np.floor(p * PLACES + 0.5)
            passing[i] = (rounded >= unit).sum(axis=0)
            at = rounded.argmax(axis=0)
            best[i] = p.max(axis=0)
            end[i] = skip + i + 1 + at
        starts = np.repeat(np.arange(1, n + 1, dtype=np.int32), n_topics)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([name] * (n * n_topics), pa.string()),
                pa.array(np.tile(np.arange(n_topics, dtype=np.int32), n)),
                pa.array((skip + starts).astype(np.int32)),
                pa.array((len(vecs) + 1 - starts).astype(np.int32)),
                pa.array(passing.ravel()),
                pa.array(best.ravel()),
                pa.array(end.ravel()),
            ],
            names=["sender", "topic_idx", "start_ord", "n_spans", "n_passing", "best_p", "best_end"],
        )

    return _sorted_hours(hours).mapInArrow(lambda it: _per_range(it, dim, handle), START_SCHEMA)


def span_rows(hours: DataFrame, space: TopicSpace, threshold: float, max_hours: int) -> DataFrame:
    """The spans of at most `max_hours` active hours that pass: `sender, topic_idx, start_ord, end_ord, p`.

    A band: hours are dealt to bins of `max_hours` ordinals, and each hour also to the bin before its own, so a bin holds
    every span that begins in it. An hour is copied once, and the work and the rows grow with hours x `max_hours`.
    """
    if max_hours < 1:
        raise ValueError("a span has one hour at least")
    rows, dim, unit = space.rows, space.dim, _units(threshold)
    own = F.floor((F.col("ord") - 1) / F.lit(max_hours)).cast("int")
    bins = F.filter(F.array(own, own - 1), lambda x: x >= 0)
    dealt = with_ordinal(hours.select("sender", "hour_idx", "n_msgs", "vec")).select(
        "sender", "ord", "n_msgs", "vec", F.explode(bins).alias("start_range")
    )
    dealt = dealt.repartition("sender", "start_range").sortWithinPartitions("sender", "start_range", "ord")

    def handle(name: str, start_range: int, vecs: np.ndarray, msgs: np.ndarray) -> pa.RecordBatch:
        n, skip = min(len(vecs), max_hours), start_range * max_hours
        prefix = np.vstack([np.zeros((1, dim)), np.cumsum(vecs, axis=0)])
        found = []
        for more in range(min(max_hours, len(vecs))):  # all spans of one length together
            starts = np.arange(min(n, len(vecs) - more))
            p = vx.softmax_rows(cosine_rows(prefix[starts + more + 1] - prefix[starts], rows))
            at, topic = np.nonzero(np.floor(p * PLACES + 0.5) >= unit)
            found.append((topic, skip + at + 1, skip + at + 1 + more, p[at, topic]))
        topic, first, last, p = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * len(p), pa.string()), pa.array(topic.astype(np.int32)), pa.array(first.astype(np.int32)),
             pa.array(last.astype(np.int32)), pa.array(p)],
            names=["sender", "topic_idx", "start_ord", "end_ord", "p"],
        )

    schema = "sender string, topic_idx int, start_ord int, end_ord int, p double"
    return dealt.mapInArrow(lambda it: _per_range(it, dim, handle), schema)


def sweep_spans(hours: DataFrame, space: TopicSpace, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold over all spans and topics: segments, messages, mean length, mean probability."""
    rows, dim = space.rows, space.dim
    levels = [float(t) for t in thresholds]
    units = np.asarray([_units(t) for t in levels], dtype=np.float64)

    def handle(name: str, start_range: int, vecs: np.ndarray, msgs: np.ndarray) -> pa.RecordBatch:
        prefix = np.vstack([np.zeros((1, dim)), np.cumsum(vecs, axis=0)])
        sent = np.concatenate([[0], np.cumsum(msgs)])
        count = np.zeros(len(units), dtype=np.int64)
        messages = np.zeros(len(units), dtype=np.int64)
        total = np.zeros(len(units))
        for i in range(min(len(vecs), START_HOURS)):
            p = _span_p(prefix, i, rows)
            rounded = np.floor(p * PLACES + 0.5)
            length = sent[i + 1 :] - sent[i]
            for k, unit in enumerate(units):
                ok = rounded >= unit
                count[k] += ok.sum()
                messages[k] += int((ok.sum(axis=1) * length).sum())
                total[k] += p[ok].sum()
        return pa.RecordBatch.from_arrays(
            [pa.array(levels), pa.array(count), pa.array(messages), pa.array(total)],
            names=["threshold", "n_segments", "n_msgs", "sum_p"],
        )

    partial = _sorted_hours(hours).mapInArrow(lambda it: _per_range(it, dim, handle), SWEEP_SCHEMA)
    return sweep_table(partial)


def sweep_table(partial: DataFrame) -> DataFrame:
    """Sums per threshold to the reported averages; zero segments give zero averages."""
    summed = partial.groupBy("threshold").agg(
        F.sum("n_segments").alias("n_segments"), F.sum("n_msgs").alias("n_msgs"), F.sum("sum_p").alias("sum_p")
    )
    per_segment = F.greatest(F.col("n_segments"), F.lit(1))
    return summed.select(
        "threshold",
        "n_segments",
        (F.col("n_msgs") / per_segment).alias("avg_length"),
        "n_msgs",
        (F.col("sum_p") / per_segment).alias("avg_p"),
    )


def sweep_blocks(blocks: DataFrame) -> DataFrame:
    """The same table for greedy blocks of several thresholds (from one walk)."""
    partial = blocks.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum("n_msgs").alias("n_msgs"), F.sum("p").alias("sum_p")
    )
    return sweep_table(partial)
