"""Seeds, islands and greedy blocks.

A block of (sender, topic) is a run of consecutive active hours. It opens at a seed, grows by the
next hour while that hour is a seed and the text of both together still passes the threshold, and
closes otherwise. Hours without words are not in the walk, so they neither close nor extend.

The walk is a scan over hours sorted within sender partitions. Its input is the pre-aggregated hour
table: at most 24 rows per calendar day for any sender, whatever the number of messages. It reads
Arrow batches, keeps only the evidence of the blocks that are open, serves all topics and thresholds
in one pass, and emits a block when it closes. No spans are enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspan.functions import vectors as vx
from talkspan.operators.scoring import cosine_rows, list_matrix
from talkspan.operators.topics import TopicSpace

BLOCK_SCHEMA = (
    "level int, threshold double, sender string, topic_idx int, block_no int, start_ord int, end_ord int, "
    "n_hours int, n_msgs bigint, start_ts timestamp_ntz, end_ts timestamp_ntz, p double, "
    "hour_idxs array<int>"
)
# A block's key. `level` numbers the thresholds of a walk; floating-point numbers make poor join keys.
BLOCK_KEY = ("level", "sender", "topic_idx", "block_no")
PLACES = 1e9  # probabilities meet thresholds after rounding to nine places


def passes(p, threshold: float):
    """Column form of every threshold and gate test: `p >= threshold` on nine places."""
    return F.floor(p * F.lit(PLACES) + F.lit(0.5)) >= F.lit(_units(threshold))


def _units(threshold: float) -> int:
    return int(np.floor(threshold * PLACES + 0.5))


def _open(sim, gate: float):
    """Does a similarity pass the gate? Unknown texts do."""
    return passes(F.coalesce(sim, F.lit(1.0)), gate)


def gate_stats(hours: DataFrame, gate: float, sims: str = "sims") -> DataFrame:
    """Hours checked and skipped, counted once per (sender, topic) check."""
    checked = F.coalesce(F.sum(F.size(sims)), F.lit(0)).cast("long")
    skipped = F.coalesce(
        F.sum(F.size(F.filter(F.col(sims), lambda s: ~_open(s, gate)))), F.lit(0)
    ).cast("long")
    if gate <= 0:
        skipped = F.lit(0).cast("long")
    return hours.agg(checked.alias("checked"), skipped.alias("skipped")).withColumn(
        "skipped_pct", F.lit(100.0) * F.col("skipped") / F.greatest(F.col("checked"), F.lit(1))
    )


def seeds(scored: DataFrame, threshold: float, gate: float = 0.0) -> DataFrame:
    """Rows `sender, topic_idx, ord, hour_idx, p` of the seed hours. Needs `p` (array), and `sims`
    (array) when there is a gate."""
    extra = ["sims"] if gate > 0 else []
    kept = scored.select("sender", "ord", "hour_idx", F.posexplode("p").alias("topic_idx", "p"), *extra)
    kept = kept.where(passes(F.col("p"), threshold))
    if gate > 0:
        kept = kept.where(_open(F.get(F.col("sims"), F.col("topic_idx")), gate)).drop("sims")
    return kept.select("sender", "topic_idx", "ord", "hour_idx", "p")


def islands(seed_hours: DataFrame) -> DataFrame:
    """Adds `island`: runs of seeds with no active non-seed hour in between."""
    order = W.partitionBy("sender", "topic_idx").orderBy("ord")
    return seed_hours.withColumn("island", F.col("ord") - F.row_number().over(order))


class Evidence(Protocol):
    """What the walk needs to know about texts: hours from a batch, joining, scoring."""

    def hours(self, batch: pa.RecordBatch) -> Sequence[Any]: ...

    def join(self, block: Any, hour: Any) -> Any: ...

    def score(self, blocks: Sequence[Any]) -> np.ndarray: ...


class VectorEvidence:
    """Text = its vector; the vector of a block is the sum of its hours (exact: whole numbers)."""

    columns = ("vec",)

    def __init__(self, space: TopicSpace) -> None:
        self.rows = space.rows

    def hours(self, batch: pa.RecordBatch) -> np.ndarray:
        return list_matrix(batch.column("vec"), self.rows.shape[1])

    def join(self, block: np.ndarray, hour: np.ndarray) -> np.ndarray:
        return block + hour

    def sims(self, blocks) -> np.ndarray:
        return cosine_rows(np.asarray(blocks), self.rows)

    def score(self, blocks) -> np.ndarray:
        return vx.softmax_rows(self.sims(blocks))


class _Output:
    """Closed blocks of one batch, column by column."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(13)]

    def add(self, *values) -> None:
        for column, value in zip(self.columns, values):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        c = self.columns
        ts = pa.timestamp("us")
        return pa.RecordBatch.from_arrays(
            [
                pa.array(c[0], pa.int32()),
                pa.array(c[1], pa.float64()),
                pa.array(c[2], pa.string()),
                pa.array(c[3], pa.int32()),
                pa.array(c[4], pa.int32()),
                pa.array(c[5], pa.int32()),
                pa.array(c[6], pa.int32()),
                pa.array(c[7], pa.int32()),
                pa.array(c[8], pa.int64()),
                pa.array(c[9], pa.int64()).cast(ts),
                pa.array(c[10], pa.int64()).cast(ts),
                pa.array(c[11], pa.float64()),
                pa.array(c[12], pa.list_(pa.int32())),
            ],
            names=[part.strip().split(" ")[0] for part in BLOCK_SCHEMA.split(", ")],
        )


class _Open:
    """Blocks of one sender that share their first hour; they share their evidence as well."""

    __slots__ = ("start", "evidence", "p", "members")

    def __init__(self, start: int, evidence, p: np.ndarray, members: np.ndarray) -> None:
        self.start = start
        self.evidence = evidence
        self.p = p
        self.members = members


class _Sender:
    """The walk over one sender's active hours. Members are (threshold, topic) pairs, flattened."""

    def __init__(self, name: str, thresholds: Sequence[float], n_topics: int, out: "_Output") -> None:
        self.name = name
        self.thresholds = thresholds
        self.n_topics = n_topics
        self.hour_idx: list[int] = []
        self.first_ts: list[int] = []
        self.last_ts: list[int] = []
        self.messages: list[int] = [0]
        self.open: list[_Open] = []
        self.count = np.zeros(len(thresholds) * n_topics, dtype=np.int64)
        self.topic_of = np.tile(np.arange(n_topics), len(thresholds))
        self.out = out

    def close(self, block: _Open, members: np.ndarray) -> None:
        end = len(self.hour_idx)
        first = block.start - 1
        for m in members:
            k, topic = divmod(int(m), self.n_topics)
            self.count[m] += 1
            self.out.add(
                k,
                self.thresholds[k],
                self.name,
                topic,
                int(self.count[m]),
                block.start,
                end,
                end - first,
                self.messages[end] - self.messages[first],
                self.first_ts[first],
                self.last_ts[end - 1],
                float(block.p[topic]),
                self.hour_idx[first:end],
            )

    def step(self, evidence: Evidence, hour, own_p, seed, units, hour_idx, n_msgs, first_ts, last_ts) -> None:
        """One active hour: `seed` and `units` run over members, `own_p` over topics."""
        free = seed.copy()
        kept: list[_Open] = []
        reachable = [b for b in self.open if seed[b.members].any()]
        joined = [evidence.join(b.evidence, hour) for b in reachable]
        scores = evidence.score(joined) if joined else ()
        for block in self.open:
            if block not in reachable:
                self.close(block, block.members)
        for block, together, p in zip(reachable, joined, scores):
            m = block.members
            ok = seed[m] & (np.floor(p[self.topic_of[m]] * PLACES + 0.5) >= units[m])
            if not ok.all():
                self.close(block, m[~ok])
            if ok.any():
                free[m[ok]] = False
                kept.append(_Open(block.start, together, p, m[ok]))
        self.hour_idx.append(hour_idx)
        self.first_ts.append(first_ts)
        self.last_ts.append(last_ts)
        self.messages.append(self.messages[-1] + n_msgs)
        fresh = np.flatnonzero(free)
        if fresh.size:
            kept.append(_Open(len(self.hour_idx), hour, own_p, fresh))
        self.open = kept

    def finish(self) -> None:
        for block in self.open:
            self.close(block, block.members)
        self.open = []


def greedy_blocks(
    hours: DataFrame,
    evidence: Evidence,
    n_topics: int,
    thresholds: Sequence[float],
    gate: float = 0.0,
    gate_sims: str | None = None,
    own_p: str | None = None,
    lead: DataFrame | None = None,
    lots: int | None = None,
) -> DataFrame:
    """Blocks of every (threshold, sender, topic) as BLOCK_SCHEMA.

    `hours` are active cells with `sender, hour_idx, n_msgs, first_ts, last_ts` and the evidence
    columns. `own_p` names an array column with probabilities already known per hour; otherwise the
    evidence scores each hour. The gate compares `gate_sims` (array column).

    `lead` are rows that a task reads before the hours they belong to: both have a column `lot` (0 to `lots` - 1, all
    hours of a sender in one), and `evidence.read` takes the lead rows, told by `word_id`, out of the batches. Every
    lot is a partition of its own.

    Evidence may have `late(rows)`, which works out what it reads from its columns behind the move, and `carry(open)`, which
    is told the evidence of the open blocks before the next batch.
    """
    if gate > 0 and gate_sims is None:
        raise ValueError("a gate needs the name of its similarity column")
    thresholds = tuple(float(t) for t in thresholds)
    columns = ["sender", "hour_idx", "n_msgs", "first_ts", "last_ts", *evidence.columns]
    if gate > 0:
        columns.append(gate_sims)
    if own_p is not None:
        columns.append(own_p)
    units = np.repeat([_units(t) for t in thresholds], n_topics)
    n_sets = len(thresholds)
    read = iter if lead is None else evidence.read
    late = getattr(evidence, "late", lambda rows: rows)
    carry = getattr(evidence, "carry", None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker: _Sender | None = None
        for batch in read(batches):
            if batch.num_rows == 0:
                continue
            out = _Output()
            if walker is not None:
                walker.out = out
            if carry is not None:
                carry([block.evidence for block in walker.open] if walker is not None else [])
            cells = evidence.hours(batch)
            if own_p is None:
                p = evidence.score(cells)
            else:
                p = list_matrix(batch.column(own_p), n_topics)
            seed = np.tile(np.floor(p * PLACES + 0.5), (1, n_sets)) >= units
            if gate > 0:
                sims = np.floor(list_matrix(batch.column(gate_sims), n_topics, missing=1.0) * PLACES + 0.5)
                open_gate = sims >= _units(gate)
                if "vec" in evidence.columns:  # an hour without a vector is not known, and passes
                    open_gate |= np.asarray(batch.column("vec").is_null())[:, None]
                seed &= np.tile(open_gate, (1, n_sets))
            names = batch.column("sender").to_pylist()
            hour_idx = batch.column("hour_idx").to_pylist()
            n_msgs = batch.column("n_msgs").to_pylist()
            first_ts = batch.column("first_ts").cast(pa.int64()).to_pylist()
            last_ts = batch.column("last_ts").cast(pa.int64()).to_pylist()
            for r, name in enumerate(names):
                if walker is None or walker.name != name:
                    if walker is not None:
                        walker.finish()
                    walker = _Sender(name, thresholds, n_topics, out)
                walker.step(
                    evidence, cells[r], p[r], seed[r], units, hour_idx[r], n_msgs[r], first_ts[r], last_ts[r]
                )
            yield out.batch()
        if walker is not None:
            walker.out = _Output()
            walker.finish()
            yield walker.out.batch()

    if lead is not None:
        rows = hours.select("lot", *columns).unionByName(lead, allowMissingColumns=True)
        rows = rows.repartitionById(lots, F.col("lot"))
        first = F.col("word_id").asc_nulls_last()
        return late(rows.sortWithinPartitions("lot", first, "sender", "hour_idx")).mapInArrow(run, BLOCK_SCHEMA)
    rows = hours.select(*columns).repartition("sender")
    return late(rows.sortWithinPartitions("sender", "hour_idx")).mapInArrow(run, BLOCK_SCHEMA)


def vector_blocks(
    hours: DataFrame,
    space: TopicSpace,
    thresholds: Sequence[float],
    gate: float = 0.0,
    gate_sims: str | None = None,
) -> DataFrame:
    """Greedy blocks in direct mode, for additive vectors `vec` of active hours."""
    return greedy_blocks(hours, VectorEvidence(space), space.size, thresholds, gate, gate_sims)


def block_hours(blocks: DataFrame) -> DataFrame:
    """One row per hour of each block."""
    return blocks.select(
        *BLOCK_KEY, F.posexplode("hour_idxs").alias("pos", "hour_idx")
    )
