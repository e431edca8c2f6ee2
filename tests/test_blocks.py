import datetime as dt
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from talkspan.functions import vectors as vx
from talkspan.operators import blocks as bk
from talkspan.operators import hours as hr
from talkspan.operators import scoring as sc
from talkspan.operators import segments as sg
from talkspan.operators import spans as sp
from talkspan.operators import tiles as ti
from talkspan.operators.topics import TopicSpace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

T0 = dt.datetime(2024, 1, 1)


class TableEvidence:
    """Hours are their numbers; the passing spans are listed."""

    columns = ()

    def __init__(self, passing):
        self.passing = set(passing)

    def hours(self, batch):
        return [(h,) for h in batch.column("hour_idx").to_pylist()]

    def join(self, block, hour):
        return block + hour

    def score(self, blocks):
        return np.array([[1.0 if b in self.passing else 0.0] for b in blocks])


def hour_rows(spark, rows, schema="sender string, hour_idx int"):
    df = spark.createDataFrame(rows, schema)
    at = F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour_idx"))
    return df.withColumn("n_msgs", F.lit(1).cast("long")).withColumn("first_ts", at).withColumn("last_ts", at)


GOLDEN = [
    ("idle gap", [1, 2, 9], [(1,), (2,), (9,), (1, 2), (1, 2, 9)], [[1, 2, 9]]),
    ("non-seed breaks", [1, 2, 3], [(1,), (3,)], [[1], [3]]),
    ("failed extension", [1, 2, 3], [(1,), (2,), (3,), (2, 3)], [[1], [2, 3]]),
    ("late failure", [1, 2, 3], [(1,), (2,), (3,), (1, 2)], [[1, 2], [3]]),
    ("recovery is not used", [1, 2, 3], [(1,), (2,), (3,), (1, 2, 3)], [[1], [2], [3]]),
    ("inactive hour left out", [1, 3], [(1,), (3,), (1, 3)], [[1, 3]]),
    ("midnight", [23, 24], [(23,), (24,), (23, 24)], [[23, 24]]),
    ("no seed", [1, 2], [], []),
]


@pytest.mark.parametrize("name, active, passing, expected", GOLDEN, ids=[g[0] for g in GOLDEN])
def test_golden_blocks(spark, name, active, passing, expected):
    hours = hour_rows(spark, [("u", h) for h in active])
    found = bk.greedy_blocks(hours, TableEvidence(passing), 1, [0.5]).orderBy("block_no").collect()
    assert [r.hour_idxs for r in found] == expected
    assert [r.block_no for r in found] == list(range(1, len(expected) + 1))


@pytest.mark.parametrize(
    "sims, expected", [([1.0, 0.1], [[1]]), ([1.0, 0.1, 1.0], [[1], [3]]), ([1.0, None], [[1, 2]])]
)
def test_gate(spark, sims, expected):
    rows = [("u", h, [s]) for h, s in enumerate(sims, 1)]
    hours = hour_rows(spark, rows, "sender string, hour_idx int, sims array<double>")
    every = [tuple(range(a, b)) for a in range(1, 5) for b in range(a + 1, 5)]
    found = bk.greedy_blocks(hours, TableEvidence(every), 1, [0.5], 0.2, "sims").orderBy("block_no").collect()
    assert [r.hour_idxs for r in found] == expected


def test_threshold_equality(spark):
    found = bk.greedy_blocks(hour_rows(spark, [("u", 1)]), TableEvidence([(1,)]), 1, [1.0]).collect()
    assert [r.hour_idxs for r in found] == [[1]]


def probability(vecs, rows):
    total = np.sum(vecs, axis=0)
    size = np.sqrt((total**2).sum())
    cos = rows @ total / size if size else np.zeros(len(rows))
    e = np.exp(cos - cos.max())
    return e / e.sum()


def walk(hours, vecs, rows, topic, t, gate=0.0):
    """The greedy rule restated: hour by hour, scoring the whole block each time."""
    good = lambda vs: round(probability(vs, rows)[topic], 9) >= t
    cos = lambda v: rows[topic] @ v / np.sqrt((v**2).sum())
    blocks, curr = [], []
    for h, v in zip(hours, vecs):
        seed = good([v]) and (gate == 0 or round(cos(v), 9) >= gate)
        if not seed:
            if curr:
                blocks.append(curr)
            curr = []
        elif not curr:
            curr = [(h, v)]
        elif good([x for _, x in curr] + [v]):
            curr = curr + [(h, v)]
        else:
            blocks.append(curr)
            curr = [(h, v)]
    if curr:
        blocks.append(curr)
    return [[h for h, _ in b] for b in blocks]


@pytest.fixture(scope="module")
def random_hours(spark):
    rng = np.random.default_rng(11)
    topics = vx.unit_rows(rng.normal(size=(4, 6)))
    data = {}
    for u in range(12):
        active = sorted(rng.choice(200, size=int(rng.integers(1, 60)), replace=False).tolist())
        data[f"u{u:02d}"] = (active, np.floor(rng.normal(size=(len(active), 6)) * 1e6))
    rows = [(u, h, [int(x) for x in v]) for u, (hs, vs) in data.items() for h, v in zip(hs, vs)]
    frame = hour_rows(spark, rows, "sender string, hour_idx int, vec array<bigint>").persist()
    return TopicSpace(("a", "b", "c", "d"), topics), data, frame


@pytest.mark.parametrize("gate", [0.0, 0.2])
def test_vector_blocks_against_brute_force(spark, random_hours, gate):
    space, data, frame = random_hours
    thresholds = [0.2, 0.25, 0.3]
    scored = sc.with_cosines(frame, space)
    found = bk.vector_blocks(scored, space, thresholds, gate, "sims" if gate else None).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.threshold, r.sender, r.topic_idx, r.block_no)):
        got.setdefault((r.threshold, r.sender, r.topic_idx), []).append(r.hour_idxs)
    expected = {}
    for t in thresholds:
        for u, (hs, vs) in data.items():
            for k in range(4):
                blocks = walk(hs, vs, space.rows, k, t, gate)
                if blocks:
                    expected[(t, u, k)] = blocks
    assert got == expected


def test_blocks_do_not_depend_on_partitioning(spark, random_hours):
    space, _, frame = random_hours
    key = ["sender", "topic_idx", "block_no"]
    one = bk.vector_blocks(frame.repartition(1), space, [0.25]).orderBy(*key).collect()
    many = bk.vector_blocks(frame.repartition(13, "hour_idx"), space, [0.25]).orderBy(*key).collect()
    assert one == many


def test_batch_borders_inside_a_sender(spark, random_hours):
    space, _, frame = random_hours
    key = ["sender", "topic_idx", "block_no"]
    whole = bk.vector_blocks(frame, space, [0.2]).orderBy(*key).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert bk.vector_blocks(frame, space, [0.2]).orderBy(*key).collect() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_block_properties(spark, random_hours):
    space, _, frame = random_hours
    scored = hr.with_ordinal(sc.with_direct_p(frame, space))
    seeds = {(r.sender, r.topic_idx, r.ord) for r in bk.seeds(scored, 0.25).collect()}
    runs = bk.islands(bk.seeds(scored, 0.25)).collect()
    island = {(r.sender, r.topic_idx, r.ord): r.island for r in runs}
    covered = []
    for r in bk.vector_blocks(frame, space, [0.25]).collect():
        ords = range(r.start_ord, r.end_ord + 1)
        assert len({island[(r.sender, r.topic_idx, o)] for o in ords}) == 1
        assert round(r.p, 9) >= 0.25
        covered += [(r.sender, r.topic_idx, o) for o in ords]
    assert sorted(covered) == sorted(seeds)  # every seed in exactly one block


def test_probabilities_sum_to_one_in_all_forms(spark, random_hours):
    space, _, frame = random_hours
    native = sc.with_cosines_native(frame, space).orderBy("sender", "hour_idx").select("sims").collect()
    arrow = sc.with_cosines(frame, space).orderBy("sender", "hour_idx").select("sims").collect()
    assert np.allclose([r.sims for r in native], [r.sims for r in arrow], atol=1e-12)
    p = [r.p for r in sc.with_direct_p(frame, space).collect()]
    assert np.allclose(np.sum(p, axis=1), 1.0)


def test_exhaustive_spans_against_brute_force(spark, random_hours):
    space, data, frame = random_hours
    found = {
        (r.sender, r.topic_idx, r.start_ord): (r.n_spans, r.n_passing, round(r.best_p, 9), r.best_end)
        for r in sp.span_starts(frame, space, 0.26).collect()
    }
    expected, counts, sent = {}, 0, 0
    for u, (hs, vs) in data.items():
        for i in range(len(hs)):
            p = np.array([probability(vs[i : j + 1], space.rows) for j in range(i, len(hs))])
            for k in range(4):
                r = np.round(p[:, k], 9)
                best = int(np.argmax(r))
                expected[(u, k, i + 1)] = (len(r), int((r >= 0.26).sum()), float(r[best]), i + 1 + best)
                counts += int((r >= 0.26).sum())
                sent += int(sum(n + 1 for n in np.flatnonzero(r >= 0.26)))
    assert found == expected
    row = sp.sweep_spans(frame, space, [0.26, 0.99]).orderBy("threshold").collect()
    assert (row[0].n_segments, row[0].n_msgs) == (counts, sent)
    assert (row[1].n_segments, row[1].avg_length, row[1].avg_p) == (0, 0.0, 0.0)


def test_long_and_array_scores_agree(spark, random_hours):
    space, _, frame = random_hours
    topics = spark.createDataFrame(
        [(i, n, [int(x * 1e9) for x in v]) for i, (n, v) in enumerate(zip(space.names, space.rows))],
        "topic_idx int, name string, vec array<bigint>",
    )
    sims = ti.similarities(frame, topics, 4, "sender", "hour_idx")
    long = {
        (r.sender, r.hour_idx, r.topic_idx): r.p
        for r in sc.softmax_long(sims, "sender", "hour_idx", score="sim").collect()
    }
    for r in sc.with_direct_p(frame, space).collect():
        for k in range(4):
            assert long[(r.sender, r.hour_idx, k)] == pytest.approx(r.p[k], abs=1e-6)


def test_segment_rows(spark):
    messages = spark.createDataFrame(
        [
            (1, "room", "u", dt.datetime(2024, 1, 1, 23, 10, 5, 999), "first\nline", 23),
            (2, "room", "u", dt.datetime(2024, 1, 1, 23, 40), "second", 23),
            (3, "hall", "u", dt.datetime(2024, 1, 2, 0, 11, 6), None, 24),
        ],
        "row_id long, chatroom string, sender string, ts timestamp_ntz, text string, hour_idx int",
    )
    hours = hr.hour_stats(hr.with_words(messages))
    found = bk.greedy_blocks(hours, TableEvidence([(23,), (24,), (23, 24)]), 1, [0.5])
    row = sg.csv_form(sg.with_transcripts(sg.segments(found, ["News"]), messages)).first()
    assert row["Start Date"] == "2024-01-01" and row["Start Time"] == "23:10:05"
    assert row["End Date"] == "2024-01-02" and row["End Time"] == "00:11:06"
    assert row["Time Duration"] == "1:01:01" and row["Topic"] == "News"
    assert row["Chat Summary"] == (
        "u :: room [2024-01-01 23:10:05]: first\nline\n"
        "u :: room [2024-01-01 23:40:00]: second\n"
        "u :: hall [2024-01-02 00:11:06]: "
    )


def test_hour_texts_join_in_row_order(spark, monkeypatch):
    texts = ["", "", "a", "", "b", None, "c c", ""]
    rng = random.Random(3)
    rows = [(i, "u", T0 + dt.timedelta(minutes=i), t, 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    frame = hr.with_words(
        spark.createDataFrame(rows, "row_id long, sender string, ts timestamp_ntz, text string, hour_idx int"), ()
    )
    for size in (100, 3, 2, 1):  # slices of any size give the same text
        monkeypatch.setattr(hr, "SLICE_ROWS", size)
        row = hr.hour_texts(frame).first()
        assert row.text == "a  b c c "
        assert row.words == ["a", "b", "c", "c"] and row.n_msgs == len(texts)
