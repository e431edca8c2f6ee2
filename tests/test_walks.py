"""Blocks of a model walked in tasks, spans as rows, neighbours of vectors, CSV files in splits: against plain restatements."""

import csv
import random

import numpy as np
import pytest

from talkspan.functions import vectors as vx
from talkspan.operators import blocks as bk
from talkspan.operators import embeddings as em
from talkspan.operators import model_blocks as mb
from talkspan.operators import neighbours as nb
from talkspan.operators import spans as sp
from talkspan.operators.topics import TopicSpace
from talkspan.sources import csv_records as cr

SPACE = TopicSpace(("a", "b", "c"), vx.unit_rows([[1, 0, 0.2], [0, 1, 0.2], [0.3, 0.3, 1]]))
THRESHOLD, GATE = 0.34, 0.2


def letters():
    """A model as a local function, which travels to the workers by value."""

    def load():
        import numpy as np

        def encode(texts):
            counts = np.asarray([[t.count(c) for c in "abc"] for t in texts], dtype=float)
            return counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-9)

        return encode

    return load


load_letters = letters()
PROVIDER = em.PandasProvider(load_letters, 3, batch_size=7)


def softmax(text):
    vec = np.floor(load_letters()([text])[0] * vx.SCALE + 0.5)
    size = np.sqrt((vec**2).sum()) or 1.0
    return vx.softmax_rows(SPACE.rows @ vec / size)


def plain_walk(texts, allowed):
    """`topic, first, last, p` of the greedy rule over one sender's hours, topic by topic."""
    unit = lambda p: int(np.floor(p * bk.PLACES + 0.5))
    least, out = unit(THRESHOLD), []
    own = {i: softmax(t) for i, t in texts.items()}
    for topic in range(3):
        block = None
        for i in sorted(texts):
            seed = unit(own[i][topic]) >= least and allowed[i][topic]
            if block and not (seed and block[1] == i - 1 and unit((p := softmax(block[2] + " " + texts[i]))[topic]) >= least):
                out.append((topic, *block[:2], round(block[3], 9)))
                block = None
                if seed:
                    block = (i, i, texts[i], own[i][topic])
            elif block:
                block = (block[0], i, block[2] + " " + texts[i], p[topic])
            elif seed:
                block = (i, i, texts[i], own[i][topic])
        if block:
            out.append((topic, *block[:2], round(block[3], 9)))
    return out


def hours_frame(spark, senders):
    rows = [(s, i, 2 * i, 3, text) for s, texts in senders.items() for i, text in texts.items()]
    frame = spark.createDataFrame(rows, "sender string, ord int, hour_idx int, n_msgs long, text string")
    return frame.selectExpr("*", "timestamp_ntz'2024-01-01' AS first_ts", "timestamp_ntz'2024-01-02' AS last_ts")


def scored_frame(spark, senders, allowed):
    rows = [(s, i, 2 * i, softmax(t).tolist(), [1.0 if x else 0.0 for x in allowed[s][i]])
            for s, texts in senders.items() for i, t in texts.items()]
    return spark.createDataFrame(rows, "sender string, ord int, hour_idx int, p array<double>, sims array<double>")


@pytest.mark.parametrize("group", [2, 256])
def test_walked_blocks_follow_the_greedy_rule(spark, monkeypatch, group):
    monkeypatch.setattr(mb, "GROUP_CHAINS", group)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aabbccd") for _ in range(rng.choice([1, 3, 9])))
    senders = {f"s{k}": {i: word() for i in range(1, rng.choice([1, 2, 8, 40]) + 1)} for k in range(9)}
    senders["long"] = {i: rng.choice(["aaa", "aab", "aad"]) for i in range(1, 30)}
    allowed = {s: {i: [rng.random() < 0.95 for _ in range(3)] for i in t} for s, t in senders.items()}
    hours, scored = hours_frame(spark, senders), scored_frame(spark, senders, allowed)
    got = mb.walked_blocks(hours, scored, PROVIDER, SPACE, THRESHOLD, GATE).collect()
    want = [(s, *x) for s, t in senders.items() for x in plain_walk(t, allowed[s])]
    assert sorted((r.sender, r.topic_idx, r.start_ord, r.end_ord, round(r.p, 9)) for r in got) == sorted(want)
    assert all(r.n_hours == r.end_ord - r.start_ord + 1 and r.n_msgs == 3 * r.n_hours for r in got)
    assert max(r.n_hours for r in got) > 3


def test_jobs_of_a_walk_do_not_grow_with_its_islands(spark):
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    used = []
    for n in (2, 500):
        senders = {"s": {i: "a" for i in range(1, n + 1)}, "t": {1: "b", 2: "b"}}
        allowed = {s: {i: [True] * 3 for i in t} for s, t in senders.items()}
        before = jobs()
        got = mb.walked_blocks(hours_frame(spark, senders), scored_frame(spark, senders, allowed), PROVIDER, SPACE, THRESHOLD).collect()
        used.append(jobs() - before)
        assert ("s", 0, 1, n) in {(r.sender, r.topic_idx, r.start_ord, r.end_ord) for r in got}
    assert used[0] == used[1]


def test_a_walk_over_nothing(spark):
    senders = {"s": {1: "d"}}
    hours, scored = hours_frame(spark, senders), scored_frame(spark, senders, {"s": {1: [True] * 3}})
    assert mb.walked_blocks(hours.limit(0), scored.limit(0), PROVIDER, SPACE, THRESHOLD).count() == 0
    assert mb.walked_blocks(hours, scored, PROVIDER, SPACE, 0.9).count() == 0
    nothing = scored.selectExpr("sender", "ord", "hour_idx", "CAST(NULL AS array<double>) AS p", "sims")
    assert mb.walked_blocks(hours, nothing, PROVIDER, SPACE, 0.3).count() == 3  # no evidence: uniform


@pytest.mark.parametrize("bound", [1, 3, 100])
def test_span_rows_are_all_short_spans_that_pass(spark, bound):
    rng = np.random.default_rng(2)
    rows = [(s, int(h), 1, [int(x) for x in rng.normal(size=3) * 1e6]) for s, n in (("x", 11), ("y", 1), ("z", 7)) for h in range(n)]
    frame = spark.createDataFrame(rows, "sender string, hour_idx int, n_msgs long, vec array<bigint>")
    got = sorted((r.sender, r.topic_idx, r.start_ord, r.end_ord, round(r.p, 9)) for r in sp.span_rows(frame, SPACE, 0.4, bound).collect())
    want = []
    for s in "xyz":
        vecs = np.array([v for name, _, _, v in rows if name == s], float)
        for i in range(len(vecs)):
            for j in range(i, min(len(vecs), i + bound)):
                v = vecs[i : j + 1].sum(axis=0)
                p = vx.softmax_rows(SPACE.rows @ v / np.sqrt((v**2).sum()))
                want += [(s, t, i + 1, j + 1, round(float(p[t]), 9)) for t in range(3) if np.floor(p[t] * 1e9 + 0.5) >= 4e8]
    assert got == sorted(want) and want
    with pytest.raises(ValueError):
        sp.span_rows(frame, SPACE, 0.4, 0)


def plain_neighbours(rows, k):
    unit = vx.unit_rows([v for _, v in rows])
    out = []
    for i, (a, _) in enumerate(rows):
        near = sorted((-int(np.floor(unit[i] @ unit[j] * 1e9 + 0.5)), b) for j, (b, _) in enumerate(rows) if b != a)
        out += [(a, n + 1, b, -less) for n, (less, b) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,block", [(1, 2048), (4, 16), (30, 2048)])
def test_neighbours_are_exact(spark, monkeypatch, k, block):
    monkeypatch.setattr(nb, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    hubs = rng.normal(size=(6, 5))
    points = hubs[rng.integers(0, 6, 260)] + 0.05 * rng.normal(size=(260, 5))
    points[[3, 9]] = 0
    vecs = [[int(x) for x in np.floor(v * 1e6)] for v in points] + [[int(x) for x in np.floor(points[7] * 1e6)]] * 60
    rows = list(enumerate(vecs, start=-5))
    frame = spark.createDataFrame([*rows, (None, [1] * 5), (999, None)], "id long, vec array<bigint>")
    found = nb.nearest_of_each(frame, k, "id", 8)
    got = sorted((r.id, r.rank, r.neighbour, int(np.floor(r.sim * 1e9 + 0.5))) for r in found.rows.collect())
    assert got == plain_neighbours(rows, k) and found.n_nodes == 259
    if k == 4:
        assert found.visits < 3 * found.n_nodes  # of eight cells; the zero vector asks all


def test_neighbours_of_few_and_none(spark):
    schema = "id long, vec array<bigint>"
    assert nb.nearest_of_each(spark.createDataFrame([], schema), 3, "id").rows.count() == 0
    assert nb.nearest_of_each(spark.createDataFrame([(1, [5, 0])], schema), 3, "id").rows.count() == 0
    two = nb.nearest_of_each(spark.createDataFrame([(1, [5, 0]), (2, [0, 5])], schema), 3, "id").rows.collect()
    assert sorted((r.id, r.rank, r.neighbour, r.sim) for r in two) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]


def test_csv_splits_equal_the_reader_of_whole_files(spark, tmp_path):
    rng = random.Random(1)
    parts = ["a", "b ", '"', "\n", "\r\n", ",", "é", "\n\n", '""', "'", "漢", " ", "x" * 200]
    for f in range(3):
        with open(tmp_path / f"part{f}.csv", "w", newline="") as out:
            writer = csv.writer(out, lineterminator=["\n", "\r\n", "\n"][f], quoting=csv.QUOTE_ALL if f == 0 else csv.QUOTE_MINIMAL)
            writer.writerow(["Chatroom", "Sender", "Timestamp", "Text"])
            for i in range(120):
                text = "".join(rng.choice(parts) for _ in range(rng.choice([1, 5, 40, 400])))
                writer.writerow([f"c{f}", f"s{i}", "2024-01-01 00:00:01", text.strip() or "q"])
            out.write("\n\n" if f == 1 else "")
    whole = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        rows = cr.read(spark, str(tmp_path))
        got = rows.collect()
        assert len({(r["_file"], r["_at"]) for r in got}) > 12  # one file over several tasks
        # in files whose lines end in \r\n the reader of whole files makes \n of those inside quotes too; here they stay
        same = lambda r: repr((*r[:3], r[3].replace("\r\n", "\n") if r[0] == "c1" else r[3]))
        assert sorted(map(same, got)) == sorted(map(same, whole.collect()))
        order = [(r.Chatroom, r.Sender) for r in cr.numbered(rows).orderBy("row_id").collect()]
        assert order == [(f"c{f}", f"s{i}") for f in range(3) for i in range(120)]
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
