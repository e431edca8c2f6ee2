"""Whole runs and the cases that once went wrong: null vectors, file order, times, zones, models that don't add up."""

import datetime as dt
import random
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from talkspan import params as pm
from talkspan.functions import vectors as vx
from talkspan.operators import blocks as bk
from talkspan.operators import embeddings as em
from talkspan.operators import keywords as kw
from talkspan.operators import scoring as sc
from talkspan.operators import segments as sg
from talkspan.operators import spans as sp
from talkspan.operators.topics import TopicSpace
from talkspan.plans import jobs
from talkspan.sources import labels as lb
from talkspan.sources import messages as ms

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = TopicSpace(("x", "y"), np.eye(2))
DAY = dt.datetime(2024, 1, 1)


def vector_hours(spark, rows):
    df = spark.createDataFrame(rows, "sender string, hour_idx int, vec array<bigint>")
    at = F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("hour_idx"))
    return df.withColumns({"n_msgs": F.lit(1).cast("long"), "first_ts": at, "last_ts": at}).coalesce(1)


def test_null_vectors_keep_their_rows(spark):
    rows = [("a", 1, [9, 1]), ("a", 2, None), ("a", 3, [1, 9]), ("b", 1, None), ("b", 2, [1, 9])]
    hours = vector_hours(spark, rows)
    sims = {(r.sender, r.hour_idx): r.sims for r in sc.with_cosines(hours, SPACE).collect()}
    assert sims["a", 2] == sims["b", 1] == [0.0, 0.0]
    assert sims["a", 1][0] > 0.9 and sims["a", 3][1] > 0.9 and sims["b", 2][1] > 0.9
    found = {(r.sender, r.topic_idx, r.start_ord): r.best_p for r in sp.span_starts(hours, SPACE, 0.6).collect()}
    assert found["b", 1, 1] > 0.6 > found["b", 0, 1] and found["b", 1, 2] > 0.6
    walked = bk.vector_blocks(hours, SPACE, [0.6]).collect()
    assert sorted((r.sender, r.topic_idx, r.hour_idxs) for r in walked) == [("a", 0, [1]), ("a", 1, [3]), ("b", 1, [2])]
    gated = bk.vector_blocks(sc.with_cosines(hours, SPACE), SPACE, [0.5], 0.9, "sims").collect()
    assert ("a", 0, (1, 2)) in {(r.sender, r.topic_idx, tuple(r.hour_idxs)) for r in gated}  # no vector passes the gate


def test_span_ranges_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("a", h, [rng.randrange(9), rng.randrange(9)]) for h in range(30)] + [("b", 1, [1, 0])]
    hours = vector_hours(spark, rows)
    key = lambda df: sorted(map(tuple, df.collect()))
    whole, sums = key(sp.span_starts(hours, SPACE, 0.6)), key(sp.sweep_spans(hours, SPACE, [0.5, 0.7]))
    monkeypatch.setattr(sp, "START_HOURS", 7)
    cut = key(sp.span_starts(hours, SPACE, 0.6))
    assert [r[:5] for r in cut] == [r[:5] for r in whole] and np.allclose([r[5] for r in cut], [r[5] for r in whole])
    assert [r[6] for r in cut] == [r[6] for r in whole]
    assert np.allclose(key(sp.sweep_spans(hours, SPACE, [0.5, 0.7])), sums)


def test_ties_go_to_the_lower_topic_on_nine_places(spark):
    rows = spark.createDataFrame([([0.3, 0.35, 0.35 + 1e-13],)], "p array<double>")
    assert rows.select(sc.most_likely(F.col("p"))).first()[0] == 1


def test_rows_keep_the_order_of_files(spark, tmp_path):
    at = 0
    for name, n in (("a.csv", 1), ("b.csv", 50), ("c.csv", 200)):
        lines = ["Chatroom,Sender,Timestamp,Text"]
        for _ in range(n):
            lines.append(f'r,s,2024-01-01 00:00:00,"{at}\nmore"')
            at += 1
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    rows = ms.read_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [int(r.text.split("\n")[0]) for r in rows] == list(range(251))
    assert len({r.row_id for r in rows}) == 251


def export(spark, times):
    rows = [("r", "s", t, f"text {i}", i) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "Chatroom string, Sender string, Timestamp string, Text string, n long")


def test_unreadable_times_are_an_error_or_are_told(spark):
    raw = export(spark, ["2024-01-01 10:00:00", "5/1/2018 10:00", None])
    with pytest.raises(Exception, match="unreadable message time"):
        ms.from_raw(raw).collect()
    kept = ms.from_raw(raw, bad_times="keep", sequence="n")
    assert [r.row_id for r in ms.unreadable(kept).orderBy("row_id").collect()] == [1, 2]
    assert kept.where("row_id = 0").first().ts == dt.datetime(2024, 1, 1, 10)


def test_durations_do_not_know_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        rows = spark.sql("SELECT timestamp_ntz'2024-03-31 01:30:00.7' AS start_ts, timestamp_ntz'2024-03-31 03:30:00' AS end_ts")
        found = sg.bounds(rows).first()
        assert found.duration_s == 7200 and found.start_ts == dt.datetime(2024, 3, 31, 1, 30)
        gap = spark.sql("SELECT 'u' AS sender, timestamp_ntz'2024-03-31 02:30:00' AS start_ts, timestamp_ntz'2024-03-31 02:30:00' AS end_ts,"
                        " 0L AS duration_s, 't' AS topic, 0.5D AS p, '' AS chat_summary")
        shown = sg.csv_form(gap).first()
        assert shown["Start Date"] == "2024-03-31" and shown["Start Time"] == "02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_only_a_missing_path_is_no_data(spark, tmp_path):
    assert lb.read_csv(spark, str(tmp_path / "absent")) is None
    assert lb.read_runs(spark, str(tmp_path / "absent"), ["x"]).count() == 0
    odd = AnalysisException(message="no rights", errorClass=None)
    assert not lb.missing_path(odd)


def load_fruit_model():
    import numpy as np

    def encode(texts):
        counts = np.asarray([[t.count("apple"), t.count("bread")] for t in texts], dtype=float)
        return counts / np.maximum(np.sqrt((counts**2).sum(axis=1, keepdims=True)), 1e-9)

    return encode


def chat(spark, rows):
    """(sender, hour, text) as messages."""
    full = [(i, "room", s, DAY + dt.timedelta(hours=h), t, "") for i, (s, h, t) in enumerate(rows)]
    return spark.createDataFrame(full, "row_id long, chatroom string, sender string, ts timestamp_ntz, text string, prompt string")


def plain_greedy(texts, score, threshold):
    """Blocks of one sender and topic as (first, last, p), hour by hour."""
    out, open_ = [], None
    for i, t in enumerate(texts):
        own = score(t)
        if own < threshold:
            out += [open_] if open_ else []
            open_ = None
            continue
        if open_:
            together = score(" ".join(texts[open_[0] : i + 1]))
            if together >= threshold:
                open_ = (open_[0], i, together)
                continue
            out.append(open_)
        open_ = (i, i, own)
    return out + ([open_] if open_ else [])


def fruit_p(topic):
    encode = load_fruit_model()

    def score(text):
        v = encode([text])[0]
        sims = v / max(np.sqrt((v * v).sum()), 1e-9)
        return float(vx.softmax_rows(np.round(sims, 12)[None, :])[0][topic])

    return score


def test_blocks_of_a_model_that_does_not_add_up(spark):
    rng = random.Random(9)
    hours = {"u": ["apple " * 9, "bread"]}
    for s in "vwx":
        hours[s] = [" ".join(rng.choice(["apple", "bread", "apple", "carrot"]) for _ in range(rng.randrange(1, 6))) for _ in range(12)]
    rows = [(s, h, t.strip()) for s, texts in hours.items() for h, t in enumerate(texts)]
    provider = em.PandasProvider(load_fruit_model, 2)
    params = pm.RunParams(topics=("apple", "bread"), threshold=0.5, use_keywords=False, lemmatize=False)
    run = jobs.analyse(chat(spark, rows), params, provider)
    got = {}
    for r in run.blocks.collect():
        got.setdefault((r.sender, r.topic_idx), []).append((r.start_ord - 1, r.end_ord - 1, r.p))
    run.release()
    for s, texts in hours.items():
        for topic in (0, 1):
            want = plain_greedy([t.strip() for t in texts], fruit_p(topic), 0.5)
            found = sorted(got.get((s, topic), []))
            assert [x[:2] for x in found] == [x[:2] for x in want]
            assert np.allclose([x[2] for x in found], [x[2] for x in want], atol=1e-5)


def test_a_joined_text_is_scored_as_one(spark):
    """Nine apples, then bread: the sum of the two hours' vectors would say 0.5 for both."""
    provider = em.PandasProvider(load_fruit_model, 2)
    params = pm.RunParams(topics=("apple", "bread"), threshold=0.2, use_keywords=False, lemmatize=False)
    run = jobs.analyse(chat(spark, [("u", 0, ("apple " * 9).strip()), ("u", 1, "bread")]), params, provider)
    found = {r.topic_idx: r for r in run.blocks.collect()}
    run.release()
    assert found[0].n_hours == found[1].n_hours == 2
    assert abs(found[0].p - 0.7075) < 1e-3 and abs(found[1].p - 0.2925) < 1e-3


def test_keyword_blocks_of_a_model_that_does_not_add_up(spark):
    rows = [("u", h, t) for h, t in enumerate(["apple pie apple", "apple bread", "bread bread butter", "apple"])]
    provider = em.PandasProvider(load_fruit_model, 2)
    params = pm.RunParams(topics=("apple", "bread"), threshold=0.55, lemmatize=False, provider="pandas")
    run = jobs.analyse(chat(spark, rows), params, provider)
    space = TopicSpace(("apple", "bread"), np.eye(2))
    model = kw.keyword_model(pm.BASELINE, provider, provider, space)

    def score(text):
        docs = spark.createDataFrame([(1, text, text.split())], "id int, text string, words array<string>")
        return kw.score(docs, ["id"], model).first().p[0]

    got = [(r.start_ord - 1, r.end_ord - 1) for r in run.blocks.where("topic_idx = 0").orderBy("start_ord").collect()]
    run.release()
    assert got == [x[:2] for x in plain_greedy([r[2] for r in rows], score, 0.55)]


def test_a_table_without_a_text_is_no_evidence(spark):
    rows = [("u", 0, "apple"), ("u", 1, "unknown words"), ("u", 2, "apple")]
    table = spark.createDataFrame([("apple", [1, 0]), ("bread", [0, 1])], "text string, vec array<bigint>")
    params = pm.RunParams(topics=("apple", "bread"), threshold=0.6, use_keywords=False, lemmatize=False)
    run = jobs.analyse(chat(spark, rows), params, em.TableProvider(table, 2))
    assert [(r.topic_idx, r.hour_idxs) for r in run.blocks.orderBy("start_ord").collect()] == [(0, [0]), (0, [2])]
    run.release()


def test_segments_are_worked_out_once(spark):
    rows = [("u", h, "apple tree") for h in range(3)] + [("v", 1, "apple")]
    params = pm.RunParams(topics=("apple", "bread"), threshold=0.5, use_keywords=False, lemmatize=False)
    provider = em.HashProvider(16)
    run = jobs.analyse(chat(spark, rows), params, provider)
    run.release()
    full = run.with_transcripts()
    plan = full._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert all(r.chat_summary.count("\n") + 1 == r.n_msgs and len(r.hour_idxs) == r.n_hours for r in full.collect())
