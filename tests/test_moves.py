"""How often texts move: the plans of steps that put texts together or take them apart."""

import datetime as dt

import pyarrow as pa

from pyspark.sql import functions as F

from catalog import base as b
from talkspan.functions import text as tx
from talkspan.operators import embeddings as em
from talkspan.operators import hours as hr
from talkspan.operators import keywords as kw
from talkspan import params as pm
from talkspan.operators import model_blocks as mb
from talkspan.operators import neighbours as nb
from talkspan.operators import scoring as sc
from talkspan.operators import segments as sg
from talkspan.plans import jobs
from talkspan.sources import messages as ms

T0 = dt.datetime(2024, 1, 1, 10)
MESSAGE = "row_id long, sender string, chatroom string, ts timestamp_ntz, text string, hour_idx int"


def messages(spark, *rows):
    """Rows `sender, hour_idx, text`."""
    full = [(i, s, "room", T0 + dt.timedelta(hours=h or 0, seconds=i), t, h) for i, (s, h, t) in enumerate(rows)]
    return spark.createDataFrame(full, MESSAGE).repartition(3)


def exchanges(frame):
    """Shuffles of a plan that carry a text or what was made of it."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")


CHAT = (
    ("a", 1, "The Cat's hat"), ("a", 1, None), ("a", 1, ""), ("a", 1, "dogs\nand CATS"), ("a", 2, "K2"), ("b", 1, "ünder way"),
    (None, 1, "no name"), ("b", None, "no hour"), ("b", 3, None), ("a", 1, "The Cat's hat"),
)


def test_hours_take_their_words_from_the_joined_text(spark):
    rows = messages(spark, *CHAT)
    moved = hr.hour_texts(hr.with_words(rows))
    read = hr.hour_texts(rows)
    assert sorted(map(str, read.collect())) == sorted(map(str, moved.collect()))
    some = hr.hour_texts(rows, ["cat"]).where("sender = 'a' AND hour_idx = 1").first()
    assert some["words"] == ["the", "s", "hat", "dogs", "and", "cats", "the", "s", "hat"]


def test_texts_of_hours_move_once(spark):
    rows = spark.createDataFrame(messages(spark, *CHAT).rdd, MESSAGE)
    assert exchanges(hr.hour_texts(rows).select(F.sha2("text", 256))) == 1


BLOCKS = "level int, sender string, topic_idx int, block_no int, hour_idxs array<int>"


def test_transcripts_are_put_together_once_per_run_of_hours(spark):
    rows = spark.createDataFrame(messages(spark, *CHAT).rdd, MESSAGE)
    found = spark.createDataFrame(
        [(0, "a", 0, 1, [1, 2]), (0, "a", 1, 1, [1, 2]), (0, "a", 2, 1, [2]), (0, "b", 0, 1, [3]), (0, "c", 0, 1, [3]), (0, None, 0, 1, [1])],
        BLOCKS,
    )
    parts = sg.transcripts(sg.transcript_parts(found, rows))
    whole = sg.block_transcripts(found, rows)
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    every = sg.with_transcripts(found, rows)
    assert every.columns == [*found.columns, "chat_summary"] and every.count() == found.count()
    assert every.where("sender = 'c'").first()["chat_summary"] == ""
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [sender" in plan and "topic_idx" not in plan.split("Aggregate [sender")[1].split("]")[0]


def spread_chat(spark):
    """Three senders, cells without messages, equal row ids, a missing text, and blocks that overlap and share hours."""
    said = [("abc"[i % 3], i * 7 % 12, None if i == 9 else f"t{i} \u00fc\n{i % 4}") for i in range(60)]
    rows = messages(spark, *said, ("a", 4, "z"), ("a", 4, "y"), (None, 1, "nobody"), ("b", None, "never"))
    rows = rows.withColumn("row_id", F.when(F.col("row_id") > 58, 58).otherwise(F.col("row_id")))
    hours = ([0, 1, 2, 3, 4], [2], [3, 4, 5], [2, 9, 11], [4, 5], [11], [2], [40])
    found = [(0, s, t, 1, h) for s in ("a", "b", "c", "d", None) for t, h in enumerate(hours)] + [(0, "a", 9, 1, [])]
    return rows, spark.createDataFrame(found, BLOCKS)


def test_transcripts_of_a_sender_are_read_in_one_pass(spark, monkeypatch):
    rows, found = spread_chat(spark)
    for how, whole in (("inner", lambda: sg.block_transcripts(found, rows)), ("left", lambda: sg.with_transcripts(found, rows))):
        runs = found.groupBy("sender", "hour_idxs").agg(F.collect_list("topic_idx").alias("own"))
        cells = sg._by_cells(runs, rows, None, how).select("sender", "hour_idxs", "chat_summary", F.explode("own").alias("topic_idx"))
        want = sorted((str(r.sender), r.topic_idx, r.chat_summary) for r in cells.collect())
        for hot, size, batch in ((1 << 16, 20, 3), (20, 1 << 24, 10_000), (0, 1 << 24, 7)):
            monkeypatch.setattr(sg, "HOT_MESSAGES", hot)
            monkeypatch.setattr(sg, "BATCH_BYTES", size)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            try:
                got = sorted((str(r.sender), r.topic_idx, r.chat_summary) for r in whole().collect())
            finally:
                spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            assert got == want


def test_texts_of_transcripts_move_once(spark):
    rows, found = spread_chat(spark)
    for frame in (sg.block_transcripts(found, rows), sg.with_transcripts(found, rows)):
        plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        # the messages with their blocks; below that only blocks move, and nothing is sorted anew
        above, walk = plan.split("FlatMapGroupsInArrow", 1)
        assert "Exchange" not in above and walk.count("Sort [") == 1
        assert walk.count("Exchange hashpartitioning") == 2 and walk.index("Exchange") < walk.index("Union")


def test_slices_of_lines_meet_their_cells_where_they_are(spark):
    rows = spark.createDataFrame(messages(spark, *CHAT).rdd, MESSAGE)
    assert exchanges(sg.line_slices(rows).groupBy(*hr.CELL).agg(F.sum("n_lines"))) == 1


def test_words_are_counted_per_document(spark, tmp_path):
    texts = spark.createDataFrame([(0, "The Cat's hat"), (1, None)], "doc_id long, text string")
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    events = spark.createDataFrame(
        [(i, T0, i % 2, "room") for i in range(6)], "event_id long, ts timestamp_ntz, user_id long, event_type string"
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    counted = b.counted(spark, str(tmp_path))
    words = hr.with_words(b.messages(spark, str(tmp_path))).select("row_id", F.size("words").alias("n"))
    assert {(r.row_id, r.n_words) for r in counted.collect()} == {(r.row_id, r.n) for r in words.collect()}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_replace")  # below the join, so once per document


def test_hashed_texts_equal_the_sums_of_their_words(spark):
    texts = ["The Cat's hat", "", "ünder 日本語の文 way_2 x", "a b c", "cat " * 500, "\U0001f600 oḱ K2"]
    frame = spark.createDataFrame([(f"h{i}", t) for i, t in enumerate(texts)] + [(None, None)], "text_hash string, text string")
    for dim in (16, 24):
        provider = em.HashProvider(dim)
        got = {r.text_hash: r.vec for r in provider.vectors(frame).collect()}
        counts = em.token_counts(frame, "text_hash", "text")
        want = em.sum_word_vectors(counts, provider.lexicon(counts), ["text_hash"], dim)
        assert got == {h: [0] * dim for h in got} | {r.text_hash: r.vec for r in want.collect()}
        assert len(got) == len(texts) + 1 and exchanges(provider.vectors(frame)) == 0


def test_hour_vectors_take_equal_texts_apart_once(spark):
    rows = hr.with_words(messages(spark, *CHAT, *[("c", h, "The Cat's hat") for h in range(5)]))
    tokens = rows.withColumn("tokens", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(tx.TOKEN), F.lit(1)))
    counted = hr.hour_word_counts(tokens, "tokens")

    class Words:  # additive, and not the hash provider itself
        additive, dim = True, 16
        lexicon = em.HashProvider(16).lexicon

    want = em.sum_word_vectors(counted, kw.lexicon(counted, Words), hr.CELL, 16)
    want = {(r.sender, r.hour_idx): r.vec for r in want.where("sender IS NOT NULL AND hour_idx IS NOT NULL").collect()}
    for provider in (em.HashProvider(16), Words):
        got = {(r.sender, r.hour_idx): r.vec for r in jobs.direct_hours(rows, provider).collect()}
        assert {k: v for k, v in got.items() if None not in k} == want


def test_similar_texts_meet_by_hash(spark):
    rows = spark.createDataFrame([(1, "Cats", "cats"), (2, None, "cats"), (3, "", "cats"), (4, "dogs", "DOGS")], "id int, left string, right string")
    found = em.text_similarity(rows, em.HashProvider(16))
    assert {r.id: round(r.similarity, 9) for r in found.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0}
    plan = em.text_similarity(rows, em.HashProvider(16)).select("id", "similarity")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l#" not in plan and "hashpartitioning(lower" not in plan


def test_cells_are_scored_without_their_texts(spark):
    from catalog.texts import LETTERS, load_letter_model

    rows = spark.createDataFrame(messages(spark, *CHAT).rdd, MESSAGE).drop("hour_idx")
    params = pm.RunParams(threshold=0.01, use_keywords=False, lemmatize=False, start_date="2024-01-01", end_date="2024-01-02")
    provider = em.make_provider("pandas", load=load_letter_model, dim=len(LETTERS))
    run = jobs.analyse(rows, params, provider)
    assert "text" not in run.hours.columns and "words" not in run.hours.columns
    whole = hr.hour_texts(ms.with_hours(rows, run.start, run.end)).where("n_words > 0")
    hours = hr.with_ordinal(jobs._embedded(whole, provider))
    space = run.scorer["space"]
    want = mb.walked_blocks(hours, sc.with_direct_p(hours, space), provider, space, 0.01)
    assert sorted(map(str, run.blocks.collect())) == sorted(map(str, want.collect())) and want.count() > 0
    run.release()


def test_texts_of_cells_move_once_and_again_only_in_chains(spark, monkeypatch):
    """Blocks of a model: what is kept are numbers, and the walk asks for the texts of the cells it puts together."""
    from catalog.texts import LETTERS, load_letter_model

    said = [("a", 1, "zzz"), ("a", 2, "zzz"), ("a", 4, "Politics"), ("b", 1, "zzz"), ("b", 7, "Sports tomorrow")]
    rows = spark.createDataFrame(messages(spark, *CHAT, *said).rdd, MESSAGE).drop("hour_idx")
    provider = em.make_provider("pandas", load=load_letter_model, dim=len(LETTERS))
    asked, walked_blocks = [], mb.walked_blocks

    def spied(hours, scored, provider, space, threshold, gate, texts):
        def some(cells):
            asked.append((cells.count(), hours.count()))
            return texts(cells)

        return walked_blocks(hours, scored, provider, space, threshold, gate, some)

    monkeypatch.setattr(mb, "walked_blocks", spied)
    for threshold in (0.01, 0.06, 0.08):
        params = pm.RunParams(threshold=threshold, use_keywords=False, lemmatize=False, start_date="2024-01-01", end_date="2024-01-02")
        run = jobs.analyse(rows, params, provider)
        assert not any("text" in frame.columns for frame in run.kept)
        whole = hr.hour_texts(ms.with_hours(rows, run.start, run.end)).where("n_words > 0")
        hours = hr.with_ordinal(jobs._embedded(whole, provider))
        space = run.scorer["space"]
        want = walked_blocks(hours, sc.with_direct_p(hours, space), provider, space, threshold)
        assert sorted(map(str, run.blocks.collect())) == sorted(map(str, want.collect()))
        run.release()
    assert asked[0][0] > asked[-1][0] and all(some <= every for some, every in asked)
    texts = spark.createDataFrame([("cat",), ("",), (None,), ("cat",)], "text string").coalesce(1)
    assert [r.vec for r in texts.select(provider.column(F.col("text")).alias("vec")).collect()][2] is None
    plan = texts.select(provider.column(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_nodes_ask_cells_in_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["node"])
    for n_cells in (1, 700, nb.NUMBERS_AT_ONCE * 2):
        pieces = list(nb._pieces([batch, batch.slice(0, 0)], n_cells))
        assert pa.Table.from_batches(pieces).column("node").to_pylist() == list(range(1000))
        assert max(p.num_rows for p in pieces) <= max(nb.NUMBERS_AT_ONCE // n_cells, 1)


def test_neighbours_in_pieces(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [(i * 37) % 101 - 50, (i * 61) % 89 - 40, i % 7]) for i in range(200)], "vec_id long, vec array<bigint>")
    found = []
    for size in (1 << 18, 40):
        monkeypatch.setattr(nb, "NUMBERS_AT_ONCE", size)
        near = nb.nearest_of_each(rows, 3, n_cells=8)
        found.append((near.visits, sorted(map(str, near.rows.collect()))))
    assert found[0] == found[1]
