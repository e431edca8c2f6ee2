"""The keyed vector table, and runs that use it."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talkspan import params as pm
from talkspan.functions import text as tx
from talkspan.operators import embeddings as em
from talkspan.plans import jobs
from talkspan.sources import vector_table as vt


class Counting:
    """A hash provider that counts the words and texts it is asked for."""

    additive = True

    def __init__(self, dim=8):
        self.inner, self.dim, self.n = em.HashProvider(dim), dim, 0

    def vectors(self, texts):
        self.n += texts.count()
        return self.inner.vectors(texts)

    def lexicon(self, counts):
        self.n += counts.select("word").distinct().count()
        return self.inner.lexicon(counts)


def chat(spark):
    day = dt.datetime(2024, 1, 1)
    said = ["train travel tickets", "food, food!", "sports\nand games", "travel travel", "", None]
    rows = [(i, "r", f"u{i % 2}", day + dt.timedelta(hours=i), said[i % 6], "") for i in range(24)]
    return spark.createDataFrame(
        rows, "row_id long, chatroom string, sender string, ts timestamp_ntz, text string, prompt string"
    )


def rows(spark, *r):
    return spark.createDataFrame(list(r), "text string, vec array<bigint>")


def content(table, model="m"):
    return {r.text: (r.vec, r.frequency, r.last_used.day) for r in table.load(model).collect()}


def keys(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").select(tx.text_key(F.col("text")).alias("text_hash"))


def test_lookup_reads_the_asked_buckets(spark, tmp_path):
    table = vt.VectorTable(spark, str(tmp_path / "v"))
    table.append(rows(spark, *((f"w{i}", [i]) for i in range(500))), "m", "2024-01-01 00:00:00")
    table.append(rows(spark, ("w7", [-7])), "m", "2024-01-02 00:00:00")
    found = table.lookup(keys(spark, ["w7", "w8", "absent", "w7", None]), "m")
    assert {r.text: (r.vec, r.frequency) for r in found.collect()} == {"w7": ([-7], 2), "w8": ([8], 1)}
    for frame in (found, table.find(["w7"], "m")):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "bucket" in plan.split("PartitionFilters:")[1].split("PushedFilters:")[0]
    assert "text_hash" in plan.split("PushedFilters:")[1].split("ReadSchema:")[0]
    assert {r.text: r.vec for r in table.find(["w9", "absent"], "m").collect()} == {"w9": [9]}
    assert table.find([], "m").count() == 0 and table.lookup(keys(spark, []), "m").count() == 0


def test_compaction_changes_files_only(spark, tmp_path):
    path = str(tmp_path / "v")
    table = vt.VectorTable(spark, path, buckets=4)
    for day in (1, 2, 3):
        table.append(rows(spark, ("a", [day]), (f"b{day}", [9]), (f"b{day}", [9])), "m", f"2024-01-0{day} 00:00:00")
    before, old = content(table), table.load("m")
    assert before["a"] == ([3], 3, 3) and before["b2"] == ([9], 2, 2)
    wider = vt.VectorTable(spark, path, buckets=16)
    wider.compact()
    assert content(table) == content(wider) == before == {r.text: (r.vec, r.frequency, r.last_used.day) for r in old.collect()}
    assert table.rows().count() == 4 and "of-16" in table.rows().inputFiles()[0]
    table.append(rows(spark, ("a", [8])), "m", "2024-01-09 00:00:00")
    assert content(wider)["a"] == ([8], 4, 9)
    table.drop_old()
    assert content(table)["a"] == ([8], 4, 9) and len(list((tmp_path / "v").iterdir())) == 1


def test_a_broken_compaction_does_not_count(spark, tmp_path):
    table = vt.VectorTable(spark, str(tmp_path / "v"))
    table.append(rows(spark, ("a", [1])), "m", "2024-01-01 00:00:00")
    left = tmp_path / "v" / f"generation-1-of-{vt.BUCKETS}" / "model=m" / "kind=keyword" / "bucket=0"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"broken off")
    assert content(table) == {"a": ([1], 1, 1)}
    table.compact()
    assert content(table) == {"a": ([1], 1, 1)}


@pytest.mark.parametrize("use_keywords", [False, True])
def test_a_second_run_embeds_nothing(spark, tmp_path, use_keywords):
    params = pm.RunParams(topics=("Travel", "Food", "Sports"), threshold=0.34, use_keywords=use_keywords, lemmatize=False)
    plain = jobs.analyse(chat(spark), params, em.HashProvider(8))
    table = vt.VectorTable(spark, str(tmp_path / "v"))
    pick = lambda run: sorted((r.sender, r.topic, r.hour_idxs, r.p) for r in run.segments.collect())
    for day in (1, 2):
        provider = Counting()
        run = jobs.analyse(chat(spark), params, provider, store=table, stored_at=f"2024-01-0{day} 00:00:00")
        assert pick(run) == pick(plain)
        document = jobs.run_document(run, "r", "now", 1.0).first().performance
        assert (provider.n > 0) == (day == 1)
        assert document.cache_hits + document.cache_misses > 3
        assert document.cache_hit_rate == 1.0 if day == 2 else document.cache_misses > 0
        run.release()
    plain.release()
    with pytest.raises(ValueError):
        jobs.analyse(chat(spark), params, store=table)


def test_an_evaluation_holds_accuracy_and_captured_lines(spark):
    params = pm.RunParams(topics=("Travel", "Food", "Sports"), threshold=0.34, use_keywords=False, lemmatize=False)
    labelled = [(1, "u :: r [t]: travel", "Travel"), (2, "u :: r [t]: food food", "Sports")]
    samples = spark.createDataFrame(labelled, "sample_id long, chat_summary string, truth string")
    times = iter((10.0, 14.0))
    run, document = jobs.evaluate(
        chat(spark), params, "r", "now", samples, clock=lambda: next(times), provider=em.HashProvider(64)
    )
    row, segs = document.first(), run.with_transcripts().collect()
    run.release()
    assert row.accuracy.total_samples == 2 and row.accuracy.correct_predictions == 1
    assert row.performance.execution_time_seconds == 4.0 and row.performance.messages_per_second == 6.0
    assert row.quality.lines_captured == sum(s.chat_summary.count("\n") + 1 for s in segs) > row.quality.total_messages_captured
    assert row.quality.distinct_messages_captured <= row.quality.total_messages_captured == sum(s.n_msgs for s in segs)


def test_stored_rows_leave_no_shuffle_files(spark, tmp_path):
    from talkspan.operators import checkpoints as cp

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    frame = spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))

    def shuffles():
        return tracker.shuffleStatuses().size()

    want, before = sorted(map(tuple, frame.collect())), shuffles()
    kept = cp.written(frame, "small")
    table = vt.VectorTable(spark, str(tmp_path / "vectors"))
    table.append(frame.select(F.col("k").cast("string").alias("text"), F.array("s").alias("vec")), "m", "2024-01-01 00:00:00")
    assert shuffles() <= before and spark.conf.get(name, "false") == "false"
    assert sorted(map(tuple, kept.collect())) == want and table.load("m").count() == 7
    with cp.freed_shuffles(spark):  # a frame that is run twice works its shuffles out anew
        twice = frame.where("k < 5")
        assert len(twice.collect()) == len(twice.collect()) == 5
    with pytest.raises(ZeroDivisionError), cp.freed_shuffles(spark):
        1 / 0
    assert spark.conf.get(name, "false") == "false"
