import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from talkspan.operators import metrics as mt
from talkspan.sources import labels as lb
from talkspan.sources import messages as ms
from talkspan.sources import sinks as sk
from talkspan.sources import vector_table as vt

CSV = '''Chatroom,Sender,Timestamp,Text
Room1,Ann,2018-05-01 09:30:00,"Hello, ""world""
second line"
Room1,Bob,2018-05-02 23:59:59,plain
Room2,Ann,2018-05-03 00:00:00,
Room2,Ann,not a time,x
'''


@pytest.fixture()
def chat_csv(tmp_path):
    path = tmp_path / "chat.csv"
    path.write_text(CSV)
    return str(path)


def test_read_csv(spark, chat_csv):
    rows = ms.read_csv(spark, chat_csv, bad_times="keep").orderBy("row_id").collect()
    assert rows[0].text == 'Hello, "world"\nsecond line' and rows[0].prompt == ""
    assert rows[1].ts == dt.datetime(2018, 5, 2, 23, 59, 59)
    assert rows[2].text is None and rows[3].ts is None


def test_between_dates_is_inclusive(spark, chat_csv):
    df = ms.read_csv(spark, chat_csv, bad_times="keep")
    assert ms.between_dates(df, "2018-05-01", "2018-05-02").count() == 2
    assert ms.between_dates(df, "2018-05-02").count() == 2
    assert ms.between_dates(df, None, "2018-05-01").count() == 1
    assert ms.effective_range(df, "2018-05-02", None) == ("2018-05-01", "2018-05-03")
    assert ms.effective_range(df, "2018-04-01", "2018-04-02") == ("2018-04-01", "2018-04-02")
    with pytest.raises(ValueError):
        ms.effective_range(ms.between_dates(df, "2019-01-01"))


def test_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(10)]
    spark.createDataFrame(rows, "row_id long, ts timestamp_ntz").write.parquet(path)
    df = ms.with_hours(spark.read.parquet(path), "2024-01-03", "2024-01-04")
    assert df.count() == 2 and {r.hour_idx for r in df.collect()} == {0, 24}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_missing_columns_rows_and_files(spark, chat_csv, tmp_path):
    raw = spark.read.option("header", True).csv(chat_csv)
    with pytest.raises(ValueError, match="Sender"):
        ms.from_raw(raw.drop("Sender"))
    with pytest.raises(ValueError):
        ms.require_rows(raw.where("false"))
    with pytest.raises(AnalysisException):
        ms.read_csv(spark, str(tmp_path / "absent.csv"))
    assert lb.read_csv(spark, str(tmp_path / "absent.csv")) is None
    assert lb.read_csv(spark, chat_csv) is None


def test_vector_table(spark, tmp_path):
    table = vt.VectorTable(spark, str(tmp_path / "vectors"))
    assert table.load("m").count() == 0
    table.create()
    rows = lambda *r: spark.createDataFrame(list(r), "text string, vec array<bigint>")
    table.append(rows(("a", [1]), ("b", [2]), ("b", [2])), "m", "2024-01-01 00:00:00")
    table.append(rows(("a", [9])), "m", "2024-01-02 00:00:00")
    table.append_new(rows(("a", [7]), ("c", [3])), "m", "2024-01-03 00:00:00")
    table.append(rows(("t", [5])), "m", "2024-01-03 00:00:00", kind="topic")
    table.create()
    got = {r.text: (r.vec, r.frequency, r.last_used.day) for r in table.load("m").collect()}
    assert got == {"a": ([9], 2, 2), "b": ([2], 2, 1), "c": ([3], 1, 3)}
    assert table.load("other").count() == 0
    table.clear("keyword")
    assert table.load("m").count() == 0 and table.load("m", "topic").count() == 1
    table.clear()
    assert table.load("m", "topic").count() == 0


def test_upserts(spark):
    stored = spark.createDataFrame(
        [("a", [1], 3, "old"), ("b", [2], 1, "old")], "text string, vec array<bigint>, frequency long, last_used string"
    )
    offered = spark.createDataFrame([("b", [8]), ("b", [8]), ("c", [9])], "text string, vec array<bigint>")
    found = vt.upsert_keywords(stored, offered, F.lit("new")).collect()
    assert {r.text: (r.vec, r.frequency, r.last_used) for r in found} == {
        "a": ([1], 3, "old"), "b": ([8], 3, "new"), "c": ([9], 1, "new"),
    }
    wanted = spark.createDataFrame([("a",), ("z",)], "text string")
    assert {r.text: r.vec for r in vt.get_keywords(stored, wanted).collect()} == {"a": [1], "z": None}


def test_labelled_metrics(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "truth string, pred string")
    assert mt.accuracy(pairs).first()["accuracy"] == 0.5
    assert mt.accuracy(pairs.where("false")).first()["accuracy"] == 0.0
    labels = mt.per_label(mt.confusion(pairs))
    got = {r.label: (r.precision, r.recall, r.f1) for r in labels.collect()}
    assert got["a"] == (1.0, 0.5, pytest.approx(2 / 3))
    assert got["b"] == (pytest.approx(1 / 3), 1.0, 0.5)
    assert got["c"] == (0.0, 0.0, 0.0)
    row = mt.weighted(labels).first()
    assert tuple(row) == (pytest.approx(0.583333, abs=1e-6), 0.5, pytest.approx(0.458333, abs=1e-6))
    assert [r.label for r in mt.best_labels(labels, 2).collect()] == ["a", "b"]
    assert mt.sorted_labels(pairs).first()["labels"] == ["a", "b", "c"]


def test_quality_without_segments(spark):
    empty = spark.createDataFrame([], "topic string, n_msgs long, p double, duration_s long")
    row = mt.quality(empty, 10).first()
    assert row.num_segments == 0 and row.coverage == 0.0 and row.avg_probability == 0.0
    assert mt.quality(empty, 0).first().coverage == 0.0


def test_lines_in_a_transcript(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("",)], "t string")
    assert [r[0] for r in df.select(mt.lines_in(F.col("t"))).collect()] == [3, 1]


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    docs = [
        ("one", '{"run_name":"one","config":{"accuracy_fingerprint":"f"},"performance":{"cache_hit_rate":0.5}}'),
        ("two", '{"run_name":"two","config":{"accuracy_fingerprint":"f"},"accuracy":{"precision":0.25}}'),
    ]
    for name, text in docs:
        spark.createDataFrame([(text,)], "value string").write.text(f"{path}/run_name={name}/metrics")
    runs = lb.read_runs(spark, path, ["one", "two", "absent"])
    table = {r.metric: (r.one, r.two) for r in mt.compare_runs(runs, ["one", "two"]).collect()}
    assert len(table) == 13
    assert table["Cache Hit Rate (%)"] == (50.0, 0.0)
    assert table["Precision"] == (None, 0.25)
    group = mt.same_accuracy_groups(runs).collect()
    assert [(r.fingerprint, r.run_names) for r in group] == [("f", ["one", "two"])]
    assert lb.read_runs(spark, str(tmp_path / "absent"), ["one"]).count() == 0
    sk.write_comparison(mt.compare_runs(runs, ["one", "two"]), ["one", "two"], str(tmp_path / "out"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert "Precision\tN/A\t0.25" in lines
    sk.write_comparison(mt.compare_runs(runs, ["two", "one"]), ["two", "one"], str(tmp_path / "once"), runs)
    lines = [r.value for r in spark.read.text(str(tmp_path / "once")).collect()]
    assert "Precision\tall runs\t0.25" in lines and "Cache Hit Rate (%)\t0.00\t50.00" in lines and len(lines) == 13
    other = runs.withColumn("fingerprint", F.when(F.col("run_name") == "one", "f"))
    assert mt.same_accuracy(runs) and not mt.same_accuracy(other) and not mt.same_accuracy(runs.where("false"))


def test_segments_are_written_small_and_read_alike(spark, tmp_path):
    rows = [
        ("u", t, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2), 86400, 0.5, "News", f'a "quoted", line\nand another {t % 2}\n' * 400) for t in range(8)
    ]
    kinds = "sender string, block_no int, start_ts timestamp_ntz, end_ts timestamp_ntz, duration_s long, p double, topic string, chat_summary string"
    segs = spark.createDataFrame(rows, kinds).coalesce(1)
    found, sizes = [], []
    for how in ("none", "gzip"):
        path = str(tmp_path / how)
        sk.write_segments_csv(segs, path, how)
        back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        found.append(sorted(map(tuple, back.collect())))
        sizes.append(sum(f.stat().st_size for f in (tmp_path / how).glob("part-*")))
    assert found[0] == found[1] and len(found[0]) == 8 and sizes[1] * 10 < sizes[0]
