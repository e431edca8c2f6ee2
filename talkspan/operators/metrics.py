"""Reports over segments, labelled predictions and runs. One aggregation job each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or_zero(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.lit(0)).cast(kind)


def lines_in(chat_summary: Column) -> Column:
    """Lines of a transcript, the message count of the printed reports."""
    return F.length(chat_summary) - F.length(F.replace(chat_summary, F.lit("\n"), F.lit(""))) + 1


def summary(segs: DataFrame) -> DataFrame:
    """One row: segments, messages, mean length, mean probability. Needs `n_msgs` and `p`."""
    return segs.agg(
        F.count(F.lit(1)).alias("n_segments"),
        _or_zero(F.sum("n_msgs"), "long").alias("n_messages"),
        _or_zero(F.avg("n_msgs"), "double").alias("avg_length"),
        _or_zero(F.avg("p"), "double").alias("avg_p"),
    )


def topic_distribution(segs: DataFrame) -> DataFrame:
    """Segments per topic, most frequent first, names break ties."""
    counts = segs.groupBy("topic").agg(F.count(F.lit(1)).alias("n_segments"))
    return counts.orderBy(F.desc("n_segments"), "topic")


def quality(segs: DataFrame, total_messages: int | Column, lines: str = "n_msgs") -> DataFrame:
    """One row of segment quality; zeros when there are no segments.

    `lines` names the column that counts a segment's messages: `n_msgs`, or transcript lines for the
    count in which multi-line messages weigh more.
    """
    hours = F.col("duration_s") / F.lit(3600.0)
    captured = _or_zero(F.sum(lines), "long")
    total = F.lit(total_messages) if isinstance(total_messages, int) else total_messages
    return segs.agg(
        F.count(F.lit(1)).alias("num_segments"),
        _or_zero(F.avg(lines), "double").alias("avg_segment_length"),
        captured.alias("total_messages_captured"),
        _or_zero(F.avg("p"), "double").alias("avg_probability"),
        _or_zero(F.min("p"), "double").alias("min_probability"),
        _or_zero(F.max("p"), "double").alias("max_probability"),
        F.countDistinct("topic").alias("topics_detected"),
        _or_zero(F.avg(hours), "double").alias("avg_segment_duration_hours"),
        _or_zero(F.min(hours), "double").alias("min_segment_duration_hours"),
        _or_zero(F.max(hours), "double").alias("max_segment_duration_hours"),
    ).withColumn(
        "coverage", F.when(total > 0, F.col("total_messages_captured") / total).otherwise(F.lit(0.0))
    )


def rounded_quality(row: DataFrame) -> DataFrame:
    """Report rounding: coverage in percent, probabilities to four places, the rest to two."""
    out = row.withColumn("coverage_percentage", F.round(F.col("coverage") * 100, 2)).drop("coverage")
    for name in ("avg_probability", "min_probability", "max_probability"):
        out = out.withColumn(name, F.round(name, 4))
    for name in (
        "avg_segment_length",
        "avg_segment_duration_hours",
        "min_segment_duration_hours",
        "max_segment_duration_hours",
    ):
        out = out.withColumn(name, F.round(name, 2))
    return out


def throughput(total_messages: Column, elapsed_s: Column) -> Column:
    return F.when(elapsed_s > 0, F.round(total_messages / elapsed_s, 2)).otherwise(F.lit(0.0))


def accuracy(pairs: DataFrame) -> DataFrame:
    """One row from `truth, pred`: samples, correct, accuracy (0 without samples)."""
    hit = F.sum((F.col("truth") == F.col("pred")).cast("long"))
    return pairs.agg(
        F.count(F.lit(1)).alias("total_samples"), _or_zero(hit, "long").alias("correct_predictions")
    ).withColumn(
        "accuracy",
        F.when(F.col("total_samples") > 0, F.col("correct_predictions") / F.col("total_samples")).otherwise(
            F.lit(0.0)
        ),
    )


def confusion(pairs: DataFrame) -> DataFrame:
    """Non-zero cells `truth, pred, n`."""
    return pairs.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def label_set(pairs: DataFrame) -> DataFrame:
    """Labels that occur as truth or prediction."""
    return pairs.select(F.explode(F.array("truth", "pred")).alias("label")).distinct()


def sorted_labels(pairs: DataFrame) -> DataFrame:
    """One row with the labels as an ordered list; labels are the topic names plus the truths."""
    return label_set(pairs).agg(F.array_sort(F.collect_list("label")).alias("labels"))


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def per_label(cells: DataFrame) -> DataFrame:
    """`label, support, accuracy, precision, recall, f1` from confusion cells; 0 where undefined.

    Each cell contributes to its truth and to its prediction, which keeps this one aggregation.
    """
    sides = F.explode(
        F.array(
            F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")),
            F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")),
        )
    )
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    long = cells.select(sides.alias("s"), hit.alias("hit")).select("s.label", "s.t", "s.p", "hit")
    sums = long.groupBy("label").agg(
        F.sum("t").alias("support"),
        F.sum("p").alias("predicted"),
        (F.sum("hit") / F.lit(2)).cast("long").alias("tp"),
    )
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    return sums.select(
        "label",
        "support",
        recall.alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def weighted(labels: DataFrame) -> DataFrame:
    """Support-weighted precision, recall and F1 over all labels."""
    total = F.sum("support")
    return labels.agg(
        *[
            F.when(total > 0, F.sum(F.col(c) * F.col("support")) / total).otherwise(F.lit(0.0)).alias(name)
            for c, name in (("precision", "precision"), ("recall", "recall"), ("f1", "f1_score"))
        ]
    )


def best_labels(labels: DataFrame, k: int = 10) -> DataFrame:
    """The k labels with the highest F1, names break ties."""
    return labels.orderBy(F.desc("f1"), "label").limit(k)


# The rows of a run comparison, (metric, path in the run document, factor).
COMPARED = (
    ("Execution Time (s)", "performance.execution_time_seconds", 1),
    ("Messages/Second", "performance.messages_per_second", 1),
    ("Peak Memory (MB)", "performance.memory_peak_mb", 1),
    ("Cache Hit Rate (%)", "performance.cache_hit_rate", 100),
    ("Segments Detected", "quality.num_segments", 1),
    ("Coverage (%)", "quality.coverage_percentage", 1),
    ("Avg Segment Length", "quality.avg_segment_length", 1),
    ("Avg Probability", "quality.avg_probability", 1),
    ("Topics Detected", "quality.topics_detected", 1),
    ("Accuracy (%)", "accuracy.accuracy_percentage", 1),
    ("Precision", "accuracy.precision", 1),
    ("Recall", "accuracy.recall", 1),
    ("F1 Score", "accuracy.f1_score", 1),
)


def comparison_rows(runs: DataFrame) -> DataFrame:
    """Runs to rows `section, metric, run_name, value`. Missing numbers are 0, except accuracy,
    which stays null (not available)."""
    items = []
    for at, (name, path, factor) in enumerate(COMPARED):
        section = path.split(".")[0]
        value = F.col(path).cast("double") * F.lit(float(factor))
        if section != "accuracy":
            value = F.coalesce(value, F.lit(0.0))
        items.append(
            F.struct(
                F.lit(at).alias("pos"), F.lit(section).alias("section"), F.lit(name).alias("metric"), value.alias("value")
            )
        )
    return runs.select("run_name", F.explode(F.array(*items)).alias("m")).select("run_name", "m.*")


def compare_runs(runs: DataFrame, names: list[str]) -> DataFrame:
    """Side by side: one row per metric, one column per run."""
    return (
        comparison_rows(runs)
        .groupBy("pos", "section", "metric")
        .pivot("run_name", names)
        .agg(F.first("value"))
        .orderBy("pos")
    )


def same_accuracy_groups(runs: DataFrame) -> DataFrame:
    """Fingerprints shared by several runs: `fingerprint, n_runs, run_names`."""
    return (
        runs.where(F.coalesce("fingerprint", F.lit("")) != "")
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("n_runs"), F.array_sort(F.collect_list("run_name")).alias("run_names"))
        .where(F.col("n_runs") > 1)
    )


def same_accuracy(runs: DataFrame) -> bool:
    """Do all runs (two or more) carry one and the same fingerprint? Their accuracy is then the same number."""
    row = runs.agg(F.countDistinct(F.coalesce("fingerprint", F.lit(""))).alias("n"), F.max("fingerprint").alias("any")).first()
    return row["n"] == 1 and bool(row["any"])
