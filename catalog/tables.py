"""Sources, sinks, filters, projections, aggregates over messages and hours."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as b
from catalog.registry import query
from catalog.sql import HOUR, fixed, greedy, passes
from talkspan import params as pm
from talkspan.functions import text as tx
from talkspan.operators import blocks as bk
from talkspan.operators import hours as hr
from talkspan.operators import metrics as mt
from talkspan.operators import scoring as sc
from talkspan.operators import segments as sg
from talkspan.operators import spans as sp
from talkspan.operators import tiles as ti
from talkspan.operators.checkpoints import freed_shuffles, written
from talkspan.sources import labels as lb
from talkspan.sources import messages as ms
from talkspan.sources import sample as sm
from talkspan.sources import sinks as sk
from talkspan.streaming import follow as fo

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "'%Y-%m-%d %H:%M:%S'"


def export_form(messages):
    """Messages with the column names of a chat export."""
    return messages.select(
        F.col("chatroom").alias("Chatroom"),
        F.col("sender").alias("Sender"),
        F.date_format("ts", STAMP).alias("Timestamp"),
        F.col("text").alias("Text"),
    )


def write_csv(df, path):
    out = df.write.option("header", True).option("quote", '"').option("escape", '"')
    out = out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    with freed_shuffles(df.sparkSession):
        out.csv(path)


@query(
    "src_messages",
    f"""SELECT chatroom, sender, strftime(ts, {SQL_STAMP}) AS ts, prompt,
        sha256(text) AS text_hash, length(text)::BIGINT AS n_chars FROM messages""",
)
def src_messages(spark, sf):
    path = b.scratch(spark, "chat")
    write_csv(export_form(sm.messages(spark, sf)), path)
    return ms.read_csv(spark, path).select(
        "chatroom",
        "sender",
        F.date_format("ts", STAMP).alias("ts"),
        "prompt",
        tx.text_key(F.col("text")).alias("text_hash"),
        F.length("text").alias("n_chars"),
    )


@query("src_validate", "SELECT 'Chatroom,Sender,Timestamp,Text' AS columns, count(*) AS n_rows FROM messages")
def src_validate(spark, sf):
    raw = ms.require_rows(ms.require_columns(export_form(sm.messages(spark, sf))))
    return raw.agg(F.lit(",".join(raw.columns)).alias("columns"), F.count(F.lit(1)).alias("n_rows"))


@query(
    "src_labels",
    "SELECT lang AS truth, sha256(text) AS text_hash FROM documents",
)
def src_labels(spark, sf):
    path = b.scratch(spark, "labelled")
    raw = sm.table(spark, sf, "documents").select(
        F.col("text").alias("Chat Summary"), F.col("lang").alias("Human Label")
    )
    write_csv(raw, path)
    return lb.read_csv(spark, path).select("truth", tx.text_key(F.col("chat_summary")).alias("text_hash"))


@query("prj_ts", f"SELECT row_id, strftime(ts, {SQL_STAMP}) AS ts FROM messages")
def prj_ts(spark, sf):
    text = F.date_format("ts", STAMP)
    return sm.messages(spark, sf).select("row_id", F.date_format(ms.parse_ts(text), STAMP).alias("ts"))


@query("prj_date", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM messages GROUP BY 1")
def prj_date(spark, sf):
    day = F.date_format(F.to_date("ts"), "yyyy-MM-dd").alias("day")
    return sm.messages(spark, sf).groupBy(day).agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt_dates",
    """SELECT row_id, sender, strftime(ts, '%Y-%m-%d') AS day FROM messages
        WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-13'""",
)
def flt_dates(spark, sf):
    kept = ms.between_dates(sm.messages(spark, sf), "2024-01-05", "2024-01-12")
    return kept.select("row_id", "sender", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("prj_prompt", "SELECT row_id, '' AS prompt FROM messages")
def prj_prompt(spark, sf):
    return ms.with_prompt(sm.messages(spark, sf).drop("prompt")).select("row_id", "prompt")


@query(
    "prj_range",
    """SELECT strftime(min(ts), '%Y-%m-%d') AS start_date, strftime(max(ts), '%Y-%m-%d') AS end_date
        FROM messages""",
)
def prj_range(spark, sf):
    bounds = ms.date_bounds(sm.messages(spark, sf))
    return bounds.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start_date", "end_date")])


@query("prj_hour_idx", f"SELECT row_id, {HOUR}::BIGINT AS hour_idx FROM messages WHERE ts < TIMESTAMP '2024-01-31'")
def prj_hour_idx(spark, sf):
    return b.messages(spark, sf).select("row_id", "hour_idx")


LINE = "sender || ' :: ' || chatroom || ' [' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ']: ' || text"


@query("prj_line", f"SELECT row_id, sha256({LINE}) AS line_hash, length({LINE})::BIGINT AS n_chars FROM messages")
def prj_line(spark, sf):
    line = tx.transcript_line(F.col("sender"), F.col("chatroom"), F.col("ts"), F.col("text"))
    return sm.messages(spark, sf).select(
        "row_id", tx.text_key(line).alias("line_hash"), F.length(line).alias("n_chars")
    )


@query(
    "prj_strip_meta",
    r"""SELECT sender, hour_idx::BIGINT AS hour_idx, sha256(array_to_string(list_transform(list_filter(
            list_transform(string_split(lines, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')),
            lambda x: x <> ''), lambda x: regexp_replace(x, '^.*?\]:\s*', '')), ' ')) AS text_hash
        FROM (SELECT sender, hour_idx, string_agg("""
    + LINE
    + ", chr(10) ORDER BY row_id) AS lines FROM worded GROUP BY sender, hour_idx)",
)
def prj_strip_meta(spark, sf):
    cells = sg.line_slices(b.messages(spark, sf)).groupBy(*hr.CELL).agg(
        F.array_sort(F.collect_list(F.struct("slice", "lines"))).alias("x")
    )
    text = tx.strip_transcript(F.array_join("x.lines", "\n"))
    return cells.select(*hr.CELL, tx.text_key(text).alias("text_hash"))


@query("flt_active", "SELECT sender, hour_idx::BIGINT AS hour_idx, n_words FROM hour_stats WHERE n_words > 0")
def flt_active(spark, sf):
    return hr.active(hr.hour_stats(b.counted(spark, sf))).select(*hr.CELL, "n_words")


SEEDS = f"""SELECT sender, topic_idx::BIGINT AS topic_idx, ord, hour_idx::BIGINT AS hour_idx,
    {fixed('p')} AS p FROM hour_p WHERE {passes('p', b.THRESHOLD)}"""


@query("flt_seed", SEEDS)
def flt_seed(spark, sf):
    kept = bk.seeds(b.scored_hours(spark, sf), b.THRESHOLD)
    return kept.withColumn("p", b.rounded(F.col("p")))


@query("flt_prefilter", SEEDS + f" AND {passes('sim', b.GATE)}")
def flt_prefilter(spark, sf):
    kept = bk.seeds(b.scored_hours(spark, sf), b.THRESHOLD, b.GATE)
    return kept.withColumn("p", b.rounded(F.col("p")))


@query(
    "prj_topics",
    """SELECT row_number() OVER (ORDER BY lang) - 1 AS topic_idx, lang AS name
        FROM (SELECT DISTINCT lang FROM documents)""",
)
def prj_topics(spark, sf):
    listed = sm.table(spark, sf, "documents").select("lang").distinct().orderBy("lang")
    text = " , ".join(r["lang"] for r in listed.collect())  # one name per language
    return ms.topics_frame(spark, pm.parse_topics(text))


@query(
    "prj_target",
    f"""SELECT sender, ord, topic_idx::BIGINT AS topic_idx, {fixed('p')} AS p FROM hour_p
        WHERE topic_idx IN (2, 5)""",
)
def prj_target(spark, sf):
    wanted = ms.topics_frame(spark, b.label_names()).where(F.col("name").isin("label_2", "label_5"))
    every = b.long_rounded(b.scored_hours(spark, sf), "sender", "ord")
    return every.join(wanted.select("topic_idx"), "topic_idx", "left_semi")


# ---- aggregates over messages and hours


@query("agg_users", "SELECT DISTINCT sender FROM messages")
def agg_users(spark, sf):
    return ms.users(sm.messages(spark, sf))


@query("agg_volume", "SELECT count(*) AS total_messages, count(DISTINCT sender) AS total_users, 720 AS total_hours FROM messages")
def agg_volume(spark, sf):
    return ms.volume(b.messages(spark, sf), sm.START, sm.END)


@query(
    "agg_hours",
    f"""SELECT sender, hour_idx::BIGINT AS hour_idx, count(*) AS n_msgs,
        sum(len(words))::BIGINT AS n_words, strftime(min(ts), {SQL_STAMP}) AS first_ts,
        strftime(max(ts), {SQL_STAMP}) AS last_ts, sha256(string_agg(text, ' ' ORDER BY row_id)) AS text_hash,
        sha256(array_to_string(flatten(list(words ORDER BY row_id)), ' ')) AS words_hash
        FROM worded GROUP BY sender, hour_idx""",
)
def agg_hours(spark, sf):
    return hr.hour_texts(b.messages(spark, sf)).select(
        *hr.CELL,
        "n_msgs",
        "n_words",
        F.date_format("first_ts", STAMP).alias("first_ts"),
        F.date_format("last_ts", STAMP).alias("last_ts"),
        tx.text_key(F.col("text")).alias("text_hash"),
        tx.text_key(F.array_join("words", " ")).alias("words_hash"),
    )


@query(
    "set_texts",
    """SELECT DISTINCT sha256(text) AS text_hash, length(text)::BIGINT AS n_chars FROM (
        SELECT string_agg(text, ' ' ORDER BY row_id) AS text, sum(len(words)) AS n
        FROM worded GROUP BY sender, hour_idx) WHERE n > 0 AND text <> ''""",
)
def set_texts(spark, sf):
    texts = hr.distinct_texts(hr.hour_texts(b.messages(spark, sf)))
    return texts.select("text_hash", F.length("text").alias("n_chars"))


@query("set_vocab", "SELECT DISTINCT word FROM doc_words")
def set_vocab(spark, sf):
    return hr.vocabulary(b.docs(spark, sf)).select("word")


@query(
    "agg_gate_stats",
    f"""SELECT count(*) AS checked, count(*) FILTER (WHERE NOT {passes('sim', b.GATE)}) AS skipped,
        {fixed(f"100.0::DOUBLE * count(*) FILTER (WHERE NOT {passes('sim', b.GATE)}) / count(*)", 4)} AS skipped_pct
        FROM hour_sims""",
)
def agg_gate_stats(spark, sf):
    stats = bk.gate_stats(b.scored_hours(spark, sf), b.GATE)
    return stats.withColumn("skipped_pct", b.rounded(F.col("skipped_pct"), 4))


@query("win_ord", "SELECT sender, hour_idx::BIGINT AS hour_idx, ord FROM hours")
def win_ord(spark, sf):
    return hr.with_ordinal(hr.active(hr.hour_stats(b.counted(spark, sf)))).select(*hr.CELL, "ord")


@query(
    "win_islands",
    f"""SELECT sender, topic_idx::BIGINT AS topic_idx, min(ord) AS first_ord, max(ord) AS last_ord FROM (
        SELECT *, ord - row_number() OVER (PARTITION BY sender, topic_idx ORDER BY ord) AS island
        FROM hour_p WHERE {passes('p', b.THRESHOLD)}) GROUP BY sender, topic_idx, island""",
)
def win_islands(spark, sf):
    runs = bk.islands(bk.seeds(b.scored_hours(spark, sf), b.THRESHOLD))
    return runs.groupBy("sender", "topic_idx", "island").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    ).drop("island")


@query(
    "win_prefix",
    """SELECT sender, ord, sum(n_msgs) OVER w::BIGINT AS msgs_so_far, sum(vec[1]) OVER w::BIGINT AS first_dim,
        sum(vec[64]) OVER w::BIGINT AS last_dim FROM hours
        WINDOW w AS (PARTITION BY sender ORDER BY ord ROWS UNBOUNDED PRECEDING)""",
)
def win_prefix(spark, sf):
    return sp.running(hr.with_ordinal(b.vector_hours(spark, sf)), b.DIM).select(
        "sender",
        "ord",
        "msgs_so_far",
        F.col("prefix")[0].alias("first_dim"),
        F.col("prefix")[b.DIM - 1].alias("last_dim"),
    )


# ---- scoring of hours in the vector space


@query(
    "join_sim_matrix",
    f"""SELECT sender, hour_idx::BIGINT AS hour_idx, topic_idx::BIGINT AS topic_idx, {fixed('sim')} AS sim
        FROM hour_sims""",
)
def join_sim_matrix(spark, sf):
    rows = sc.with_cosines(b.vector_hours(spark, sf), b.label_space(spark, sf))
    return rows.select(*hr.CELL, F.posexplode("sims").alias("topic_idx", "sim")).withColumn(
        "sim", b.rounded(F.col("sim"))
    )


P_ROWS = f"SELECT sender, ord, topic_idx::BIGINT AS topic_idx, {fixed('p')} AS p FROM hour_p"


@query("score_direct", P_ROWS)
def score_direct(spark, sf):
    hours = hr.with_ordinal(b.vector_hours(spark, sf))
    return b.long_rounded(sc.with_direct_p(hours, b.label_space(spark, sf)), "sender", "ord")


@query("fn_softmax", P_ROWS)
def fn_softmax(spark, sf):
    hours = hr.with_ordinal(b.vector_hours(spark, sf))
    sims = ti.similarities(hours, sm.label_topics(spark, sf), sm.N_LABELS, "sender", "ord")
    p = sc.softmax_long(sims, "sender", "ord", score="sim")
    return p.withColumn("p", b.rounded(F.col("p")))


# ---- blocks and segments

BLOCK_ROWS = f"""SELECT threshold, sender, topic_idx::BIGINT AS topic_idx, block_no, start_ord, end_ord,
    n_hours, n_msgs, {fixed('p')} AS p FROM blocks"""


def block_rows(found):
    return found.select(
        "threshold", "sender", "topic_idx", "block_no", "start_ord", "end_ord", "n_hours", "n_msgs",
        b.rounded(F.col("p")).alias("p"),
    )


ONE = greedy([b.THRESHOLD])
LOW = greedy([b.LOW_THRESHOLD])
GATED = greedy([b.THRESHOLD], b.GATE)
MANY = greedy(b.SWEEP)


@query("find_all_blocks", BLOCK_ROWS, ONE)
def find_all_blocks(spark, sf):
    return block_rows(b.blocks(spark, sf))


@query(
    "follow_blocks",
    BLOCK_ROWS,
    ONE
    | {
        "hour_stats": """SELECT sender, hour_idx, count(*) AS n_msgs, sum(len(words))::BIGINT AS n_words,
            min(ts) AS first_ts, max(ts) AS last_ts FROM worded
            WHERE hour_idx < (SELECT max(hour_idx) FROM worded) GROUP BY sender, hour_idx"""
    },
)
def follow_blocks(spark, sf):
    """The messages as a stream, worked off: blocks of all hours that ended before the newest message."""
    kept = written(b.vector_messages(spark, sf), "chat")
    stream = spark.readStream.schema(kept.schema).parquet(*{f.rsplit("/", 1)[0] for f in kept.inputFiles()})
    found = fo.catch_up(stream, b.label_space(spark, sf), b.THRESHOLD, b.scratch(spark, "follow"), lateness="0 seconds")
    return block_rows(found)


@query("find_blocks", BLOCK_ROWS, LOW)
def find_blocks(spark, sf):
    return block_rows(b.blocks(spark, sf, [b.LOW_THRESHOLD]))


@query("find_blocks_gated", BLOCK_ROWS, GATED)
def find_blocks_gated(spark, sf):
    return block_rows(b.blocks(spark, sf, [b.THRESHOLD], b.GATE))


@query(
    "agg_bounds",
    f"""SELECT sender, topic_idx::BIGINT AS topic_idx, block_no, strftime(start_ts, {SQL_STAMP}) AS start_ts,
        strftime(end_ts, {SQL_STAMP}) AS end_ts, date_diff('second', start_ts, end_ts) AS duration_s FROM blocks""",
    ONE,
)
def agg_bounds(spark, sf):
    return sg.bounds(b.blocks(spark, sf)).select(
        "sender",
        "topic_idx",
        "block_no",
        F.date_format("start_ts", STAMP).alias("start_ts"),
        F.date_format("end_ts", STAMP).alias("end_ts"),
        "duration_s",
    )


DURATION = """CASE WHEN s // 86400 = 0 THEN '' WHEN s // 86400 = 1 THEN '1 day, '
    ELSE (s // 86400) || ' days, ' END || ((s % 86400) // 3600) || ':' ||
    lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')"""


@query(
    "fn_duration",
    f"""SELECT sender, topic_idx::BIGINT AS topic_idx, block_no, {DURATION} AS duration FROM (
        SELECT *, date_diff('second', start_ts, end_ts) AS s FROM blocks)""",
    LOW,
)
def fn_duration(spark, sf):
    found = sg.bounds(b.blocks(spark, sf, [b.LOW_THRESHOLD]))
    return found.select("sender", "topic_idx", "block_no", tx.duration_text(F.col("duration_s")).alias("duration"))


BLOCK_HOURS = {
    "block_hours": """SELECT b.threshold, b.sender, b.topic_idx, b.block_no, h.hour_idx, h.ord - b.start_ord AS pos
        FROM blocks b JOIN hours h ON h.sender = b.sender AND h.ord BETWEEN b.start_ord AND b.end_ord"""
}


@query(
    "join_block_hours",
    """SELECT b.sender, b.topic_idx::BIGINT AS topic_idx, b.block_no, b.pos, b.hour_idx::BIGINT AS hour_idx,
        s.n_words, s.n_msgs FROM block_hours b JOIN hour_stats s USING (sender, hour_idx)""",
    ONE | BLOCK_HOURS,
)
def join_block_hours(spark, sf):
    stats = hr.hour_stats(b.counted(spark, sf)).select(*hr.CELL, "n_words", "n_msgs")
    return bk.block_hours(b.blocks(spark, sf)).join(stats, list(hr.CELL)).drop("level")


@query(
    "join_block_msgs",
    """SELECT b.sender, b.topic_idx::BIGINT AS topic_idx, b.block_no, b.pos, m.row_id
        FROM block_hours b JOIN worded m USING (sender, hour_idx)""",
    ONE | BLOCK_HOURS,
)
def join_block_msgs(spark, sf):
    rows = b.messages(spark, sf).select(*hr.CELL, "row_id")
    return bk.block_hours(b.blocks(spark, sf)).join(rows, list(hr.CELL)).select(
        "sender", "topic_idx", "block_no", "pos", "row_id"
    )


@query(
    "agg_captured",
    """SELECT sum(n_msgs * n)::BIGINT AS messages_captured, sum(n_msgs)::BIGINT AS distinct_messages_captured
        FROM (SELECT sender, hour_idx, count(*) AS n FROM block_hours GROUP BY ALL)
        JOIN hour_stats USING (sender, hour_idx)""",
    ONE | BLOCK_HOURS,
)
def agg_captured(spark, sf):
    return sg.captured(b.blocks(spark, sf), hr.hour_stats(b.counted(spark, sf)))


TRANSCRIPT = {
    "transcripts": f"""SELECT threshold, sender, topic_idx, block_no,
        string_agg({LINE}, chr(10) ORDER BY hour_idx, row_id) AS chat_summary
        FROM block_hours JOIN worded USING (sender, hour_idx) GROUP BY ALL"""
}


@query(
    "agg_transcript",
    """SELECT sender, topic_idx::BIGINT AS topic_idx, block_no, sha256(chat_summary) AS summary_hash,
        length(chat_summary)::BIGINT AS n_chars FROM transcripts""",
    ONE | BLOCK_HOURS | TRANSCRIPT,
)
def agg_transcript(spark, sf):
    found = sg.block_transcripts(b.blocks(spark, sf), b.messages(spark, sf))
    return found.select(
        "sender",
        "topic_idx",
        "block_no",
        tx.text_key(F.col("chat_summary")).alias("summary_hash"),
        F.length("chat_summary").alias("n_chars"),
    )


SEGMENT_ROWS = f"""SELECT b.sender, b.topic, b.block_no, strftime(start_ts, {SQL_STAMP}) AS start_ts,
    strftime(end_ts, {SQL_STAMP}) AS end_ts, date_diff('second', start_ts, end_ts) AS duration_s, n_hours, n_msgs,
    {fixed('p')} AS p, sha256(chat_summary) AS summary_hash
    FROM blocks b JOIN transcripts t USING (threshold, sender, topic_idx, block_no)"""


@query("build_segments", SEGMENT_ROWS, ONE | BLOCK_HOURS | TRANSCRIPT)
def build_segments(spark, sf):
    full = sg.with_transcripts(b.segments(spark, sf), b.messages(spark, sf))
    return full.select(
        "sender",
        "topic",
        "block_no",
        F.date_format("start_ts", STAMP).alias("start_ts"),
        F.date_format("end_ts", STAMP).alias("end_ts"),
        "duration_s",
        "n_hours",
        "n_msgs",
        b.rounded(F.col("p")).alias("p"),
        tx.text_key(F.col("chat_summary")).alias("summary_hash"),
    )


CSV_ROWS = f"""SELECT b.sender AS "User", strftime(start_ts, '%Y-%m-%d') AS "Start Date",
    strftime(start_ts, '%H:%M:%S') AS "Start Time", strftime(end_ts, '%Y-%m-%d') AS "End Date",
    strftime(end_ts, '%H:%M:%S') AS "End Time",
    (SELECT {DURATION} FROM (SELECT date_diff('second', start_ts, end_ts) AS s)) AS "Time Duration",
    topic AS "Topic", {fixed('p')} AS "Probability", sha256(chat_summary) AS "Chat Summary"
    FROM blocks b JOIN transcripts t USING (threshold, sender, topic_idx, block_no)"""


@query("sink_segments", CSV_ROWS, ONE | BLOCK_HOURS | TRANSCRIPT)
def sink_segments(spark, sf):
    path = b.scratch(spark, "segments")
    sk.write_segments_csv(sg.with_transcripts(b.segments(spark, sf), b.messages(spark, sf)), path, "gzip")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.withColumn("Probability", b.rounded(F.col("Probability").cast("double"))).withColumn(
        "Chat Summary", tx.text_key(F.col("Chat Summary"))
    )


@query(
    "agg_summary",
    f"""SELECT count(*) AS n_segments, sum(n_msgs)::BIGINT AS n_messages, {fixed('avg(n_msgs)', 4)} AS avg_length,
        {fixed('avg(p)', 6)} AS avg_p FROM blocks""",
    ONE,
)
def agg_summary(spark, sf):
    row = mt.summary(b.segments(spark, sf))
    return row.withColumn("avg_length", b.rounded(F.col("avg_length"), 4)).withColumn(
        "avg_p", b.rounded(F.col("avg_p"))
    )


DIST = "SELECT topic, count(*) AS n_segments FROM blocks GROUP BY topic"


@query("agg_topic_dist", DIST, ONE)
def agg_topic_dist(spark, sf):
    return mt.topic_distribution(b.segments(spark, sf))


@query("sort_topic_dist", f"SELECT *, row_number() OVER (ORDER BY n_segments DESC, topic) AS rank FROM ({DIST})", ONE)
def sort_topic_dist(spark, sf):
    ordered = mt.topic_distribution(b.segments(spark, sf)).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n_segments")).alias("neg"), "topic"))).alias("x")
    )  # one row per topic name
    return ordered.select(F.posexplode("x").alias("pos", "t")).select(
        "t.topic", (-F.col("t.neg")).alias("n_segments"), (F.col("pos") + 1).alias("rank")
    )


QUALITY = f"""SELECT count(*) AS num_segments, {fixed('avg(n_msgs)', 4)} AS avg_segment_length,
    sum(n_msgs)::BIGINT AS total_messages_captured,
    {fixed('sum(n_msgs) / (SELECT count(*) FROM worded)', 6)} AS coverage,
    {fixed('avg(p)')} AS avg_probability, {fixed('min(p)')} AS min_probability, {fixed('max(p)')} AS max_probability,
    count(DISTINCT topic) AS topics_detected, {fixed('avg(h)', 4)} AS avg_segment_duration_hours,
    {fixed('min(h)', 4)} AS min_segment_duration_hours, {fixed('max(h)', 4)} AS max_segment_duration_hours
    FROM (SELECT *, date_diff('second', start_ts, end_ts) / 3600.0::DOUBLE AS h FROM blocks)"""


@query("agg_quality", QUALITY, ONE)
def agg_quality(spark, sf):
    total = ms.volume(b.messages(spark, sf), sm.START, sm.END).first()["total_messages"]
    row = mt.quality(b.segments(spark, sf), total)
    for name in ("coverage", "avg_probability", "min_probability", "max_probability"):
        row = row.withColumn(name, b.rounded(F.col(name)))
    for name in row.columns:
        if name.endswith("_hours") or name == "avg_segment_length":
            row = row.withColumn(name, b.rounded(F.col(name), 4))
    return row


@query(
    "fn_round",
    """SELECT round(coverage * 100, 2) AS coverage_percentage, round(avg_probability, 4) AS avg_probability,
        round(avg_segment_length, 2) AS avg_segment_length FROM (
        SELECT sum(n_msgs) / (SELECT count(*) FROM worded) AS coverage, avg(p) AS avg_probability,
        avg(n_msgs) AS avg_segment_length FROM blocks)""",
    ONE,
)
def fn_round(spark, sf):
    total = ms.volume(b.messages(spark, sf), sm.START, sm.END).first()["total_messages"]
    row = mt.rounded_quality(mt.quality(b.segments(spark, sf), total))
    return row.select("coverage_percentage", "avg_probability", "avg_segment_length")


SWEEP_COLUMNS = f"""threshold, n_segments, {fixed('n_msgs / greatest(n_segments, 1)', 4)} AS avg_length, n_msgs,
    {fixed('sum_p / greatest(n_segments, 1)')} AS avg_p"""


def sweep_rows(table):
    return table.withColumn("avg_length", b.rounded(F.col("avg_length"), 4)).withColumn(
        "avg_p", b.rounded(F.col("avg_p"))
    )


@query(
    "agg_sweep",
    f"""SELECT {SWEEP_COLUMNS} FROM (SELECT threshold, count(*) AS n_segments, sum(n_msgs)::BIGINT AS n_msgs,
        sum(p) AS sum_p FROM blocks GROUP BY threshold)""",
    MANY,
)
def agg_sweep(spark, sf):
    return sweep_rows(sp.sweep_blocks(b.blocks(spark, sf, b.SWEEP)))


SPANS = {
    "prefixes": """SELECT sender, ord, sum(n_msgs) OVER w::BIGINT AS sent, vec FROM (
            SELECT sender, ord, any_value(n_msgs) AS n_msgs, list(s ORDER BY i) AS vec FROM (
                SELECT sender, ord, n_msgs, i, sum(v) OVER (PARTITION BY sender, i ORDER BY ord
                    ROWS UNBOUNDED PRECEDING)::BIGINT AS s
                FROM (SELECT sender, ord, n_msgs, unnest(vec) AS v, generate_subscripts(vec, 1) AS i FROM hours))
            GROUP BY sender, ord) WINDOW w AS (PARTITION BY sender ORDER BY ord ROWS UNBOUNDED PRECEDING)""",
    "span_vecs": """SELECT e.sender, s.ord + 1 AS start_ord, e.ord AS end_ord, e.sent - s.sent AS n_msgs,
            list_transform(list_zip(e.vec, s.vec), lambda z: z[1] - z[2]) AS vec
        FROM prefixes e JOIN (SELECT sender, ord, sent, vec FROM prefixes UNION ALL
            SELECT DISTINCT sender, 0, 0, list_transform(range(64), lambda x: 0) FROM hours) s
        ON s.sender = e.sender AND s.ord < e.ord""",
    "span_sims": """SELECT sender, start_ord, end_ord, n_msgs, list_transform(rows, lambda r:
            coalesce(list_dot_product(r, vec::DOUBLE[]) / nullif(sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])), 0), 0.0))
            AS sims FROM span_vecs CROSS JOIN topic_rows""",
    "span_weights": """SELECT sender, start_ord, end_ord, n_msgs, list_transform(sims, lambda s: exp(s)) AS weights
        FROM span_sims""",
    "span_p": """SELECT sender, start_ord, end_ord, n_msgs, unnest(weights) / list_sum(weights) AS p,
        generate_subscripts(weights, 1) - 1 AS topic_idx FROM span_weights""",
    "levels": "SELECT * FROM (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in b.SWEEP) + ") v(threshold)",
}


@query(
    "agg_sweep_spans",
    f"""SELECT {SWEEP_COLUMNS} FROM (SELECT threshold, count(*) AS n_segments, sum(n_msgs)::BIGINT AS n_msgs,
        sum(p) AS sum_p FROM span_p JOIN levels ON {passes('p', 'threshold')} GROUP BY threshold)""",
    SPANS,
)
def agg_sweep_spans(spark, sf):
    return sweep_rows(sp.sweep_spans(b.vector_hours(spark, sf), b.label_space(spark, sf), b.SWEEP))


ALL_SPANS = f"""SELECT sender, topic_idx::BIGINT AS topic_idx, start_ord, count(*) AS n_spans,
    count(*) FILTER (WHERE {passes('p', b.THRESHOLD)}) AS n_passing, {fixed('max(p)')} AS best_p
    FROM span_p GROUP BY ALL"""


@query("all_spans", ALL_SPANS, SPANS)
def all_spans(spark, sf):
    found = sp.span_starts(b.vector_hours(spark, sf), b.label_space(spark, sf), b.THRESHOLD)
    return found.select(
        "sender", "topic_idx", "start_ord", "n_spans", "n_passing", b.rounded(F.col("best_p")).alias("best_p")
    )


@query(
    "join_spans",
    f"""SELECT sender, topic_idx::BIGINT AS topic_idx, start_ord,
        arg_min(end_ord, (-floor(p * 1e9::DOUBLE + 0.5), end_ord)) AS best_end FROM span_p GROUP BY ALL""",
    SPANS,
)
def join_spans(spark, sf):
    found = sp.span_starts(b.vector_hours(spark, sf), b.label_space(spark, sf), b.THRESHOLD)
    return found.select("sender", "topic_idx", "start_ord", "best_end")


SPAN_HOURS = 24


@query(
    "span_rows",
    f"""SELECT sender, topic_idx::BIGINT AS topic_idx, start_ord, end_ord, {fixed('p')} AS p FROM span_p
        WHERE end_ord - start_ord < {SPAN_HOURS} AND {passes('p', b.THRESHOLD)}""",
    SPANS,
)
def span_rows(spark, sf):
    """Spans of at most a day of active hours, as rows."""
    found = sp.span_rows(b.vector_hours(spark, sf), b.label_space(spark, sf), b.THRESHOLD, SPAN_HOURS)
    return found.select("sender", "topic_idx", "start_ord", "end_ord", b.rounded(F.col("p")).alias("p"))
