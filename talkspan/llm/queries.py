"""One registered query per operator of this package, with SQL of the same result where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.llm import (
    bpe,
    captures,
    chat,
    collocations,
    decontaminate,
    neardup,
    packing,
    repeats,
    rollups,
    secrets,
    shards,
    store,
    token_files,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the verdict needs no suffix array in SQL: words in repeats of w words or more are those in windows of w words found
# twice, and a repeat of over m words exists where a window of m + 1 words is found twice
SQL_REPEATS = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (
  SELECT doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS key
  FROM pos, (VALUES (8), (5), (61)) s(k) WHERE i + k - 1 <= len(ws)),
twice AS (
  SELECT doc_id, i, k FROM (
    SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k, key) AS n FROM win) WHERE n > 1),
cov AS (
  SELECT doc_id, k, count(DISTINCT p) AS n
  FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM twice) GROUP BY doc_id, k),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(c8.n, 0) AS n_repeat_words,
         coalesce(c5.n, 0) AS covered, coalesce(c61.n, 0) AS too_long
  FROM w LEFT JOIN lines USING (doc_id)
  LEFT JOIN cov c8 ON c8.doc_id = w.doc_id AND c8.k = 8
  LEFT JOIN cov c5 ON c5.doc_id = w.doc_id AND c5.k = 5
  LEFT JOIN cov c61 ON c61.doc_id = w.doc_id AND c61.k = 61),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * covered <= 30 * n_words AND too_long = 0 AS kept
FROM judged
"""


@query("op8_suffix_repeats", SQL_REPEATS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = repeats.with_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL_HITS = r"""
WITH lower_docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
lower_items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 9), ' ') AS key, least(len(ws), 10) AS width
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM lower_items WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT width FROM grams),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM lower_docs),
win AS (
  SELECT doc_id, i, width, array_to_string(list_slice(ws, i, i + width - 1), ' ') AS key
  FROM pos, widths WHERE i + width - 1 <= len(ws)),
hits AS (SELECT w.doc_id, w.i, w.width, g.item_id FROM win w JOIN grams g ON w.key = g.key),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS all_items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(t.n, 0) AS n_items,
       sha256(coalesce(all_items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM lower_docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""


@query("op1_benchmark_hits", SQL_HITS)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_guess_cost_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.with_findings(docs, secrets.corpus_model(docs), keep=["doc_id"])
    n = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(n(k).alias(f"n_{k}") for k in secrets.KINDS),
        F.sha2(secrets.span_text(F.col("findings"), secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.span_text(F.col("findings")).alias("spans"),
    )


def vocabulary() -> str:
    """Where the public tokenizers are installed on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ids_text(ids):
    return F.array_join(ids.cast("array<string>"), ",")


@query("op5_segment_tree_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.with_ids(docs, vocabulary(), keep=["doc_id"])
    both = bpe.with_text(ids, vocabulary())
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_orc_token_ids")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_path(spark, "token-ids")
    token_files.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return token_files.places(token_files.read(spark, path))


N_SHARDS = 8


@query("op9_hypergeometric_shards")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), store.fresh_path(spark, "shards")
    shards.write(docs, path, N_SHARDS)
    text = F.coalesce("row.text", F.lit(""))
    return shards.read(docs, path).select(
        "row.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


SQL_CAPTURES = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
b32 AS (
  SELECT page_id, n, list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER) + 1, 1)),
    'string_agg', '') AS digest FROM d),
firsts AS (SELECT digest, min(page_id) AS first_page FROM b32 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_page < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page < page_id THEN first_page END AS refers_to
FROM b32 JOIN firsts USING (digest)
"""


@query("op3_warc_transactions", SQL_CAPTURES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_path(spark, "archives")
    captures.write(table(spark, sf_dir, "pages"), path)
    records = store.written(captures.read(spark, path), "records", "zstd")
    return captures.resolved(captures.flat(captures.transactions(records)))


@query("op10_role_repair")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = chat.repaired(table(spark, sf_dir, "conversations"))
    return fixed.select("conv_id", "turn", "role", "new_role", "action", "inserted", "price", "fragment")


@query("op6_prob_min_hash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.with_class(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL_TOTALS = r"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
           FROM documents),
kept AS (SELECT * FROM d WHERE doc_id = first),
lines AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM kept),
once AS (SELECT doc_id, array_to_string(list_distinct(l), chr(10)) AS t FROM lines),
counts AS (
  SELECT source, lang, 'words-1' AS version, len(regexp_extract_all(o.t, '[^\x20\x09-\x0D]+')) AS n
  FROM kept JOIN once o USING (doc_id)
  UNION ALL
  SELECT source, lang, 'words-2', len(regexp_extract_all(t, '[0-9]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F0-9]+')) FROM kept)
SELECT source, lang, version, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM counts GROUP BY ALL
"""


@query("op7_delta_rollups", SQL_TOTALS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tokenizer versions come in, copies of texts leave, and counts are revised to texts without repeated lines;
    the batch of deletes is delivered twice."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    words = lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    counted = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.sha2(text, 256).alias("text_hash"), words(text).alias("words_1"),
        F.regexp_count(text, F.lit(r"[0-9]+|[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F0-9]+")).cast("long").alias("words_2"),
        F.when(F.size(F.array_distinct(lines)) < F.size(lines), words(F.array_join(F.array_distinct(lines), "\n")))
        .alias("once"),
    )
    counted = store.written(counted, "counts")
    firsts = counted.groupBy("text_hash").agg(F.min("doc_id").alias("first"))
    copies = counted.join(firsts, "text_hash").where(F.col("doc_id") != F.col("first"))
    copies = copies.withColumn("version", F.explode(F.array(F.lit("words-1"), F.lit("words-2"))))
    deletes = copies.select("doc_id", "version", "source", "lang", F.lit(0).alias("n_tokens"), F.lit(rollups.DELETE).alias("op"))
    revised = counted.where(F.col("once").isNotNull())
    rollup = rollups.Rollup(spark, store.fresh_path(spark, "rollup"))
    rollup.apply(1, rollups.count_events(counted, "words-1", rollups.INSERT, "words_1"))
    rollup.apply(2, rollups.count_events(counted, "words-2", rollups.INSERT, "words_2"))
    rollup.apply(3, deletes)
    rollup.apply(4, rollups.count_events(revised, "words-1", rollups.REVISE, "once"))
    rollup.apply(3, deletes)
    rollup.compact()
    return rollup.totals()


SQL_PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) s(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
inner_parts AS (
  SELECT lang, array_to_string(list_slice(ws, 1, k - 1), ' ') AS phrase, f FROM cand WHERE k > 2
  UNION ALL SELECT lang, array_to_string(list_slice(ws, 2, k), ' '), f FROM cand WHERE k > 2),
held AS (SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY lang, phrase),
kept AS (
  SELECT c.* FROM cand c LEFT JOIN held h ON c.lang = h.lang AND c.phrase = h.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < 100 * c.f),
cuts AS (
  SELECT *, array_to_string(list_slice(ws, 1, j), ' ') AS first_part, array_to_string(list_slice(ws, j + 1, k), ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM kept)),
rates AS (
  SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, CAST(t.n AS BIGINT) AS n, j,
         CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first_part
  JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang),
lowest AS (SELECT * FROM rates QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


@query("op11_collocations", SQL_PHRASES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.best(collocations.mined(table(spark, sf_dir, "documents")))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(whitening.steps(table(spark, sf_dir, "embeddings")), ["vec_id"])
    model = made.model
    shares = [] if model is None else [float(e / model.trace) for e in model.values]
    explained = F.array(*map(F.lit, shares)) if shares else F.array().cast("array<double>")
    rows = made.rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(0 if model is None else model.centre.n).cast("long").alias("n"),
        "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(made.error).alias("identity_error"),
    )


@query("op13_packing")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_path(spark, "packed")
    packing.write(table(spark, sf_dir, "documents"), path, vocabulary())
    return packing.measured(packing.read(spark, path)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
