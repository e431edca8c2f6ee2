"""Text functions, embeddings, keyword modes, labelled accuracy, vector table, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base as b
from catalog.registry import query
from catalog.sql import STOP, as_lists, cosine, dot, fixed, greedy, hash_long, passes, softmax_rows, words
from talkspan import params as pm
from talkspan.functions import text as tx
from talkspan.functions import vectors as vx
from talkspan.operators import blocks as bk
from talkspan.operators import cells as ce
from talkspan.operators import embeddings as em
from talkspan.operators import hours as hr
from talkspan.operators import keyword_blocks as kb
from talkspan.operators import keywords as kw
from talkspan.operators import neighbours as nb
from talkspan.operators import lda as ld
from talkspan.operators import metrics as mt
from talkspan.operators import scoring as sc
from talkspan.operators import tiles as ti
from talkspan.operators import topics as tp
from talkspan.operators import vocab as vo
from talkspan.operators.checkpoints import written
from talkspan.plans import jobs as jb
from talkspan.sources import labels as lb
from talkspan.sources import messages as ms
from talkspan.sources import sample as sm
from talkspan.sources import sinks as sk
from talkspan.sources import vector_table as vt

ZERO = f"list_transform(range({b.HASH_DIM}), lambda x: 0::BIGINT)"

# ---- text functions


@query("fn_clean", "SELECT doc_id, array_to_string(words, ' ') AS words, len(words)::BIGINT AS n_words FROM docs")
def fn_clean(spark, sf):
    return b.docs(spark, sf).select(
        "doc_id", F.array_join("words", " ").alias("words"), F.size("words").alias("n_words")
    )


@query(
    "fn_clean_batch",
    "SELECT row_id, sha256(array_to_string(words, ' ')) AS words_hash, len(words)::BIGINT AS n_words FROM worded",
)
def fn_clean_batch(spark, sf):
    return b.worded(spark, sf).select(
        "row_id", tx.text_key(F.array_join("words", " ")).alias("words_hash"), F.size("words").alias("n_words")
    )


@query(
    "fn_tokens",
    f"""SELECT doc_id, word FROM doc_tokens WHERE word NOT IN ({STOP})""",
)
def fn_tokens(spark, sf):
    found = tx.keyword_candidates(F.col("text"))
    return b.docs(spark, sf).select("doc_id", F.explode(found).alias("word"))


@query("fn_hash", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def fn_hash(spark, sf):
    return b.docs(spark, sf).select("doc_id", tx.text_key(F.col("text")).alias("text_hash"))


ENDINGS = vo.NOUN_ENDINGS
LEMMA_FORMS = " UNION ALL ".join(
    ["SELECT word, word AS form FROM v"]
    + [
        f"SELECT word, left(word, length(word) - {len(e)}) || '{r}' FROM v "
        f"WHERE suffix(word, '{e}')"
        for e, r in ENDINGS
    ]
)


@query(
    "fn_lemma",
    f"""SELECT v.word, coalesce(m.form, v.word) AS lemma FROM (SELECT DISTINCT word FROM doc_words) v LEFT JOIN (
        SELECT word, arg_min(form, (length(form), form)) AS form FROM (
            WITH v AS (SELECT DISTINCT word FROM doc_words) {LEMMA_FORMS})
        WHERE form IN (SELECT word FROM doc_words) GROUP BY word) m USING (word)""",
)
def fn_lemma(spark, sf):
    vocabulary = hr.vocabulary(b.docs(spark, sf))
    return vo.lemma_map(vocabulary, vocabulary)


FREQUENT = 4


@query(
    "fn_spell",
    "SELECT v.word, coalesce(best.fixed, v.word) AS fixed FROM counted v LEFT JOIN best USING (word)",
    {
        "counted": "SELECT word, sum(n)::BIGINT AS n FROM doc_words GROUP BY word",
        "known": f"SELECT * FROM counted WHERE n >= {FREQUENT}",
        "once": """SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS form FROM (
            SELECT word, unnest(range(1, length(word) + 1)) AS i FROM counted)""",
        "twice": """SELECT DISTINCT word, left(form, i - 1) || substr(form, i + 1) AS form FROM (
            SELECT word, form, unnest(range(1, length(form) + 1)) AS i FROM once)""",
        "forms": "SELECT word, word AS form FROM counted UNION SELECT * FROM once UNION SELECT * FROM twice",
        "pairs": """SELECT DISTINCT l.word, r.word AS candidate FROM forms l JOIN forms r USING (form)
            JOIN known k ON k.word = r.word WHERE l.word NOT IN (SELECT word FROM known)""",
        "best": """SELECT word, arg_min(candidate, (d, -n, candidate)) AS fixed FROM (
            SELECT p.word, candidate, k.n, damerau_levenshtein(p.word, candidate) AS d
            FROM pairs p JOIN known k ON k.word = candidate) WHERE d <= 2 GROUP BY word""",
    },
)
def fn_spell(spark, sf):
    vocabulary = hr.vocabulary(b.docs(spark, sf))
    return vo.spell_map(vocabulary, vocabulary.where(F.col("n") >= FREQUENT))


@query(
    "agg_word_freq",
    "SELECT doc_id, word, n FROM doc_words",
)
def agg_word_freq(spark, sf):
    return kw.word_freq(b.docs(spark, sf), b.DOC)


# ---- vectors


@query(
    "prov_hash",
    f"SELECT doc_id, array_to_string(coalesce(vec, {ZERO}), ',') AS vec FROM documents LEFT JOIN dv USING (doc_id)",
)
def prov_hash(spark, sf):
    return b.language_vectors(spark, sf).select("doc_id", F.array_join(F.col("vec").cast("array<string>"), ",").alias("vec"))


@query("prov_interface", "SELECT word, array_to_string(vec, ',') AS vec FROM (SELECT DISTINCT word FROM doc_tokens) JOIN wv USING (word)")
def prov_interface(spark, sf):
    """The provider's text interface, one text per distinct word."""
    counted = em.token_counts(b.docs(spark, sf), "doc_id", "text")
    return em.word_vectors(counted, em.make_provider("hash", dim=b.HASH_DIM)).select("word", vec_text())


@query("prov_factory", "SELECT count(DISTINCT word) AS n_words, 'hash,pandas,table,word2vec' AS names FROM doc_tokens")
def prov_factory(spark, sf):
    provider = em.make_provider("hash", dim=b.HASH_DIM)
    words_ = em.token_counts(b.docs(spark, sf), "doc_id", "text")
    return provider.lexicon(words_).agg(
        F.count(F.lit(1)).alias("n_words"), F.lit(",".join(sorted(em.PROVIDERS))).alias("names")
    )


def stored_words(spark, sf):
    """A vector table of the distinct cleaned words of the documents: `text, vec, frequency`."""
    vocabulary = hr.vocabulary(b.docs(spark, sf))
    vecs = em.hashed_words(vocabulary.select("word"), b.HASH_DIM)
    return vocabulary.join(vecs, "word").select(F.col("word").alias("text"), "vec", F.col("n").alias("frequency"))


def offered_words(spark, sf):
    """Words of the benchmark texts, one row per occurrence, with the vectors of a new model."""
    rows = sm.table(spark, sf, "benchmark").select(F.explode(tx.clean_words(F.col("text"))).alias("word"))
    vecs = em.hashed_words(rows.distinct(), b.HASH_DIM)
    return rows.join(vecs, "word").select(
        F.col("word").alias("text"), F.transform("vec", lambda x: -x).alias("vec")
    )


def vec_text(vec="vec"):
    return F.array_join(F.col(vec).cast("array<string>"), ",").alias("vec")


STORE = {
    "stored": """SELECT word AS text, sum(n)::BIGINT AS frequency, any_value(vec) AS vec
        FROM doc_words JOIN wv USING (word) GROUP BY word""",
    "occurrences": f"SELECT unnest({words('text')}) AS text FROM benchmark",
    "offer_words": "SELECT DISTINCT text AS word FROM occurrences",
    "offered": """SELECT text, count(*) AS uses FROM occurrences GROUP BY text""",
}
STORE |= {
    "ol": hash_long(b.HASH_DIM, "offer_words"),
    "offer_vecs": as_lists("ol", "word", b.HASH_DIM),
    "offers": """SELECT o.text, o.uses, list_transform(v.vec, lambda x: -x) AS vec
        FROM offered o JOIN offer_vecs v ON v.word = o.text""",
}


@query(
    "store_append",
    """SELECT coalesce(s.text, o.text) AS text, sha256(coalesce(s.text, o.text)) AS text_hash,
        array_to_string(coalesce(s.vec, o.vec), ',') AS vec FROM stored s FULL JOIN offers o ON s.text = o.text""",
    STORE,
)
def store_append(spark, sf):
    table = vt.VectorTable(spark, b.scratch(spark, "vectors"))
    table.create()
    table.append(stored_words(spark, sf), "hash16", "2024-01-01 00:00:00")
    table.append_new(offered_words(spark, sf), "hash16", "2024-01-02 00:00:00")
    return table.load("hash16").select("text", "text_hash", vec_text())


@query("store_load", "SELECT text, sha256(text) AS text_hash, array_to_string(vec, ',') AS vec FROM stored", STORE)
def store_load(spark, sf):
    table = vt.VectorTable(spark, b.scratch(spark, "vectors"))
    table.append(stored_words(spark, sf), "hash16", "2024-01-01 00:00:00")
    table.append(offered_words(spark, sf), "other", "2024-01-01 00:00:00")
    return table.load("hash16").select("text", "text_hash", vec_text())


@query(
    "store_upsert_keywords",
    """SELECT coalesce(s.text, o.text) AS text, array_to_string(coalesce(o.vec, s.vec), ',') AS vec,
        coalesce(s.frequency, 0) + coalesce(o.uses, 0) AS frequency,
        CASE WHEN o.text IS NULL THEN '2024-01-01' ELSE '2024-01-02' END AS last_used
        FROM stored s FULL JOIN offers o ON s.text = o.text""",
    STORE,
)
def store_upsert_keywords(spark, sf):
    stored = stored_words(spark, sf).withColumn("last_used", F.lit("2024-01-01"))
    found = vt.upsert_keywords(stored, offered_words(spark, sf), F.lit("2024-01-02"))
    return found.select("text", vec_text(), "frequency", "last_used")


TOPIC_STORE = {
    "new_topics": "SELECT name, list_transform(vec, lambda x: -x) AS vec FROM label_topics",
}


@query(
    "store_upsert_topics",
    """SELECT name, array_to_string(vec, ',') AS vec FROM new_topics
        UNION ALL SELECT name, array_to_string(vec, ',') FROM tv""",
    TOPIC_STORE,
)
def store_upsert_topics(spark, sf):
    labels = sm.label_topics(spark, sf).select("name", "vec")
    named = em.embed_topics(ms.topics_frame(spark, pm.DEFAULT_TOPICS), em.HashProvider(b.HASH_DIM))
    stored = labels.unionByName(named.select("name", "vec"))
    offered = labels.select("name", F.transform("vec", lambda x: -x).alias("vec"))
    return vt.upsert_topics(stored, offered).select("name", vec_text())


@query(
    "store_get_keywords",
    "SELECT o.text, array_to_string(s.vec, ',') AS vec FROM offered o LEFT JOIN stored s ON s.text = o.text",
    STORE,
)
def store_get_keywords(spark, sf):
    return vt.get_keywords(stored_words(spark, sf), offered_words(spark, sf)).select("text", vec_text())


@query("store_get_topics", "SELECT name, array_to_string(vec, ',') AS vec FROM label_topics ORDER BY name")
def store_get_topics(spark, sf):
    return vt.get_topics(sm.label_topics(spark, sf)).select("name", vec_text())


@query(
    "store_stats",
    f"""SELECT (SELECT count(*) FROM label_topics) AS topic_count, (SELECT count(*) FROM stored) AS keyword_count,
        {b.DIM}::BIGINT AS embedding_dim""",
    STORE,
)
def store_stats(spark, sf):
    return vt.stats(sm.label_topics(spark, sf), stored_words(spark, sf))


@query("store_create", "SELECT 'keyword' AS kind, 0::BIGINT AS n_before, count(*) AS n_after FROM stored", STORE)
def store_create(spark, sf):
    table = vt.VectorTable(spark, b.scratch(spark, "vectors"))
    table.create()
    before = table.load("hash16").count()
    table.append(stored_words(spark, sf), "hash16", "2024-01-01 00:00:00")
    table.create()  # an existing table is left alone
    return table.load("hash16").agg(
        F.lit("keyword").alias("kind"), F.lit(before).cast("long").alias("n_before"), F.count(F.lit(1)).alias("n_after")
    )


@query(
    "store_clear",
    "SELECT 'topic' AS kind, count(*) AS n FROM label_topics UNION ALL SELECT 'keyword', 0",
)
def store_clear(spark, sf):
    table = vt.VectorTable(spark, b.scratch(spark, "vectors"))
    table.append(stored_words(spark, sf), "m", "2024-01-01 00:00:00")
    topics = sm.label_topics(spark, sf).select(F.col("name").alias("text"), "vec")
    table.append(topics, "m", "2024-01-01 00:00:00", "topic")
    table.clear("keyword")
    kinds = [table.load("m", k).agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k in ("topic", "keyword")]
    return kinds[0].unionByName(kinds[1])


@query(
    "join_embed",
    f"""SELECT o.text, (s.text IS NOT NULL) AS stored, array_to_string(coalesce(s.vec,
            CASE WHEN length(o.text) > 1 THEN v.vec ELSE {ZERO} END), ',') AS vec
        FROM offered o JOIN offer_vecs v ON v.word = o.text LEFT JOIN stored s ON s.text = o.text""",
    STORE,
)
def join_embed(spark, sf):
    store = stored_words(spark, sf).withColumn("text_hash", tx.text_key(F.col("text")))
    texts = offered_words(spark, sf).select("text")
    found = em.embed_texts(texts, em.HashProvider(b.HASH_DIM), store)
    return found.select("text", "stored", vec_text())


@query(
    "prov_table",
    "SELECT o.text, array_to_string(s.vec, ',') AS vec FROM offered o JOIN stored s ON s.text = o.text",
    STORE,
)
def prov_table(spark, sf):
    provider = em.TableProvider(stored_words(spark, sf), b.HASH_DIM)
    found = em.embed_texts(offered_words(spark, sf).select("text"), provider)
    return found.select("text", vec_text())


@query(
    "join_topics_known",
    """SELECT t.name FROM default_topics t WHERE lower(t.name) NOT IN (SELECT text FROM stored)""",
    STORE,
)
def join_topics_known(spark, sf):
    lowered = ms.topics_frame(spark, pm.DEFAULT_TOPICS).withColumn("name", F.lower("name"))
    stored = stored_words(spark, sf).select(F.col("text").alias("name"))
    missing = em.unknown_topics(lowered, stored)
    names = ms.topics_frame(spark, pm.DEFAULT_TOPICS).select("name")
    return names.join(missing.withColumnRenamed("name", "low"), F.lower(names["name"]) == F.col("low")).select("name")


@query(
    "fn_cosine",
    f"SELECT vec_id, label::BIGINT AS label, {fixed('sim')} AS sim FROM vec_sims WHERE topic_idx = label",
)
def fn_cosine(spark, sf):
    own = sm.label_topics(spark, sf).select(F.col("topic_idx").alias("label"), F.col("vec").alias("centre"))
    pairs = sm.vectors(spark, sf).join(own, "label")
    return pairs.select("vec_id", "label", b.rounded(vx.cosine(F.col("vec"), F.col("centre"))).alias("sim"))


@query(
    "fn_norm",
    f"""SELECT vec_id, {fixed('vec[1] / n')} AS first_dim, {fixed('vec[64] / n')} AS last_dim FROM (
        SELECT vec_id, vec, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM emb)""",
)
def fn_norm(spark, sf):
    rows = sm.vectors(spark, sf).select("vec_id", vx.unit(F.col("vec")).alias("u"))
    return rows.select(
        "vec_id",
        b.rounded(F.col("u")[0]).alias("first_dim"),
        b.rounded(F.col("u")[b.DIM - 1]).alias("last_dim"),
    )


@query(
    "fn_text_sim",
    f"""SELECT doc_id, {fixed(cosine('d.vec', 'l.vec'))} AS similarity FROM (
        SELECT doc_id, lower(name) AS word FROM documents CROSS JOIN default_topics WHERE name = 'Technology') p
        LEFT JOIN dv d USING (doc_id) JOIN wv l USING (word)""",
)
def fn_text_sim(spark, sf):
    rows = b.docs(spark, sf).select("doc_id", F.col("text").alias("left"), F.lit("TECHNOLOGY").alias("right"))
    found = em.text_similarity(rows, em.HashProvider(b.HASH_DIM))
    return found.select("doc_id", b.rounded(F.col("similarity")).alias("similarity"))


@query(
    "vec_topk",
    f"""SELECT vec_id, rank, topic_idx::BIGINT AS topic_idx, {fixed('sim')} AS sim FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, topic_idx) AS rank FROM vec_sims)
        WHERE rank <= 3""",
)
def vec_topk(spark, sf):
    found = sc.top_topics(sm.vectors(spark, sf), b.label_space(spark, sf), 3, "vec_id")
    return found.withColumn("sim", b.rounded(F.col("sim")))


NEAREST = f"""SELECT topic_idx::BIGINT AS topic_idx, rank, vec_id, {fixed('sim')} AS sim FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_idx ORDER BY sim DESC, vec_id) AS rank FROM vec_sims)
    WHERE rank <= 5"""


@query("vec_topk_topics", NEAREST)
def vec_topk_topics(spark, sf):
    found = sc.nearest_to_topics(sm.vectors(spark, sf), b.label_space(spark, sf), 5, "vec_id")
    return found.withColumn("sim", b.rounded(F.col("sim")))


@query("vec_topk_cells", NEAREST)
def vec_topk_cells(spark, sf):
    vecs = sm.vectors(spark, sf).select("vec_id", "vec")
    centres = ce.fit_centres(vecs, ce.n_cells_for(vecs.count()))
    assigned = ce.written(ce.assign(vecs, centres), b.scratch(spark, "cells"))
    found = ce.nearest(assigned, ce.measure(assigned, centres), b.label_space(spark, sf), 5, "vec_id")
    return found.withColumn("sim", b.rounded(F.col("sim")))


@query(
    "vec_topk_self",
    f"""SELECT vec_id, rank, neighbour, {fixed('sim', 9)} AS sim FROM (
        SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY floor(sim * 1e9::DOUBLE + 0.5) DESC, neighbour) AS rank
        FROM (SELECT e.vec_id, o.vec_id AS neighbour, {cosine('e.vec', 'o.vec')} AS sim
            FROM emb e JOIN emb o ON o.vec_id <> e.vec_id)) WHERE rank <= 5""",
)
def vec_topk_self(spark, sf):
    """The five nearest other vectors of every vector."""
    return nb.nearest_of_each(sm.vectors(spark, sf).select("vec_id", "vec"), 5).rows


@query(
    "vec_topk_tiles",
    f"""SELECT vec_id, rank, topic_idx, {fixed('sim', 9)} AS sim, {fixed('exp(sim) / total')} AS p FROM (
        SELECT *, sum(exp(sim)) OVER (PARTITION BY vec_id) AS total,
            row_number() OVER (PARTITION BY vec_id ORDER BY floor(sim * 1e9::DOUBLE + 0.5) DESC, topic_idx) AS rank
        FROM (SELECT e.vec_id, o.vec_id AS topic_idx, {cosine('e.vec', 'o.vec')} AS sim FROM emb e CROSS JOIN emb o))
        WHERE rank <= 5""",
)
def vec_topk_tiles(spark, sf):
    """Every vector as a topic: the five nearest topics of each vector and their share of the softmax over all of them.
    Tiles are small enough for the samples to have several."""
    vecs = sm.vectors(spark, sf)
    topics = vecs.select(F.col("vec_id").alias("topic_idx"), "vec")
    numbers = vecs.agg(F.max("vec_id")).first()[0]
    found = ti.top_topics(vecs, topics, 0 if numbers is None else numbers + 1, 5, "vec_id", in_block=512, in_tile=256)
    return found.select("vec_id", "rank", "topic_idx", b.rounded(F.col("sim"), 9).alias("sim"), b.rounded(F.col("p")).alias("p"))


# ---- keyword modes over whole documents


@query(
    "kw_extract",
    "SELECT doc_id, rank, word AS keyword, relevance, freq FROM keywords",
)
def kw_extract(spark, sf):
    found = kw.extract(b.ordered_docs(spark, sf), b.DOC, b.text_model(spark, pm.BASELINE))
    return found.drop("vec")


@query("win_kw_rank", "SELECT doc_id, rank, word AS keyword FROM ranked WHERE rank <= n_words")
def win_kw_rank(spark, sf):
    found = kw.extract(b.ordered_docs(spark, sf), b.DOC, b.text_model(spark, pm.BASELINE, top_n=None))
    return found.select("doc_id", "rank", "keyword")


@query("top_keywords", "SELECT doc_id, rank, word AS keyword FROM ranked WHERE rank <= least(n_words, 5)")
def top_keywords(spark, sf):
    found = kw.extract(b.ordered_docs(spark, sf), b.DOC, b.text_model(spark, pm.BASELINE, top_n=5))
    return found.select("doc_id", "rank", "keyword")


@query(
    "join_kw_topic",
    f"""SELECT word AS keyword, topic_idx::BIGINT AS topic_idx,
        {fixed('coalesce(CASE WHEN size > 0 THEN s / size END, 0.0)')} AS similarity
        FROM (SELECT k.word, t.topic_idx, list_dot_product(k.v, t.v) AS s, k.size * t.size AS size
            FROM kept_words k CROSS JOIN topic_vecs t)""",
    {
        "kept_words": f"""SELECT word, vec::DOUBLE[] AS v, sqrt({dot('vec', 'vec')}) AS size
            FROM (SELECT DISTINCT word FROM keywords) JOIN wv USING (word)""",
        "topic_vecs": f"SELECT topic_idx, vec::DOUBLE[] AS v, sqrt({dot('vec', 'vec')}) AS size FROM tv",
    },
)
def join_kw_topic(spark, sf):
    model = b.text_model(spark, pm.BASELINE)
    found = kw.topic_similarity(kw.extract(b.ordered_docs(spark, sf), b.DOC, model), model.topics)
    return found.withColumn("similarity", b.rounded(F.col("similarity")))


def score_parts(relevance: str = "k.relevance", space: str = "") -> dict[str, str]:
    """CTEs `kw_weights`, `topic_sums`, `doc_p` of a keyword mode; `space` is where topics are compared."""
    return {
        "kw_weights": f"""SELECT k.doc_id, k.word, k.freq * {relevance} AS weight FROM keywords k
            JOIN wv{space} x USING (word) LEFT JOIN dv{space} d USING (doc_id) LEFT JOIN bv{space} w USING (doc_id)
            WHERE k.freq > 0""",
        "topic_sums": f"""SELECT d.doc_id, t.topic_idx, coalesce(s.score, 0.0) AS sim
            FROM docs d CROSS JOIN default_topics t LEFT JOIN (
                SELECT k.doc_id, t.topic_idx, sum(k.weight * {cosine('x.vec', 't.vec')}) AS score
                FROM kw_weights k JOIN wv{space} x USING (word) CROSS JOIN tv{space} t GROUP BY ALL) s
            ON s.doc_id = d.doc_id AND s.topic_idx = t.topic_idx""",
        "doc_p": softmax_rows("topic_sums", "doc_id"),
    }


BASE = score_parts()
SUMS = f"SELECT doc_id, topic_idx::BIGINT AS topic_idx, {fixed('sim', 5)} AS score FROM topic_sums"
DOC_P = f"SELECT doc_id, topic_idx::BIGINT AS topic_idx, {fixed('p')} AS p FROM doc_p"


@query("agg_topic_score", SUMS, BASE)
def agg_topic_score(spark, sf):
    model = b.text_model(spark, pm.BASELINE)
    docs = b.ordered_docs(spark, sf)
    scores = kw.document_scores(docs, b.DOC, model)
    zero = F.array_repeat(F.lit(0.0), model.topics.size)
    rows = docs.select("doc_id").join(scores, "doc_id", "left").select(
        "doc_id", F.posexplode(F.coalesce("scores", zero)).alias("topic_idx", "score")
    )
    return rows.withColumn("score", b.rounded(F.col("score"), 5))


def doc_scores(spark, sf, mode, **options):
    return b.long_rounded(kw.score(b.ordered_docs(spark, sf), b.DOC, b.text_model(spark, mode, **options)), "doc_id")


@query("score_keyword", DOC_P, BASE)
def score_keyword(spark, sf):
    return doc_scores(spark, sf, pm.BASELINE)


@query("score_mixed", DOC_P, score_parts(space="2"))
def score_mixed(spark, sf):
    return doc_scores(spark, sf, pm.MIXED)


@query("score_bow", DOC_P, score_parts(cosine("x.vec", "w.vec"), "2"))
def score_bow(spark, sf):
    return doc_scores(spark, sf, pm.BAG_OF_WORDS)


@query("score_full", DOC_P, score_parts(cosine("x.vec", "d.vec"), "2"))
def score_full(spark, sf):
    return doc_scores(spark, sf, pm.FULL_TEXT)


HYBRID_GATE = {
    "doc_sims": f"""SELECT d.doc_id, t.topic_idx, {cosine('v.vec', 't.vec')} AS sim
        FROM docs d LEFT JOIN dv2 v USING (doc_id) CROSS JOIN tv2 t"""
}


@query(
    "score_hybrid",
    f"""SELECT p.doc_id, p.topic_idx::BIGINT AS topic_idx, {fixed('p.p')} AS p, ({passes('s.sim', 0.1)}) AS gate
        FROM doc_p p JOIN doc_sims s USING (doc_id, topic_idx)""",
    BASE | HYBRID_GATE,
)
def score_hybrid(spark, sf):
    """Keywords and topics in one space, the text-level gate in the other."""
    docs = b.ordered_docs(spark, sf)
    p = kw.score(docs, b.DOC, b.text_model(spark, pm.HYBRID))
    main = em.HashProvider(b.OTHER_DIM)
    gates = sc.with_cosines_native(b.hashed(docs, main), b.named_topics(spark, main))
    both = p.join(gates.select("doc_id", "sims"), "doc_id")
    rows = both.select("doc_id", F.posexplode(F.arrays_zip("p", "sims")).alias("topic_idx", "x"))
    return rows.select("doc_id", "topic_idx", b.rounded(F.col("x.p")).alias("p"), bk.passes(F.col("x.sims"), 0.1).alias("gate"))


@query("score_auto", DOC_P, score_parts(space="2"))
def score_auto(spark, sf):
    """`auto` with the remote provider is the mixed mode."""
    return doc_scores(spark, sf, pm.resolve_mode(pm.AUTO, pm.REMOTE_PROVIDER))


CLEAN_P = {
    "clean_sims": f"""SELECT d.doc_id, t.topic_idx, {cosine('v.vec', 't.vec')} AS sim
        FROM docs d LEFT JOIN bv v USING (doc_id) CROSS JOIN tv t""",
    "clean_p": softmax_rows("clean_sims", "doc_id"),
}


@query("score_clean_cosine", f"SELECT doc_id, topic_idx::BIGINT AS topic_idx, {fixed('p')} AS p FROM clean_p", CLEAN_P)
def score_clean_cosine(spark, sf):
    """Softmax of the cosine between the joined cleaned words and each topic."""
    provider = em.HashProvider(b.HASH_DIM)
    vecs = b.hashed(kw.from_clean_text(b.docs(spark, sf)), provider)
    scored = sc.with_direct_p(vecs, b.named_topics(spark, provider))
    return b.long_rounded(scored, "doc_id")


CLEAN_KW = {
    "candidates": f"""SELECT t.doc_id, t.word, t.n AS freq, {fixed(cosine('x.vec', 'v.vec'), 4)} AS relevance
        FROM doc_words t JOIN wv x USING (word) JOIN bv v USING (doc_id) WHERE length(t.word) > 1""",
    "keywords": "SELECT * FROM ranked WHERE rank <= n_words",
}


@query("score_clean_keyword", DOC_P, BASE | CLEAN_KW)
def score_clean_keyword(spark, sf):
    """Keywords of the cleaned text, as many as it has words."""
    docs = kw.from_clean_text(b.ordered_docs(spark, sf))
    return b.long_rounded(kw.score(docs, b.DOC, b.text_model(spark, pm.BASELINE, top_n=None)), "doc_id")


@query(
    "fn_uniform",
    f"""SELECT doc_id, count(*) AS n_topics FROM doc_p WHERE abs(p - 1.0 / {len(pm.DEFAULT_TOPICS)}) < 1e-9
        GROUP BY doc_id HAVING count(*) = {len(pm.DEFAULT_TOPICS)}""",
    BASE,
)
def fn_uniform(spark, sf):
    """Documents without evidence: every topic at 1/T."""
    even = 1.0 / len(pm.DEFAULT_TOPICS)
    p = kw.score(b.ordered_docs(spark, sf), b.DOC, b.text_model(spark, pm.BASELINE))
    flat = F.size(F.filter(F.col("p"), lambda x: F.abs(x - even) < 1e-9))
    return p.select("doc_id", flat.alias("n_topics")).where(F.col("n_topics") == len(pm.DEFAULT_TOPICS))


@query(
    "predict_topic",
    """SELECT doc_id, name AS pred FROM (SELECT doc_id, topic_idx, row_number() OVER (
        PARTITION BY doc_id ORDER BY floor(p * 1e12 + 0.5) DESC, topic_idx) AS r FROM doc_p)
        JOIN default_topics USING (topic_idx) WHERE r = 1""",
    BASE,
)
def predict_topic(spark, sf):
    model = b.text_model(spark, pm.BASELINE)
    return jb.predict(b.ordered_docs(spark, sf), b.DOC, pm.RunParams(), model)


@query(
    "win_argmax",
    """SELECT sender, ord, topic_idx::BIGINT AS topic_idx FROM (SELECT *, row_number() OVER (
        PARTITION BY sender, ord ORDER BY p DESC, topic_idx) AS r FROM hour_p) WHERE r = 1""",
)
def win_argmax(spark, sf):
    return b.scored_hours(spark, sf).select("sender", "ord", sc.most_likely(F.col("p")).alias("topic_idx"))


SOURCE_TOPICS = {"source_words": "SELECT DISTINCT source AS word FROM documents"}
for _d in (b.HASH_DIM, b.OTHER_DIM):
    SOURCE_TOPICS |= {
        f"source_long{_d}": hash_long(_d, "source_words"),
        f"source_vecs{_d}": as_lists(f"source_long{_d}", "word", _d),
    }


@query(
    "embed_topics",
    " UNION ALL ".join(
        f"SELECT row_number() OVER (ORDER BY word) - 1 AS topic_idx, word AS name, {d}::BIGINT AS space, "
        f"array_to_string(vec, ',') AS vec FROM source_vecs{d}"
        for d in (b.HASH_DIM, b.OTHER_DIM)
    ),
    SOURCE_TOPICS,
)
def embed_topics(spark, sf):
    """The document sources as topic names, in two spaces."""
    listed = sm.table(spark, sf, "documents").select("source").distinct().orderBy("source")
    topics = ms.topics_frame(spark, [r["source"] for r in listed.collect()])  # a short list of names
    both = [
        em.embed_topics(topics, em.HashProvider(d)).select("topic_idx", "name", F.lit(d).alias("space"), vec_text())
        for d in (b.HASH_DIM, b.OTHER_DIM)
    ]
    return both[0].unionByName(both[1])


@query(
    "embed_texts",
    f"""SELECT DISTINCT sha256(text) AS text_hash, array_to_string(coalesce(vec, {ZERO}), ',') AS vec
        FROM documents LEFT JOIN dv USING (doc_id)""",
)
def embed_texts(spark, sf):
    texts = sm.table(spark, sf, "documents").select("text")
    return em.embed_texts(texts, em.HashProvider(b.HASH_DIM)).select("text_hash", vec_text())


# ---- labelled accuracy


@query("join_pred_truth", "SELECT sample_id, truth, pred FROM label_pairs")
def join_pred_truth(spark, sf):
    return b.label_pairs(spark, sf)


@query(
    "agg_accuracy",
    f"""SELECT count(*) AS total_samples, count(*) FILTER (WHERE truth = pred) AS correct_predictions,
        {fixed('avg((truth = pred)::INT::DOUBLE)')} AS accuracy FROM label_pairs""",
)
def agg_accuracy(spark, sf):
    return mt.accuracy(b.label_pairs(spark, sf)).withColumn("accuracy", b.rounded(F.col("accuracy")))


@query("agg_confusion", "SELECT truth, pred, n FROM cells")
def agg_confusion(spark, sf):
    return mt.confusion(b.label_pairs(spark, sf))


PER_LABEL = f"""SELECT label, support, {fixed('recall')} AS accuracy, {fixed('precision')} AS precision,
    {fixed('recall')} AS recall, {fixed('f1')} AS f1 FROM label_scores"""


def rounded_labels(df):
    for name in ("accuracy", "precision", "recall", "f1"):
        df = df.withColumn(name, b.rounded(F.col(name)))
    return df


@query("agg_per_topic", PER_LABEL)
def agg_per_topic(spark, sf):
    return rounded_labels(mt.per_label(mt.confusion(b.label_pairs(spark, sf))))


@query("top_topics_f1", PER_LABEL + " ORDER BY label_scores.f1 DESC, label LIMIT 10")
def top_topics_f1(spark, sf):
    return rounded_labels(mt.best_labels(mt.per_label(mt.confusion(b.label_pairs(spark, sf)))))


@query(
    "agg_weighted_prf",
    f"""SELECT {fixed('sum(precision * support) / sum(support)')} AS precision,
        {fixed('sum(recall * support) / sum(support)')} AS recall,
        {fixed('sum(f1 * support) / sum(support)')} AS f1_score FROM label_scores""",
)
def agg_weighted_prf(spark, sf):
    row = mt.weighted(mt.per_label(mt.confusion(b.label_pairs(spark, sf))))
    return row.select(*[b.rounded(F.col(c)).alias(c) for c in row.columns])


@query("set_labels", "SELECT truth AS label FROM label_pairs UNION SELECT pred FROM label_pairs")
def set_labels(spark, sf):
    return mt.label_set(b.label_pairs(spark, sf))


@query(
    "sort_labels",
    """SELECT string_agg(label, ',' ORDER BY label) AS labels FROM (
        SELECT truth AS label FROM label_pairs UNION SELECT pred FROM label_pairs)""",
)
def sort_labels(spark, sf):
    return mt.sorted_labels(b.label_pairs(spark, sf)).select(F.array_join("labels", ",").alias("labels"))


def labelled_languages(spark, sf, provider):
    """Whole documents as labelled transcripts; the truth is the language, the topics are languages."""
    line = tx.transcript_line(F.lit("user"), F.lit("room"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.lit(""))
    rows = sm.table(spark, sf, "documents").select(
        F.col("doc_id").alias("sample_id"), F.col("lang").alias("truth"), F.concat(line, F.col("text")).alias("chat_summary")
    )
    space = tp.topic_space(b.languages(spark, sf), b.HASH_DIM)
    params = pm.RunParams(topics=space.names, use_keywords=False, lemmatize=False)
    return jb.labelled_accuracy(rows, params, model=None, provider=provider, space=space)


@query("eval_labelled", """SELECT truth, pred, count(*) AS n FROM lang_pairs GROUP BY ALL""")
def eval_labelled(spark, sf):
    return labelled_languages(spark, sf, em.HashProvider(b.HASH_DIM))["confusion"]


# ---- runs


def runs_table(spark, sf):
    """Saved runs over the segments: one per threshold, with the numbers a comparison shows."""
    per_run = b.blocks(spark, sf, b.SWEEP).groupBy("threshold").agg(
        F.count(F.lit(1)).cast("double").alias("num_segments"),
        F.avg("n_msgs").alias("avg_segment_length"),
        F.avg("p").alias("avg_probability"),
        F.countDistinct("topic_idx").cast("double").alias("topics_detected"),
    )
    return per_run.select(
        F.concat(F.lit("run_"), F.col("threshold").cast("string")).alias("run_name"),
        F.lit("2024-01-31T00:00:00").alias("timestamp"),
        F.struct(
            F.when(F.col("threshold") < 0.105, "low").otherwise("high").alias("accuracy_fingerprint")
        ).alias("config"),
        F.struct(
            "num_segments", "avg_segment_length", "avg_probability", "topics_detected"
        ).alias("quality"),
    )


def saved_runs(spark, sf):
    path = b.scratch(spark, "runs")
    runs = runs_table(spark, sf)
    runs.withColumn("folder", F.col("run_name")).write.partitionBy("folder").json(path)
    return spark.read.schema(lb.RUN_SCHEMA).json(path).withColumn(
        "fingerprint", F.col("config.accuracy_fingerprint")
    )


RUNS = greedy(b.SWEEP) | {
    "run_rows": """SELECT 'run_' || threshold AS run_name, count(*)::DOUBLE AS num_segments,
        avg(n_msgs) AS avg_segment_length, avg(p) AS avg_probability,
        count(DISTINCT topic_idx)::DOUBLE AS topics_detected,
        CASE WHEN threshold < 0.105 THEN 'low' ELSE 'high' END AS fingerprint FROM blocks GROUP BY threshold"""
}


@query(
    "src_runs",
    f"""SELECT run_name, fingerprint, num_segments, {fixed('avg_probability')} AS avg_probability FROM run_rows""",
    RUNS,
)
def src_runs(spark, sf):
    return saved_runs(spark, sf).select(
        "run_name",
        "fingerprint",
        "quality.num_segments",
        b.rounded(F.col("quality.avg_probability")).alias("avg_probability"),
    )


def run_names():
    return [f"run_{t}" for t in b.SWEEP]


COMPARE_COLUMNS = ", ".join(f"max(value) FILTER (WHERE run_name = '{n}') AS \"{n}\"" for n in run_names())
COMPARE_ROWS = " UNION ALL ".join(
    f"SELECT {pos} AS pos, '{path.split('.')[0]}' AS section, '{name}' AS metric, run_name, "
    + (fixed(path.split(".")[1], 4) if path.split(".")[1] in ("num_segments", "avg_segment_length", "avg_probability", "topics_detected")
       else ("NULL::DOUBLE" if path.startswith("accuracy") else "0.0::DOUBLE"))
    + " AS value FROM run_rows"
    for pos, (name, path, _) in enumerate(mt.COMPARED)
)


@query(
    "compare_runs",
    f"SELECT pos::BIGINT AS pos, section, metric, {COMPARE_COLUMNS} FROM ({COMPARE_ROWS}) GROUP BY ALL ORDER BY pos",
    RUNS,
)
def compare_runs(spark, sf):
    table = mt.compare_runs(saved_runs(spark, sf), run_names())
    rounded = [vx.fixed(F.col(f"`{n}`"), 4).alias(n) for n in run_names()]
    return table.select("pos", "section", "metric", *rounded)


@query("sink_compare", f"SELECT count(*) AS n_lines FROM ({COMPARE_ROWS}) WHERE run_name = 'run_0.11'", RUNS)
def sink_compare(spark, sf):
    path = b.scratch(spark, "comparison")
    table = mt.compare_runs(saved_runs(spark, sf), run_names())
    sk.write_comparison(table, run_names(), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("n_lines"))


@query(
    "compare_dupes",
    """SELECT fingerprint, count(*) AS n_runs, string_agg(run_name, ',' ORDER BY run_name) AS run_names
        FROM run_rows GROUP BY fingerprint HAVING count(*) > 1""",
    RUNS,
)
def compare_dupes(spark, sf):
    found = mt.same_accuracy_groups(saved_runs(spark, sf))
    return found.withColumn("run_names", F.array_join("run_names", ","))


@query(
    "fn_fingerprint",
    """SELECT source, 'hash|m|True|m|' || string_agg(DISTINCT lang, ',' ORDER BY lang) || '|False|True|auto' AS fingerprint
        FROM documents GROUP BY source""",
)
def fn_fingerprint(spark, sf):
    """One run per document source, its languages as topics."""
    runs = sm.table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("topics"))
    before = [F.lit(x) for x in ("hash", "m", "True", "m")]
    after = [F.lit(x) for x in ("False", "True", "auto")]
    return runs.select("source", tx.fingerprint(F.col("topics"), *before, *after).alias("fingerprint"))


@query("fn_run_name", "SELECT DISTINCT 'hash_t0.07_' || strftime(ts, '%Y%m%d') AS run_name FROM events")
def fn_run_name(spark, sf):
    """A default run name per day of data."""
    day = F.date_format("ts", "yyyyMMdd")
    prefix = pm.default_run_name("hash", pm.DEFAULT_THRESHOLD, "")
    return sm.table(spark, sf, "events").select(F.concat(F.lit(prefix), day).alias("run_name")).distinct()


def text_run(spark, sf, **changes):
    """A run over the sample messages and default topics, direct mode in the hashed space."""
    params = pm.RunParams(threshold=b.TEXT_THRESHOLD, use_keywords=False, lemmatize=False).with_(**changes)
    return jb.analyse(sm.messages(spark, sf), params, em.HashProvider(b.HASH_DIM), em.HashProvider(b.HASH_DIM))


_TEXT_WALK = greedy([b.TEXT_THRESHOLD])
TEXT_RUN = _TEXT_WALK | {
    "n_docs": "SELECT count(*) AS n FROM documents",
    "hour_long": """SELECT w.sender, w.hour_idx, x.d, sum(x.v)::BIGINT AS v
        FROM worded w CROSS JOIN n_docs JOIN dl x ON x.doc_id = (w.row_id * 7919) % n_docs.n GROUP BY ALL""",
    "hour_sums": f"""SELECT sender, hour_idx, list(coalesce(v, 0) ORDER BY d) AS vec FROM (
        SELECT k.sender, k.hour_idx, g.d, x.v FROM (SELECT DISTINCT sender, hour_idx FROM worded) k
        CROSS JOIN (SELECT unnest(range({b.HASH_DIM})) AS d) g LEFT JOIN hour_long x USING (sender, hour_idx, d))
        GROUP BY sender, hour_idx""",
    "hour_sims": f"""SELECT h.sender, h.ord, h.hour_idx, h.n_msgs, t.topic_idx, {cosine('h.vec', 't.vec')} AS sim
        FROM hours h CROSS JOIN tv t""",
    "topic_rows": f"""SELECT list(list_transform(vec, lambda x: x / sqrt({dot('vec', 'vec')})) ORDER BY topic_idx) AS rows
        FROM tv""",
    "run_blocks": "SELECT w.*, n.name FROM blocks w JOIN default_topics n USING (topic_idx)",
    "cell_lines": """SELECT sender, hour_idx, count(*) AS n_cell,
        sum(1 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS n_lines FROM worded GROUP BY ALL""",
    "run_cells": """SELECT h.sender, h.hour_idx, count(*) AS n_blocks FROM blocks w JOIN hours h
        ON h.sender = w.sender AND h.ord BETWEEN w.start_ord AND w.end_ord GROUP BY ALL""",
    "caught": """SELECT sum(n_cell)::BIGINT AS distinct_messages, sum(n_lines * n_blocks)::BIGINT AS lines
        FROM run_cells JOIN cell_lines USING (sender, hour_idx)""",
    "found_langs": "SELECT count(*) AS n, count(*) FILTER (WHERE truth = pred) AS hits FROM lang_pairs",
}
RUN_PRINT = "hash|None|False|None|" + ",".join(sorted(pm.DEFAULT_TOPICS)) + "|False|False|auto"
RUN_START = {"start_date": sm.START, "end_date": sm.END}


@query(
    "evaluate",
    f"""SELECT 'sample' AS run_name, '{RUN_PRINT}|languages' AS accuracy_fingerprint,
        (SELECT count(*) FROM worded) AS total_messages, count(*) AS num_segments, {fixed('avg(p)', 4)} AS avg_probability,
        sum(n_msgs)::BIGINT AS messages_captured, (SELECT distinct_messages FROM caught) AS distinct_messages_captured,
        (SELECT lines FROM caught) AS lines_captured, (SELECT n FROM found_langs) AS total_samples,
        (SELECT hits FROM found_langs) AS correct_predictions FROM run_blocks""",
    TEXT_RUN,
)
def evaluate(spark, sf):
    """A whole evaluation: the run over the messages, and accuracy on the documents labelled with their language."""
    provider = em.HashProvider(b.HASH_DIM)
    run = text_run(spark, sf, labelled_set="languages", **RUN_START)
    accuracy = labelled_languages(spark, sf, provider)
    document = jb.run_document(run, "sample", "2024-01-31T00:00:00", 1.0, accuracy)
    run.release()  # the document is a finished row
    accuracy["pairs"].unpersist()
    return document.select(
        "run_name", "config.accuracy_fingerprint", "performance.total_messages", "quality.num_segments",
        vx.fixed(F.col("quality.avg_probability"), 4).alias("avg_probability"),
        F.col("quality.total_messages_captured").alias("messages_captured"), "quality.distinct_messages_captured",
        "quality.lines_captured", "accuracy.total_samples", "accuracy.correct_predictions",
    )


@query("agg_run_cost", "SELECT count(*) AS total_messages, round(count(*) / 50.0, 2) AS messages_per_second FROM messages")
def agg_run_cost(spark, sf):
    """Throughput for a given elapsed time (50 s)."""
    total = sm.messages(spark, sf).agg(F.count(F.lit(1)).alias("total_messages"))
    return total.withColumn("messages_per_second", mt.throughput(F.col("total_messages"), F.lit(50.0)))


@query(
    "sink_eval",
    f"SELECT 'sample' AS run_name, '{RUN_PRINT}' AS fingerprint, count(*)::DOUBLE AS num_segments FROM run_blocks",
    TEXT_RUN,
)
def sink_eval(spark, sf):
    base = b.scratch(spark, "eval")
    run = text_run(spark, sf, **RUN_START)
    document = jb.run_document(run, "sample", "2024-01-31T00:00:00", 1.0)
    summary, topics = mt.summary(run.segments), mt.topic_distribution(run.segments)
    sk.write_run(document, run.with_transcripts(), summary, topics, base, "sample", "gzip")
    run.release()
    return lb.read_runs(spark, base, ["sample", "absent"]).select("run_name", "fingerprint", "quality.num_segments")


@query(
    "sink_summary",
    f"""SELECT line FROM (
        SELECT 'segments: ' || count(*) AS line FROM blocks
        UNION ALL SELECT printf('average length: %.2f messages', avg(n_msgs)) FROM blocks
        UNION ALL SELECT 'messages captured: ' || sum(n_msgs) FROM blocks
        UNION ALL SELECT printf('average relevance: %.4f', avg(p)) FROM blocks
        UNION ALL SELECT topic || ': ' || count(*) || ' segments' FROM blocks GROUP BY topic)""",
    greedy([b.THRESHOLD]),
)
def sink_summary(spark, sf):
    path = b.scratch(spark, "summary")
    segs = b.segments(spark, sf)
    sk.write_summary(mt.summary(segs), mt.topic_distribution(segs), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(
    "fn_json",
    f"""SELECT run_name, json_object('run_name', run_name, 'config', json_object('accuracy_fingerprint', fingerprint),
        'quality', json_object('num_segments', num_segments::BIGINT, 'topics_detected', topics_detected::BIGINT,
        'avg_probability', printf('%.4f', {fixed('avg_probability', 4)})))::VARCHAR AS document FROM run_rows""",
    RUNS,
)
def fn_json(spark, sf):
    """Run documents as JSON text, nested; whole numbers and a printed probability."""
    shown = F.struct(
        F.col("quality.num_segments").cast("long").alias("num_segments"),
        F.col("quality.topics_detected").cast("long").alias("topics_detected"),
        F.format_string("%.4f", vx.fixed(F.col("quality.avg_probability"), 4)).alias("avg_probability"),
    )
    runs = runs_table(spark, sf).withColumn("quality", shown)
    return runs.select("run_name", F.to_json(F.struct("run_name", "config", "quality")).alias("document"))


@query(
    "store_run",
    f"""SELECT r.run, count(*) AS n_segments, {fixed('avg(p)', 4)} AS avg_p, r.run = 2 AS all_found
        FROM run_blocks CROSS JOIN (VALUES (1::BIGINT), (2::BIGINT)) r(run) GROUP BY ALL""",
    TEXT_RUN,
)
def store_run(spark, sf):
    """Two runs with one vector table: equal segments, and the second finds every vector. Words and topics are keyed;
    the table is compacted between them."""
    table = vt.VectorTable(spark, b.scratch(spark, "vectors"))
    params = pm.RunParams(threshold=b.TEXT_THRESHOLD, use_keywords=False, lemmatize=False, **RUN_START)
    both = []
    for run_no in (1, 2):
        run = jb.analyse(
            sm.messages(spark, sf), params, em.HashProvider(b.HASH_DIM),
            store=table, stored_at=f"2024-01-0{run_no} 00:00:00",
        )
        found = all(x.asked == x.found for x in run.stores)
        row = run.segments.agg(F.count(F.lit(1)).alias("n_segments"), vx.fixed(F.avg("p"), 4).alias("avg_p")).select(
            F.lit(run_no).cast("long").alias("run"), "n_segments", "avg_p", F.lit(found).alias("all_found")
        )
        both.append(written(row, "run"))  # a finished row: the second run need not hold the first
        run.release()
        table.compact()
    return both[0].unionByName(both[1])


# ---- rows only: fitted models and the keyword walk


@query("score_lda")
def score_lda(spark, sf):
    docs = b.docs(spark, sf)
    numbers, model = ld.fitted(docs, b.DOC, len(pm.DEFAULT_TOPICS))
    return b.long_rounded(ld.score(docs, b.DOC, numbers, model), "doc_id")


@query(
    "lda_counts",
    "SELECT doc_id, dense_rank() OVER (ORDER BY word) - 1 AS word_id, word, n::DOUBLE AS n FROM doc_words",
)
def lda_counts(spark, sf):
    """The counts that the topic model sees, read off its sparse vectors, with the word of each column."""
    docs = b.docs(spark, sf)
    numbers = ld.numbering(docs, b.DOC)
    rows = ld.counts(docs, b.DOC, numbers, numbers.count())
    cells = rows.select("doc_id", F.explode(F.arrays_zip("counts.indices", "counts.values")).alias("x"))
    cells = cells.select("doc_id", F.col("x.indices").cast("long").alias("word_id"), F.col("x.values").alias("n"))
    return cells.join(numbers, "word_id").select("doc_id", "word_id", "word", "n")


@query("prov_w2v")
def prov_w2v(spark, sf):
    docs = b.docs(spark, sf)
    provider = em.make_provider("word2vec", corpus=docs, dim=16)
    return em.embed_texts(docs.select("text"), provider).select("text_hash", vec_text())


def load_length_model():
    """Stands in for a user's model: two numbers per text."""
    import numpy as np

    return lambda texts: np.asarray([[len(t), t.count(" ") + 1.0] for t in texts])


@query(
    "prov_pandas",
    """SELECT DISTINCT sha256(text) AS text_hash,
        (length(text) * 1000000) || ',' || ((length(text) - length(replace(text, ' ', '')) + 1) * 1000000) AS vec
        FROM documents""",
)
def prov_pandas(spark, sf):
    provider = em.make_provider("pandas", load=load_length_model, dim=2)
    texts = sm.table(spark, sf, "documents").select("text")
    return em.embed_texts(texts, provider).select("text_hash", vec_text())


def load_letter_model():
    """Stands in for an embedding model: letter counts scaled to length one, so vectors of texts don't add up."""
    import numpy as np

    def encode(texts):
        counts = np.asarray([[t.count(c) + t.count(c.upper()) for c in LETTERS] for t in texts], dtype=float)
        return counts / np.maximum(np.sqrt((counts * counts).sum(axis=1, keepdims=True)), 1e-9)

    return encode


LETTERS = "abcdefghijklmnopqrstuvwxyz"
MODEL_THRESHOLD = 0.066


def letter_counts(text: str) -> str:
    one = f"length({text}) - length(replace(replace({text}, c, ''), upper(c), ''))"
    return f"list_transform(string_split('{','.join(LETTERS)}', ','), lambda c: {one})"


def unit_millionths(vec: str) -> str:
    return f"list_transform({vec}, lambda x: floor(x / sqrt({dot(vec, vec)}) * 1e6 + 0.5))"


_WALK = greedy([MODEL_THRESHOLD])
MODEL_BLOCKS = _WALK | {
    "hours": """SELECT s.*, v.vec, row_number() OVER (PARTITION BY s.sender ORDER BY s.hour_idx) AS ord
        FROM hour_stats s JOIN hour_sums v USING (sender, hour_idx) WHERE n_words > 0""",
    "hour_sums": f"""SELECT sender, hour_idx, list(s ORDER BY i) AS vec FROM (
        SELECT sender, hour_idx, i, sum(v)::BIGINT AS s FROM (
            SELECT sender, hour_idx, unnest(counts) AS v, generate_subscripts(counts, 1) AS i
            FROM (SELECT sender, hour_idx, {letter_counts('text')} AS counts FROM worded)) GROUP BY ALL)
        GROUP BY sender, hour_idx""",
    "model_topics": f"""SELECT topic_idx, name, {unit_millionths('counts')} AS vec
        FROM (SELECT *, {letter_counts('name')} AS counts FROM default_topics)""",
    "topic_rows": f"""SELECT list(list_transform(vec, lambda x: x / sqrt({dot('vec', 'vec')})) ORDER BY topic_idx) AS rows
        FROM model_topics""",
    "hour_sims": f"""SELECT h.sender, h.ord, h.hour_idx, h.n_msgs, t.topic_idx, {cosine('h.seen', 't.vec')} AS sim
        FROM (SELECT *, {unit_millionths('vec')} AS seen FROM hours) h CROSS JOIN model_topics t""",
    "walk": _WALK["walk"].replace(
        "list_dot_product(r, joined::DOUBLE[])", "list_dot_product(r, seen::DOUBLE[])"
    ).replace(
        "sqrt(list_dot_product(joined::DOUBLE[], joined::DOUBLE[]))", "sqrt(list_dot_product(seen::DOUBLE[], seen::DOUBLE[]))"
    ).replace(
        "FROM (SELECT w.threshold, w.sender", f"FROM (SELECT *, {unit_millionths('joined')} AS seen FROM (SELECT w.threshold, w.sender"
    ) + ")",
}


@query(
    "find_blocks_model",
    f"""SELECT sender, topic_idx::BIGINT AS topic_idx, block_no, start_ord, end_ord, n_msgs, {fixed('p')} AS p
        FROM blocks""",
    MODEL_BLOCKS,
)
def find_blocks_model(spark, sf):
    """A whole run in direct mode with a model whose vectors don't add up: blocks are scored on their joined text."""
    params = pm.RunParams(threshold=MODEL_THRESHOLD, use_keywords=False, lemmatize=False)
    params = params.with_(start_date=sm.START, end_date=sm.END)
    provider = em.make_provider("pandas", load=load_letter_model, dim=len(LETTERS))
    found = jb.analyse(sm.messages(spark, sf), params, provider).blocks
    return found.select(
        "sender", "topic_idx", "block_no", "start_ord", "end_ord", "n_msgs", b.rounded(F.col("p")).alias("p")
    )


KEYWORD_THRESHOLD = 0.2


@query("find_blocks_keyword")
def find_blocks_keyword(spark, sf):
    """Greedy blocks in the baseline keyword mode over the sample messages."""
    cells = hr.hour_texts(b.messages(spark, sf)).drop("words")  # the walk cleans them from the texts
    found = kb.keyword_blocks(cells, None, b.text_model(spark, pm.BASELINE), KEYWORD_THRESHOLD)
    return found.select("sender", "topic_idx", "block_no", "start_ord", "end_ord", b.rounded(F.col("p")).alias("p"))


@query("default_run")
def default_run(spark, sf):
    """A whole run with the default parameters: keywords, lemmas, the default topics and threshold."""
    run = jb.analyse(sm.messages(spark, sf), pm.RunParams(), em.HashProvider(b.HASH_DIM))
    return run.segments.select(
        "sender", "topic", "block_no", "start_ts", "end_ts", "n_hours", "n_msgs", b.rounded(F.col("p")).alias("p")
    )
