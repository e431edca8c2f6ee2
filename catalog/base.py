"""Inputs shared by the registered queries, all derived from the sample tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspan.functions import text as tx
from talkspan.functions import vectors as vx
from talkspan.operators import blocks as bk
from talkspan.operators import embeddings as em
from talkspan.operators import hours as hr
from talkspan.operators import keywords as kw
from talkspan.operators import scoring as sc
from talkspan.operators import segments as sg
from talkspan.operators import topics as tp
from talkspan.params import DEFAULT_TOPICS
from talkspan.sources import messages as ms
from talkspan.sources import sample as sm

DIM = sm.DIM
HASH_DIM = 16
OTHER_DIM = 24
THRESHOLD = 0.11
LOW_THRESHOLD = 0.09
GATE = 0.15
SWEEP = (0.09, 0.1, 0.11, 0.12)
TEXT_THRESHOLD = 0.05
DOC = ["doc_id"]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables: below the shared folder the cluster names. Only a local
    session without that setting falls back to a folder of this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="talkspan-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def messages(spark, sf) -> DataFrame:
    return ms.with_hours(sm.messages(spark, sf), sm.START, sm.END)


def worded(spark, sf) -> DataFrame:
    return hr.with_words(messages(spark, sf))


def counted(spark, sf) -> DataFrame:
    """Messages with the number of their cleaned words in place of the text, which is counted once per document."""
    n_words = F.size(tx.clean_words(F.col("text"))).cast("long").alias("n_words")
    return ms.with_hours(sm.messages(spark, sf, n_words), sm.START, sm.END).drop("text", "prompt")


def vector_messages(spark, sf) -> DataFrame:
    """Messages with vector and cleaned word count; the text stops here."""
    rows = counted(spark, sf).select("row_id", "chatroom", "sender", "ts", "hour_idx", "n_words")
    return rows.join(sm.message_vectors(spark, sf), "row_id")


def vector_hours(spark, sf) -> DataFrame:
    """Active cells with summed message vectors."""
    return hr.active(hr.hour_vectors(vector_messages(spark, sf), DIM))


def label_space(spark, sf) -> tp.TopicSpace:
    return tp.topic_space(sm.label_topics(spark, sf), DIM)


def scored_hours(spark, sf) -> DataFrame:
    """Active cells with ordinal, similarities and probabilities."""
    space = label_space(spark, sf)
    hours = sc.with_cosines(hr.with_ordinal(vector_hours(spark, sf)), space)
    return hours.withColumn("p", vx.softmax(F.col("sims")))


def blocks(spark, sf, thresholds=(THRESHOLD,), gate=0.0) -> DataFrame:
    space = label_space(spark, sf)
    hours = vector_hours(spark, sf)
    if gate > 0:
        hours = sc.with_cosines(hours, space)
    return bk.vector_blocks(hours, space, thresholds, gate, "sims" if gate > 0 else None)


def label_names() -> list[str]:
    return [f"label_{i}" for i in range(sm.N_LABELS)]


def segments(spark, sf) -> DataFrame:
    return sg.segments(blocks(spark, sf), label_names())


def docs(spark, sf) -> DataFrame:
    """Whole documents with cleaned words: `doc_id, lang, text, words`, spread by document."""
    rows = sm.table(spark, sf, "documents").select("doc_id", "lang", "text").repartition("doc_id")
    return hr.with_words(rows)


def ordered_docs(spark, sf) -> DataFrame:
    """`docs` in the order of their ids in every task, so that keywords are worked out where the documents are."""
    rows = sm.table(spark, sf, "documents").select("doc_id", "lang", "text").repartition("doc_id")
    return hr.with_words(rows.sortWithinPartitions("doc_id"))


def named_topics(spark, provider) -> tp.TopicSpace:
    """The default topic names in the space of a provider."""
    topics = ms.topics_frame(spark, DEFAULT_TOPICS)
    return tp.topic_space(em.embed_topics(topics, provider), provider.dim)


def text_model(spark, mode: str, **options) -> kw.KeywordModel:
    own, other = em.HashProvider(HASH_DIM), em.HashProvider(OTHER_DIM)
    from talkspan import params as pm

    side = own if mode in (pm.BASELINE, pm.HYBRID) else other
    return kw.keyword_model(mode, other, own, named_topics(spark, side), **options)


def rounded(p, places: int = 6):
    return vx.fixed(p, places)


def long_rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Array form of `p` as rows with six places."""
    return sc.long_p(df, *keys).withColumn("p", rounded(F.col("p")))


def language_vectors(spark, sf) -> DataFrame:
    """`doc_id, lang, vec`: hash vectors of the whole documents."""
    rows = sm.table(spark, sf, "documents").select("doc_id", "lang", "text").repartition("doc_id")
    keyed = rows.withColumn("text_hash", tx.text_key(F.col("text")))
    provider = em.HashProvider(HASH_DIM)
    vecs = provider.vectors(keyed.select("text_hash", "text").dropDuplicates(["text_hash"]))
    return keyed.join(vecs, "text_hash").select("doc_id", "lang", "text", "vec")


def hashed(docs: DataFrame, provider: em.HashProvider) -> DataFrame:
    """`doc_id, vec` of the documents that have a text, each worked out where its text is."""
    keyed = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("text_hash"), "text")
    return provider.vectors(keyed).withColumnRenamed("text_hash", "doc_id")


def languages(spark, sf) -> DataFrame:
    """One topic per language in name order, the sum of its documents: `topic_idx, name, vec`."""
    sums = language_vectors(spark, sf).groupBy("lang").agg(vx.sum_vectors(F.col("vec"), HASH_DIM).alias("vec"))
    return sums.select(F.col("lang").alias("topic_idx"), F.col("lang").alias("name"), "vec")


def label_pairs(spark, sf) -> DataFrame:
    """`sample_id, truth, pred`: nearest label of each vector."""
    space = label_space(spark, sf)
    scored = sc.with_direct_p(sm.vectors(spark, sf), space)
    return scored.select(
        F.col("vec_id").alias("sample_id"),
        F.concat(F.lit("label_"), "label").alias("truth"),
        sc.topic_name(sc.most_likely(F.col("p")), space.names).alias("pred"),
    )
