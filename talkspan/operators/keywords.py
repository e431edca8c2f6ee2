"""Keyword extraction and keyword-weighted topic scores.

A document is any keyed row with `text` and cleaned `words`: a message, an hour cell, a labelled
sample. Where tasks can work out the vectors of words by themselves, keywords are ranked and scored where the documents
are (`keyword_tasks`). Otherwise texts are tokenised once: their word counts are a written table, which every later step
(the lexicon, document vectors, ranking, scores) reads by column. Vocabulary tables join on the word; adaptive
execution broadcasts them when they measure small and splits common words when they do not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspan import params
from talkspan.functions import text as tx
from talkspan.functions import vectors as vx
from talkspan.functions.stopwords import DEFAULT_STOP_WORDS
from talkspan.operators import keyword_tasks as kt
from talkspan.operators.checkpoints import written
from talkspan.operators.embeddings import EmbeddingProvider, word_vectors
from talkspan.operators.topics import TopicSpace


@dataclass(frozen=True)
class KeywordModel:
    """Which space ranks the keywords, which compares them with topics, and what relevance means."""

    extract: EmbeddingProvider
    compare: EmbeddingProvider
    topics: TopicSpace
    relevance: str = "extraction"  # or "words", "text": cosine with that document in `compare`
    top_n: int | None = params.DEFAULT_TOP_KEYWORDS
    stop_words: tuple[str, ...] | None = None

    @property
    def one_space(self) -> bool:
        return self.extract is self.compare


def keyword_model(
    mode: str, provider: EmbeddingProvider, keyword_provider: EmbeddingProvider, topics: TopicSpace, **options
) -> KeywordModel:
    """The model a mode name stands for. `topics` must lie in the space that mode compares in:
    the keyword provider's for baseline and hybrid, the main provider's otherwise."""
    if mode in (params.BASELINE, params.HYBRID):
        return KeywordModel(keyword_provider, keyword_provider, topics, "extraction", **options)
    relevance = {params.MIXED: "extraction", params.BAG_OF_WORDS: "words", params.FULL_TEXT: "text"}[mode]
    return KeywordModel(keyword_provider, provider, topics, relevance, **options)


def bags(docs: DataFrame, key: Sequence[str], stop_words=None) -> DataFrame:
    """`key, word, n_tok, n_word, candidate`: counts among the tokens of the text and among the
    cleaned words. One pass over the documents."""
    both = docs.select(*key, tx.tokens(F.col("text")).alias("tokens"), "words").select(
        *key, F.size("tokens").alias("n_tokens"), F.posexplode(F.concat("tokens", "words")).alias("pos", "word")
    )
    from_text = (F.col("pos") < F.col("n_tokens")).cast("bigint")
    counted = (
        both.select(*key, "word", from_text.alias("t"))
        .groupBy(*key, "word")
        .agg(F.sum("t").alias("n_tok"), F.sum(F.lit(1) - F.col("t")).alias("n_word"))
    )
    return counted.withColumn("candidate", (F.col("n_tok") > 0) & allowed(stop_words))


def allowed(stop_words=None) -> Column:
    """May `word` become a keyword?"""
    stop = sorted(set(DEFAULT_STOP_WORDS if stop_words is None else stop_words))
    return ~F.col("word").isin(stop) if stop else F.lit(True)


def counts(docs: DataFrame, key: Sequence[str], stop_words=None) -> DataFrame:
    """`bags` as a written table: everything that reads it more than once starts here."""
    return written(bags(docs, key, stop_words), "bags")


def map_counts(counted: DataFrame, key: Sequence[str], mapping: DataFrame, to: str, stop_words=None) -> DataFrame:
    """`bags` after the cleaned words were replaced by `mapping` (`word`, `to`) and stop words dropped again.

    What moves is one row per document and word, and no list of words is taken apart or put together. Tokens stay.
    """
    none = F.lit(0).cast("bigint")
    new = mapping.where(F.col("word") != F.col(to)).select("word", F.col(to).alias("_to"))
    joined = counted.join(new, "word", "left")
    keep = F.struct("word", "n_tok", F.when(F.col("_to").isNull(), F.col("n_word")).otherwise(none).alias("n_word"))
    move = F.struct(F.col("_to").alias("word"), none.alias("n_tok"), "n_word")
    moves = F.col("_to").isNotNull() & (F.col("n_word") > 0)
    rows = joined.select(*key, F.explode(F.when(moves, F.array(keep, move)).otherwise(F.array(keep))).alias("x"))
    stop = sorted({"", *(DEFAULT_STOP_WORDS if stop_words is None else stop_words)})
    counted_word = F.when(F.col("x.word").isin(stop), none).otherwise(F.col("x.n_word"))
    again = (
        rows.select(*key, "x.word", "x.n_tok", counted_word.alias("n_word"))
        .groupBy(*key, "word")
        .agg(F.sum("n_tok").alias("n_tok"), F.sum("n_word").alias("n_word"))
        .where("n_tok > 0 OR n_word > 0")
    )
    return again.withColumn("candidate", (F.col("n_tok") > 0) & allowed(stop_words))


def word_freq(docs: DataFrame, key: Sequence[str]) -> DataFrame:
    """`key, word, n` among the cleaned words."""
    return (
        docs.select(*key, F.explode("words").alias("word"))
        .groupBy(*key, "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def lexicon(counted: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """`word, vec, size` of the distinct words, each computed once."""
    found = provider.lexicon(counted) if hasattr(provider, "lexicon") else word_vectors(counted, provider)
    return found.withColumn("size", vx.norm(F.col("vec")))


def _document_vectors(
    docs: DataFrame, with_vec: DataFrame, key: Sequence[str], provider: EmbeddingProvider, source: str
) -> DataFrame:
    """`key, doc_vec, doc_size`. Additive providers sum word vectors (and count `n_words` on the way); the others embed
    the document text."""
    if provider.additive:
        weight = {
            "text": F.col("n_tok"),
            "words": F.when(F.length("word") > 1, F.col("n_word")).otherwise(F.lit(0)),
        }[source]
        sums = with_vec.groupBy(*key).agg(
            vx.sum_vectors(F.col("vec"), provider.dim, weight).alias("doc_vec"), F.sum("n_word").alias("n_words")
        )
        return sums.withColumn("doc_size", vx.norm(F.col("doc_vec")))
    body = F.col("text") if source == "text" else F.array_join("words", " ")
    keyed = docs.select(*key, body.alias("text")).withColumn("text_hash", tx.text_key(F.col("text")))
    texts = keyed.select("text_hash", "text").dropDuplicates(["text_hash"])
    return keyed.join(provider.vectors(texts), "text_hash").select(
        *key, F.col("vec").alias("doc_vec"), vx.norm(F.col("vec")).alias("doc_size")
    )


def _relevance(dim: int) -> Column:
    """Cosine of word and document; both lengths are worked out once per word and per document."""
    return vx.ratio(
        vx.dot_of(F.col("vec"), F.col("doc_vec"), dim), F.col("size") * F.col("doc_size")
    )


def extract(docs: DataFrame, key: Sequence[str], model: KeywordModel, counted: DataFrame | None = None) -> DataFrame:
    """Ranked keywords `key, rank, keyword, relevance, freq, vec`.

    Candidates are ranked by cosine with the document (four places), then by word; a document keeps
    as many as it has cleaned words, and at most `top_n`.
    """
    if counted is None and kt.fits(model):
        return kt.keywords(docs, key, model, weighted=False)
    counted = counts(docs, key, model.stop_words) if counted is None else counted
    with_vec = counted.join(lexicon(counted, model.extract), "word")
    doc_vec = _document_vectors(docs, with_vec, key, model.extract, "text")
    if not model.extract.additive:
        doc_vec = doc_vec.join(counted.groupBy(*key).agg(F.sum("n_word").alias("n_words")), list(key))
    candidates = (
        with_vec.where("candidate")
        .join(doc_vec, list(key))
        .withColumn("relevance", vx.fixed(_relevance(model.extract.dim), 4))
    )
    order = W.partitionBy(*key).orderBy(F.desc("relevance"), "word")
    ranked = candidates.withColumn("rank", F.row_number().over(order))
    if model.top_n is not None:
        ranked = ranked.where(F.col("rank") <= model.top_n)
    return ranked.where(F.col("rank") <= F.col("n_words")).select(
        *key, "rank", F.col("word").alias("keyword"), "relevance", F.col("n_word").alias("freq"), "vec"
    )


def weighted_keywords(
    docs: DataFrame, key: Sequence[str], model: KeywordModel, counted: DataFrame | None = None
) -> DataFrame:
    """Keywords with the relevance the mode asks for and `vec` in the comparing space."""
    if counted is None and kt.fits(model):
        return kt.keywords(docs, key, model, weighted=True)
    counted = counts(docs, key, model.stop_words) if counted is None else counted
    found = extract(docs, key, model, counted)
    if model.one_space and model.relevance == "extraction":
        return found
    lex = lexicon(counted, model.compare)
    found = found.drop("vec").join(lex.withColumnRenamed("word", "keyword"), "keyword")
    if model.relevance == "extraction":
        return found
    with_vec = counted.join(lex, "word")
    doc_vec = _document_vectors(docs, with_vec, key, model.compare, model.relevance)
    return (
        found.join(doc_vec, list(key))
        .withColumn("relevance", _relevance(model.compare.dim))
        .drop("doc_vec", "doc_size", "size", "n_words")
    )


def topic_similarity(words: DataFrame, space: TopicSpace) -> DataFrame:
    """Cosine of each distinct keyword with each topic: `keyword, topic_idx, similarity`."""
    distinct = words.select("keyword", "vec").dropDuplicates(["keyword"])
    sims = vx.cosines(F.col("vec"), space.literal())
    return distinct.select("keyword", F.posexplode(sims).alias("topic_idx", "similarity"))


def topic_scores(found: DataFrame, key: Sequence[str], space: TopicSpace) -> DataFrame:
    """Per document: sum over keywords of similarity x relevance x frequency, as `scores`."""
    hits = found.where(F.col("freq") > 0)  # a keyword outside the cleaned words weighs nothing
    weighted = hits.withColumn("sims", vx.cosines(F.col("vec"), space.literal())).withColumn(
        "weight", F.col("relevance") * F.col("freq")
    )
    return weighted.groupBy(*key).agg(
        F.array(*[F.sum(F.col("sims")[i] * F.col("weight")) for i in range(space.size)]).alias("scores")
    )


def document_scores(
    docs: DataFrame, key: Sequence[str], model: KeywordModel, counted: DataFrame | None = None
) -> DataFrame:
    """`key, scores` of the documents that have a keyword among their cleaned words."""
    if counted is None and kt.fits(model):
        return kt.scores(docs, key, model)
    return topic_scores(weighted_keywords(docs, key, model, counted), key, model.topics)


def score(docs: DataFrame, key: Sequence[str], model: KeywordModel, counted: DataFrame | None = None) -> DataFrame:
    """`key, p`. Documents without keywords (or without weight) are uniform over the topics. `counted` are their word
    counts, where they are known already."""
    scores = document_scores(docs, key, model, counted)
    even = F.array_repeat(F.lit(1.0 / model.topics.size), model.topics.size)
    return (
        docs.select(*key)
        .join(scores, list(key), "left")
        .select(*key, F.when(F.col("scores").isNull(), even).otherwise(vx.softmax(F.col("scores"))).alias("p"))
    )


def from_clean_text(docs: DataFrame) -> DataFrame:
    """The documents with their cleaned words as text."""
    return docs.withColumn("text", F.array_join("words", " "))
