"""Keywords and topic scores of whole documents inside the tasks that hold them.

Where a task can work out the vectors of words by itself (`word_encoder`), the keywords of a document need nothing but the
document: no row per word is moved, no vocabulary is joined. Documents are read in the order of their keys; rows that share
a key are one document, and what they hold is added up. A task keeps one Arrow batch and, where a document does not end
with its batch, the counts of that document's distinct words.

The arithmetic is that of `keywords`: whole numbers are summed, and dimensions are multiplied and added one by one in their
order, so that ranks and ties come out alike.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.functions import text as tx
from talkspan.functions.stopwords import DEFAULT_STOP_WORDS
from talkspan.operators.checkpoints import bounded_batches

OWN = ("_rows", "_words", "_tokens")
KEYWORDS = "rank int, keyword string, relevance double, freq bigint, vec array<bigint>"
SCORES = "scores array<double>"


def fits(model) -> bool:
    """Can a task work out the words of this model by itself?"""
    return all(hasattr(p, "word_encoder") for p in (model.extract, model.compare))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, dimensions added one by one."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def ratio(num: np.ndarray, den: np.ndarray) -> np.ndarray:
    return np.where(den != 0, num / np.where(den != 0, den, 1.0), 0.0)


class Words:
    """The distinct words of a batch in the order of their bytes, with vectors worked out when asked for."""

    def __init__(self, words: pa.Array) -> None:
        coded = words.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.words = coded.dictionary.take(pa.array(order))
        self.at = place[coded.indices.to_numpy(zero_copy_only=False)]
        self.listed = self.words.to_pylist()


class Space:
    """Vectors of a batch's words in one space, and their lengths."""

    def __init__(self, whole: np.ndarray) -> None:
        self.whole = whole
        self.vec = whole.astype(np.float64)
        self.size = np.sqrt(dots(self.vec, self.vec))

    def documents(self, word: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector of each document, the weighted sum of its words, and its length."""
        out = np.empty((len(starts), self.whole.shape[1]))
        for d in range(out.shape[1]):
            out[:, d] = np.add.reduceat(self.whole[word, d] * weight, starts)
        return out, np.sqrt(dots(out, out))


class Ranker:
    """Keywords or topic scores of documents whose word counts are at hand."""

    def __init__(self, model, weighted: bool, scores: bool) -> None:
        self.one_space = model.one_space
        self.relevance = model.relevance
        self.weighted, self.scores = weighted, scores
        self.top_n = model.top_n
        self.stop = set(DEFAULT_STOP_WORDS if model.stop_words is None else model.stop_words)
        self.topics = model.topics.rows
        self.starts = model.extract.word_encoder(), model.compare.word_encoder()

    def start(self) -> None:
        first, second = self.starts
        self.extract = first()
        self.compare = self.extract if self.one_space else second()

    def work(self, words: Words, doc: np.ndarray, word: np.ndarray, t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        """Places of documents, one per row returned, and the other columns. `doc, word` are sorted, without repeats."""
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        nth = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]).astype(np.int64)]))
        n_words = np.add.reduceat(c, starts)
        space = Space(self.extract(words.listed))
        vecs, sizes = space.documents(word, t, starts)
        allowed = np.asarray([w not in self.stop for w in words.listed], dtype=bool)
        may = np.flatnonzero((t > 0) & allowed[word])
        cosine = ratio(dots(space.vec[word[may]], vecs[nth[may]]), space.size[word[may]] * sizes[nth[may]])
        relevance = np.floor(cosine * 1e4 + 0.5) / 1e4
        order = np.lexsort((word[may], -relevance, nth[may]))
        may, relevance = may[order], relevance[order]
        rank = _places(nth[may])
        limit = n_words[nth[may]]
        if self.top_n is not None:
            limit = np.minimum(limit, self.top_n)
        kept = rank <= limit
        may, relevance, rank = may[kept], relevance[kept], rank[kept]
        other = space
        if self.weighted and not self.one_space:
            other = Space(self.compare(words.listed))
        if self.weighted and self.relevance != "extraction":
            counts = t if self.relevance == "text" else np.where([len(w) > 1 for w in words.listed], 1, 0)[word] * c
            vecs, sizes = other.documents(word, counts, starts)
            relevance = ratio(dots(other.vec[word[may]], vecs[nth[may]]), other.size[word[may]] * sizes[nth[may]])
        if self.scores:
            return self._scores(other, doc[may], word[may], relevance, c[may])
        at = word[may]
        offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * np.int32(other.whole.shape[1]))
        listed = pa.ListArray.from_arrays(offsets, pa.array(other.whole[at].ravel()))
        return doc[may], [
            pa.array(rank.astype(np.int32)), words.words.take(pa.array(at)), pa.array(relevance), pa.array(c[may]), listed
        ]

    def _scores(self, space: Space, doc: np.ndarray, word: np.ndarray, relevance: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        hit = freq > 0  # a keyword outside the cleaned words weighs nothing
        doc, word, weight = doc[hit], word[hit], relevance[hit] * freq[hit]
        n_topics = len(self.topics)
        used, at = np.unique(word, return_inverse=True)
        sims = np.zeros((len(used), n_topics))
        for d in range(self.topics.shape[1]):
            sims += space.vec[used, d][:, None] * self.topics[:, d]
        sims = ratio(sims, space.size[used][:, None])
        starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        sums = np.zeros((len(starts), n_topics))
        for k in range(n_topics if len(doc) else 0):
            sums[:, k] = np.add.reduceat(sims[at, k] * weight, starts)
        offsets = pa.array(np.arange(len(starts) + 1, dtype=np.int32) * np.int32(n_topics))
        return doc[starts], [pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))]


def _places(group: np.ndarray) -> np.ndarray:
    """Place within its group, from 1, of each entry of a sorted array."""
    if not len(group):
        return np.zeros(0, np.int64)
    first = np.concatenate([[True], group[1:] != group[:-1]])
    at = np.arange(len(group))
    return at - np.maximum.accumulate(np.where(first, at, 0)) + 1


def _counted(words: Words, doc: np.ndarray, t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """`doc, word, t, c` once per document and word, in order."""
    n = max(len(words.words), 1)
    pair, at = np.unique(doc * n + words.at, return_inverse=True)
    sums = [np.bincount(at, x, len(pair)).astype(np.int64) for x in (t, c)]
    return pair // n, pair % n, *sums


def _documents(batches: Iterator[pa.RecordBatch], key: Sequence[str], ranker: Ranker, names: list[str]) -> Iterator[pa.RecordBatch]:
    ranker.start()
    held, left = None, 0  # the document that the last batch did not end, and how many of its rows are to come
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        rows = batch.column("_rows").to_numpy(zero_copy_only=False)
        first = np.zeros(n, dtype=np.int64)
        at = left
        while at < n:
            first[at] = 1
            at += int(rows[at])
        left = at - n
        doc = np.cumsum(first) - (held is None)
        keys = pa.Table.from_batches([batch.select(list(key))]).filter(pa.array(first.astype(bool)))
        lists = batch.column("_words")
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        t = (place < batch.column("_tokens").fill_null(0).to_numpy(zero_copy_only=False)[row]).astype(np.int64)
        flat, doc, c = lists.flatten(), doc[row], 1 - t
        if flat.null_count:
            some = flat.is_valid().to_numpy(zero_copy_only=False)
            flat, doc, t, c = flat.drop_null(), doc[some], t[some], c[some]
        if held is not None:
            keys = pa.concat_tables([held[0], keys])
            flat = pa.concat_arrays([held[1], flat])
            doc = np.concatenate([np.zeros(len(held[1]), np.int64), doc])
            t, c = np.concatenate([held[2], t]), np.concatenate([held[3], c])
            held = None
        words = Words(flat)
        doc, word, t, c = _counted(words, doc, t, c)
        if left:
            last = doc == keys.num_rows - 1
            held = keys.slice(keys.num_rows - 1), words.words.take(pa.array(word[last])), t[last], c[last]
            doc, word, t, c = doc[~last], word[~last], t[~last], c[~last]
        if len(doc):
            places, columns = ranker.work(words, doc, word, t, c)
            yield from pa.Table.from_arrays(
                [*keys.take(pa.array(places)).columns, *columns], names=names
            ).combine_chunks().to_batches()


def _in_tasks(docs: DataFrame, key: Sequence[str], ranker: Ranker, fields: str) -> DataFrame:
    clash = set(OWN) & set(key)
    if clash:
        raise ValueError(f"keys must not be called {sorted(clash)}")
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[k] for k in key], *T.StructType.fromDDL(fields).fields])
    names = schema.fieldNames()
    own = docs.dropna(subset=list(key)).select(*key, "text", "words")
    same = own.withColumn("_rows", F.count(F.lit(1)).over(W.partitionBy(*key)))  # rows of a document follow each other
    tokens = tx.tokens(F.col("text"))
    listed = same.select(*key, "_rows", tokens.alias("_t"), "words").select(
        *key, "_rows", F.concat("_t", "words").alias("_words"), F.size("_t").alias("_tokens")
    )
    return listed.mapInArrow(lambda batches: _documents(batches, key, ranker, names), schema)


def keywords(docs: DataFrame, key: Sequence[str], model, weighted: bool) -> DataFrame:
    """`keywords.extract`, or `keywords.weighted_keywords`."""
    return _in_tasks(docs, key, Ranker(model, weighted, False), KEYWORDS)


def scores(docs: DataFrame, key: Sequence[str], model) -> DataFrame:
    """`keywords.topic_scores` of the weighted keywords."""
    return _in_tasks(docs, key, Ranker(model, True, True), SCORES)
