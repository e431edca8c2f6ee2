"""Text to vector: providers, and the lookup that embeds each distinct text once.

No language model ships with this library. Vectors come from a supplied table, from hashing, from
Word2Vec fitted on the corpus, or from any Python model run in Arrow batches on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspan.functions import text as tx
from talkspan.functions import vectors as vx
from talkspan.operators import skipgram as sg
from talkspan.operators.checkpoints import bounded_batches, written

VECTOR_TYPE = "array<bigint>"


class EmbeddingProvider(Protocol):
    """What a provider has to offer. `vectors` maps `text_hash, text` to `text_hash, vec`."""

    dim: int
    additive: bool

    def vectors(self, texts: DataFrame) -> DataFrame: ...


def trigrams(word: Column) -> Column:
    """Character trigrams of a word with `#` at both ends."""
    padded = F.concat(F.lit("#"), word, F.lit("#"))
    return F.transform(
        F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))
    )


def hashed_words(words: DataFrame, dim: int) -> DataFrame:
    """`word, vec` of distinct words by signed trigram hashing: the md5 of each trigram picks a
    dimension and a sign. The sums stay on the partitioning that made the words distinct."""
    grams = words.select("word", F.explode(trigrams(F.col("word"))).alias("gram"))
    code = F.conv(F.substring(F.md5("gram"), 1, 8), 16, 10).cast("bigint")
    sign = F.when(F.floor(F.col("code") / dim) % 2 == 0, F.lit(vx.SCALE)).otherwise(F.lit(-vx.SCALE))
    placed = grams.withColumn("code", code).select(
        "word", (F.col("code") % dim).alias("d"), sign.cast("bigint").alias("s")
    )
    none = F.lit(0).cast("bigint")
    return placed.groupBy("word").agg(
        F.array(*[F.sum(F.when(F.col("d") == i, F.col("s")).otherwise(none)) for i in range(dim)]).alias("vec")
    )


def word_vectors(words: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """`word, vec` for distinct words (`word`), through the provider's text interface."""
    keyed = words.select("word").distinct().withColumn("text_hash", tx.text_key(F.col("word")))
    vecs = provider.vectors(keyed.select("text_hash", F.col("word").alias("text")))
    return keyed.join(vecs, "text_hash").select("word", "vec")


class _HashedWords:
    """`hashed_words` inside a task. It remembers the trigrams it has met, up to `KEPT`."""

    KEPT = 100_000
    AT_ONCE = 32_768  # words

    def __init__(self, dim: int) -> None:
        self.dim = dim
        self.grams: dict[int, tuple[int, int]] = {}

    def _place(self, gram: int) -> tuple[int, int]:
        """Dimension and value of a trigram, given as three times 21 bits."""
        found = self.grams.get(gram)
        if found is None:
            letters = "".join(chr(gram >> shift & 0x1FFFFF) for shift in (42, 21, 0))
            code = int(hashlib.md5(letters.encode()).hexdigest()[:8], 16)
            found = code % self.dim, vx.SCALE if code // self.dim % 2 == 0 else -vx.SCALE
            if len(self.grams) >= self.KEPT:
                self.grams.clear()
            self.grams[gram] = found
        return found

    def vectors(self, words: list[str]) -> np.ndarray:
        """One row per word. Each distinct trigram of some words is looked up once."""
        out = np.zeros((len(words), self.dim), dtype=np.int64)
        for i in range(0, len(words), self.AT_ONCE):
            some = words[i : i + self.AT_ONCE]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            letters = np.frombuffer(f"#{'##'.join(some)}#".encode("utf-32-le"), "<u4").astype(np.int64)
            word = np.repeat(np.arange(len(some)), lengths)
            at = np.arange(len(word)) + 2 * word  # a word has as many trigrams as letters, and two signs around it
            grams, which = np.unique(letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2], return_inverse=True)
            placed = np.array([self._place(g) for g in grams.tolist()], np.int64).reshape(-1, 2)[which]
            sums = np.bincount(word * self.dim + placed[:, 0], placed[:, 1], len(some) * self.dim)  # exact: whole numbers
            out[i : i + len(some)] = sums.reshape(-1, self.dim).astype(np.int64)
        return out

    def sums(self, tokens: pa.ListArray) -> np.ndarray:
        """One vector per list of words. Dimensions are summed one by one, so a batch needs one number per word at a time."""
        out = np.zeros((len(tokens), self.dim), dtype=np.int64)
        lengths = tokens.value_lengths().to_numpy(zero_copy_only=False)
        coded = tokens.flatten().dictionary_encode()
        if not len(coded):
            return out
        words = self.vectors(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy(zero_copy_only=False)
        some = np.flatnonzero(lengths)
        starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]]).astype(np.int64)
        for d in range(self.dim):
            out[some, d] = np.add.reduceat(words[at, d], starts)
        return out


class HashProvider:
    """Vector of a text = sum of the hashed vectors of its tokens. Additive, deterministic."""

    additive = True

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def vectors(self, texts: DataFrame) -> DataFrame:
        """One row per row, where the texts are: a task hashes each word it meets, and neither words nor texts move."""
        dim = self.dim

        @F.arrow_udf(returnType=VECTOR_TYPE)
        def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            words = _HashedWords(dim)
            for tokens in batches:
                sums = words.sums(tokens)
                offsets = np.arange(0, sums.size + 1, dim, dtype=np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(sums.ravel()))

        bounded_batches(texts.sparkSession)
        return texts.select("text_hash", hashed(tx.tokens(F.col("text"))).alias("vec"))

    def lexicon(self, counts: DataFrame) -> DataFrame:
        """`word, vec` of the distinct words of a count table."""
        return hashed_words(counts.select("word").distinct(), self.dim)

    def word_encoder(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        """What a task needs to work out vectors of words by itself: `start()` returns the function from words to one
        fixed-point row each."""
        dim = self.dim

        def start() -> Callable[[list[str]], np.ndarray]:
            return _HashedWords(dim).vectors

        return start


def token_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """`key, word, n` over all tokens of each text."""
    long = texts.select(key, F.explode(tx.tokens(F.col(text))).alias("word"))
    return long.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def sum_word_vectors(counts: DataFrame, lexicon: DataFrame, key: Sequence[str], dim: int) -> DataFrame:
    """Text vectors from word counts. A word has one row per text, so even the most common word is
    spread over its texts; adaptive skew handling splits it, and small lexicons are broadcast."""
    return (
        counts.join(lexicon, "word")
        .groupBy(*key)
        .agg(vx.sum_vectors(F.col("vec"), dim, F.col("n")).alias("vec"))
    )


class TableProvider:
    """Precomputed vectors `text, vec`. Texts that are not in the table get no row."""

    additive = False

    def __init__(self, table: DataFrame, dim: int) -> None:
        self.dim = dim
        self.table = table.select(tx.text_key(F.col("text")).alias("text_hash"), "vec")

    def vectors(self, texts: DataFrame) -> DataFrame:
        return texts.select("text_hash").join(self.table, "text_hash")


class Word2VecProvider:
    """Text vector = sum of Word2Vec vectors of its cleaned words; fitted on a corpus of `words`.

    Training runs on `partitions` parts of the corpus and averages them, so the vectors depend on that number: it is a
    parameter and not the size of the cluster. Spark ML trains up to `DRIVER_WORDS` words, which its driver holds; more
    words are trained by `skipgram`, in more parts if those get large, and stay spread.
    """

    additive = True
    DRIVER_WORDS = 100_000

    def __init__(
        self, corpus: DataFrame, dim: int = 32, min_count: int = 1, seed: int = 7, partitions: int = 8
    ) -> None:
        from pyspark.ml.feature import Word2Vec

        self.dim = dim
        self.model = self.learned = None
        counts = sg.word_counts(corpus, min_count)
        if counts.count() > self.DRIVER_WORDS:
            self.learned = sg.fitted(corpus, counts, dim, seed, partitions)
            return
        trainer = Word2Vec(vectorSize=dim, minCount=min_count, seed=seed, maxIter=1, numPartitions=partitions)
        self.model = trainer.setInputCol("words").setOutputCol("v").fit(corpus.select("words"))

    def lexicon(self, counts: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        learned = self.learned
        if learned is None:
            vec = vx.fixed_point(vector_to_array(F.col("vector")))
            learned = self.model.getVectors().select("word", vec.alias("vec"))
        return counts.select("word").distinct().join(learned, "word")

    def vectors(self, texts: DataFrame) -> DataFrame:
        long = texts.select("text_hash", F.explode(tx.clean_words(F.col("text"))).alias("word"))
        counts = long.groupBy("text_hash", "word").agg(F.count(F.lit(1)).alias("n"))
        vecs = sum_word_vectors(counts, self.lexicon(counts), ["text_hash"], self.dim)
        zero = F.array_repeat(F.lit(0).cast("bigint"), self.dim)
        return (
            texts.select("text_hash")
            .join(vecs, "text_hash", "left")
            .select("text_hash", F.coalesce("vec", zero).alias("vec"))
        )


class PandasProvider:
    """Any Python model. `load()` runs once per Python worker and returns `encode(list[str])`,
    which returns one vector per text; it is called with batches of `batch_size` texts."""

    additive = False

    def __init__(
        self, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch_size: int = 64
    ) -> None:
        self.dim = dim
        self.load = load
        self.batch_size = batch_size

    def encoder(self) -> Callable[[], Callable[[list[str]], np.ndarray]]:
        """What a task needs to work vectors out by itself: `start()` loads the model and returns the function from texts
        to fixed-point vectors, which calls the model in batches."""
        load, size, dim = self.load, self.batch_size, self.dim

        def start() -> Callable[[list[str]], np.ndarray]:
            encode = load()

            def run(texts: list[str]) -> np.ndarray:
                parts = [np.asarray(encode(texts[i : i + size]), dtype=np.float64) for i in range(0, len(texts), size)]
                vecs = np.concatenate(parts) if parts else np.zeros((0, dim))
                return np.floor(vecs * vx.SCALE + 0.5).astype(np.int64)

            return run

        return start

    def column(self, text: Column) -> Column:
        """The vectors of texts where they are; equal texts of an Arrow batch are shown to the model once."""
        start = self.encoder()

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            encode = start()
            for batch in batches:
                texts = batch.to_pylist()
                known = list(dict.fromkeys(t for t in texts if t is not None))
                vecs = dict(zip(known, encode(known)))
                yield pa.array([None if t is None else vecs[t] for t in texts], pa.list_(pa.int64()))

        return F.arrow_udf(run, VECTOR_TYPE)(text)

    def vectors(self, texts: DataFrame) -> DataFrame:
        start, size = self.encoder(), self.batch_size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            encode = start()
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    whole = encode(part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("text_hash"), pa.array(list(whole), pa.list_(pa.int64()))],
                        names=["text_hash", "vec"],
                    )

        return texts.select("text_hash", "text").mapInArrow(
            run, f"text_hash string, vec {VECTOR_TYPE}"
        )


class StoredProvider:
    """A provider behind a vector table: known texts and words are looked up, only the rest goes through `provider` and
    is then added to the table under `model`, with `at` as its time.

    `model` has to name everything the vectors depend on (for Word2Vec the fit too). Texts and words are kinds of their
    own, since the vector of a one-letter text need not be that of a word. Each call is two small writes and a lookup,
    at once and not lazily; `asked` and `found` count the distinct keys of all calls.
    """

    def __init__(self, provider: EmbeddingProvider, table, model: str, at: str) -> None:
        self.provider, self.table, self.model, self.at = provider, table, model, at
        self.dim, self.additive = provider.dim, provider.additive
        self.asked = self.found = 0

    def vectors(self, texts: DataFrame) -> DataFrame:
        known = self._answered(texts.select("text_hash", "text"), self.provider.vectors, "text")
        return known.select("text_hash", "vec")

    def lexicon(self, counts: DataFrame) -> DataFrame:
        """`word, vec` of the distinct words of a count table."""
        words = counts.select("word").distinct()
        keys = words.select(tx.text_key(F.col("word")).alias("text_hash"), F.col("word").alias("text"))

        def work(missing: DataFrame) -> DataFrame:
            named = missing.select(F.col("text").alias("word"))
            if hasattr(self.provider, "lexicon"):
                fresh = self.provider.lexicon(named)
            else:
                fresh = word_vectors(named, self.provider)
            return fresh.select(tx.text_key(F.col("word")).alias("text_hash"), "vec")

        return self._answered(keys, work, "word").select(F.col("text").alias("word"), "vec")

    def _answered(self, keys: DataFrame, work: Callable[[DataFrame], DataFrame], kind: str) -> DataFrame:
        keys = written(keys.dropDuplicates(["text_hash"]), "keys")
        known = written(self.table.lookup(keys, self.model, kind).select("text_hash", "text", "vec"), "known")
        missing = keys.join(known, "text_hash", "left_anti")
        fresh = written(missing.join(work(missing), "text_hash").select("text_hash", "text", "vec"), "fresh")
        self.asked += keys.count()
        self.found += known.count()
        if not fresh.isEmpty():
            self.table.append(fresh, self.model, self.at, kind)
        return known.unionByName(fresh)


PROVIDERS: dict[str, Callable[..., EmbeddingProvider]] = {
    "hash": HashProvider,
    "table": TableProvider,
    "word2vec": Word2VecProvider,
    "pandas": PandasProvider,
}


def make_provider(name: str, **options) -> EmbeddingProvider:
    if name not in PROVIDERS:
        raise ValueError(f"unknown embedding provider {name!r}, expected one of {sorted(PROVIDERS)}")
    return PROVIDERS[name](**options)


def distinct_keys(texts: DataFrame, text: str = "text") -> DataFrame:
    """Each distinct text once, with its hash."""
    return texts.select(tx.text_key(F.col(text)).alias("text_hash"), F.col(text).alias("text")).dropDuplicates(
        ["text_hash"]
    )


def embed_texts(
    texts: DataFrame, provider: EmbeddingProvider, store: DataFrame | None = None
) -> DataFrame:
    """`text_hash, text, vec, stored` for the distinct texts: stored vectors are looked up, only the
    rest goes through the provider."""
    keys = distinct_keys(texts)
    if store is None:
        fresh = provider.vectors(keys)
        return keys.join(fresh, "text_hash").select(
            "text_hash", "text", "vec", F.lit(False).alias("stored")
        )
    known = keys.join(store.select("text_hash", "vec"), "text_hash").select(
        "text_hash", "text", "vec", F.lit(True).alias("stored")
    )
    missing = keys.join(store.select("text_hash"), "text_hash", "left_anti")
    fresh = missing.join(provider.vectors(missing), "text_hash").select(
        "text_hash", "text", "vec", F.lit(False).alias("stored")
    )
    return known.unionByName(fresh)


def hit_rate(embedded: DataFrame) -> DataFrame:
    """Share of distinct texts found in the store."""
    hits = F.sum(F.col("stored").cast("int"))
    return embedded.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.coalesce(hits, F.lit(0)).cast("long").alias("hits"),
        F.coalesce(hits / F.count(F.lit(1)), F.lit(0.0)).alias("hit_rate"),
    )


def embed_topics(topics: DataFrame, provider: EmbeddingProvider, store: DataFrame | None = None) -> DataFrame:
    """`topic_idx, name, vec` for topic names."""
    vecs = embed_texts(topics.select(F.col("name").alias("text")), provider, store)
    return topics.join(vecs.select(F.col("text").alias("name"), "vec"), "name").select(
        "topic_idx", "name", "vec"
    )


def unknown_topics(topics: DataFrame, store: DataFrame) -> DataFrame:
    """Topics without a stored vector; empty when all are known."""
    return topics.select("name").join(store.select("name"), "name", "left_anti")


def text_similarity(pairs: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """Cosine of two texts per row (`left`, `right`), case-folded."""
    lowered = pairs.withColumn("l", F.lower("left")).withColumn("r", F.lower("right"))
    texts = lowered.select(F.col("l").alias("text")).unionByName(lowered.select(F.col("r").alias("text")))
    vecs = embed_texts(texts, provider).select("text_hash", "vec")
    keyed = lowered.select(*pairs.columns, tx.text_key(F.col("l")).alias("lh"), tx.text_key(F.col("r")).alias("rh"))
    return (
        keyed.join(vecs.select(F.col("text_hash").alias("lh"), F.col("vec").alias("lv")), "lh", "left")
        .join(vecs.select(F.col("text_hash").alias("rh"), F.col("vec").alias("rv")), "rh", "left")
        .select(*pairs.columns, vx.cosine(F.col("lv"), F.col("rv")).alias("similarity"))
    )
