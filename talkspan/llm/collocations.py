r"""Phrase collocations: contiguous phrases that occur far more often than their parts would by chance.

Texts are lower-cased (A-Z) and cut at `.,;:!?` and line ends into pieces, pieces at blanks and tabs into words. All counts
are per language. Phrases of 2 to `max_words` words with at least `min_count` occurrences are candidates; a candidate is
rated at each cut into two parts by floor(1000 * a * n / (l * r)), with `a`, `l`, `r` the occurrences of phrase and parts
and `n` those of all words, and its lowest rating counts. A candidate that a longer one contains as often is dropped.

1. Words are counted; a word's id is a hash of `id_bytes` bytes, as many as keep the ids of frequent words apart from those of
   all other words, which is checked over the whole vocabulary (else everything is hashed anew).
2. Phrases of k words are counted in quotient filters (`quotient.Layout`) for k = 2, 3, ...: each task sums its n-grams into
   filters by language and bucket, buckets meet and their sorted filters are merged. What is moved is one entry per
   different n-gram of a task, ten to thirty bytes, whatever number of times it occurs, so frequent phrases are no hot keys.
3. An n-gram is only counted where both n-grams of one word less are frequent, as a bit filter of at most `FILTER_BITS` bits
   tells tasks; a filter that is too full costs work and no result. Every part of a candidate is frequent, so all counts that
   ratings need are there.
4. Ratings are joins of the frequent phrases with their parts, dealt out by a salt, in whole numbers of 38 digits.

Bounds: a task holds `TASK_CELLS` ids, a bucket about `BUCKET_ENTRIES` n-grams; nothing but bit filters passes the driver.
A task tells words apart by 64-bit hashes.

Defined results: null and empty texts have no words; a null language is `und`; equal rows count each; an empty table and
one without frequent phrases give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar
from talkspan.llm import pretokens as pt
from talkspan.llm import store
from talkspan.llm.quotient import Layout

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
NO_LANGUAGE = "und"
TASK_CELLS = 3 << 20
BUCKET_ENTRIES = 1 << 20
LEAST_BUCKET_BITS = 4
#: The bit filter of frequent n-grams: bits per n-gram, and at most this many address bits (8 MB).
BITS_EACH, FILTER_BITS, LEAST_FILTER_BITS = 32, 26, 13
SALTS = 8
#: Totals of this many languages at most are broadcast.
BROADCAST_LANGUAGES = 10_000

#: Bytes that end a piece, and bytes that end a word.
_BREAK = ar.byte_table((0x0A, 0x0D))
_BREAK[[ord(c) for c in ".,;:!?"]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def scan(texts: pa.Array, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes; and start, end, text, piece and 64-bit key of all words."""
    block = ar.block_of(texts)
    data = _LOWER[block.data]
    starts, ends = ar.runs(_WORD[data])
    piece = np.searchsorted(np.flatnonzero(_BREAK[data]), starts)
    keys = pt.span_keys(data ^ np.uint8(salt * 37 & 0xFF), starts, ends)
    return data, starts, ends, block.owner(starts), piece, keys


def language_hash(name: str) -> np.uint64:
    data = np.frombuffer(name.encode(), np.uint8)
    return pt.span_keys(data, np.zeros(1, np.int64), np.array([len(data)]))[0] if len(data) else np.uint64(1)


def gram_hash(language: np.ndarray, ids: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of a language and some ids."""
    out = language
    with np.errstate(over="ignore"):
        for x in ids:
            out = ar.mixed(out * _ODD + x)
    return out


class _Languages:
    """Small numbers for the languages that a task meets until it passes its counts on."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.names: list[str] = []
        self._numbers: dict[str, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        own = []
        for name in coded.dictionary.to_pylist():
            if name not in self._numbers:
                self._numbers[name] = len(self.names)
                self.names.append(name)
            own.append(self._numbers[name])
        return np.array(own, np.int64)[coded.indices.to_numpy(False)]


def _rows(docs: DataFrame, text: str, language: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(language).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


_VOCABULARY = "lang string, word string, key long, n long"


def vocabulary(rows: DataFrame, salt: int = 0) -> DataFrame:
    """`lang, word, key, n` of all words of `lang, text`: each word's key, and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, held = _Languages(), []

        def summed():
            group, keys, counts, words = (np.concatenate([h[i] for h in held]) for i in range(4))
            with np.errstate(over="ignore"):
                both = ar.mixed(keys + group.astype(np.uint64) * _ODD)
            _, first, back = np.unique(both, return_index=True, return_inverse=True)
            total = np.bincount(back, counts).astype(np.int64)
            names = pa.array(languages.names, pa.string()).take(pa.array(group[first]))
            yield from pa.Table.from_arrays(
                [names, pa.array(words[first], pa.string()), pa.array(keys[first].view(np.int64)), pa.array(total)],
                ["lang", "word", "key", "n"]).to_batches(max_chunksize=1 << 16)
            held.clear()
            languages.clear()

        size = 0
        for batch in batches:
            for part in ar.slices(batch, "text"):
                data, starts, ends, owner, _, keys = scan(part.column(1), salt)
                group = languages.of(part.column(0))[owner]
                with np.errstate(over="ignore"):
                    both = ar.mixed(keys + group.astype(np.uint64) * _ODD)
                _, first, times = np.unique(both, return_index=True, return_counts=True)
                raw = data.tobytes()
                words = np.array([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())], object)
                held.append((group[first], keys[first], times, words))
                size += len(first)
                if size > TASK_CELLS // 4:
                    yield from summed()
                    size = 0
        if held:
            yield from summed()

    ar.bounded_batches(rows.sparkSession)
    found = rows.mapInArrow(run, _VOCABULARY)
    return found.groupBy("lang", "word").agg(F.first("key").alias("key"), F.sum("n").alias("n"))


def _numbered(rows: DataFrame, min_count: int) -> tuple[DataFrame, int, int]:
    """The written vocabulary, the salt of its keys, and the bytes of an id, the top of the key: no frequent word shares its
    id with any other word."""
    for salt in range(8):
        found = store.written(vocabulary(rows, salt), "phrase-words")
        n, frequent = found.agg(F.count(F.lit(1)), F.count_if(F.col("n") >= min_count)).first()
        id_bytes = next((b for b in (4, 5, 6, 7) if 64 * n * frequent < 1 << (8 * b)), 8)
        ids = found.groupBy(_id(id_bytes)).agg(F.min("word").alias("low"), F.max("word").alias("high"), F.max("n").alias("n"))
        if ids.where(f"low != high AND n >= {int(min_count)}").isEmpty():
            return found, salt, id_bytes
    raise RuntimeError("no hash keeps the words apart")


def _id(id_bytes: int):
    return F.shiftrightunsigned("key", 64 - 8 * id_bytes).alias("id")


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A bit for the top bits of each hash in column `h`, as 64-bit words; `2 ** FILTER_BITS` bits at most."""
    n = hashes.count()
    bits = min(FILTER_BITS, max(LEAST_FILTER_BITS, (BITS_EACH * n).bit_length()))
    place = hashes.select(F.shiftrightunsigned("h", 64 - bits).alias("p"))
    word = place.select((F.col("p") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
    found = word.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[found["w"].to_numpy()] = found["b"].to_numpy()
    return out.view(np.uint64)


def hits(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - (len(words).bit_length() + 5))
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


_FILTERS = ("lang string, bucket long, occupied binary, run_ends binary, remainders binary, more binary, counts binary")
_PHRASES = "lang string, ids array<long>, n long, h long"


def count_filters(rows: DataFrame, layout: Layout, salt: int, frequent_words, frequent_parts) -> DataFrame:
    """Filters of the n-grams of `layout.k` words of each task; the bit filters are broadcast values."""
    k, shift = layout.k, np.uint64(64 - layout.bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, held, cells = _Languages(), [], 0

        def passed_on():
            columns = [np.concatenate([h[i] for h in held]) for i in range(k + 1)]
            held.clear()
            group = columns.pop()
            merged = layout.summed(layout.permuted(columns), np.ones(len(group), np.int64), group)
            owner, made = layout.filters(*merged)
            names = pa.array(languages.names, pa.string()).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([names, *made.columns], ["lang", *made.schema.names])
            languages.clear()

        for batch in batches:
            for part in ar.slices(batch, "text"):
                _, _, _, owner, piece, keys = scan(part.column(1), salt)
                n = len(keys) - k + 1
                if n <= 0:
                    continue
                group = languages.of(part.column(0))
                language = np.array([language_hash(x) for x in languages.names], np.uint64)[group][owner]
                ids = keys >> shift
                known = hits(frequent_words.value, gram_hash(language, [ids]))
                whole = piece[:n] == piece[k - 1 :]
                for i in range(k):
                    whole &= known[i : i + n]
                at = np.flatnonzero(whole)
                if k > 2:
                    own = [ids[at + i] for i in range(k)]
                    both = hits(frequent_parts.value, gram_hash(language[at], own[:-1]))
                    at = at[both & hits(frequent_parts.value, gram_hash(language[at], own[1:]))]
                if not len(at):
                    continue
                held.append((*(ids[at + i] for i in range(k)), group[owner[at]].astype(np.uint16)))
                cells += len(at) * k
                if cells > TASK_CELLS or len(languages.names) > 60_000:
                    yield from passed_on()
                    cells = 0
        if held:
            yield from passed_on()

    ar.bounded_batches(rows.sparkSession)
    return rows.mapInArrow(run, _FILTERS)


def merged_counts(filters: DataFrame, layout: Layout, min_count: int) -> DataFrame:
    """`lang, ids, n, h` of the n-grams with at least `min_count` occurrences over all filters; `h` is their hash."""

    def merge(own: pa.Table) -> pa.Table:
        name = own.column("lang")[0].as_py()
        cells, counts = layout.merged(own)
        often = counts >= min_count
        ids = layout.restored([c[often] for c in cells])
        n = int(often.sum())
        h = gram_hash(np.full(n, language_hash(name), np.uint64), ids)
        flat = np.stack(ids, axis=1).astype(np.int64).reshape(-1)
        return pa.table({"lang": pa.array([name] * n, pa.string()), "ids": ar.list_array(pa.array(flat), np.full(n, layout.k)),
                         "n": pa.array(counts[often]), "h": pa.array(h.view(np.int64))})

    return filters.groupBy("lang", "bucket").applyInArrow(merge, _PHRASES)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text: str = "text",
            language: str = "lang") -> tuple[DataFrame, DataFrame]:
    """`lang, ids, n, word` of all frequent words and phrases (`word` of single words only), and `lang, n` of all words."""
    rows = _rows(docs, text, language)
    spark = docs.sparkSession
    known, salt, id_bytes = _numbered(rows, min_count)
    totals = known.groupBy("lang").agg(F.sum("n").alias("n"))
    often = known.where(F.col("n") >= min_count).select("lang", "word", "n", _id(id_bytes))
    out = often.select("lang", F.array("id").alias("ids"), "n", "word")
    n_words = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bucket_bits = max(LEAST_BUCKET_BITS, (int(n_words) // BUCKET_ENTRIES).bit_length())
    words = spark.sparkContext.broadcast(bit_filter(_hashed(often)))
    parts = words
    for k in range(2, max_words + 1):
        layout = Layout(k, id_bytes, bucket_bits)
        found = merged_counts(count_filters(rows, layout, salt, words, parts), layout, min_count)
        found = store.written(found, f"phrases-{k}")
        if found.isEmpty():
            break
        out = out.unionByName(found.select("lang", "ids", "n", F.lit(None).cast("string").alias("word")))
        parts = spark.sparkContext.broadcast(bit_filter(found.select("h")))
    return out, totals


def _hashed(often: DataFrame) -> DataFrame:
    """The hashes of frequent words, as tasks work them out."""

    def kernel(batch: pa.RecordBatch) -> dict:
        language = np.array([language_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
        return {"h": gram_hash(language, [batch.column(1).to_numpy(False).view(np.uint64)]).view(np.int64)}

    return ar.arrow_map(often.select("lang", "id"), kernel, [T.StructField("h", T.LongType())], [], None)


_CUTS = """array_min(zip_with(ls, rs, (x, y) -> struct(
  cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0))
  div (cast(x.n as decimal(19,0)) * cast(y.n as decimal(19,0))) as score, x.at as at, x.n as l, y.n as r)))"""


def rated(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """`lang, phrase, n_words, a, l, r, n, score` of all candidates that no longer one contains as often."""
    size = F.size("ids")
    candidates = counts.where(size > 1).select("lang", "ids", F.col("n").alias("a"))
    # a longer candidate holds a phrase as often as itself only if one of one word more does
    longer = candidates.where(size > 2)
    inner = F.explode(F.array(F.slice("ids", 1, size - 1), F.slice("ids", 2, size - 1))).alias("ids")
    held = longer.select("lang", inner, "a").groupBy("lang", "ids").agg(F.max("a").alias("longer"))
    candidates = candidates.join(held, ["lang", "ids"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True)))
    part = lambda side, at, begin, length: F.struct(
        F.lit(side).alias("side"), at.alias("at"), F.slice("ids", begin, length).alias("part"))
    cuts = F.sequence(F.lit(1), size - 1)
    parts = F.concat(
        F.transform(cuts, lambda j: part("l", j, F.lit(1), j)),
        F.transform(cuts, lambda j: part("r", j, j + 1, size - j)),
        F.transform(F.sequence(F.lit(1), size), lambda i: part("w", i, i, F.lit(1))),
    )
    salt = F.pmod(F.xxhash64("ids"), F.lit(SALTS)).alias("salt")
    asked = candidates.select("lang", "ids", "a", salt, F.explode(parts).alias("p")).select("*", "p.*").drop("p")
    table = counts.select("lang", F.col("ids").alias("part"), "n", "word").select("*", F.explode(
        F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = asked.join(table, ["lang", "part", "salt"])
    listed = lambda side, *cols: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", *cols))))
    whole = met.groupBy("lang", "ids", "a").agg(
        listed("l", "n").alias("ls"), listed("r", "n").alias("rs"), listed("w", "word").alias("ws"))
    few = totals.count() <= BROADCAST_LANGUAGES
    whole = whole.join(F.broadcast(totals) if few else totals, "lang").withColumn("cut", F.expr(_CUTS))
    return whole.select("lang", F.array_join("ws.word", " ").alias("phrase"), F.size("ids").alias("n_words"), "a",
                        "cut.l", "cut.r", "n", "cut.score")


def mined(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, text: str = "text",
          language: str = "lang") -> DataFrame:
    """All collocations of `docs`, as `rated` has them."""
    return rated(*phrases(docs, min_count, max_words, text, language))


def best(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first `top` of each language by score, occurrences and phrase, with `rank` from 1; tasks pass on as many each."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
