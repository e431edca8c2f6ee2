"""Packing of documents into sequences by dynamic programming over cuts, in document order.

The token ids of documents, each with its end id, stand behind each other in ascending (`doc_id`, input position) order.
A sequence is a window of that stream of at most `size` ids; where windows meet is a cut. A window is padded to `size`
unless its length is a power of two (of those only `least` and more are sought, else there would be many short windows). A cut costs nothing behind a document, `sentence` behind a sentence and `hard` elsewhere,
in ids of padding; each window costs `window`. Cuts may stand behind documents and sentences, and in stretches of more than
`stride` ids without either every `stride` ids. The cheapest windows are found from left to right: of the cuts that lie at most
`size` ids back, a monotone queue holds those that can still be the best, so each cut enters and leaves it once; windows of
a power of two ids are tried beside it.

Documents are ranged by (`doc_id`, position) over tasks, and each task packs its own range, so the last window of a range is
all that a cut of ranges costs. Within a task cuts are final where the cheapest ways to all open cuts agree, and the ids before
them leave; so a task holds `CHUNK` ids and one block of texts, about. Every piece (the part of a document in a window) is written
with its ids as ORC, with the row index and Bloom filter on `doc_id` of `token_files`.

Defined results: null and empty texts have only the end id; a null `doc_id` comes first; rows with equal `doc_id` follow each
other in input order and are packed each; an empty table has no pieces. Other input columns are not written. Ids of
documents are whole numbers.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar
from talkspan.llm import pretokens as pt
from talkspan.llm import token_files as tf

#: Ids that are collected before cuts are worked out; and how many may wait for cuts to become final.
CHUNK, MOST_OPEN = 1 << 18, 1 << 22
#: Bits of a sequence's number within the range of its task.
_NUMBER_BITS = 32

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


@dataclass(frozen=True)
class Prices:
    """Lengths in ids, prices in ids of padding."""

    size: int = 1024
    sentence: int = 4
    hard: int = 16
    window: int = 1
    stride: int = 32
    least: int = 64

    def padding(self, length: int) -> int:
        return 0 if length & (length - 1) == 0 else self.size - length


def sentence_ends(path: str) -> np.ndarray:
    """For each id of a byte-level vocabulary whether a sentence can end behind it: `.`, `!`, `?` or a line end."""
    vocab = pt.check_settings(path)["model"]["vocab"]
    back = {c: bytes([b]) for b, c in pt.byte_letters().items()}
    out = np.zeros(max(vocab.values()) + 2, bool)
    for token, i in vocab.items():
        raw = b"".join(back[c] for c in token)
        out[i] = raw.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in raw
    return out


class Windows:
    """The cheapest windows of a stream of cuts, found from left to right."""

    def __init__(self, prices: Prices):
        self.prices = prices
        self.at = [0]  # the cut that is final last, then the open ones
        self.cost = [0]
        self.back = [0]
        self._keys, self._cuts, self._head = [0], [0], 0  # the queue: cost + place, rising from the head, and the cut

    def extend(self, places: np.ndarray, prices: np.ndarray) -> None:
        """Adds cuts; consecutive places lie at most `size` apart."""
        n, size, window = len(self.at), self.prices.size, self.prices.window
        shift = max(0, n - size - 1)
        known = np.concatenate([np.array(self.at[shift:], np.int64), places])
        exact: list = [()] * len(places)
        length = self.prices.least
        while length < size:
            spot = np.minimum(np.searchsorted(known, places - length), len(known) - 1)
            found = np.flatnonzero(known[spot] == places - length)
            for j, i in zip(found.tolist(), (spot[found] + shift).tolist()):
                exact[j] = (*exact[j], i)
            length *= 2
        places = places.tolist()
        at, cost, back, keys, cuts, head = self.at, self.cost, self.back, self._keys, self._cuts, self._head
        at.extend(places)
        for place, price, others in zip(places, prices.tolist(), exact):
            far = place - size
            while at[cuts[head]] < far:
                head += 1
            best, source = keys[head] - far, cuts[head]
            for i in others:
                if cost[i] < best:
                    best, source = cost[i], i
            best += price + window
            cost.append(best)
            back.append(source)
            best += place
            while keys and keys[-1] >= best:  # those before the head are smaller than those behind it
                keys.pop()
                cuts.pop()
            if len(keys) < head:
                head = len(keys)
            keys.append(best)
            cuts.append(n)
            n += 1
        self._head = head

    def final(self, last: bool = False, force: bool = False) -> list[int]:
        """Ends of the windows that no later cut can change (all with `last`); they leave."""
        end = len(self.at) - 1
        if not last:
            live = [i for i in range(max(0, end - self.prices.size), end + 1) if self.at[i] > self.at[end] - self.prices.size]
            if force:
                live = [min(live, key=lambda i: (self.cost[i], -i))]
            heap = [-i for i in live]
            while len(heap) > 1:
                i = -heapq.heappop(heap)
                if -heap[0] != i:
                    heapq.heappush(heap, -self.back[i])
            end = -heap[0]
            if force and end == live[0]:
                end = self.back[end]
        ends, i = [], end
        while i:
            ends.append(self.at[i])
            i = self.back[i]
        if end:
            base = self.cost[end]
            queue = [(k - base, i - end) for k, i in zip(self._keys[self._head :], self._cuts[self._head :]) if i >= end]
            self._keys, self._cuts, self._head = [k for k, _ in queue], [i for _, i in queue], 0
            self.at, self.cost = self.at[end:], [c - base for c in self.cost[end:]]
            self.back = [0] + [max(0, i - end) for i in self.back[end + 1 :]]
        return ends[::-1]


class Packer:
    """Packs one stream of documents; `add` and `close` give the pieces that are final."""

    def __init__(self, prices: Prices, ends_sentence: np.ndarray, chunk: int = CHUNK, most_open: int = MOST_OPEN):
        self.prices, self._ends_sentence = prices, ends_sentence
        self._windows = Windows(prices)
        self._chunk, self._most_open = chunk, most_open
        self._ids = np.zeros(0, np.int32)  # from the last final cut on
        self._begin = 0  # its place in the stream
        self._seen = 0  # up to where cuts are known
        self._waiting: list[np.ndarray] = []
        self._wait_ids = 0
        self._docs: list[tuple[np.ndarray, np.ndarray]] = []  # ids and lengths of documents that wait
        self._doc_ids = np.zeros(0, object)
        self._doc_at = np.zeros(0, np.int64)
        self._doc_n = np.zeros(0, np.int64)
        self._n_sequences = 0

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[dict]:
        self._waiting.append(ids)
        self._wait_ids += len(ids)
        self._docs.append((doc_ids, sizes))
        if self._wait_ids >= self._chunk:
            self._take()
            yield from self._cut()

    def close(self) -> Iterator[dict]:
        self._take()
        yield from self._cut(last=True)

    def _take(self) -> None:
        """What waits joins the open ids, and its cuts are added."""
        if not self._docs:
            return
        ids = np.concatenate(self._waiting)
        sizes = np.concatenate([s for _, s in self._docs])
        ends = self._seen + np.cumsum(sizes)
        self._doc_ids = np.concatenate([self._doc_ids, *(d for d, _ in self._docs)])
        self._doc_at = np.concatenate([self._doc_at, ends - sizes])
        self._doc_n = np.concatenate([self._doc_n, sizes])
        kind = np.full(len(ids), 3, np.int8)  # 0 behind a document, 1 behind a sentence
        closing = self._ends_sentence[ids]
        closing[:-1] &= ~closing[1:]  # of several in a row the last
        kind[closing] = 1
        kind[ends - self._seen - 1] = 0
        spots = np.flatnonzero(kind < 3)  # the last id ends a document, so it is one of them
        gaps = np.diff(np.concatenate([[-1], spots]))
        wide = np.flatnonzero(gaps > self.prices.stride)
        if len(wide):
            more = (gaps[wide] - 1) // self.prices.stride
            first = np.repeat(np.concatenate([[-1], spots])[wide], more)
            step = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
            hard = first + step * self.prices.stride
            kind[hard] = 2
            spots = np.flatnonzero(kind < 3)
        price = np.array([0, self.prices.sentence, self.prices.hard])[kind[spots]]
        self._windows.extend(self._seen + spots + 1, price)
        self._seen += len(ids)
        self._ids = np.concatenate([self._ids, ids])
        self._waiting, self._wait_ids, self._docs = [], 0, []

    def _cut(self, last: bool = False) -> Iterator[dict]:
        ends = np.array(self._windows.final(last, len(self._ids) > self._most_open), np.int64)
        if not len(ends):
            return
        starts = np.concatenate([[self._begin], ends[:-1]])
        stop = ends[-1]
        inside = self._doc_at[(self._doc_at > self._begin) & (self._doc_at < stop)]
        piece = np.union1d(starts, inside)
        sizes = np.diff(np.append(piece, stop))
        doc = np.searchsorted(self._doc_at, piece, "right") - 1
        number = np.searchsorted(starts, piece, "right") - 1
        yield {
            "doc_id": self._doc_ids[doc], "start": piece - self._doc_at[doc], "ids": self._ids[: stop - self._begin], "sizes": sizes,
            "doc_tokens": self._doc_n[doc], "sequence": self._n_sequences + number, "offset": piece - starts[number],
        }
        self._n_sequences += len(ends)
        self._ids = self._ids[stop - self._begin :].copy()
        self._begin = int(stop)
        keep = max(0, int(np.searchsorted(self._doc_at, stop, "right")) - 1)
        self._doc_ids, self._doc_at, self._doc_n = self._doc_ids[keep:], self._doc_at[keep:], self._doc_n[keep:]


_ENDS: dict[str, np.ndarray] = {}


def write(docs: DataFrame, path: str, vocabulary: str, prices: Prices = Prices(), text: str = "text",
          end_id: int = tf.END_ID) -> None:
    """Writes the pieces of all documents as ORC files below `path`."""
    ranged = tf.ranged(docs, text)

    def batches_of(made: dict, arrow: pa.Schema, file_no: int) -> pa.RecordBatch:
        lists = ar.list_array(pa.array(made["ids"], pa.int32()), made["sizes"])
        numbers = (file_no << _NUMBER_BITS) + made["sequence"]
        columns = [pa.array(made["doc_id"], pa.int64()), pa.array(made["start"]), lists, pa.array(made["doc_tokens"]),
                   pa.array(numbers), pa.array(made["offset"])]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, file_no = to_arrow_schema(PIECES), TaskContext.get().partitionId()
        if vocabulary not in _ENDS:
            _ENDS[vocabulary] = sentence_ends(vocabulary)
        packer = Packer(prices, _ENDS[vocabulary])
        for batch in batches:
            for part in ar.slices(batch, "text"):
                ids = tf.with_end(tf.LibraryCodec.of(vocabulary).encode(ar.texts_of(part, "text")), end_id)
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                names = np.array(part.column(0).to_pylist(), object)
                for made in packer.add(names, ids.values.to_numpy(False), sizes):
                    yield batches_of(made, arrow, file_no)
        for made in packer.close():
            yield batches_of(made, arrow, file_no)

    ar.bounded_batches(docs.sparkSession)
    ranged.mapInArrow(run, PIECES).write.options(**tf.ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The pieces: `doc_id, start, ids, doc_tokens, sequence_id, offset`; sequence numbers rise with the documents."""
    return spark.read.schema(PIECES).orc(path)


def measured(pieces: DataFrame) -> DataFrame:
    """The pieces with `length` and `ids_crc32` (of the little-endian 32-bit form) instead of their ids."""
    fields = [T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]

    def kernel(batch: pa.RecordBatch) -> dict:
        ids = batch.column(batch.schema.get_field_index("ids"))
        at = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(False).astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
        return {"length": np.diff(at).astype(np.int64), "ids_crc32": np.array(sums, np.int64)}

    return ar.arrow_map(pieces, kernel, fields, [f.name for f in PIECES if f.name != "ids"], None)


def padding(measured_pieces: DataFrame, prices: Prices = Prices()) -> DataFrame:
    """One row: `n_sequences, n_ids, n_padding, n_document_cuts` of measured pieces."""
    whole = measured_pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n"), F.count_if(F.col("start") > 0).alias("cuts"))
    short = F.when(F.bit_count("n") == 1, 0).otherwise(prices.size - F.col("n"))
    return whole.agg(F.count(F.lit(1)).alias("n_sequences"), F.sum("n").alias("n_ids"), F.sum(short).alias("n_padding"),
                     F.sum("cuts").alias("n_document_cuts"))
