"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are ranged by (`doc_id`, input position) and sorted within each range, so that file k holds the documents
before those of file k + 1. Every row carries the number of its file and how many ids stand before it in that file; with
the totals of the files read back, that gives the place of a document among all ids. Readers take any stripes in
parallel, and a search for document ids skips stripes and row groups by their statistics and Bloom filters.

Texts are encoded by the tokenizers library. Its model is given each distinct pre-token once per worker; ids of texts are
put together from those. Special strings in a text are recognized.

Defined results: null and empty texts have only the end id; a null `doc_id` comes first; rows with equal `doc_id` follow
each other in input order. Other input columns are not written.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar
from talkspan.llm import pretokens as pt
from talkspan.llm import store

END_ID = 0
ORC = {
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(32 << 20),
    "compression": "zstd",
}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("file_no", T.IntegerType()),
    T.StructField("ids_before", T.LongType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())),
])


class LibraryCodec:
    """The tokenizers library behind a lexicon of pre-tokens; one per worker and file."""

    _known: dict[str, LibraryCodec] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.cutter = pt.Cutter(path)
        self.lexicon = pt.Lexicon(self._encode)
        self._library = Tokenizer.from_file(path)
        self._letters = np.array([ord(c) for _, c in sorted(pt.byte_letters().items())], "<u4")

    @classmethod
    def of(cls, path: str) -> LibraryCodec:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """The library's model on each pre-token, written in the letters that stand for its bytes."""
        lengths = ends - starts
        letters = self._letters[pt.gathered(data, starts, lengths)].tobytes().decode("utf-32-le")
        edges = np.concatenate([[0], np.cumsum(lengths)]).tolist()
        tokenize = self._library.model.tokenize
        made = [[t.id for t in tokenize(letters[a:b])] for a, b in zip(edges, edges[1:])]
        sizes = np.fromiter(map(len, made), np.int32, len(made))
        ids = np.fromiter(chain.from_iterable(made), np.int32, int(sizes.sum()))
        return ids, np.cumsum(sizes, dtype=np.int64) - sizes, sizes

    def encode(self, texts: pa.Array) -> pa.ListArray:
        return pt.encoded(texts, self.cutter, self.lexicon)


def with_end(ids: pa.ListArray, end_id: int) -> pa.ListArray:
    sizes = np.diff(ids.offsets.to_numpy())
    flat = np.insert(ids.flatten().to_numpy(False), np.cumsum(sizes), end_id)
    return ar.list_array(pa.array(flat, pa.int32()), sizes + 1)


def ranged(docs: DataFrame, text: str = "text") -> DataFrame:
    """`doc_id, text, position`, ranged and sorted by (`doc_id`, input position)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("position"))
    return rows.repartitionByRange("doc_id", "position").sortWithinPartitions("doc_id", "position")


def write(docs: DataFrame, path: str, vocabulary: str, text: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of all documents as ORC files in ascending `doc_id` order."""
    schema = SCHEMA

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, before, file_no = to_arrow_schema(schema), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in ar.slices(batch, "text"):
                ids = with_end(LibraryCodec.of(vocabulary).encode(ar.texts_of(part, "text")), end_id)
                sizes = np.diff(ids.offsets.to_numpy()).astype(np.int64)
                starts = before + np.cumsum(sizes) - sizes
                before += int(sizes.sum())
                numbers = pa.array(np.full(part.num_rows, file_no, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), numbers, pa.array(starts), ids.cast(arrow.field("ids").type)], schema=arrow
                )

    ar.bounded_batches(docs.sparkSession)
    ranged(docs, text).mapInArrow(run, schema).write.options(**ORC).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a filter on `doc_id` is pushed into stripes and row groups."""
    return spark.read.schema(SCHEMA).orc(path)


def places(rows: DataFrame) -> DataFrame:
    """`doc_id, start, n_tokens, ids_crc32` of rows read back: where the ids of a document begin among all ids, how
    many there are, and the checksum of their little-endian 32-bit form."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]

    def kernel(batch: pa.RecordBatch) -> dict:
        ids = batch.column(batch.schema.get_field_index("ids"))
        at = ids.offsets.to_numpy()
        flat = ids.values.to_numpy(False).astype("<u4", copy=False)
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
        return {"n_tokens": np.diff(at).astype(np.int64), "ids_crc32": np.array(sums, np.int64)}

    narrow = ar.arrow_map(rows, kernel, fields, ["doc_id", "file_no", "ids_before"], None)
    narrow = store.written(narrow, "token-places")
    files = narrow.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    # one row per file
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("files_before"))
    start = (F.col("files_before") + F.col("ids_before")).alias("start")
    return narrow.join(files, "file_no").select("doc_id", start, "n_tokens", "ids_crc32")
