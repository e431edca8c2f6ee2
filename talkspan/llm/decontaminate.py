"""Benchmark decontamination: a broadcast set of test n-grams, scanned over training token windows.

Texts are lower-cased (A-Z) and cut into words of digits, letters and all characters outside ASCII. Every run of
`width` words of a benchmark item is a window; an item of fewer words, but not none, is one window. The windows are
numbered by a hash; each training window is looked up by its hash, and a hit is verified word for word before it counts.

The windows of a benchmark go to the executors in parts of at most `PART_WINDOWS` windows (their number is counted
first), one scan of the texts per part, so that what is broadcast is bounded whatever the size of the benchmark. The
scans follow each other within one stage, and each adds its hits to the row; nothing is shuffled.

Defined results: null and empty texts have no words and no hits; items without words are not searched for; equal rows
get equal results; items with the same `item_id` count once, an item without one goes by the empty id. Input columns that
carry the name of a result column are replaced.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar

WIDTH = 10
#: Windows in one broadcast part: 30 to 60 MB in a task for words of usual length.
PART_WINDOWS = 200_000

#: The bytes of words. Every byte of a character outside ASCII is 0x80 or more.
_WORD = ar.byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_VALUES = ar.value_table()[_LOWER]
_BITS = 20


def lower_words(text: str | None) -> list[str]:
    """The words of one text."""
    block = ar.block_of(pa.array([text or ""]))
    starts, ends = ar.runs(_WORD[block.data])
    data = _LOWER[block.data].tobytes()
    return [data[a:b].decode() for a, b in zip(starts, ends)]


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """`item_id, key`: the windows of all items, as their words joined by a blank, in native expressions."""
    lower = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.expr(r"regexp_extract_all(lowered, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")
    items = benchmark.select("item_id", lower.alias("lowered")).select("item_id", words.alias("words"))
    items = items.where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    at = items.select("item_id", "words", F.explode(starts).alias("i"))
    key = F.array_join(F.slice("words", F.col("i"), width), " ")
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return at.select(item.alias("item_id"), key.alias("key")).distinct()


class WindowSet:
    """The windows of one part, by hash for the scan and by their words for verifying."""

    _kept: dict[str, WindowSet] = {}

    @classmethod
    def of(cls, name: str, rows) -> WindowSet:
        """The set made of a broadcast value; a worker keeps the last one."""
        if name not in cls._kept:
            cls._kept.clear()
            cls._kept[name] = cls(rows.value)
        return cls._kept[name]

    def __init__(self, rows: list[tuple[str, str]]):
        items: dict[str, list[str]] = {}
        for item, key in rows:
            items.setdefault(key, []).append(item)
        self.numbers = {key: i for i, key in enumerate(items)}
        self.items = [sorted(set(x)) for x in items.values()]
        by_width: dict[int, list[np.ndarray]] = {}
        for at in range(0, len(items), 10_000):
            keys = list(self.numbers)[at : at + 10_000]
            block = ar.block_of(pa.array(keys))
            words, owner, _, _ = scan_words(block)
            first = np.searchsorted(owner, np.arange(len(keys)))
            count = np.bincount(owner, minlength=len(keys))
            for width in np.unique(count):
                hashes = ar.window_hashes(words, int(width))
                by_width.setdefault(int(width), []).append(hashes[first[count == width]])
        self.hashes = {w: np.unique(np.concatenate(h)) for w, h in by_width.items()}
        self.filters = {}
        for w, h in self.hashes.items():
            table = np.zeros(1 << _BITS, bool)
            table[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.filters[w] = table


def scan_words(block: ar.Block):
    """Word hashes, the text of each word, and where words begin and end."""
    starts, ends = ar.runs(_WORD[block.data])
    return ar.span_hashes(_VALUES, block.data, starts, ends), block.owner(starts), starts, ends


def find(block: ar.Block, known: WindowSet):
    """Verified hits: text, first word and width of each, and the number of its window; also the words scanned."""
    words, owner, starts, ends = scan_words(block)
    texts, firsts, widths, numbers = [], [], [], []
    for width, hashes in known.hashes.items():
        seen = ar.window_hashes(words, width)
        maybe = np.flatnonzero(known.filters[width][(seen >> np.uint64(64 - _BITS)).astype(np.int64)])
        maybe = maybe[owner[maybe] == owner[maybe + width - 1]]
        place = np.minimum(np.searchsorted(hashes, seen[maybe]), len(hashes) - 1)
        maybe = maybe[hashes[place] == seen[maybe]]
        for i in maybe:
            key = b" ".join(_LOWER[block.data[starts[k] : ends[k]]].tobytes() for k in range(i, i + width)).decode()
            number = known.numbers.get(key)
            if number is not None:
                texts.append(owner[i])
                firsts.append(i)
                widths.append(width)
                numbers.append(number)
    as_longs = [np.array(x, np.int64) for x in (texts, firsts, widths, numbers)]
    return (*as_longs, owner, starts, ends)


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def measure(block: ar.Block, known: WindowSet) -> dict:
    """The result columns: words, runs of hit words (numbers within the text, end exclusive), and the items."""
    texts, firsts, widths, numbers, owner, _, _ = find(block, known)
    n = block.n
    text_word = np.searchsorted(owner, np.arange(n + 1))
    # each text is moved one place further, so that a run of hit words never goes on into the next text
    spread = np.arange(len(owner)) + owner
    hit = ar.covered(len(owner) + n + 1, firsts + texts, firsts + texts + widths)
    a, b = ar.runs(hit)
    first, last = np.searchsorted(spread, a), np.searchsorted(spread, b - 1)
    of = owner[first]
    spans = pa.StructArray.from_arrays(
        [pa.array(first - text_word[of]), pa.array(last + 1 - text_word[of])], ["start", "end"]
    )
    items: list[set] = [set() for _ in range(n)]
    for t, k in zip(texts, numbers):
        items[t].update(known.items[k])
    return {
        "n_words": np.diff(text_word),
        "hit_words": ar.list_array(spans, np.bincount(of, minlength=n)),
        "items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
    }


def _merged(spans):
    """Sorted union of overlapping or touching spans of one text."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joins = (F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= x["start"])
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(
            F.concat(acc, F.array(x))
        )

    return F.aggregate(F.array_sort(spans), F.filter(spans, lambda x: F.lit(False)), step)


def with_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, part_windows: int = PART_WINDOWS,
              text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with `n_words`, `hit_words` (runs of hit words) and the sorted `items` that occur in the text."""
    spark = docs.sparkSession
    names = [f.name for f in FIELDS]
    kept = [c for c in (keep or docs.columns) if c not in names]
    grams = windows(benchmark, width)
    n_parts = max(1, -(-grams.count() // part_windows))
    part = F.pmod(F.xxhash64("key"), F.lit(n_parts))
    out = None
    for k in range(n_parts):
        rows = grams.where(part == k).collect()  # about part_windows rows
        known = spark.sparkContext.broadcast([(r["item_id"], r["key"]) for r in rows])
        last = k == n_parts - 1
        if out is None:
            out = _scan(docs, known, text, kept if last else None, "")
            continue
        found = _scan(out, known, text, [*kept, *names] if last else None, "_part")
        both = {
            "hit_words": _merged(F.concat("hit_words", "hit_words_part")),
            "items": F.array_sort(F.array_union("items", "items_part")),
        }
        out = found.withColumns(both).drop(*(f"{c}_part" for c in names))
    return out.withColumn("n_hit", F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]))


def _scan(docs: DataFrame, known, text: str, keep, suffix: str) -> DataFrame:
    name = uuid.uuid4().hex

    def kernel(batch: pa.RecordBatch) -> dict:
        made = measure(ar.block_of(ar.texts_of(batch, text)), WindowSet.of(name, known))
        return {f"{k}{suffix}": v for k, v in made.items()}

    fields = [T.StructField(f.name + suffix, f.dataType) for f in FIELDS]
    return ar.arrow_map(docs, kernel, fields, keep, text)


def cut_text(text: str, spans: list[dict]) -> str:
    """The text without the given runs of words: from the first letter of a run to the last."""
    data = text.encode()
    starts, ends = ar.runs(_WORD[np.frombuffer(data, np.uint8)])
    parts, at = [], 0
    for s in spans:
        parts.append(data[at : starts[s["start"]]])
        at = ends[s["end"] - 1]
    return b"".join([*parts, data[at:]]).decode()


def without_spans(hits: DataFrame, text: str = "text") -> DataFrame:
    """The result of `with_hits` with the hit words cut out of the text; other texts stay as they are."""

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        spans = batch.column(batch.schema.get_field_index("hit_words")).to_pylist()
        return {text: pa.array([cut_text(t, s) if s else t for t, s in zip(texts, spans)], pa.string())}

    cut = ar.arrow_map(hits, kernel, [T.StructField(text, T.StringType())], text=text)
    return cut.select(*hits.columns)


def without_documents(hits: DataFrame) -> DataFrame:
    """The result of `with_hits` without the documents that have hits."""
    return hits.where(F.size("hit_words") == 0)
