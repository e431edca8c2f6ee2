"""Quality rules by repetition inside a text: a suffix array over words and its longest common prefixes.

For every text the suffixes of its word sequence are ranked by prefix doubling, neighbouring suffixes get the length of
their common prefix, and a word position thereby knows the longest string that starts there and occurs elsewhere in the
text. Strings that no longer repeated string contains are the maximal repeats; their union is the covered part. A text
is rejected where that part is too large or the longest repeat too long. Texts without any repeated window of `min_words`
words have no suffix to rank and are passed by the window test alone, which changes no result.

Defined results: a null or empty text has no words, fails the word minimum and is not kept. Equal rows get equal
results. Input columns that carry the name of a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkspan.llm import arrays as ar

#: White space that ends words, and the symbols that are counted.
SPACE = ((0x20, 0x20), (0x09, 0x0D))
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 8
BASE_LEAST = 20
BASE_PERCENT = 30

_WORD = ~ar.byte_table(*SPACE)
_SYMBOL = ar.byte_table(*((b, b) for b in SYMBOLS))
_VALUES = ar.value_table()


@dataclass(frozen=True)
class RepeatRules:
    """Repeats count from `min_words` words on; at most `max_percent` of the words may lie in repeats, and no repeat
    may have more than `max_repeat` words."""

    min_words: int = 5
    max_percent: int = 30
    max_repeat: int = 60


def suffix_ranks(words: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ranks of all suffixes by prefix doubling, each within its text; also the ranks by 1, 2, 4, ... words.

    `words` are numbers that are equal for equal words, `texts` the ascending text numbers. Only suffixes that still
    share their rank are ranked again.
    """
    n = len(words)
    first = np.lexsort((words, texts))
    fresh = np.ones(n, bool)
    fresh[1:] = (words[first][1:] != words[first][:-1]) | (texts[first][1:] != texts[first][:-1])
    rank = np.empty(n, np.int64)
    rank[first] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels, width = [rank], 1
    while True:
        shared = np.bincount(rank, minlength=n)[rank] > 1
        active = np.flatnonzero(shared)
        if not len(active):
            return rank, levels
        beyond = active + width
        same = beyond < n
        same[same] = texts[beyond[same]] == texts[active[same]]
        second = np.where(same, rank[np.minimum(beyond, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[active]))
        group, tail = rank[active][order], second[order]
        begins = np.ones(len(order), bool)
        begins[1:] = group[1:] != group[:-1]
        differs = begins.copy()
        differs[1:] |= tail[1:] != tail[:-1]
        at = np.arange(len(order))
        inside = at - np.maximum.accumulate(np.where(begins, at, 0))
        lead = np.maximum.accumulate(np.where(differs, at, 0))
        rank = rank.copy()
        rank[active[order]] = group + inside[lead]
        levels.append(rank)
        width *= 2


def common_prefixes(levels: list[np.ndarray], texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and, for each neighbour pair in it, the words both suffixes share at their beginning."""
    n = len(texts)
    order = np.argsort(levels[-1], kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(max(n - 1, 0), np.int64)
    open_pairs = texts[left] == texts[right]
    for k in range(len(levels) - 1, -1, -1):
        # equal ranks by 2^k words of one text are equal words only where both have so many left: a shorter
        # suffix has a rank of its own
        inside = open_pairs & (left < n) & (right < n)
        a, b = np.minimum(left, n - 1), np.minimum(right, n - 1)
        equal = inside & (texts[a] == texts[b]) & (levels[k][a] == levels[k][b])
        equal &= texts[a] == texts[order[:-1]]
        step = equal.astype(np.int64) << k
        shared += step
        left += step
        right += step
    return order, shared


def repeat_reach(words: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each word the length of the longest string that starts there and occurs elsewhere in its text."""
    if len(words) < 2:
        return np.zeros(len(words), np.int64)
    _, levels = suffix_ranks(words, texts)
    order, shared = common_prefixes(levels, texts)
    reach = np.zeros(len(words), np.int64)
    reach[order[:-1]] = shared
    reach[order[1:]] = np.maximum(reach[order[1:]], shared)
    return reach


def maximal(reach: np.ndarray, texts: np.ndarray, min_words: int) -> np.ndarray:
    """Word positions where a repeat begins that no other repeat of the text contains."""
    at = np.arange(len(reach))
    end = at + reach
    before = np.concatenate([[-1], end[:-1]])
    inside = np.concatenate([[False], texts[1:] == texts[:-1]])
    return np.flatnonzero((reach >= min_words) & ~(inside & (before >= end)))


def repeated_windows(words: np.ndarray, texts: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows of `width` words that occur at least twice in their text."""
    hashes = ar.window_hashes(words, width)
    n = len(hashes)
    whole = np.flatnonzero(texts[:n] == texts[width - 1 : width - 1 + n]) if n else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        keys = ar.mixed(hashes[whole] + texts[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    equal = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    return whole[twice]


def measure(block: ar.Block, rules: RepeatRules) -> dict:
    """The result columns of the texts of a block."""
    data, n = block.data, block.n
    in_word = _WORD[data]
    starts, ends = ar.runs(in_word)
    owner = block.owner(starts)
    words = ar.span_hashes(_VALUES, data, starts, ends)
    n_words = np.bincount(owner, minlength=n)
    characters = in_word & ((data & 0xC0) != 0x80)

    line_ends = np.flatnonzero(data == 0x0A)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    first_word = np.searchsorted(starts, line_starts)
    some = np.searchsorted(starts, line_ends) > first_word
    line_starts, line_ends = line_starts[some], line_ends[some]
    line_owner = block.owner(line_starts)
    with np.errstate(over="ignore"):
        lines = ar.span_hashes(_VALUES, data, line_starts, line_ends) + ar.mixed(line_owner.astype(np.uint64) + np.uint64(1))
    _, one_each = np.unique(lines, return_index=True)
    n_dup_lines = np.bincount(line_owner, minlength=n) - np.bincount(line_owner[one_each], minlength=n)

    twice = repeated_windows(words, owner, BASE_WINDOW)
    n_repeat = np.bincount(owner[ar.covered(len(words), twice, twice + BASE_WINDOW)], minlength=n)
    failed = (n_words < BASE_LEAST) | (100 * n_repeat > BASE_PERCENT * n_words)

    with_repeats = np.zeros(n, bool)
    with_repeats[owner[repeated_windows(words, owner, rules.min_words)]] = True
    chosen = np.flatnonzero(with_repeats[owner])
    texts = owner[chosen]
    reach = repeat_reach(words[chosen], texts)
    at = np.flatnonzero(reach >= rules.min_words)
    n_covered = np.bincount(texts[ar.covered(len(chosen), at, at + reach[at])], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, texts[at], reach[at])
    heads = maximal(reach, texts, rules.min_words)
    text_start = np.searchsorted(owner, np.arange(n))
    spans = pa.StructArray.from_arrays(
        [pa.array(chosen[heads] - text_start[texts[heads]]), pa.array(reach[heads])], ["start", "words"]
    )
    kept = ~failed & (100 * n_covered <= rules.max_percent * n_words) & (longest <= rules.max_repeat)
    return {
        "n_words": n_words,
        "word_chars": block.per_text(characters),
        "n_symbols": block.per_text(_SYMBOL[data]),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "covered_words": n_covered,
        "longest_repeat": longest,
        "repeats": ar.list_array(spans, np.bincount(texts[heads], minlength=n)),
        "kept": kept,
    }


_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")
_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.LongType())])
FIELDS = [T.StructField(c, T.LongType()) for c in _LONGS] + [
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("repeats", T.ArrayType(_SPAN)),
]


def with_quality(docs: DataFrame, rules: RepeatRules = RepeatRules(), text: str = "text",
                 keep: list[str] | None = None) -> DataFrame:
    """`docs` with the counts, the maximal repeats (`repeats`: first word and length) and the verdict `kept`."""

    def kernel(batch: pa.RecordBatch) -> dict:
        return measure(ar.block_of(ar.texts_of(batch, text)), rules)

    return ar.arrow_map(docs, kernel, FIELDS, keep, text)
