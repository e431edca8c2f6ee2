"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

Each distinct pre-token starts as its bytes. The leaves of a segment tree hold the merge rank of each symbol with its
right neighbour, together with the position; the root is therefore the leftmost pair of the lowest rank. Merging it
changes three leaves (the pair itself, the one before, and the one that is used up), each updated up to the root, until
the root holds no mergeable pair. The trees of many pre-tokens are worked on side by side: row i of an array is the tree
of pre-token i, and one array step updates one level of all of them. A pre-token of n bytes takes O(n log n) steps.

Encoding equals the tokenizers library with special strings recognized in the text and none added; decoding keeps special
strings and replaces invalid UTF-8, as the library's decode(ids, skip_special_tokens=False) does.

Defined results: null and empty texts have no ids and decode to the empty text; a null list of ids decodes to the empty
text; an id outside the vocabulary is an error. Input columns that carry the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from talkspan.llm import arrays as ar
from talkspan.llm import pretokens as pt

_NONE = np.int64(1) << 62
_TREE_CELLS = 1 << 21


class Merges:
    """Merge ranks of a vocabulary file as sorted arrays."""

    def __init__(self, path: str):
        made = pt.check_settings(path)
        vocab, merges = made["model"]["vocab"], made["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        letters = pt.byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self._n = max([*vocab.values(), *(t["id"] for t in made["added_tokens"])]) + 1
        keys = np.array([vocab[a] * self._n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order.astype(np.int64)
        self.results = np.array([vocab[a + b] for a, b in pairs], np.int64)
        back = {c: b for b, c in letters.items()}
        self.token_bytes = [b""] * self._n
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        self.known = np.zeros(self._n, bool)
        self.known[list(vocab.values())] = True
        for t in made["added_tokens"]:
            self.token_bytes[t["id"]] = t["content"].encode()
            self.known[t["id"]] = True

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it does not merge."""
        keys = left * self._n + right
        place = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[place] == keys, self._ranks[place], -1)


def merge_all(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words in one array, where those of each word begin, and how many it has. Words of similar length
    share the shape of their trees and are merged together."""
    sizes = np.array([len(w) for w in words], np.int64)
    shape = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    parts, total = [], 0
    at, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
    for leaves in np.unique(shape):
        own = np.flatnonzero(shape == leaves)
        at_once = max(1, _TREE_CELLS // int(leaves))
        for k in range(0, len(own), at_once):
            rows = own[k : k + at_once]
            ids, n = _merge_rows([words[i] for i in rows], sizes[rows], int(leaves), merges)
            at[rows] = total + np.cumsum(n) - n
            counts[rows] = n
            total += len(ids)
            parts.append(ids.astype(np.int32))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), at, counts


def _merge_rows(words: list[bytes], sizes: np.ndarray, leaves: int, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    rows, n = len(words), leaves
    flat = np.frombuffer(b"".join(words), np.uint8)
    inside = np.arange(n) < sizes[:, None]
    symbols = np.full((rows, n), -1, np.int64)
    symbols[inside] = merges.byte_ids[flat]
    following = np.tile(np.arange(1, n + 1), (rows, 1))
    before = np.tile(np.arange(-1, n - 1), (rows, 1))
    # a leaf holds rank * n + position, so that the least leaf is the leftmost of the lowest rank
    tree = np.full((rows, 2 * n), _NONE, np.int64)
    pair = inside[:, 1:]
    r, c = np.nonzero(pair)
    rank = merges.rank(symbols[r, c], symbols[r, c + 1])
    tree[r, n + c] = np.where(rank >= 0, rank * n + c, _NONE)
    level = n
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    flat_tree = tree.reshape(-1)
    open_rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(open_rows):
        root = flat_tree[open_rows * (2 * n) + 1]
        spot, result = root % n, merges.results[root // n]
        used = following[open_rows, spot]
        behind = following[open_rows, used]
        symbols[open_rows, spot] = result
        symbols[open_rows, used] = -1
        following[open_rows, spot] = behind
        more = behind < n
        before[open_rows[more], behind[more]] = spot[more]
        left = before[open_rows, spot]
        some = left >= 0
        own, left = open_rows[some], left[some]
        right = np.where(more, symbols[open_rows, np.minimum(behind, n - 1)], -1)
        _update(flat_tree, n, open_rows, used, np.full(len(open_rows), _NONE))
        _update(flat_tree, n, open_rows, spot, _leaf(merges, result, right, spot, n))
        _update(flat_tree, n, own, left, _leaf(merges, symbols[own, left], result[some], left, n))
        open_rows = open_rows[flat_tree[open_rows * (2 * n) + 1] < _NONE]
    return symbols[symbols >= 0], (symbols >= 0).sum(axis=1)


def _leaf(merges: Merges, left: np.ndarray, right: np.ndarray, spot: np.ndarray, n: int) -> np.ndarray:
    rank = np.where(right >= 0, merges.rank(left, np.maximum(right, 0)), -1)
    return np.where(rank >= 0, rank * n + spot, _NONE)


def _update(tree: np.ndarray, n: int, rows: np.ndarray, spot: np.ndarray, value: np.ndarray) -> None:
    """Sets one leaf of each row and the nodes above it; `tree` holds the rows of 2n nodes behind each other."""
    base = rows * (2 * n)
    node = n + spot
    tree[base + node] = value
    width = n
    while width > 1:
        beside = tree[base + (node ^ 1)]
        value = np.minimum(value, beside)
        node = node >> 1
        tree[base + node] = value
        width >>= 1


class Codec:
    """Encodes and decodes with one vocabulary file; one per worker and file."""

    _known: dict[str, Codec] = {}

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.cutter = pt.Cutter(path)
        self.lexicon = pt.Lexicon(self._encode)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        return merge_all([data[a:b].tobytes() for a, b in zip(starts, ends)], self.merges)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        return pt.encoded(texts, self.cutter, self.lexicon)

    def decode(self, ids: list[int] | np.ndarray) -> str:
        at = np.asarray(ids, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= len(self.merges.known) or not self.merges.known[at].all()):
            raise ValueError("an id is not in the vocabulary")
        return b"".join(map(self.merges.token_bytes.__getitem__, at.tolist())).decode("utf-8", "replace")


def with_ids(docs: DataFrame, path: str, text: str = "text", column: str = "ids",
             keep: list[str] | None = None) -> DataFrame:
    """`docs` with the token ids of the text."""

    def kernel(batch: pa.RecordBatch) -> dict:
        return {column: Codec.of(path).encode(ar.texts_of(batch, text))}

    return ar.arrow_map(docs, kernel, [T.StructField(column, T.ArrayType(T.IntegerType()))], keep, text)


def with_text(rows: DataFrame, path: str, ids: str = "ids", column: str = "decoded",
              keep: list[str] | None = None) -> DataFrame:
    """`rows` with the text that the token ids stand for."""

    def kernel(batch: pa.RecordBatch) -> dict:
        lists = batch.column(batch.schema.get_field_index(ids))
        codec = Codec.of(path)
        return {column: pa.array([codec.decode(x.values.to_numpy(False)) if x.is_valid else "" for x in lists])}

    return ar.arrow_map(rows, kernel, [T.StructField(column, T.StringType())], keep, None)


def with_ids_and_text(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded",
                      keep: list[str] | None = None) -> DataFrame:
    """`with_text` of `with_ids`, in one pass: a task has one worker with one vocabulary instead of two."""

    def kernel(batch: pa.RecordBatch) -> dict:
        codec = Codec.of(path)
        lists = codec.encode(ar.texts_of(batch, text))
        return {ids: lists, decoded: pa.array([codec.decode(x.values.to_numpy(False)) for x in lists], pa.string())}

    fields = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]
    return ar.arrow_map(docs, kernel, fields, keep, text)
