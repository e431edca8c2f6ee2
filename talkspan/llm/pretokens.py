"""Texts cut into pre-tokens by array steps, and a bounded memory of the ids of pre-tokens seen.

Byte-level BPE never merges over the border of a pre-token, so a text is encoded by encoding its distinct pre-tokens.
`cut` finds the borders of a block of texts from the classes of their characters (letter, number, white space, other), byte
by byte; `Lexicon` keeps the ids of up to `limit` distinct pre-tokens in flat arrays and forgets the least used ones when it
would pass the limit, so its size never decides a result. Both depend on the vocabulary file's own settings: byte-level pre-tokenizing
without a prefix space, no normalizer; others are refused.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from talkspan.llm import arrays as ar

LETTER, NUMBER, SPACE, OTHER, UNKNOWN, CLOSE, MARK = range(7)
_VALUES = ar.value_table(256)


def check_settings(path: str) -> dict:
    """The vocabulary file as read, if its settings are those that this package implements."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made["pre_tokenizer"] or {}
    model = made["model"]
    wanted = (
        made["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        and before.get("use_regex", True) and model["type"] == "BPE" and not model.get("dropout")
        and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        and not model.get("ignore_merges") and (made["decoder"] or {}).get("type") == "ByteLevel"
        and all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in made["added_tokens"])
    )
    if not wanted:
        raise ValueError("only byte-level BPE vocabularies without a normalizer or prefix space are implemented")
    return made


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others in turn for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class CharacterClasses:
    """Classes of code points as the tokenizers library sees them: each is asked for once, when it first occurs."""

    def __init__(self, pre_tokenizer):
        self._cut = pre_tokenizer.pre_tokenize_str
        self._table = np.full(0x110000, UNKNOWN, np.uint8)
        for c in range(0x80):
            self._table[c] = self._ask(c)
        self.ascii = self._table[:256].copy()  # by byte; those of longer characters are set by `byte_classes`

    def _ask(self, code: int) -> int:
        if code == 0x20:
            return SPACE
        c = chr(code)
        if len(self._cut(f"a{c}")) == 1:
            return LETTER
        if len(self._cut(f"1{c}")) == 1:
            return NUMBER
        return OTHER if len(self._cut(f"!{c}")) == 1 else SPACE

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self._table[codes]
        if (found == UNKNOWN).any():
            for c in np.unique(codes[found == UNKNOWN]):
                self._table[c] = self._ask(int(c))
            found = self._table[codes]
        return found


def byte_classes(data: np.ndarray, classes: CharacterClasses) -> np.ndarray:
    """The class of the character that each byte of UTF-8 text belongs to."""
    found = classes.ascii[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
        codes = (data[lead] & (0x7F >> size)).astype(np.int64)
        for k in (1, 2, 3):
            more = np.flatnonzero(size > k)
            codes[more] = (codes[more] << 6) | (data[lead[more] + k] & 0x3F)
        own = classes.of(codes)
        found[lead] = own
        for k in (1, 2, 3):
            more = size > k
            found[lead[more] + k] = own[more]
    return found


def borders(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a pre-token; bytes of class `CLOSE` end a text, those of class `MARK` a part of it.

    The rules, in words: runs of letters, numbers or other characters each take a blank before them; of white space
    before another character all but the last one stay together, and that one joins what follows if it is a blank and
    else stands alone; an apostrophe that stands alone takes s, t, m, d, re, ve or ll from the letters behind it.
    """
    n = len(data)
    begin = np.ones(n, bool)
    np.not_equal(classes[1:], classes[:-1], out=begin[1:])
    last = np.flatnonzero((classes[:-1] == SPACE) & begin[1:])  # the last byte of a run of white space
    last = last[classes[last + 1] < CLOSE]
    blank = data[last] == 0x20
    begin[last[blank]] = True
    begin[last[blank] + 1] = False
    other = last[~blank]
    while len(inner := np.flatnonzero((data[other] & 0xC0) == 0x80)):
        other[inner] -= 1
    begin[other] = True
    lone = np.flatnonzero((data == 0x27) & begin)
    lone = lone[lone + 1 < n]
    lone = lone[classes[lone + 1] == LETTER]
    if len(lone):
        ahead = np.concatenate([data, np.zeros(3, data.dtype)])
        one = np.isin(ahead[lone + 1], [ord(c) for c in "stmd"])
        pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
        two = np.logical_or.reduce([(ahead[lone + 1] == a) & (ahead[lone + 2] == b) for a, b in pairs])
        for hit, width in ((one, 1), (two, 2)):
            at = lone[hit]
            begin[at + 1] = False
            rest = at + 1 + width
            # a blank that joins what follows begins by itself; what follows it does not
            begin[rest[rest < n]] = True
    return begin


@dataclass
class Cut:
    """Pre-tokens of a block of texts: the bytes, starts and ends, how many each text has, and the ids of the pre-tokens
    that are special strings by their number."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    per_text: np.ndarray
    marks: dict[int, int]


class Cutter:
    """Cuts blocks of texts into pre-tokens; special strings of the vocabulary stand alone."""

    def __init__(self, path: str, encode_special: bool = False):
        from tokenizers import Tokenizer

        made = check_settings(path)
        self.special = {} if encode_special else {
            t["content"]: t["id"] for t in sorted(made["added_tokens"], key=lambda t: -len(t["content"]))
        }
        self.classes = CharacterClasses(Tokenizer.from_file(path).pre_tokenizer)

    def cut(self, texts: pa.Array) -> Cut:
        block = ar.block_of(texts)
        data, n = block.data, block.n
        classes = byte_classes(data, self.classes)
        classes[block.starts[1:] - 1] = CLOSE  # the newline behind each text
        marks: dict[int, tuple[int, int]] = {}  # byte position: its end, its id
        for content, number in self.special.items():
            self._find_special(data, content.encode(), number, marks)
        for a, (b, _) in marks.items():
            classes[a:b] = MARK
        begin = borders(data, classes) if len(data) else np.zeros(0, bool)
        begin[list(marks)] = True
        points = np.flatnonzero(begin)
        ends = np.append(points[1:], len(data))
        kinds = classes[points]
        inside = kinds != CLOSE
        starts, ends, kinds = points[inside], ends[inside], kinds[inside]
        before = np.concatenate([[0], np.cumsum(inside)])
        per_text = np.diff(before[np.searchsorted(points, block.starts)])
        numbers = {int(i): marks[int(starts[i])][1] for i in np.flatnonzero(kinds == MARK)}
        return Cut(data, starts, ends, per_text, numbers)

    @staticmethod
    def _find_special(data, content, number, marks):
        raw = data.tobytes()
        p = raw.find(content)
        while p >= 0:
            marks.setdefault(p, (p + len(content), number))
            p = raw.find(content, p + len(content))


_WORD_BYTES, _LONG = 8, 64
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(_WORD_BYTES + 1)], np.uint64)


def span_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, never 0: eight bytes at a time, and for spans of over 64 bytes the hash of `arrays`."""
    padded = np.concatenate([data, np.zeros(_WORD_BYTES, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    sizes = ends - starts
    with np.errstate(over="ignore"):
        keys = ar.mixed((words[starts] & _MASKS[np.minimum(sizes, _WORD_BYTES)]) ^ ar.mixed(sizes.astype(np.uint64)))
        at = _WORD_BYTES
        more = np.flatnonzero((sizes > at) & (sizes <= _LONG))
        while len(more):
            piece = words[starts[more] + at] & _MASKS[np.minimum(sizes[more] - at, _WORD_BYTES)]
            keys[more] = ar.mixed(keys[more] * np.uint64(0xD6E8FEB86659FD93) + piece)
            at += _WORD_BYTES
            more = more[sizes[more] > at]
    long = np.flatnonzero(sizes > _LONG)
    if len(long):
        keys[long] = ar.span_hashes(_VALUES, data, starts[long], ends[long])
    keys[keys == 0] = 1
    return keys


class Lexicon:
    """Ids of distinct pre-tokens by a 64-bit hash of their bytes, in an open-addressed table of flat arrays.

    `encode` takes the bytes of a block, starts and ends of pre-tokens; it gives ids in one array, where those of each
    pre-token begin, and how many it has.
    """

    def __init__(self, encode: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]], limit: int = 1 << 20):
        self._encode, self._limit = encode, limit
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)
        self._n = 0  # entries; the arrays above have room for more
        self._n_ids = 0
        self._place(1 << 12)

    def look_up(self, cut: Cut) -> tuple[np.ndarray, np.ndarray]:
        """Place in `ids` and number of ids for each span."""
        keys = span_keys(cut.data, cut.starts, cut.ends)
        entry = self._find(keys)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, first = np.unique(keys[missing], return_index=True)
            if self._n + len(first) > self._limit and self._n:
                self._forget()
                entry = self._find(keys)
                missing = np.flatnonzero(entry < 0)
                _, first = np.unique(keys[missing], return_index=True)
            new = missing[first]
            self._learn(keys[new], *self._encode(cut.data, cut.starts[new], cut.ends[new]))
            entry[missing] = self._find(keys[missing])
        np.add.at(self.used, entry, 1)
        return self.at[entry], self.size[entry]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where there is none."""
        mask = np.uint64(len(self._slots) - 1)
        slot = (keys & mask).astype(np.int64)
        entry = self._slots[slot]
        open_ = np.flatnonzero((entry >= 0) & (self.keys[entry] != keys)) if self._n else np.zeros(0, np.int64)
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            entry[open_] = self._slots[slot[open_]]
            open_ = open_[(entry[open_] >= 0) & (self.keys[entry[open_]] != keys[open_])]
        return entry

    def _place(self, n_slots: int) -> None:
        """Builds the table of slots anew."""
        self._slots = np.full(n_slots, -1, np.int32)
        self._add_slots(np.arange(self._n))

    def _add_slots(self, entries: np.ndarray) -> None:
        mask = len(self._slots) - 1
        slot = (self.keys[entries] & np.uint64(mask)).astype(np.int64)
        while len(entries):
            free = self._slots[slot] < 0
            self._slots[slot[free]] = entries[free]
            lost = self._slots[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & mask

    def _forget(self) -> None:
        """Keeps the most used half of the limit and halves its counts, so that later texts count for more."""
        stay = np.sort(np.argsort(-self.used[: self._n], kind="stable")[: self._limit // 2])
        at, size = self.at[stay], self.size[stay]
        self.ids = gathered(self.ids, at, size)
        self.size, self.keys, self.used = size, self.keys[stay], self.used[stay] // 2
        self.at = np.cumsum(size, dtype=np.int64) - size
        self._n, self._n_ids = len(stay), len(self.ids)
        self._place(len(self._slots))

    def _learn(self, keys: np.ndarray, ids: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> None:
        n, n_ids = self._n + len(keys), self._n_ids + len(ids)
        for name in ("keys", "at", "size", "used"):
            setattr(self, name, _with_room(getattr(self, name), self._n, n))
        self.ids = _with_room(self.ids, self._n_ids, n_ids)
        new = slice(self._n, n)
        self.keys[new], self.at[new], self.size[new], self.used[new] = keys, at + self._n_ids, sizes, 0
        self.ids[self._n_ids : n_ids] = ids
        entries = np.arange(self._n, n)
        self._n, self._n_ids = n, n_ids
        if 2 * n > len(self._slots):
            self._place(1 << (2 * n).bit_length())
        else:
            self._add_slots(entries)


def _with_room(old: np.ndarray, used: int, wanted: int) -> np.ndarray:
    """`old` with room for `wanted` values, of which `used` are kept."""
    if wanted <= len(old):
        return old
    out = np.zeros(max(wanted, len(old) * 3 // 2, 1024), old.dtype)
    out[:used] = old[:used]
    return out


def gathered(flat: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces `flat[at:at + size]` behind each other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at - (ends - sizes), sizes)]


def encoded(texts: pa.Array, cutter: Cutter, lexicon: Lexicon) -> pa.ListArray:
    """The ids of each text."""
    cut = cutter.cut(texts)
    at, sizes = lexicon.look_up(cut)
    ids = gathered(lexicon.ids, at, sizes)
    if cut.marks:
        sizes = sizes.copy()
        spans = np.cumsum(sizes) - sizes
        keep = np.ones(len(ids), bool)
        for k in sorted(cut.marks):
            keep[spans[k] + 1 : spans[k] + sizes[k]] = False
            ids[spans[k]] = cut.marks[k]
            sizes[k] = 1
        ids = ids[keep]
    token_ends = np.concatenate([[0], np.cumsum(sizes)])
    text_ends = token_ends[np.concatenate([[0], np.cumsum(cut.per_text)])]
    return ar.list_array(pa.array(ids, pa.int32()), np.diff(text_ends))
