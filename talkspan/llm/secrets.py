"""Secret scans: patterns for keys, and a guess-cost estimate for values that stand in a credential context.

The base patterns are assignments to credential names, access key ids and long hexadecimal runs. Beside them every value
in a wider credential context (`pwd:`, `passphrase =`, `auth_key=` ...) is priced: dynamic programming finds the cheapest
segmentation into common words, dates, repeats, keyboard walks, sequences and brute-force characters, in decades of
guesses. A value whose cheapest segmentation still costs `least_decades` is a finding of kind `guess`; placeholders such
as `changeme123` stay. Values made of letters only are priced too; for those the words of the corpus count as common
(`corpus_model`: words of 4 to 32 letters that stand in one of `COMMON_IN` documents, two at least, outside of credential
contexts; a share, so that a larger corpus of the same kind has the same words). So a rarer word in a context, or a chain of
words that costs the limit, is a finding, and a password that as many documents use as a word elsewhere is none. Values shorter than `least_length` are not priced. The cost of assigned values is reported too, base findings stay whatever they cost.

The automaton has one state per kind of span, so the work grows with the length of a value (times the longest word), and
texts are scanned whole. Positions are code points, ends are exclusive.

Defined results: null and empty texts have no findings; equal findings of one kind never overlap, findings of different
kinds may. Input columns that carry the name of a result column are replaced.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkspan.llm import arrays as ar

#: Kinds in their order, and the least lengths.
KINDS = ("assign", "access", "hex", "guess")
BASE_KINDS = KINDS[:3]
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

_ASCII_CASE = re.IGNORECASE | re.ASCII
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _ASCII_CASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
_CONTEXT = re.compile(
    # a name begins behind a character other than a letter, or as the upper-case part of a camel-case name
    r"""(?:(?:(?<![a-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass(?:word|wd|phrase|code|key)?|pwd|passwd|secret|token"""
    r"""|credentials?|bearer|(?:api|access|auth|private|secret|client|encryption|signing)[_-]?(?:key|secret|token)|auth)"""
    r"""["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?(?:(?:bearer|basic)[\x20\t]+)?"""
    r"""|(?<![a-z])authorization["']?[\x20\t]*[:=][\x20\t]*["']?(?:bearer|basic|token)[\x20\t]+"""
    r"""|(?<![a-z])bearer[\x20\t]+(?=[^\s"'<>,;()\[\]{}]*[0-9]))([^\s"'<>,;()\[\]{}]+)""",
    _ASCII_CASE,
)
#: A text without any of these has no credential context.
_HINTS = ("pass", "pwd", "secret", "token", "api", "key", "auth", "credential", "bearer")

#: Frequent parts of passwords, most frequent first.
COMMON_WORDS = (
    "password pass admin welcome login letmein master secret user test guest root default changeme example sample "
    "demo token key love hello monkey dragon shadow sunshine princess football baseball superman batman qwerty "
    "iloveyou trustno starwars computer internet server system database access public private prod dev staging "
    "temp temporary dummy foobar foo bar baz abc summer winter spring autumn monday friday january december "
    "secure security change placeholder your here insert none null true false xxxx todo company office home "
    "money freedom whatever michael jordan daniel charlie thomas george robert ashley jessica andrew hunter "
    "killer pepper ginger cookie summer flower purple orange silver golden tiger eagle wolf cheese banana apple"
).split()
#: A word is common where it stands in one of this many documents, and in two at least.
COMMON_IN = 1000
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

_DATE = re.compile(
    r"(?:19|20)\d\d|(?:(?:19|20)\d\d|\d\d)([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)"
)
_DATE_LENGTHS = range(4, 11)
_PERIODS = (1, 2, 3, 4)
_SEGMENT, _ENTER = 0.3, 1.0
_COPY, _SEQUENCE, _WALK = 0.05, 0.05, 0.6
_YEAR, _FULL_DATE = 2.1, 4.6


def _neighbours() -> set[tuple[str, str]]:
    place = {c: (x + y / 2, y) for y, row in enumerate(KEY_ROWS) for x, c in enumerate(row)}
    return {
        (a, b) for a, (ax, ay) in place.items() for b, (bx, by) in place.items()
        if a != b and abs(ay - by) <= 1 and abs(ax - bx) <= 1
    }


_NEAR = _neighbours()


def _brute(c: str) -> float:
    if "0" <= c <= "9":
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(33) if c.isascii() else 2.0


@dataclass(frozen=True)
class GuessModel:
    """`words`: frequent parts, most frequent first; `least_decades`: from how many decades of guesses a value counts;
    `least_length`: shorter values are not priced; `prose`: further words for values of letters only."""

    words: tuple[str, ...] = tuple(dict.fromkeys(COMMON_WORDS))
    least_decades: float = 8.0
    least_length: int = 8
    prose: tuple[str, ...] = ()

    def ranks(self) -> dict[str, float]:
        return _ranks(self.words)

    def prose_ranks(self) -> dict[str, float]:
        return _ranks(tuple(dict.fromkeys(self.words + self.prose)))


def _ranks(words: tuple[str, ...]) -> dict[str, float]:
    return {w: math.log10(i + 2) for i, w in enumerate(words)}


def corpus_model(docs: DataFrame, text: str = "text") -> GuessModel:
    """The model whose words for values of letters only are those of one in `COMMON_IN` documents; so many times the words
    of a mean document at most reach the driver, whatever the number of documents."""
    outside = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "(?i)" + _CONTEXT.pattern, " ")
    words = F.regexp_extract_all(F.lower(outside), F.lit(r"(?<!\p{L})\p{L}{4,32}(?!\p{L})"), F.lit(0))
    rows = docs.select(F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    least = max(2, -(-docs.count() // COMMON_IN))
    found = rows.where(F.col("n") >= least).toArrow()
    ranked = sorted(zip(found["n"].to_pylist(), found["word"].to_pylist()), key=lambda x: (-x[0], x[1]))
    return GuessModel(prose=tuple(word for _, word in ranked))


def guess_cost(value: str, ranks: dict[str, float]) -> tuple[float, list[tuple[str, int, int]]]:
    """Decades of guesses of the cheapest segmentation, and its spans as (kind, start, end).

    States after a character: `any` (a span may end here), brute force, a copy of the character some places before, a
    sequence up or down, a keyboard walk. Each step extends its span by one character at a small price; entering a state from `any`
    pays for a new span. Words and dates are spans of bounded length taken as a whole. Ties go to the state named first.
    """
    low = value.lower() if len(value.lower()) == len(value) else value
    plain = low.translate(LOOKALIKES)
    longest = max(map(len, ranks), default=0)
    steps = [("brute", 0), *(("repeat", p) for p in _PERIODS), ("sequence", 1), ("sequence", -1), ("walk", 0)]
    best, back = [0.0], [("", 0)]
    state = [(math.inf, 0)] * len(steps)  # price, and where the span began
    for k, c in enumerate(value):
        entered = []
        for (kind, by), (price, start) in zip(steps, state):
            enter = _ENTER
            if kind == "brute":
                goes, step, enter = True, _brute(c), _SEGMENT
            elif kind == "repeat":
                goes, step = k >= by and low[k] == low[k - by], _COPY
            elif kind == "sequence":
                goes, step = k >= 1 and ord(low[k]) - ord(low[k - 1]) == by and c.isalnum(), _SEQUENCE
            else:
                goes, step = k >= 1 and (low[k - 1], low[k]) in _NEAR, _WALK
            fresh = best[k] + enter
            if not goes:
                entered.append((math.inf, 0))
            elif price <= fresh:
                entered.append((price + step, start))
            else:
                entered.append((fresh + step, k))
        state = entered
        options = [(price, kind, start) for (kind, _), (price, start) in zip(steps, state)]
        for j in range(max(0, k + 1 - longest), k - 1):
            price = ranks.get(low[j : k + 1])
            if price is None and plain[j : k + 1] in ranks:
                price = ranks[plain[j : k + 1]] + 0.3
            if price is not None:
                case = 0.0 if value[j : k + 1] == low[j : k + 1] else 0.3
                options.append((best[j] + price + case + _SEGMENT, "word", j))
        if c.isdigit():
            for length in _DATE_LENGTHS:
                j = k + 1 - length
                if j >= 0 and value[j].isdigit() and _DATE.fullmatch(value, j, k + 1):
                    options.append((best[j] + (_YEAR if length == 4 else _FULL_DATE) + _SEGMENT, "date", j))
        price, kind, start = min(options, key=lambda x: x[0])
        best.append(price)
        back.append((kind, start))
    spans, at = [], len(value)
    while at:
        kind, start = back[at]
        spans.append((kind, start, at))
        at = start
    return best[-1], spans[::-1]


def findings(text: str, model: GuessModel, ranks: dict[str, float], prose: dict[str, float] | None = None) -> list[dict]:
    """All findings of one text by start, then kind; `prose` has the ranks for values of letters only."""
    out = []

    def add(kind, start, end, value_start, decades=None, parts=None):
        shown = None if parts is None else " ".join(f"{k}:{a}:{b}" for k, a, b in parts)
        out.append({"kind": kind, "start": start, "end": end, "value_start": value_start, "decades": decades,
                    "parts": shown})

    lower = text.lower()
    if any(h in lower for h in _HINTS):
        taken = []
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                decades, parts = guess_cost(m[2], ranks)
                add("assign", m.start(), m.end(), m.start(2), decades, parts)
                taken.append((m.start(2), m.end()))
        nearest = 0
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?")
            start, end = m.start(1), m.start(1) + len(value)
            if end < m.end(1) and m[0][-len(m[1]) - 1] in "\"'" and text.startswith(m[0][-len(m[1]) - 1], m.end(1)):
                value, end = m[1], m.end(1)  # what closes a quoted value belongs to it
            while nearest < len(taken) and taken[nearest][1] < end:
                nearest += 1
            if nearest < len(taken) and taken[nearest][0] <= start:  # a base value that reaches its end
                continue
            if len(value) >= model.least_length:
                decades, parts = guess_cost(value, prose if prose and value.isalpha() else ranks)
                if decades >= model.least_decades:
                    add("guess", start, end, start, decades, parts)
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                add("access", m.start(), m.end(), m.start())
    for m in _HEX.finditer(text):
        add("hex", m.start(), m.end(), m.start())
    out.sort(key=lambda f: (f["start"], KINDS.index(f["kind"])))
    return out


FINDING = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
    T.StructField("value_start", T.LongType()),
    T.StructField("decades", T.DoubleType()),
    T.StructField("parts", T.StringType()),
])


def with_findings(docs: DataFrame, model: GuessModel = GuessModel(), text: str = "text",
                  keep: list[str] | None = None, column: str = "findings") -> DataFrame:
    """`docs` with an array of findings: kind, span, where the value begins, decades of guesses, cheapest spans."""
    from pyspark.sql.pandas.types import to_arrow_type

    ranks, prose = model.ranks(), model.prose_ranks()
    field = T.StructField(column, T.ArrayType(FINDING))

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = ar.texts_of(batch, text)
        found = [findings(t, model, ranks, prose) for t in texts.to_pylist()]
        return {column: pa.array(found, to_arrow_type(field.dataType))}

    return ar.arrow_map(docs, kernel, [field], keep, text)


def span_text(found, kinds: tuple[str, ...] = KINDS):
    """`kind:start:end` of the findings of some kinds, joined by commas."""
    own = F.filter(found, lambda f: f["kind"].isin(*kinds))
    shown = F.transform(own, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string")))
    return F.array_join(shown, ",")


def redact(text: str, found: list[dict], mark: str) -> str:
    """The text with the values of all findings replaced; overlapping values get one mark."""
    out, at = [], 0
    for a, b in sorted((f["value_start"], f["end"]) for f in found):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[redacted]", text: str = "text", column: str = "findings") -> DataFrame:
    """The result of `with_findings` with the found values replaced in the text; other texts stay as they are."""

    def kernel(batch: pa.RecordBatch) -> dict:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        found = batch.column(batch.schema.get_field_index(column)).to_pylist()
        return {text: pa.array([redact(t, f, mark) if f else t for t, f in zip(texts, found)], pa.string())}

    return ar.arrow_map(docs, kernel, [T.StructField(text, T.StringType())], text=text).select(*docs.columns)
