"""Text expressions. Everything here is a built-in column expression, so it stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkspan.functions.stopwords import DEFAULT_STOP_WORDS

# What counts as a letter when cleaning, and as a token when picking keywords.
NON_LETTERS = "[^A-Za-z]+"
TOKEN = r"([\p{L}\p{N}_]{2,})"
TRANSCRIPT_PREFIX = r"^.*?\]:\s*"
BLANK_ENDS = r"^\s+|\s+$"


def _without(words: Column, stop_words: Iterable[str] | None) -> Column:
    stop = sorted({"", *(DEFAULT_STOP_WORDS if stop_words is None else stop_words)})
    return F.filter(words, lambda w: ~w.isin(stop))


def message_text(text: Column, null_text: str | None = None) -> Column:
    """The text to work on; `null_text` gives missing texts a word of their own."""
    return text if null_text is None else F.coalesce(text, F.lit(null_text))


def clean_words(text: Column, stop_words: Iterable[str] | None = None) -> Column:
    """Lower-case ASCII words without stop words, in order. Null and blank give an empty array."""
    letters = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NON_LETTERS, " "))
    return _without(F.split(letters, " "), stop_words)


def tokens(text: Column) -> Column:
    """All lower-case tokens of two or more word characters, in order, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def keyword_candidates(text: Column, stop_words: Iterable[str] | None = None) -> Column:
    """Distinct tokens that may become keywords."""
    return _without(F.array_distinct(tokens(text)), stop_words)


def strip_transcript(text: Column) -> Column:
    """Transcript back to plain text: per line drop the `user :: room [time]: ` prefix."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, BLANK_ENDS, ""))
    kept = F.filter(lines, lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, TRANSCRIPT_PREFIX, "")), " ")


def plain_time(ts: Column, first: int = 1, length: int = 19) -> Column:
    """`2024-01-31 09:05:00` or a part of it. Read off the zone-less value, so the session's zone plays no part."""
    return F.substring(ts.cast("timestamp_ntz").cast("string"), first, length)


def transcript_line(sender: Column, chatroom: Column, ts: Column, text: Column) -> Column:
    return F.concat(
        sender,
        F.lit(" :: "),
        F.coalesce(chatroom, F.lit("")),
        F.lit(" ["),
        plain_time(ts),
        F.lit("]: "),
        F.coalesce(text, F.lit("")),
    )


def text_key(text: Column) -> Column:
    return F.sha2(text, 256)


def duration_text(seconds: Column) -> Column:
    """`1:01:01`, `1 day, 0:00:05`, `2 days, 0:00:00`, with days floored below zero."""
    days = F.floor(seconds / 86400)
    rest = seconds - days * 86400
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3600),
        F.floor((rest % 3600) / 60),
        F.floor(rest % 60),
    )
    day_text = F.concat(days.cast("string"), F.when(F.abs(days) == 1, " day, ").otherwise(" days, "))
    return F.when(days == 0, clock).otherwise(F.concat(day_text, clock))


def fingerprint(topics: Column, *parts: Column) -> Column:
    """Accuracy fingerprint of a run held in a table: sorted topics and the other parameters."""
    before, after = parts[:4], parts[4:]
    sorted_topics = F.array_join(F.array_sort(topics), ",")
    return F.concat_ws("|", *before, sorted_topics, *after)
