"""Column helpers for prose: lexicons, sentences, words, series, asides, normal forms. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends other than LF, as fixed values: CRLF and CR, VT, FF, FS, GS, RS, NEL, LS, PS.
LINE_ENDS = r"\r\n?|[\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def alternation(phrases: list[str]) -> str:
    """Longest phrase first; blanks within a phrase match any white space."""
    return "|".join(r"\s+".join(re.escape(w) for w in p.split()) for p in sorted(phrases, key=len, reverse=True))


def lexicon(phrases: list[str]) -> str:
    """A case-insensitive pattern of a closed phrase list, each phrase bounded by word ends."""
    return rf"(?i)\b(?:{alternation(phrases)})\b"


#: What \s matches; trimming by characters is linear, where a pattern with \s+$ tries every run of white space.
SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once; a column used inside a lambda may else be made again for each element."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, LINE_ENDS, "\n")


def sentences(c: Column) -> Column:
    """Parts of the stripped text after a full stop, question or exclamation mark and white space."""
    return F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def words(c: Column) -> Column:
    """Number of tokens without white space."""
    return F.regexp_count(c, F.lit(r"\S+"))


def first_words(c: Column, n: int) -> Column:
    """The first n tokens, with three dots where there are more."""
    w = F.regexp_extract_all(c, F.lit(r"\S+"), 0)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, "...").otherwise(""))


def series(c: Column) -> Column:
    """Items of an and/or-joined series; one item where there is no comma or no coordinator."""
    t = F.replace(F.rtrim(strip(c), F.lit(".!?")), F.lit(";"), F.lit(","))
    joined = F.regexp_replace(t, r"(?i),?\s+(?:and|or)\s+", ", ")
    many = F.filter(F.transform(F.split(joined, ","), strip), lambda x: x != "")
    return F.when(t == "", F.array().cast("array<string>")).when(t.contains(",") & has(t, r"(?i),?\s+(?:and|or)\s+"), many).otherwise(F.array(t))


def asides(c: Column, lead: int = 8) -> tuple[Column, Column]:
    """(clauses between the first and the last comma, words in them) after a short opening segment."""
    seg = F.transform(F.split(c, ","), strip)
    ok = (F.size(seg) >= 3) & (words(seg[0]) <= lead)
    inner = F.slice(seg, 2, F.greatest(F.size(seg) - 2, F.lit(0)))
    n_words = F.aggregate(inner, F.lit(0), lambda s, x: s + words(x))
    return F.when(ok, F.size(inner)).otherwise(0), F.when(ok, n_words).otherwise(0)


def normal_loose(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed (full case folding and NFC need the Arrow variant)."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def normal_heading(c: Column) -> Column:
    return F.rtrim(normal_loose(c), F.lit(".,:;!?"))


def sanitize(c: Column, limit: int) -> Column:
    """Dashes to spaced hyphens, white space collapsed, cut to ``limit`` characters, right end trimmed."""
    t = F.regexp_replace(F.regexp_replace(c, r"\s+", " "), " ?[—–] ?", " - ")
    return F.rtrim(F.left(strip(F.regexp_replace(t, " +", " ")), F.lit(limit)), F.lit(SPACE))


def slug(c: Column) -> Column:
    """Lower case without punctuation, blanks as single hyphens."""
    t = F.regexp_replace(F.lower(strip(c)), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(t, r"[\s-]+", "-")


def tokens(c: Column) -> Column:
    """Tokens in lower case, reduced to a-z and 0-9; empty ones dropped."""
    return F.filter(F.transform(F.split(F.lower(c), r"\s+"), lambda t: F.regexp_replace(t, "[^0-9a-z]", "")), lambda t: t != "")


def shingles(tokens_: Column, n: int) -> Column:
    """Distinct runs of n consecutive tokens."""

    def runs(t: Column) -> Column:
        last = F.size(t) - n + 1
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    return let(tokens_, runs)
