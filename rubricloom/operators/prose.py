"""Markdown prose to sections, paragraphs and sentences without a shuffle.

A text is split at its heading lines first and each section at its blank lines then, so a paragraph's number under its
heading is its position in the array and no window over lines is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T

HEADING = r"(?m)^(#{1,6}[ \t]+[^\n]*)$"


def sections(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each heading (and for text before the first): doc_id, sec, level, heading, body.

    ``sec`` counts from 0; section 0 is the text before the first heading (level and heading null) and is left out
    where it is blank. Null and empty texts give no rows; repeated rows give their sections each.
    """
    t = F.regexp_replace(T.unix_lines(F.col(text)), HEADING, "\x01$1")
    parts = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(t, "\x01")).alias("sec", "part"))
    head = F.regexp_extract("part", r"^(#{1,6})[ \t]+([^\n]*)", 0) != ""
    inside = (F.col("sec") > 0) | head
    out = parts.select("doc_id", "sec", F.when(inside, F.length(F.regexp_extract("part", "^(#*)", 1))).alias("level"), F.when(inside, T.strip(F.regexp_extract("part", r"^#{1,6}[ \t]+([^\n]*)", 1))).alias("heading"), F.when(inside, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")).alias("body"))
    return out.where((F.col("level") > 0) | F.col("level").isNull() & (T.strip(F.col("body")) != ""))


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each paragraph: doc_id, sec, level, heading, n (from 1 under its heading), text (lines joined), sentences."""
    s = sections(df, key, text)
    blocks = F.filter(F.split("body", r"\n(?:[^\S\n]*\n)++"), lambda b: T.strip(b) != "")
    p = s.select("doc_id", "sec", "level", "heading", F.posexplode(blocks).alias("i", "b"))
    p = p.select("doc_id", "sec", "level", "heading", (F.col("i") + 1).alias("n"), T.strip(F.regexp_replace(F.btrim("b", F.lit("\n")), "\n", " ")).alias("text"))
    return p.withColumn("sentences", T.sentences(F.col("text")))


def location(heading: str = "heading", n: str = "n"):
    """Where a paragraph is: numbered under its heading, or in the document where it has none."""
    where = F.concat(F.lit("paragraph "), F.col(n).cast("string"))
    return F.when(F.coalesce(F.col(heading), F.lit("")) != "", F.concat(F.col(heading), F.lit(", "), where)).otherwise(where)


def heading_paths(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, at (from 0), level, heading and path (the headings above it, outermost first, and itself) of each heading.

    A heading above is one with no heading of its own or a higher level between; read off the row's array of headings.
    """
    h = F.regexp_extract_all(T.unix_lines(F.col(text)), F.lit(HEADING), 1)
    hs = F.transform(h, lambda x: F.struct(F.length(F.regexp_extract(x, "^#+", 0)).alias("level"), T.strip(F.regexp_extract(x, r"^#{1,6}[ \t]+([^\n]*)", 1)).alias("title")))
    d = df.select(F.col(key).alias("doc_id"), hs.alias("h")).select("doc_id", "h", F.posexplode("h").alias("at", "x"))
    above = F.filter(F.transform(F.slice("h", 1, F.col("at")), lambda y, j: F.when(~F.exists(F.slice("h", j + 2, F.col("at") - j), lambda z: z["level"] <= y["level"]), y["title"])), lambda t: t.isNotNull())
    return d.select("doc_id", "at", F.col("x.level").alias("level"), F.col("x.title").alias("heading"), F.concat(above, F.array("x.title")).alias("path"))


def pipe_tables(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (from 0 over the page) and cells of each line between pipes; rules of dashes are left out."""
    lines = F.regexp_extract_all(T.unix_lines(F.col(text)), F.lit(r"(?m)^[^\S\n]*(\|[^\n]*\|)[^\S\n]*$"), 1)
    rows = F.filter(lines, lambda x: ~F.rlike(x, F.lit(r"^\|[\s:|-]*\|\z")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|\z", ""), r"(?<!\\)\|"), T.strip)
    return df.select(F.col(key).alias("doc_id"), F.posexplode(rows).alias("row", "line")).select("doc_id", "row", cells.alias("cells"))


def section_texts(df: DataFrame, title: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The text under each heading that reads ``title`` (ignoring case), up to the next one of its own or a higher level."""
    t = F.concat(F.lit("\n"), T.unix_lines(F.col(text)))
    parts = F.split(F.regexp_replace(t, r"\n(#{1,6}[ \t]+[^\n]*)", "\x01$1"), "\x01")
    level = lambda x: F.length(F.regexp_extract(x, "^(#{1,6})[ \t]", 1))
    d = df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.slice(parts, 2, F.size(parts)).alias("p")).select("doc_id", "p", F.posexplode("p").alias("at", "x"))
    d = d.where(T.normal_loose(F.regexp_extract("x", r"^#{1,6}[ \t]+([^\n]*)", 1)) == title.lower())
    later = F.slice("p", F.col("at") + 2, F.size("p"))
    end = F.coalesce(F.array_min(F.filter(F.transform(later, lambda y, j: F.when(level(y) <= level(F.col("x")), j)), lambda j: j.isNotNull())), F.size(later))
    body = F.concat(F.regexp_replace("x", r"^[^\n]*", ""), F.array_join(F.transform(F.slice(later, 1, end), lambda y: F.concat(F.lit("\n"), y)), ""))
    return d.select("doc_id", "at", T.strip(body).alias("body"))


_FENCE = r" {0,3}(?:```|~~~)"
_LINE = r"[^\S\n]*\S[^\n]*"
#: A fenced block up to its closing fence (any fence line, or the end of the text), else a run of lines that are not blank.
#: Possessive, so that neither a long block nor a long text recurses.
_BLOCK = rf"(?m)^{_FENCE}[^\n]*+(?:\n(?!{_FENCE})[^\n]*+)*+(?:\n{_FENCE}[^\n]*+)?+|^{_LINE}(?:\n{_LINE})*+"


def blocks(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The scoring grammar's blocks: doc_id, pos (from 0), kind (heading, paragraph or other), level, title, number of
    lines and text.

    Lines end at LF only. A fence opened by three backticks or tildes runs through blank lines to any closing fence.
    Indented code, lists, quotes, fences, tables and HTML are ``other``; ATX and two-line setext headings are headings.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    b = df.select(F.col(key).alias("doc_id"), F.regexp_extract_all(t, F.lit(_BLOCK), 0).alias("_b"))
    first = lambda x: F.substring_index(x, "\n", 1)
    n_lines = lambda x: F.regexp_count(x, F.lit("\n")) + 1

    def kind(x):
        h, lines = first(x), n_lines(x)
        return (
            F.when(F.rlike(h, F.lit(r"^(?: {4}|\t)")), "other")
            .when(F.rlike(h, F.lit(r"^ {0,3}#{1,6}(?:[ \t]|$)")), "heading")
            .when(F.rlike(h, F.lit(r"^ {0,3}(?:(?:[-*+]|\d{1,9}[.)])[ \t]|>|```|~~~|\||<)")), "other")
            .when((lines == 2) & F.rlike(x, F.lit(r"\n {0,3}(?:=+|-+)[ \t]*\z")), "heading")
            .otherwise("paragraph")
        )

    out = b.select("doc_id", F.posexplode("_b").alias("pos", "text")).withColumn("kind", kind(F.col("text")))
    atx = F.rlike("text", F.lit(r"^ {0,3}#"))
    level = F.when(atx, F.length(F.regexp_extract("text", r"^ {0,3}(#+)", 1))).otherwise(F.when(F.rlike("text", F.lit(r"\n {0,3}=")), 1).otherwise(2))
    title = F.when(atx, T.strip(F.regexp_replace(F.regexp_extract("text", r"^ {0,3}#{1,6}([^\n]*)", 1), r"[ \t]+#+[ \t]*$|^[ \t]*#+[ \t]*$", ""))).otherwise(T.strip(first(F.col("text"))))
    head = F.col("kind") == "heading"
    return out.select("doc_id", "pos", "kind", F.when(head, level).alias("level"), F.when(head, title).alias("title"), n_lines(F.col("text")).alias("n_lines"), "text")
