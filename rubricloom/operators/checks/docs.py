"""Documentation rules: skipped heading levels, long flat lists, and sentences in another mode's register.

All three read arrays within a row; a page's counts come from the array, so nothing is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import prose

#: Thresholds, mode names and sentence openings.
FLAT_ITEMS, LONG_ITEMS = 7, 20
MODES = {"tutorial": "tutorial", "how-to": "how-to", "howto": "how-to", "how_to": "how-to", "reference": "reference", "explanation": "explanation"}
ACTION = ["first,", "next,", "then,", "finally,", "after that,", "once you have", "now,"]
EXPLANATION = ["because", "since", "this is because", "the reason is", "as a result,", "in other words,", "consequently,"]
FOREIGN = {"tutorial": EXPLANATION, "how-to": EXPLANATION, "reference": ACTION + EXPLANATION, "explanation": ACTION}
_ITEM = r"^(\s*)(?:[-*+]|\d+[.)])\s+(.*)$"
CRITERIA = ["DIATAXIS-HEADING-DEPTH", "DIATAXIS-NAV-LENGTH", "DIATAXIS-MODE"]


def _pages(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, declared mode (null if none) and the text after the opening block between --- lines, if there is one."""
    t = F.coalesce(T.unix_lines(F.col(text)), F.lit(""))
    d = df.select(F.col(key).alias("doc_id"), t.alias("_t")).withColumn("_b", F.regexp_extract("_t", r"(?s)\A[^\S\n]*---[^\S\n]*\n(?:.*?\n)??[^\S\n]*---[^\S\n]*(?:\n|\z)", 0))
    raw = F.lower(F.regexp_extract("_b", r'(?im)^\s*mode:\s*"?([A-Za-z][A-Za-z_-]*)"?\s*$', 1))
    mode = F.try_element_at(F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv]), raw)
    return d.select("doc_id", mode.alias("mode"), F.expr("substring(_t, length(_b) + 1)").alias("text"))


def heading_depth(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Headings more than one level below the heading before; severity 3 from two on a page."""
    h = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6}[ \t]+[^\n]*)$"), 1)
    hs = F.transform(h, lambda x: F.struct(F.length(F.regexp_extract(x, "^#+", 0)).alias("level"), T.strip(F.regexp_replace(x, "^#+", "")).alias("title")))
    p = _pages(df, key, text)
    jump = lambda h: F.filter(F.transform(h, lambda x, i: F.struct(F.when(i > 0, F.try_element_at(h, F.greatest(i, F.lit(1)))).alias("a"), x.alias("b"), i.alias("i"))), lambda z: z["b"]["level"] > z["a"]["level"] + 1)
    q = p.withColumn("j", T.let(hs, jump)).where(F.size("j") > 0).withColumn("k", F.size("j")).withColumn("x", F.explode("j"))
    evidence = F.concat(F.lit("level "), F.col("x.a.level").cast("string"), F.lit(" to "), F.col("x.b.level").cast("string"))
    return q.select("doc_id", F.col("x.i").alias("at"), F.lit("DIATAXIS-HEADING-DEPTH").alias("criterion"), F.when(F.col("k") >= 2, 3).otherwise(2).alias("severity"), F.concat(F.lit("the "), F.col("x.b.title"), F.lit(" heading")).alias("location"), evidence.alias("evidence"))


def lists(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lists of a page: section, heading, items at the top level and nested items.

    A list goes on over blank lines before another item, and over lines indented deeper than its first item.
    """
    s = prose.sections(_pages(df, key, text), "doc_id", "text")
    run = r"(?m)^[^\S\n]*(?:[-*+]|\d+[.)])[^\S\n]+[^\n]*(?:\n(?:[^\S\n]*\n)*+[^\S\n]*(?:[-*+]|\d+[.)])[^\S\n]+[^\n]*|\n[^\S\n]+[^\s][^\n]*)*+"
    x = s.select("doc_id", "sec", "heading", F.posexplode(F.regexp_extract_all("body", F.lit(run), 0)).alias("n", "block"))
    items = F.filter(F.split("block", "\n"), lambda l: F.rlike(l, F.lit(_ITEM)))
    dents = F.transform(items, lambda l: F.length(F.regexp_extract(l, r"^(\s*)", 1)))
    x = x.withColumn("k", T.let(dents, lambda d: F.struct(F.size(F.filter(d, lambda v: v <= d[0])).alias("top"), F.size(F.filter(d, lambda v: v > d[0])).alias("nested"))))
    return x.select("doc_id", "sec", "heading", "n", "k.top", "k.nested")


def nav_length(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lists of more than seven top-level items without any nesting; severity 3 above twenty."""
    q = lists(df, key, text).where(f"top > {FLAT_ITEMS} AND nested = 0")
    place = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("the list under "), "heading")).otherwise(F.lit("the list before the first heading"))
    return q.select("doc_id", F.col("sec").alias("at"), F.lit("DIATAXIS-NAV-LENGTH").alias("criterion"), F.when(F.col("top") > LONG_ITEMS, 3).otherwise(2).alias("severity"), place.alias("location"), F.concat(F.col("top").cast("string"), F.lit(" flat items")).alias("evidence"))


def mode(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sentences of paragraphs and list items that open in another register than the page declares; 3 from two on a page."""
    p = _pages(df, key, text).where("mode IS NOT NULL")
    body = F.regexp_replace("text", prose.HEADING, "\n\n")
    units = F.filter(F.split(F.regexp_replace(body, r"(?m)^[^\S\n]*(?:[-*+]|\d+[.)])[^\S\n]+", "\n\n"), r"\n(?:[^\S\n]*\n)++"), lambda b: T.strip(b) != "")
    sents = F.flatten(F.transform(units, lambda u: T.sentences(F.regexp_replace(u, r"\s*\n\s*", " "))))

    def foreign(s: Column) -> Column:
        out = F.lit(False)
        for m, marks in FOREIGN.items():
            test = reduce(lambda a, b: a | b, [F.rlike(F.lower(s), F.lit(rf"^\Q{k}\E(?:[^\p{{L}}\p{{N}}]|$)")) for k in marks])
            out = F.when(F.col("mode") == m, test).otherwise(out)
        return out

    q = p.withColumn("h", F.filter(sents, foreign)).where(F.size("h") > 0).withColumn("k", F.size("h")).select("doc_id", "mode", "k", F.posexplode("h").alias("at", "s"))
    return q.select("doc_id", "at", F.lit("DIATAXIS-MODE").alias("criterion"), F.when(F.col("k") >= 2, 3).otherwise(2).alias("severity"), F.concat(F.lit("a "), "mode", F.lit(" page")).alias("location"), F.col("s").alias("evidence"))


def check(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return heading_depth(df, key, text).unionByName(nav_length(df, key, text)).unionByName(mode(df, key, text))
