"""Argument rules, one finding a document at most: no marked conclusion, and hedging in too many sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators.checks import lexicons as L
from rubricloom.operators.prose import HEADING

CRITERIA = ["TOULMIN-CLAIM-MARKER", "TOULMIN-HEDGE-DENSITY"]


def _documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each text's prose (headings without marks), its paragraphs' sentences and where it is found."""
    t = F.coalesce(T.unix_lines(F.col(text)), F.lit(""))
    blocks = F.filter(F.split(F.regexp_replace(t, HEADING, "\n\n$1\n\n"), r"\n(?:[^\S\n]*\n)++"), lambda b: T.strip(b) != "")
    flat = F.transform(blocks, lambda b: T.strip(F.regexp_replace(F.btrim(b, F.lit("\n")), "\n", " ")))
    d = df.select(F.col(key).alias("doc_id"), flat.alias("b"))
    is_head = lambda b: T.has(b, r"^#{1,6}[ \t]+|^#{1,6}$")
    top = F.filter("b", lambda b: T.has(b, r"^#[ \t]+"))
    name = F.regexp_replace(F.try_element_at(top, F.lit(1)), r"^#[ \t]+", "")
    prose_ = F.array_join(F.transform("b", lambda b: F.regexp_replace(b, r"^#{1,6}[ \t]+", "")), " ")
    s = F.flatten(F.transform(F.filter("b", lambda b: ~is_head(b)), T.sentences))
    where = F.when(name.isNotNull(), F.concat(F.lit('the whole document, under its "'), name, F.lit('" heading'))).otherwise(F.lit("the whole document, starting at line 1"))
    return d.select("doc_id", prose_.alias("prose"), s.alias("sentences"), where.alias("location"))


def claim_marker(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Prose without any phrase that marks a conclusion; severity 3 from 300 words on."""
    d = _documents(df, key, text).where((T.strip(F.col("prose")) != "") & ~T.has(F.col("prose"), T.lexicon(L.CLAIM_MARKERS)))
    n = T.count(F.col("prose"), r"\S*\w\S*")
    return d.select("doc_id", F.lit("TOULMIN-CLAIM-MARKER").alias("criterion"), F.when(n >= 300, 3).otherwise(2).alias("severity"), "location", F.concat(F.lit("no conclusion marker in "), n.cast("string"), F.lit(" words")).alias("evidence"))


def hedge_density(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """More than 0.35 of the sentences hedge; severity 3 above 0.50."""
    hedged = F.size(F.filter("sentences", lambda s: T.has(s, T.lexicon(L.HEDGES))))
    d = _documents(df, key, text).withColumns({"h": hedged, "k": F.size("sentences")}).where("h > 0.35 * k")
    return d.select("doc_id", F.lit("TOULMIN-HEDGE-DENSITY").alias("criterion"), F.when(F.expr("h > 0.5 * k"), 3).otherwise(2).alias("severity"), "location", F.concat(F.col("h").cast("string"), F.lit(" of "), F.col("k").cast("string"), F.lit(" sentences hedge")).alias("evidence"))
