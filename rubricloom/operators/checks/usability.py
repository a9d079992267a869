"""Usability rules over markdown: dead-end states, labels that vary for one action, and lists of controls without names.

A state is a level-2 section with the deeper ones under it. All rules read arrays within a page's row or group by page.
The rules over pages of HTML are with the markup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import prose
from rubricloom.operators.markup import CONTROLS

#: Names that say only what kind of control something is.
ROLE_NOUNS = ["button", "link", "icon", "field", "toggle", "checkbox", "menu", "control", "input", "dropdown", "tab"]
_LINK = r"\[([^\]]+)\]\(([^)]*)\)"
_PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~ “”‘’""" + "\t\r\n"
_ITEM = r"(?m)^[^\S\n]*(?:[-*+]|\d+[.)])[^\S\n]+([^\n]*)"


def anchors(headings: Column) -> Column:
    """GitHub anchors of an array of headings in order; a repeated one takes -1, -2 and so on."""
    base = F.transform(headings, lambda h: F.coalesce(F.nullif(F.regexp_replace(F.btrim(F.regexp_replace(T.slug(h), "-{2,}", "-"), F.lit("-")), "^$", ""), F.lit("")), F.lit("section")))
    nth = lambda b: F.transform(b, lambda x, i: F.struct(x.alias("x"), F.size(F.filter(F.slice(b, 1, i), lambda y: y == x)).alias("k")))
    return F.transform(T.let(base, nth), lambda z: F.when(z["k"] == 0, z["x"]).otherwise(F.concat(z["x"], F.lit("-"), z["k"].cast("string"))))


def states(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, pos, label, anchor and links (anchors linked to from inside) of each state."""
    t = F.concat(F.lit("\n"), T.unix_lines(F.col(text)))
    parts = df.where(F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.split(F.regexp_replace(t, r"\n(##[ \t][^\n]*)", "\x01$1"), "\x01").alias("p"))
    inner = F.slice("p", 2, F.size("p"))
    # a heading of level 1 does not end a state, as only level 2 begins one
    heads = F.transform(inner, lambda x: T.strip(F.regexp_extract(x, r"^##[ \t]+([^\n]*)", 1)))
    links = lambda x: F.transform(F.filter(F.regexp_extract_all(F.regexp_replace(x, r"^[^\n]*", ""), F.lit(_LINK), 2), lambda u: F.startswith(T.strip(u), F.lit("#"))), lambda u: F.substring(T.strip(u), 2, 1_000_000_000))
    s = parts.select("doc_id", heads.alias("h"), F.transform(inner, links).alias("l")).withColumn("a", anchors(F.col("h")))
    return s.select("doc_id", F.posexplode(F.arrays_zip("h", "a", "l")).alias("pos", "x")).select("doc_id", "pos", F.col("x.h").alias("label"), F.col("x.a").alias("anchor"), F.col("x.l").alias("links"))


def dead_ends(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """NNG-H3-DEADEND: states of pages with two or more that link to no other; 3 where others lead there."""
    g = states(df, key, text).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "label", "anchor", "links"))).alias("s")).where(F.size("s") >= 2)
    out = lambda x: F.filter(x["links"], lambda u: (u != x["anchor"]) & F.exists("s", lambda y: y["anchor"] == u))
    ways_in = lambda x: F.aggregate("s", F.lit(0), lambda k, y: k + F.when(y["anchor"] != x["anchor"], F.size(F.filter(y["links"], lambda u: u == x["anchor"]))).otherwise(0))
    bad = F.transform(F.filter("s", lambda x: F.size(out(x)) == 0), lambda x: F.struct(x["pos"].alias("pos"), x["label"].alias("label"), ways_in(x).alias("k")))
    q = g.select("doc_id", F.inline(bad))
    return q.select("doc_id", F.lit("NNG-H3-DEADEND").alias("criterion"), F.when(F.col("k") > 0, 3).otherwise(2).alias("severity"), F.concat(F.lit("the "), "label", F.lit(" state")).alias("location"), F.concat(F.col("k").cast("string"), F.lit(" ways in")).alias("evidence"))


def canonical(c: Column) -> Column:
    """A label without case, surrounding punctuation and a final ellipsis."""
    t = T.strip(F.regexp_replace(T.strip(c), r"(?:\.\.\.|…)\s*$", ""))
    return F.lower(F.regexp_replace(F.btrim(t, F.lit(_PUNCTUATION)), r"\s+", " "))


def control_naming(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """NNG-H4-CONTROL-NAMING over markdown links: two or more labels of one action on a page; 3 from three."""
    t = T.unix_lines(F.col(text))
    labels = F.transform(F.regexp_extract_all(t, F.lit(_LINK), 1), lambda x: canonical(F.regexp_replace(x, "[*_`]", "")))
    d = df.where(F.contains(F.col(text), F.lit("]("))).select(F.col(key).alias("doc_id"), labels.alias("l"))
    each = [_action(a) for a in CONTROLS]
    q = d.select("doc_id", F.inline(F.array(*each))).where(F.size("names") >= 2)
    return q.select("doc_id", F.lit("NNG-H4-CONTROL-NAMING").alias("criterion"), F.when(F.size("names") >= 3, 3).otherwise(2).alias("severity"), F.col("action").alias("location"), F.array_join("names", ", ").alias("evidence"))


def _action(name: str) -> Column:
    return F.struct(F.lit(name).alias("action"), F.array_sort(F.array_distinct(F.filter("l", lambda x: x.isin(CONTROLS[name])))).alias("names"))


def bare_controls(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """NNG-H6-LABELED over markdown: items of lists under headings on controls or fields that name only a kind of control;
    3 where no item of the section says more."""
    s = prose.sections(df, key, text).where(F.contains(F.lower("heading"), F.lit("control")) | F.contains(F.lower("heading"), F.lit("field")))
    bare = lambda x: F.lower(F.btrim(F.regexp_replace(F.regexp_replace(T.strip(F.regexp_replace(x, "[*_`]", "")), r"(?i)^(?:a|an|the)\s+", ""), r"(?i)\s+(?:control|field)$", ""), F.lit(" .:;,")))
    items = F.transform(F.regexp_extract_all("body", F.lit(_ITEM), 1), lambda x, i: F.struct((i + 1).alias("n"), T.strip(x).alias("text"), bare(x).isin(ROLE_NOUNS).alias("bare")))
    q = s.select("doc_id", "sec", "heading", items.alias("x")).withColumn("hits", F.filter("x", lambda x: x["bare"])).where(F.size("hits") > 0)
    q = q.select("doc_id", "sec", "heading", (F.size("hits") == F.size("x")).alias("all"), F.explode("hits").alias("h"))
    return q.select("doc_id", F.lit("NNG-H6-LABELED").alias("criterion"), F.when(F.col("all"), 3).otherwise(2).alias("severity"), F.concat(F.lit("the "), "heading", F.lit(" list, item "), F.col("h.n").cast("string")).alias("location"), F.col("h.text").alias("evidence"))


def check(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rules over pages that are no HTML."""
    d = df.where(~F.startswith(F.ltrim(F.col(text)), F.lit("<")))
    return dead_ends(d, key, text).unionByName(control_naming(d, key, text)).unionByName(bare_controls(d, key, text))
