"""Fixture rules: a passive or hedged first sentence of a paragraph, and a heading without a body."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import prose

#: The fixture grammar's hedged openings and passive phrases.
HEDGES = ["it may possibly be the case that", "it could perhaps be argued that"]
PASSIVES = ["is reviewed", "is filed", "is closed", "is signed off on"]


def first_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """TOY-ACTIVE and TOY-HEDGE over each paragraph's first sentence; paragraphs are numbered over the document."""
    p = prose.paragraphs(df, key, text).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("sec", "n"))).where(F.size("sentences") > 0).withColumn("s", F.col("sentences")[0])
    some = lambda tests: reduce(lambda a, b: a | b, tests)
    active, hedged = some([F.contains("s", F.lit(x)) for x in PASSIVES]), some([F.startswith(F.lower("s"), F.lit(x)) for x in HEDGES])
    rules = F.explode(F.array_compact(F.array(F.when(active, "TOY-ACTIVE"), F.when(hedged, "TOY-HEDGE"))))
    place = F.concat(F.when(F.coalesce("heading", F.lit("")) != "", F.concat("heading", F.lit(", "))).otherwise(F.lit("")), F.lit("paragraph "), F.col("k").cast("string"), F.lit(", first sentence"))
    return p.select("doc_id", "sec", "n", rules.alias("criterion"), F.lit(2).alias("severity"), place.alias("location"), F.col("s").alias("evidence"))


def orphans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """TOY-ORPHAN: headings below level 1 with no paragraph before the next heading of the same or a higher level.

    The sections of a document are one array again, so the look-ahead is an array search within the row.
    """
    s = prose.sections(df, key, text).withColumn("words", T.words(F.col("body")))
    g = s.where("heading IS NOT NULL").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sec", "level", "heading", "words"))).alias("h"))
    later = lambda i: F.slice("h", i + 2, F.size("h"))
    end = lambda x, i: F.coalesce(F.array_min(F.filter(F.transform(later(i), lambda y, j: F.when(y["level"] <= x["level"], j)), lambda j: j.isNotNull())), F.size(later(i)))
    empty = F.filter(F.transform("h", lambda x, i: F.struct(x.alias("x"), F.aggregate(F.slice(later(i), 1, end(x, i)), x["words"], lambda a, y: a + y["words"]).alias("k"))), lambda z: (z["k"] == 0) & (z["x"]["level"] > 1))
    return g.select("doc_id", F.explode(empty).alias("z")).select("doc_id", F.col("z.x.sec").alias("sec"), F.lit("TOY-ORPHAN").alias("criterion"), F.lit(3).alias("severity"), F.concat(F.lit("the "), "z.x.heading", F.lit(" heading")).alias("location"))
