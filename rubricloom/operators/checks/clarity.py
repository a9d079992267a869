"""Clarity rules over prose: fifteen checks over one parse of the texts.

A row of the parse is a sentence beside what its rules need of its paragraph, section and document; sections without
paragraphs give one row too. Every rule is a test, a severity and an evidence over such a row, so all rules together are
one scan and one generate, and no check shuffles. Every finding has doc_id, sec, n, criterion, severity, location and
evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import prose
from rubricloom.operators.checks import lexicons as L

SECTION_SOFT, SECTION_HARD = 400, 800


def rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each sentence: doc_id, mixed (two unclear duties beside a clear one in the document), sec, heading,
    sec_words, marks (of each paragraph of the section, whether it opens or goes on with a transition), n, text, sentences,
    at, s. The first row of a paragraph has at 0, the first of a section n 1."""
    t = F.col(text)
    mixed = (T.count(t, T.lexicon(L.NON_MUST)) >= 2) & T.has(t, T.lexicon(["must", "should"]))
    d = df.select(F.struct(F.col(key).alias("id"), mixed.alias("mixed")).alias("k"), t.alias("text"))
    s = prose.sections(d, "k", "text")
    start = rf"(?i)^(?:{T.alternation(L.TRANSITIONS)})\b"
    blocks = F.filter(F.split("body", r"\n(?:[^\S\n]*\n)++"), lambda b: T.strip(b) != "")
    s = s.withColumn("ps", F.transform(blocks, lambda b: T.strip(F.regexp_replace(F.btrim(b, F.lit("\n")), "\n", " "))))
    marks = F.array_join(F.transform("ps", lambda b, i: F.when((i == 0) | T.has(b, start), "T").otherwise("F")), "")
    s = s.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.mixed").alias("mixed"), "sec", "heading", T.words(F.col("body")).alias("sec_words"), marks.alias("marks"), F.posexplode_outer("ps").alias("_i", "text"))
    p = s.withColumn("n", F.coalesce(F.col("_i"), F.lit(0)) + 1).withColumn("sentences", T.sentences(F.col("text"))).drop("_i")
    return p.select("*", F.posexplode_outer("sentences").alias("_j", "s")).withColumn("at", F.coalesce(F.col("_j"), F.lit(0))).drop("_j")


def _content(c: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), 1), lambda w: (F.length(w) > 2) & ~w.isin(L.STOPWORDS))


def _head(item: Column, first: Column) -> Column:
    t = F.when(first, F.regexp_replace(item, rf"(?is)^.*\b(?:{'|'.join(L.INTRODUCERS)})\s+", "")).otherwise(item)
    w = F.filter(F.split(T.strip(t), r"\s+"), lambda x: x != "")
    head = F.regexp_replace(F.lower(w[0]), "^[.,;:]+|[.,;:]+$", "")
    return F.when(F.size(w) == 0, "other").when((head == "to") & (F.size(w) > 1), "infinitive").when(T.has(head, "^[a-z]+ing$"), "gerund").otherwise("other")


def _measures(r: DataFrame) -> DataFrame:
    """``r`` with the counts that several rules share, each made once."""
    k, m = T.asides(F.col("s"))
    r = r.withColumns({"items": T.series(F.col("s")), "w": T.words(F.col("s")), "sub": T.count(F.col("s"), T.lexicon(L.SUBORDINATORS)), "aside": F.struct(k.alias("k"), m.alias("m")), "neg": T.count(F.col("s"), T.lexicon(L.NEGATIONS)), "steps": T.count(F.col("s"), L.STEPS)})
    first = F.when(F.col("at") == 0, F.array_distinct(_content(F.col("s"))))
    rest = F.when(F.col("at") == 0, _content(F.array_join(F.slice("sentences", 2, F.size("sentences")), " ")))
    m3 = F.size("sentences") >= 3
    alone = m3 & (F.size(first) > 0) & (F.try_divide(F.size(F.array_intersect(first, rest)), F.size(first)) < 0.15)
    left = F.length(F.substring_index(F.left("marks", F.col("n")), "T", -1))
    right = F.length(F.substring_index(F.expr("substring(marks, n)"), "T", 1))
    return r.withColumns({"alone": F.coalesce(alone, F.lit(False)), "k": F.when(F.col("at") == 0, T.words(F.col("text"))), "run": left + right - 1})


def _rules() -> dict[str, list[tuple[Column, Column, Column]]]:
    """Test, severity and evidence of each rule over the measured rows."""
    s, n_all = F.col("s"), F.size("sentences")
    hard = lambda test: F.when(test, 3).otherwise(2)

    def dense(pattern: str, share: float) -> list[tuple[Column, Column, Column]]:
        hits = F.size(F.filter("sentences", lambda x: T.has(x, pattern)))
        return [(T.has(s, pattern), hard((n_all >= 3) & (F.try_divide(hits, n_all) >= share)), s)]

    wordy, jargon = T.lexicon(L.WORDY), T.lexicon(L.JARGON)
    defined = lambda x, next_: reduce(lambda a, b: a | b, [F.contains(F.lower(F.concat_ws(" ", x, next_)), F.lit(d)) for d in L.DEFINITIONS]) | F.contains(x, F.lit("("))
    plain = lambda x, next_: T.has(x, jargon) & ~defined(x, next_)
    undefined = lambda ss: F.size(F.filter(F.transform(ss, lambda x, i: plain(x, F.get(ss, i + 1))), lambda ok: ok))
    head, once = F.col("heading").isNotNull() & (F.col("n") == 1) & (F.col("at") == 0), F.col("at") == 0
    classes = F.array_distinct(F.transform("items", lambda x, i: _head(x, i == 0)))
    few, k, m = F.size("items") < 3, F.col("aside.k"), F.col("aside.m")
    return {
        "PLAIN-ACTIVE": dense(L.PASSIVE, 0.75),
        "PLAIN-CONCISE": [(T.has(s, wordy), hard(F.aggregate("sentences", F.lit(0), lambda a, x: a + T.count(x, wordy)) >= 3), s)],
        "PLAIN-DOUBLE-NEGATIVE": [(F.col("neg") >= 2, hard(F.col("neg") >= 3), s)],
        "PLAIN-HEADINGS": [
            (head & F.lower("heading").isin(L.VAGUE_HEADINGS), F.lit(2), F.concat(F.lit("heading: "), F.col("heading"))),
            (head & (F.col("sec_words") > SECTION_SOFT), hard(F.col("sec_words") > SECTION_HARD), F.concat(F.col("sec_words").cast("string"), F.lit(" words up to the next heading"))),
        ],
        "PLAIN-JARGON": [(plain(s, F.get("sentences", F.col("at") + 1)), hard(T.let(F.col("sentences"), undefined) >= 3), s)],
        "PLAIN-LISTS": [((F.size("items") >= 3) | (F.col("steps") >= 3), hard((F.size("items") >= 5) | (F.col("steps") >= 5)), s)],
        "PLAIN-MUST": [(T.has(s, T.lexicon(L.NON_MUST)), hard(F.col("mixed")), s)],
        "PLAIN-NOMINALIZATION": dense(L.NOMINAL, 0.8),
        "PLAIN-PARAGRAPH": [(once & (n_all > 0) & (F.col("alone") | (F.col("k") > 150)), hard(F.col("alone")), F.when(F.col("alone"), s).otherwise(F.concat(F.col("k").cast("string"), F.lit(" words in one paragraph"))))],
        "PLAIN-PRONOUNS": dense(T.lexicon(L.SUBSTITUTES), 0.75),
        "PLAIN-SENTENCE-LENGTH": [((F.col("w") > 30) | (F.col("sub") > 3), hard((F.col("w") >= 50) | (F.col("sub") >= 4)), s)],
        "PLAIN-SUBJECT-VERB-OBJECT": [(few & ((k >= 2) | (m >= 6)), hard((k >= 2) & (m >= 15)), s)],
        "PLAIN-TRANSITIONS": [(once & (F.expr("substring(marks, n, 1)") == "F"), hard(F.col("run") >= 4), T.first_words(F.col("text"), 12))],
        "WILLIAMS-PARALLELISM": [((F.size("items") >= 2) & (F.size(classes) >= 2), hard((F.size("items") >= 4) & (F.size(classes) >= 3)), s)],
        "WILLIAMS-SHAPE": [((F.col("w") >= 40) & few & ((k >= 2) | (F.col("sub") >= 2)), hard(F.col("w") >= 60), s)],
    }


CRITERIA = [
    "PLAIN-ACTIVE", "PLAIN-CONCISE", "PLAIN-DOUBLE-NEGATIVE", "PLAIN-JARGON", "PLAIN-LISTS", "PLAIN-NOMINALIZATION", "PLAIN-PARAGRAPH",
    "PLAIN-PRONOUNS", "PLAIN-SENTENCE-LENGTH", "PLAIN-SUBJECT-VERB-OBJECT", "WILLIAMS-PARALLELISM", "WILLIAMS-SHAPE",
    "PLAIN-HEADINGS", "PLAIN-MUST", "PLAIN-TRANSITIONS",
]


def findings(parsed: DataFrame, criteria: list[str]) -> DataFrame:
    """Findings of the given rules over ``rows``."""
    rules, about = _rules(), F.concat(F.lit("the "), F.col("heading"), F.lit(" heading"))
    out = []
    for c in criteria:
        heading = c == "PLAIN-HEADINGS"
        for test, severity, evidence in rules[c]:
            out.append(F.when(test, F.struct((F.lit(0) if heading else F.col("n")).alias("n"), F.lit(c).alias("criterion"), severity.cast("int").alias("severity"), (about if heading else prose.location()).alias("location"), evidence.alias("evidence"))))
    return _measures(parsed).select("doc_id", "sec", F.inline(F.array_compact(F.array(*out))))


def run(df: DataFrame, criterion: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of one clarity rule over the texts of ``df``."""
    return findings(rows(df, key, text), [criterion])


def check(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of all clarity rules, from one parse."""
    return findings(rows(df, key, text), CRITERIA)
