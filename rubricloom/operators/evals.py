"""Conformance of skills and examples, routing trials, and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lanes(declared: DataFrame, implemented: DataFrame) -> DataFrame:
    """Declared and implemented criteria that lack their counterpart."""
    a, b = declared.select("criterion").distinct(), implemented.select("criterion").distinct()
    return a.exceptAll(b).withColumn("problem", F.lit("not implemented")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("not declared")))


def modal(trials: DataFrame, key: list[str], answer: str, order: str) -> DataFrame:
    """The most frequent answer of each case, the first seen among equals, and whether all trials agree."""
    n = trials.groupBy(*key, answer).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*key)
    best = n.withColumns({"r": F.row_number().over(w.orderBy(F.desc("n"), "first")), "n_answers": F.count(F.lit(1)).over(w)}).where("r = 1")
    return best.select(*key, answer, "n", (F.col("n_answers") == 1).alias("unanimous"))


def totals(df: DataFrame, by: str, correct: str) -> DataFrame:
    """Right and all cases by kind, with a row over all (null kind)."""
    return df.rollup(by).agg(F.count_if(correct).alias("n_correct"), F.count(F.lit(1)).alias("n_cases"))


def example_rules(examples: DataFrame, group: str) -> DataFrame:
    """Groups with too few golden (3) or anti (1) examples, and golden examples whose note is under 40 characters."""
    g = examples.groupBy(group).agg(F.count_if(F.col("kind") == "golden").alias("n_golden"), F.count_if(F.col("kind") == "anti").alias("n_anti"), F.count_if((F.col("kind") == "golden") & (F.length("note") < 40)).alias("n_short_notes"))
    return g.withColumn("passes", (F.col("n_golden") >= 3) & (F.col("n_anti") >= 1) & (F.col("n_short_notes") == 0))


def grid(skills: DataFrame, artifacts: DataFrame, tiers: list[str], k: int) -> DataFrame:
    """The plan of runs: every artifact of a skill's domain, tier, repetition and condition."""
    cells = skills.join(artifacts, "domain").withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers])))
    return cells.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("condition", F.explode(F.array(F.lit("skill"), F.lit("baseline"))))


def version_drift(df: DataFrame, name: str, version: str) -> DataFrame:
    """Names that carry more than one version."""
    return df.groupBy(name).agg(F.array_sort(F.collect_set(version)).alias("versions")).where(F.size("versions") > 1)


def triggers(cases: DataFrame, skill: str = "skill", expected: str = "expected", domain: str = "domain", own: str = "own_domain") -> DataFrame:
    """Routing cases of each skill: all, those that should and should not trigger it, those from another domain, and
    whether there are enough (20, 1, 3 and 3)."""
    no = ~F.coalesce(F.col(expected), F.lit(False))
    g = cases.groupBy(skill).agg(F.count(F.lit(1)).alias("n_cases"), F.count_if(F.coalesce(F.col(expected), F.lit(False))).alias("n_positive"), F.count_if(no).alias("n_negative"), F.count_if(no & (F.col(domain) != F.col(own))).alias("n_cross"))
    return g.withColumn("passes", (F.col("n_cases") >= 20) & (F.col("n_positive") >= 1) & (F.col("n_negative") >= 3) & (F.col("n_cross") >= 3))


def long_quotes(df: DataFrame, key: str, text: str, most: int = 25) -> DataFrame:
    """Quoted spans of more than ``most`` words in one line, with their words: copied rather than paraphrased."""
    spans = F.concat(F.regexp_extract_all(text, F.lit("“([^”\\n]*)”"), 1), F.regexp_extract_all(text, F.lit('"([^"\\n]*)"'), 1))
    q = df.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(spans).alias("at", "span")).withColumn("n_words", F.regexp_count("span", F.lit(r"\S+")))
    return q.where(F.col("n_words") > most).select(key, "at", "n_words")


def lengths(df: DataFrame, key: str, text: str, most: int = 500) -> DataFrame:
    """Lines of each page and whether it stays within ``most``; a final line feed ends no further line."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.when(t == "", 0).otherwise(F.regexp_count(F.regexp_replace(t, r"\n\z", ""), F.lit(r"\n")) + 1)
    return df.select(F.col(key), n.cast("long").alias("n_lines"), (n <= most).alias("passes"))


def frontmatter_rules(pages: DataFrame, key: str, fields: str) -> DataFrame:
    """Problems of a page's frontmatter (``fields``: a map): missing name, version or description, a name or version out
    of grammar, a description out of 20 to 1024 characters, criteria in both lanes or in none."""
    get = lambda k: F.nullif(F.btrim(F.try_element_at(fields, F.lit(k))), F.lit(""))
    name, version, about = get("name"), get("version"), get("description")
    ids = lambda k: F.filter(F.split(F.regexp_replace(F.coalesce(get(k), F.lit("")), r"[\[\]\s\"']", ""), ","), lambda x: x != "")
    a, b = ids("scripted"), ids("judged")
    out = [F.when(v.isNull(), F.lit(f"{n} is missing")) for n, v in (("name", name), ("version", version), ("description", about))]
    out += [F.when(~F.rlike(name, F.lit(r"^[a-z0-9]+(?:-[a-z0-9]+)*\z")), F.lit("name is no slug")), F.when(~F.rlike(version, F.lit(r"^\d+\.\d+\.\d+\z")), F.lit("version is not semantic"))]
    out += [F.when(~F.length(about).between(20, 1024), F.lit("description is too short or too long")), F.when(F.arrays_overlap(a, b), F.lit("a criterion is in both lanes")), F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit("both lanes are empty"))]
    return pages.select(F.col(key), F.explode(F.array_compact(F.array(*out))).alias("problem"))


def drift(committed: DataFrame, generated: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """Generated pages against the committed ones: same, stale, missing or untracked."""
    a, b = committed.select(key, F.sha2(text, 256).alias("_a"), F.lit(1).alias("_x")), generated.select(key, F.sha2(text, 256).alias("_b"), F.lit(1).alias("_y"))
    j = a.join(b, key, "full_outer")
    return j.select(key, F.when(F.col("_x").isNull(), "missing").when(F.col("_y").isNull(), "untracked").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("stale").alias("status"))
