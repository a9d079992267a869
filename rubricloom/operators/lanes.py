"""The scripted lane: all checks of a skill over a table of artifacts, as findings of its envelopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import envelope, markup
from rubricloom.operators.checks import argument, clarity, docs, microcopy, toy, usability

_FINDING = ["doc_id", "criterion", "severity", "location", "evidence"]


def _argument(df: DataFrame, key: str, text: str) -> DataFrame:
    return argument.claim_marker(df, key, text).select(*_FINDING).unionByName(argument.hedge_density(df, key, text).select(*_FINDING))


def _usability(df: DataFrame, key: str, text: str) -> DataFrame:
    pages = markup.check(df, key, text).where(F.startswith("criterion", F.lit("NNG-")))
    return usability.check(df, key, text).select(*_FINDING).unionByName(pages.select(*_FINDING))


def _accessibility(df: DataFrame, key: str, text: str) -> DataFrame:
    return markup.check(df, key, text).where(F.startswith("criterion", F.lit("WCAG-")))


def _toy(df: DataFrame, key: str, text: str) -> DataFrame:
    return toy.first_sentences(df, key, text).select(*_FINDING).unionByName(toy.orphans(df, key, text).select("doc_id", "criterion", "severity", "location", F.col("location").alias("evidence")))


#: The checks of each skill.
SKILLS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "critique-clarity": clarity.check,
    "critique-argument": _argument,
    "critique-docs": docs.check,
    "critique-microcopy": microcopy.check,
    "critique-usability": _usability,
    "critique-accessibility": _accessibility,
    "critique-toy": _toy,
}


def run_checks(df: DataFrame, skill: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of one skill's checks: doc_id, criterion, severity, location, evidence, lane scripted, confidence high.

    Locations and evidences are sanitized and cut to the contract's limits. An unknown skill is an error; null texts,
    repeated rows and empty tables behave as in the checks.
    """
    if skill not in SKILLS:
        raise ValueError(f"unknown skill {skill!r}")
    found = SKILLS[skill](df, key, text)
    cut = lambda c: T.sanitize(F.col(c).cast("string"), envelope.LIMITS[c]).alias(c)
    return found.select("doc_id", "criterion", F.col("severity").cast("int").alias("severity"), cut("location"), cut("evidence"), F.lit("scripted").alias("lane"), F.lit("high").alias("confidence"))


def envelopes(df: DataFrame, skill: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The emitted findings of each artifact, ranked, bounded and numbered."""
    found = run_checks(df, skill, key, text)
    return envelope.rank_and_bound(found, ["doc_id"], "evidence")


def own_run(envelopes_: DataFrame, run: dict[str, Column]) -> DataFrame:
    """Envelopes whose run block is overwritten by what the engine itself knows, whatever was claimed."""
    return envelopes_.withColumn("run", _with(F.col("run"), run))


def _with(c: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        c = c.withField(name, value)
    return c
