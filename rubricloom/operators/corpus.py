"""Seeded-defect corpus: keyed random streams, document generation with planted defects, leak rules and verification.

A document is a pure function of its recipe's key, so generation is a narrow map over a table of recipes and any lost
part is made again byte for byte.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T

#: Shingle length and path words that would give a defect away.
SHINGLE = 6
BANNED = ["clean", "defect", "seed", "plant", "bug"]
#: Longest criterion id that the contract allows.
LONGEST_ID = 64


class Dice:
    """Draws from the Philox counter generator under a key made of a seed and a purpose, so a document depends on its own
    recipe alone; only raw 64-bit words are used, which every platform and version gives alike."""

    def __init__(self, *purpose: object) -> None:
        key = hashlib.sha256(json.dumps([str(p) for p in purpose]).encode()).digest()
        self._purpose, self._words = purpose, np.random.Philox(key=np.frombuffer(key[:16], np.uint64))

    def upto(self, n: int) -> int:
        """A number from 0 to n - 1; the high half of the product with a 64-bit word."""
        if n < 1:
            raise ValueError("nothing to choose from")
        return int(self._words.random_raw()) * n >> 64

    def pick(self, options: list):
        return options[self.upto(len(options))]

    def some(self, options, k: int) -> list:
        """k different options in random order."""
        left = list(options)
        return [left.pop(self.upto(len(left))) for _ in range(min(k, len(left)))]

    def about(self, *more: object) -> Dice:
        """Dice of their own for a part of the work."""
        return Dice(*self._purpose, *more)


#: Injectors by criterion: each turns a paragraph's sentences into ones that break the rule.
INJECTORS: dict[str, Callable[[Dice, list[str]], list[str]]] = {}


def injector(criterion: str):
    def add(f):
        if criterion in INJECTORS:
            raise ValueError(f"{criterion} has an injector")
        INJECTORS[criterion] = f
        return f

    return add


_WHO = ["clerk", "driver", "editor", "founder", "porter", "tenant"]
_DO = ["signs", "sends", "keeps", "reads", "moves", "counts"]
_WHAT = ["form", "ledger", "notice", "parcel", "permit", "report"]
_WHEN = ["before noon", "every week", "after the break", "on request"]


def _sentence(r: Dice) -> str:
    return f"The {r.pick(_WHO)} {r.pick(_DO)} the {r.pick(_WHAT)} {r.pick(_WHEN)}."


@injector("PLAIN-ACTIVE")
def _active(r: Dice, s: list[str]) -> list[str]:
    return [f"The {r.pick(_WHAT)} was signed {r.pick(_WHEN)}.", *s[1:]]


@injector("PLAIN-CONCISE")
def _concise(r: Dice, s: list[str]) -> list[str]:
    return [*s[:-1], f"In order to go on, the {r.pick(_WHO)} keeps the {r.pick(_WHAT)}."]


@injector("PLAIN-DOUBLE-NEGATIVE")
def _double(r: Dice, s: list[str]) -> list[str]:
    return [*s[:-1], f"No {r.pick(_WHO)} is unable to keep the {r.pick(_WHAT)}."]


@injector("PLAIN-JARGON")
def _jargon(r: Dice, s: list[str]) -> list[str]:
    return [*s[:-1], f"Notwithstanding the {r.pick(_WHAT)}, the {r.pick(_WHO)} goes on."]


@injector("PLAIN-MUST")
def _must(r: Dice, s: list[str]) -> list[str]:
    return [*s[:-1], f"The {r.pick(_WHO)} shall keep the {r.pick(_WHAT)}."]


@injector("PLAIN-NOMINALIZATION")
def _nominal(r: Dice, s: list[str]) -> list[str]:
    return [*s[:-1], f"We make a decision on the {r.pick(_WHAT)}."]


@injector("PLAIN-PRONOUNS")
def _pronoun(r: Dice, s: list[str]) -> list[str]:
    return [*s[:-1], f"The applicant keeps the {r.pick(_WHAT)}."]


@injector("PLAIN-LISTS")
def _lists(r: Dice, s: list[str]) -> list[str]:
    a, b, c = r.some(_WHAT, 3)
    return [*s[:-1], f"Bring the {a}, the {b}, and the {c}."]


@injector("PLAIN-SENTENCE-LENGTH")
def _length(r: Dice, s: list[str]) -> list[str]:
    more = " and then ".join(f"the {r.pick(_WHO)} {r.pick(_DO)} the {r.pick(_WHAT)}" for _ in range(6))
    return [*s[:-1], more[0].upper() + more[1:] + "."]


def generate(seed: str, recipe: int) -> tuple[str, list[tuple[str, str, int]]]:
    """A document and its planted defects (criterion, heading, paragraph under it), at most one a section."""
    r = Dice(seed, "recipe", recipe)
    sections = []
    for k in range(3 + r.upto(3)):
        paragraphs = [[_sentence(r) for _ in range(2 + r.upto(3))] for _ in range(2 + r.upto(3))]
        sections.append((f"{r.pick(_WHAT).title()} {r.pick(['Steps', 'Terms', 'Times'])} {k + 1}", paragraphs))
    plants = []
    for at, criterion in zip(r.some(range(len(sections)), 2), r.about("plants").some(sorted(INJECTORS), 2)):
        head, paragraphs = sections[at]
        n = r.upto(len(paragraphs))
        paragraphs[n] = INJECTORS[criterion](r.about(criterion), paragraphs[n])
        plants.append((criterion, head, n + 1))
    text = f"# Page {recipe}\n\n" + "\n\n".join(f"## {h}\n\n" + "\n\n".join(" ".join(p) for p in ps) for h, ps in sections) + "\n"
    return text, sorted(plants)


def build(recipes: DataFrame, seed: str, key: str = "recipe") -> DataFrame:
    """Documents of a table of recipe numbers with their hash and defects."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = [generate(seed, int(k)) for k in p["recipe"]]
            yield pd.DataFrame({"recipe": p["recipe"], "text": [t for t, _ in made], "sha256": [hashlib.sha256(t.encode()).hexdigest() for t, _ in made], "defects": [[{"criterion": c, "heading": h, "paragraph": n} for c, h, n in d] for _, d in made]})

    return recipes.select(F.col(key).cast("long").alias("recipe")).mapInPandas(run, "recipe bigint, text string, sha256 string, defects array<struct<criterion:string,heading:string,paragraph:int>>")


def lock(made: DataFrame, key: str = "recipe") -> DataFrame:
    """What a corpus must come out as: hash and number of defects of each document."""
    return made.select(key, "sha256", F.size("defects").alias("n_defects"))


def verify(made: DataFrame, committed: DataFrame, key: str = "recipe", digest: str = "sha256") -> DataFrame:
    """Regenerated against committed documents: same, differs, missing or extra."""
    a, b = made.select(key, F.col(digest).alias("x")), committed.select(key, F.col(digest).alias("y"))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") == F.col("y"), "same").otherwise("differs")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def description_leaks(texts: DataFrame, descriptions: DataFrame, text_key: str, text: str, key: str, description: str, n: int = SHINGLE) -> DataFrame:
    """Pairs of a text and a description that share a run of n tokens, with the number of shared runs.

    The runs meet by equality of a hash and are compared themselves; descriptions shorter than n tokens leak nothing.
    """
    # the tokens are a column of their own, or each run would make them again
    side = lambda df, k, c, name: df.select(F.col(k).alias(name), T.tokens(F.col(c)).alias("t")).select(name, F.explode(T.shingles(F.col("t"), n)).alias("s")).withColumn("h", F.xxhash64("s"))
    a, b = side(texts, text_key, text, "doc"), side(descriptions, key, description, "item")
    return a.join(b, ["h", "s"]).groupBy("doc", "item").agg(F.countDistinct("s").alias("n_shared"))


def path_leaks(df: DataFrame, path: str, criteria: DataFrame, most: int = 10_000) -> DataFrame:
    """``df`` with ``leaks``: whether a path holds a banned word as a segment, or a criterion id anywhere.

    Up to ``most`` ids (counted) are tried as they are; beyond that, the pieces of a path as long as an id may be meet the
    ids by equality. Null paths leak nothing (false).
    """
    ids = criteria.select(F.lower("criterion").alias("_id")).where("_id <> ''").distinct()
    low = F.lower(path)
    banned = F.coalesce(F.arrays_overlap(F.split(low, r"[^a-z0-9]+"), F.array(*[F.lit(b) for b in BANNED])), F.lit(False))
    few = [r[0] for r in ids.limit(most + 1).collect()]
    if len(few) <= most:
        named = F.exists(F.array(*[F.lit(c) for c in few]), lambda c: F.contains(low, c)) if few else F.lit(False)
        return df.withColumn("leaks", banned | F.coalesce(named, F.lit(False)))
    starts = df.select(F.col(path).alias("_path")).where("_path IS NOT NULL").distinct().withColumn("_at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("_path"), F.lit(1)))))
    pieces = starts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(LONGEST_ID)))).where("_at + _n <= length(_path) + 1")
    met = pieces.select("_path", F.expr("lower(substring(_path, _at, _n))").alias("_id")).join(ids, "_id").select("_path").distinct().withColumn("_named", F.lit(True))
    return df.join(met, F.col(path) == F.col("_path"), "left").withColumn("leaks", banned | F.coalesce("_named", F.lit(False))).drop("_path", "_named")
