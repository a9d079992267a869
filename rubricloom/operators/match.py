"""One-to-one matching by a fixed order, as a fold over each group's sorted candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def taken(candidates: Column, left: str, right: str) -> Column:
    """The (l, r) pairs taken from sorted candidates when each side may be used once; ``left`` and ``right`` are the types.

    The fold keeps the used ones of each side, so a candidate costs two look-ups in native arrays.
    """
    none = F.struct(F.array().cast(f"array<{left}>").alias("ls"), F.array().cast(f"array<{right}>").alias("rs"))
    used = lambda s, x: F.array_contains(s["ls"], x["l"]) | F.array_contains(s["rs"], x["r"])
    more = lambda s, x: F.struct(F.array_append(s["ls"], x["l"]).alias("ls"), F.array_append(s["rs"], x["r"]).alias("rs"))
    pairs = lambda s: F.zip_with(s["ls"], s["rs"], lambda l, r: F.struct(l.alias("l"), r.alias("r")))
    return F.aggregate(candidates, none, lambda s, x: F.when(used(s, x), s).otherwise(more(s, x)), pairs)


def taken_of_classes(candidates: Column, left: str, name: str) -> Column:
    """The (l, c, k) taken from sorted candidates (g, j, l, c, n): ``l`` takes the first free one of the ``n`` alike of
    class ``c``, its ``k``-th from 0. Each l is used once; a candidate that occurs twice changes nothing. ``left`` and
    ``name`` are the types of l and c."""
    none = F.struct(F.array().cast(f"array<{left}>").alias("ls"), F.array().cast(f"array<{name}>").alias("cs"))
    n_used = lambda cs, c: F.size(F.filter(cs, lambda v: v == c))
    free = lambda s, x: ~F.array_contains(s["ls"], x["l"]) & ((F.size(s["cs"]) < x["n"]) | (n_used(s["cs"], x["c"]) < x["n"]))
    more = lambda s, x: F.struct(F.array_append(s["ls"], x["l"]).alias("ls"), F.array_append(s["cs"], x["c"]).alias("cs"))
    out = lambda s: F.transform(F.arrays_zip(s["ls"], s["cs"]), lambda y, i: F.struct(y["ls"].alias("l"), y["cs"].alias("c"), n_used(F.slice(s["cs"], 1, i), y["cs"]).alias("k")))
    return F.aggregate(candidates, none, lambda s, x: F.when(free(s, x), more(s, x)).otherwise(s), out)


def greedy(df: DataFrame, group: list[str], left: Column, right: Column, order: list[Column]) -> DataFrame:
    """The pairs (l, r) taken when a group's candidates are tried in ``order`` and each side may be used once.

    ``order`` is completed by left and right, so equal keys end the same way at every run. A group is one envelope or
    one pair of runs: the fold looks at most at the pairs already taken, fewer than the envelope's claims.
    """
    keys = [o.alias(f"_k{i}") for i, o in enumerate(order)]
    flat = df.select(*group, F.struct(*keys, left.alias("l"), right.alias("r")).alias("_x"))
    kinds = {f.name: f.dataType.simpleString() for f in flat.schema["_x"].dataType.fields}
    g = flat.groupBy(*group).agg(F.array_sort(F.collect_list("_x")).alias("_c"))
    return g.select(*group, F.inline(taken(F.col("_c"), kinds["l"], kinds["r"])))


def jaccard(matched: Column, a: Column, b: Column) -> Column:
    """|M| / (|A| + |B| - |M|); 1.0 where both are empty."""
    return F.when((a == 0) & (b == 0), 1.0).otherwise(matched / (a + b - matched))
