"""Report tables: best and worst entries, criteria by lane, recomputed against committed figures, labelled run sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def floor_strip(entries: DataFrame, metrics: list[str], order: list[str]) -> DataFrame:
    """For each metric the lowest and the highest value and the entry that has it, the first by ``order`` among equals.

    One grouped pass over the unpivoted metrics; null values do not count, a metric without values has no row.
    """
    name = F.concat_ws(" ", *[F.col(c).cast("string") for c in order])
    long = entries.select(name.alias("entry"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]))).where("value IS NOT NULL")
    best = F.min(F.struct((-F.col("value")).alias("v"), "entry"))
    worst = F.min(F.struct("value", "entry"))
    g = long.groupBy("metric").agg(worst.alias("w"), best.alias("b"))
    return g.select("metric", F.col("w.value").alias("lowest"), F.col("w.entry").alias("lowest_entry"), (-F.col("b.v")).alias("highest"), F.col("b.entry").alias("highest_entry"))


def explorer(criteria: DataFrame, by: str = "domain", lane: str = "usual_lane") -> DataFrame:
    """How many criteria each domain has in each lane, with totals (null) on both axes."""
    return criteria.cube(by, lane).agg(F.countDistinct("criterion").alias("n_criteria"))


def compare(recomputed: DataFrame, committed: DataFrame, key: list[str], figures: list[str]) -> DataFrame:
    """Each recomputed cell beside the committed one: same, differs, or unchecked where none was committed.

    Figures are compared as they are (numerators and denominators); two nulls are equal.
    """
    c = committed.select(*[F.col(k).alias(f"_{k}") for k in key], F.struct(*figures).alias("_then"), F.lit(True).alias("_has"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    j = recomputed.select(*key, F.struct(*figures).alias("_now")).join(c, same, "left")
    equal = reduce(lambda a, b: a & b, [F.col(f"_now.{f}").eqNullSafe(F.col(f"_then.{f}")) for f in figures])
    return j.select(*key, F.when(F.col("_has").isNull(), "unchecked").when(equal, "same").otherwise("differs").alias("status"))


def guard(checked: DataFrame) -> DataFrame:
    """One row with the counts of ``compare``; running it fails where a cell differs or nothing was checked."""
    n = checked.agg(F.count_if(F.col("status") == "same").alias("n_same"), F.count_if(F.col("status") == "differs").alias("n_differs"), F.count_if(F.col("status") == "unchecked").alias("n_unchecked"))
    ok = (F.col("n_differs") == 0) & (F.col("n_same") > 0)
    stop = F.when(~ok, F.raise_error(F.concat(F.lit("not reproduced: "), F.col("n_differs").cast("string"), F.lit(" cells differ, "), F.col("n_same").cast("string"), F.lit(" agree"))).cast("boolean")).otherwise(F.lit(True))
    return n.withColumn("reproduced", stop)


def run_sets(sets: dict[str, DataFrame], label: str = "run_set") -> DataFrame:
    """Several sets of runs as one table, each row with the name of its set; columns that a set lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(label, F.lit(n)) for n, df in sets.items()])


def table_lines(df: DataFrame, columns: list[str], order: list[str], digits: int = 3) -> DataFrame:
    """The rows of a markdown table (pos, line) in order: numbers with fixed digits, n/a for null, pipes escaped.

    A report has a row for each cell of its grid; it is sorted as a whole, as a page is.
    """
    cell = lambda c, t: F.coalesce(F.format_string(f"%.{digits}f", c) if t in ("double", "float") else F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("n/a"))
    kinds = dict(df.dtypes)
    cells = [F.when(F.col(c).isNull(), F.lit("n/a")).otherwise(cell(c, kinds[c])) for c in columns]
    return df.orderBy(*order).select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
