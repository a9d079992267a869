"""The best representative of each group of records that report one thing.

Two forms: ``best_record`` keeps the whole top-ranked record of a group; ``best_fields`` builds a record field by
field. Both rank by windows whose rank filter Spark also applies before the shuffle, so a hot group sends one row per
task and field and never meets in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_record(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group under ``order`` (which should end in a unique column), by row_number."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def completeness(values: list[Column]) -> Column:
    """How many of the values are usable."""
    return sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))


def best_fields(df: DataFrame, group: list[str], fields: dict[str, Column], rank: dict[str, bool], min_rows: int = 2) -> DataFrame:
    """One row for each group of at least ``min_rows`` rows; each field holds its first usable value under ``rank``.

    ``fields`` maps a result column to the usable value of a row, null where there is none; the fields are chosen
    independently, and a field that no row of the group can give is null. ``rank`` maps columns to whether
    they descend (nulls last either way) and should end in a unique column, so that ties end the same way at every run. Repeated rows count as rows. Groups with a null key are kept as one
    group; filter them before if they mean nothing. Other columns of ``df`` are left out. An empty table gives no rows.
    """
    keys = [F.col(g) for g in group]
    ranks = [F.col(r).alias(f"_r{i}") for i, r in enumerate(rank)]
    order = [F.desc_nulls_last(f"_r{i}") if down else F.asc_nulls_last(f"_r{i}") for i, down in enumerate(rank.values())]
    wide = df.select(*keys, *ranks, F.posexplode(F.array(*[v.cast("string") for v in fields.values()])).alias("_field", "_value"))
    w = Window.partitionBy(*group, "_field").orderBy(F.col("_value").isNull(), *order)
    # the first rows of one field tell whether the group is large enough, so one pass over the records does
    top = wide.select(*group, "_field", "_value", F.row_number().over(w).alias("_rank")).where(F.col("_rank") <= max(min_rows, 1))
    first = lambda i: F.max(F.when((F.col("_field") == i) & (F.col("_rank") == 1), F.col("_value")))
    out = top.groupBy(*group).agg(*[first(i).alias(n) for i, n in enumerate(fields)], F.count_if(F.col("_field") == 0).alias("_n"))
    return out.where(F.col("_n") >= min_rows).drop("_n")
