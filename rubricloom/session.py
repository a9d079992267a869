"""Session helpers: table loading, lineage cuts in the shared folder, and measured broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` over all cores where it lies in fewer pieces than there are cores, as one small file does; else unchanged,
    so that large inputs are never shuffled for it. For work that costs far more than moving the rows."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, key) if df.rdd.getNumPartitions() < n else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; in local mode alone a temporary folder is made where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rubricloom-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def measured_size(df: DataFrame, text: Column) -> tuple[int, int]:
    """Rows and characters of a side that someone wants to broadcast, measured by one aggregate."""
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``max_rows`` rows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
