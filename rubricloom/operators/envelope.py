"""Findings to ranked, bounded envelopes with a gate; merging of lanes; the baseline's mapping; packing of occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricloom.functions import text as T

#: Fixed values of the contract.
CONTRACT_VERSION = "1.0.0"
MOST_LOW = 5
LIMITS = {"location": 400, "evidence": 2000, "violation": 1000, "fix": 1000}
REQUIRED = ["criterion", "severity", "location", "evidence", "violation", "fix"]
BASELINE = {"criterion": "BASELINE-GENERIC", "severity": 3, "lane": "judged", "confidence": "medium"}
SEVERITIES = [0, 1, 2, 3, 4]


def gate(n3: Column, n4: Column, threshold: Column) -> Column:
    return F.when((n4 > 0) | (n3 > threshold), "fail").otherwise("pass")


def exit_code(n3: Column, n4: Column, threshold: Column, valid: Column) -> Column:
    """3 invalid, 1 any finding of severity 4, 2 more of severity 3 than allowed, else 0."""
    return F.when(~valid, 3).when(n4 > 0, 1).when(n3 > threshold, 2).otherwise(0)


def histogram(df: DataFrame, key: list[str], severity: str = "severity") -> DataFrame:
    """Counts of the five severities, zero-filled; partial counts before the shuffle."""
    return df.groupBy(*key).agg(*[F.count_if(F.col(severity) == s).alias(f"n{s}") for s in SEVERITIES], F.count(F.lit(1)).alias("n_findings"))


def rank_and_bound(df: DataFrame, key: list[str], tie: str, most_low: int = MOST_LOW) -> DataFrame:
    """Findings that are emitted, with their rank, id (F-001 ...) and the number of suppressed ones beside them.

    All of severity 3 and 4 stay, and the first ``most_low`` below, by severity (descending), criterion and location;
    nulls last, ``tie`` decides between equals.
    """
    order = [F.desc_nulls_last("severity"), F.asc_nulls_last("criterion"), F.asc_nulls_last("location"), F.col(tie)]
    low = F.coalesce(F.col("severity") < 3, F.lit(True))
    w = Window.partitionBy(*key).orderBy(*order)
    # the rank filter also runs in each task before the shuffle, so a large envelope sends a bounded number of low rows
    kept = df.where(~low).unionByName(df.where(low).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most_low).drop("_r"))
    n = df.where(low).groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.count(F.lit(1)).alias("_n"))
    same = [df_k.eqNullSafe(F.col(f"_{k}")) for k, df_k in ((k, F.col(k)) for k in key)]
    kept = kept.withColumn("rank", F.row_number().over(w)).join(n, same, "left")
    kept = kept.withColumn("suppressed_count", F.greatest(F.coalesce("_n", F.lit(0)) - most_low, F.lit(0)).cast("long")).drop("_n", *[f"_{k}" for k in key])
    r = F.col("rank").cast("string")
    return kept.withColumn("id", F.concat(F.lit("F-"), F.when(F.length(r) < 3, F.lpad(r, 3, "0")).otherwise(r)))


def summary(df: DataFrame, key: list[str], threshold: Column | None = None, most_low: int = MOST_LOW) -> DataFrame:
    """Histogram before bounding, suppressed count, threshold and gate of each envelope."""
    h = histogram(df, key)
    h = h.withColumn("severity_3_threshold", F.lit(0) if threshold is None else threshold)
    low = F.col("n_findings") - F.col("n3") - F.col("n4")
    return h.withColumns({"suppressed_count": F.greatest(low - most_low, F.lit(0)), "gate": gate(F.col("n3"), F.col("n4"), F.col("severity_3_threshold"))})


def assemble(runs: DataFrame, findings: DataFrame, tie: str = "row_id") -> DataFrame:
    """One envelope for each run as nested columns run, findings and summary; runs without findings have an empty list."""
    kept = rank_and_bound(findings, ["run_id"], tie)
    f = kept.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "criterion", "lane", "severity", "location", "evidence", "violation", "fix", "confidence"))).alias("f"))
    s = summary(findings, ["run_id"]).withColumnRenamed("suppressed_count", "_suppressed")
    e = runs.join(f, "run_id", "left").join(s.drop("severity_3_threshold", "gate"), "run_id", "left")
    n = {f"n{i}": F.coalesce(f"n{i}", F.lit(0)) for i in SEVERITIES}
    t = F.coalesce("severity_3_threshold", F.lit(0))
    run = F.struct("skill", "skill_version", F.lit(CONTRACT_VERSION).alias("contract_version"), "artifact_id", "artifact_sha256", "model", F.col("run_timestamp").alias("timestamp"), "rubrics")
    inner = F.transform(F.coalesce("f", F.array().cast("array<struct<rank:int,id:string,criterion:string,lane:string,severity:int,location:string,evidence:string,violation:string,fix:string,confidence:string>>")), lambda x: x.dropFields("rank"))
    summ = F.struct(F.struct(*[n[f"n{i}"].alias(str(i)) for i in SEVERITIES]).alias("by_severity"), F.coalesce("_suppressed", F.lit(0)).alias("suppressed_count"), gate(n["n3"], n["n4"], t).alias("gate"), t.alias("severity_3_threshold"))
    return e.select("run_id", run.alias("run"), inner.alias("findings"), summ.alias("summary"))


def merge_lanes(df: DataFrame) -> DataFrame:
    """Raw findings of both lanes in contract form, with ``error`` naming missing fields or a severity that is no integer.

    Lane defaults to scripted and confidence to high; scripted findings are always of high confidence; prose is
    sanitized and cut to its limit; severity may come as text.
    """
    lane = F.coalesce("lane", F.lit("scripted"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    sev = F.expr("try_cast(trim(cast(severity AS string)) AS int)")
    error = F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))).when(sev.isNull(), F.lit("severity is not an integer"))
    prose = {c: T.sanitize(F.col(c), n) for c, n in LIMITS.items()}
    return df.withColumns({"error": error, "lane": lane, "confidence": F.when(lane == "scripted", "high").otherwise(F.coalesce("confidence", F.lit("high"))), "severity": sev, **prose})


def rubrics(df: DataFrame, key: list[str]) -> DataFrame:
    """The sorted namespaces (text before the first hyphen) that each envelope's findings cite."""
    return df.groupBy(*key).agg(F.array_sort(F.collect_set(F.substring_index("criterion", "-", 1))).alias("rubrics"))


def baseline(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Findings of a generic response: blocks of Location, Evidence, Problem and Fix lines between blank lines.

    A label's value goes on over the lines after it up to the next label; the first of repeated labels counts; blocks
    without all four are dropped. Every finding takes the fixed criterion, severity, lane and confidence.
    """
    t = T.unix_lines(F.col(text))
    blocks = df.select(F.col(key).alias("doc_id"), F.posexplode(F.split(t, r"\n(?:[^\S\n]*\n)++")).alias("block", "b"))
    label = lambda n: F.nullif(T.strip(F.regexp_replace(F.regexp_extract("b", rf"(?s)(?:^|\n)\s*{n}:[ \t]*(.*?)(?=\n\s*(?:Location|Evidence|Problem|Fix):|$)", 1), r"\s*\n\s*", " ")), F.lit(""))
    out = blocks.select("doc_id", "block", label("Location").alias("location"), label("Evidence").alias("evidence"), label("Problem").alias("violation"), label("Fix").alias("fix")).where("location IS NOT NULL AND evidence IS NOT NULL AND violation IS NOT NULL AND fix IS NOT NULL")
    return out.withColumns({k: F.lit(v) for k, v in BASELINE.items()})


def pack(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Occurrences of one breach: one or two become findings of their own, three or more one finding with instances.

    Repeated (location, evidence) count once, at their first place in ``order``.
    """
    once = df.groupBy(*key, "location", "evidence").agg(F.min(order).alias("_o"))
    g = once.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_o", "location", "evidence"))).alias("_x"))
    many = F.size("_x") >= 3
    rows = F.when(many, F.slice("_x", 1, 1)).otherwise(F.col("_x"))
    return g.select(*key, F.when(many, F.transform("_x", lambda x: x.dropFields("_o"))).alias("instances"), F.inline(rows)).select(*key, "location", "evidence", "instances")
