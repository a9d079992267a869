"""The contract's rules as one table of violations: one row for each envelope, path and rule.

An envelope can break several rules; a rule never raises on bad input.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.operators.envelope import gate, histogram

COLUMNS = ["run_id", "path", "rule", "level", "message"]
#: Grammar of criterion ids, finding ids and timestamps.
CRITERION = r"^[A-Z][A-Z0-9]*(?:-[A-Z0-9]+(?:\.[A-Z0-9]+)*)+\z"
FINDING_ID = r"^F-[0-9]{1,6}\z"
TIMESTAMP = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]{1,9})?Z\z"
SHA = r"^[0-9a-f]{64}\z"


def _rows(df: DataFrame, path: Column, rule: str, message: Column, level: str = "error") -> DataFrame:
    return df.select("run_id", path.alias("path"), F.lit(rule).alias("rule"), F.lit(level).alias("level"), message.alias("message"))


def real_instant(c: Column) -> Column:
    """Whether a timestamp of the right shape names a real instant (second 60 counts as 59); true for other shapes."""
    part = lambda i: F.regexp_extract(c, TIMESTAMP, i)
    second = F.when(part(6) == "60", "59").otherwise(part(6))
    at = F.concat(F.concat_ws("-", part(1), part(2), part(3)), F.lit(" "), F.concat_ws(":", part(4), part(5), second))
    ok = F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull() & (part(1) != "0000")
    return F.when(F.rlike(c, F.lit(TIMESTAMP)), ok).otherwise(True)


_DASH = "[—–]"


def _broken(test: Column, path: Column, rule: str, message: Column | str, level: str = "error") -> Column:
    """A violation where ``test`` holds, else null."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(test, F.lit(False)), F.struct(path.alias("path"), F.lit(rule).alias("rule"), F.lit(level).alias("level"), text.alias("message")))


def _not(test: Column) -> Column:
    """True where the test fails or cannot be told."""
    return F.coalesce(~test, F.lit(True))


def finding_rules(rubrics: Column | None = None) -> Column:
    """Violations of one finding's row, as one array: required fields, lengths, patterns, enums, confidence of the scripted
    lane, instances (two or more, none twice), the origin of BYOR criteria, dashes in any text, and, where the run's
    ``rubrics`` are given, the criterion's namespace."""
    at = lambda c: F.concat(F.lit("findings."), F.coalesce("finding_id", F.lit("?")), F.lit(f".{c}"))
    out = []
    for c, most in (("criterion", 64), ("location", 400), ("evidence", 2000), ("violation", 1000), ("fix", 1000)):
        out.append(_broken(F.col(c).isNull() | (F.col(c) == ""), at(c), "schema", "is required"))
        out.append(_broken(F.length(c) > most, at(c), "schema", f"is longer than {most}"))
    out.append(_broken(~F.rlike("criterion", F.lit(CRITERION)), at("criterion"), "schema", "is no criterion id"))
    out.append(_broken(_not(F.rlike("finding_id", F.lit(FINDING_ID))), at("id"), "schema", "is no finding id"))
    out.append(_broken(_not(F.col("lane").isin("scripted", "judged")), at("lane"), "schema", "is not scripted or judged"))
    out.append(_broken(_not(F.col("confidence").isin("high", "medium", "low")), at("confidence"), "schema", "is not high, medium or low"))
    out.append(_broken(_not(F.col("severity").between(0, 4)), at("severity"), "schema", "is not 0 to 4"))
    out.append(_broken(F.expr("lane = 'scripted' AND confidence <> 'high'"), at("confidence"), "schema", "scripted findings are of high confidence"))
    out.append(_broken(F.size("instances") == 1, at("instances"), "schema", "holds fewer than two"))
    out.append(_broken(F.size(F.array_distinct("instances")) < F.size("instances"), at("instances"), "schema", "holds one twice"))
    out.append(_broken(F.expr("startswith(criterion, 'BYOR-') AND NOT coalesce(rubric_source = 'byor', false)"), at("rubric_source"), "schema", "is not byor"))
    texts = [(c, F.col(c)) for c in ("criterion", "location", "evidence", "violation", "fix")]
    texts += [(f"instances.{c}", F.array_join(F.col(f"instances.{c}"), " ")) for c in ("location", "evidence")]
    for c, t in texts:
        out.append(_broken(F.rlike(t, F.lit(_DASH)), at(c), "no-dashes", F.when(F.contains(t, F.lit("—")), "em dash").otherwise("en dash")))
    if rubrics is not None:
        space = F.substring_index("criterion", "-", 1)
        out.append(_broken(~F.array_contains(rubrics, space), at("criterion"), "rubrics-cover-findings", F.concat(F.lit("no rubric "), space)))
    return F.array_compact(F.array(*out))


def run_rules() -> Column:
    """Violations of one run's row, as one array: hash, timestamp shape, real instant, dashes in its names."""
    out = [
        _broken(_not(F.rlike("artifact_sha256", F.lit(SHA))), F.lit("run.artifact_sha256"), "schema", "is no SHA-256"),
        _broken(_not(F.rlike("run_timestamp", F.lit(TIMESTAMP))), F.lit("run.timestamp"), "schema", "is no UTC timestamp"),
        _broken(~real_instant(F.col("run_timestamp")), F.lit("run.timestamp"), "real-instants", "names no real instant"),
    ]
    for c in ("skill", "skill_version", "model"):
        t = F.col(c)
        out.append(_broken(F.rlike(t, F.lit(_DASH)), F.lit(f"run.{c}"), "no-dashes", F.when(F.contains(t, F.lit("—")), "em dash").otherwise("en dash")))
    return F.array_compact(F.array(*out))


def count_rules(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Violations that need a run's findings together: repeated ids, the gate, the producer's threshold, the output bound."""
    per = findings.groupBy("run_id", "finding_id").agg(F.count(F.lit(1)).alias("k"), *[F.count_if(F.col("severity") == n).alias(f"n{n}") for n in (3, 4)], F.count_if(F.col("severity") < 3).alias("low"))
    twice = F.collect_list(F.when(F.col("finding_id").isNotNull() & (F.col("k") > 1), F.struct("finding_id", "k")))
    g = per.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in ("n3", "n4", "low")], twice.alias("twice"), F.lit(True).alias("found"))
    r = runs.select("run_id", "gate", "severity_3_threshold", F.lit(True).alias("run"))
    j = g.join(r, "run_id", "full_outer")
    n3, n4, most = (F.coalesce(c, F.lit(0)) for c in ("n3", "n4", "severity_3_threshold"))
    want = gate(n3, n4, most)
    ids = F.transform(F.coalesce("twice", F.array().cast("array<struct<finding_id:string,k:bigint>>")), lambda x: F.struct(F.concat(F.lit("findings."), x["finding_id"], F.lit(".id")).alias("path"), F.lit("unique-finding-ids").alias("rule"), F.lit("error").alias("level"), F.concat(F.lit("occurs "), x["k"].cast("string"), F.lit(" times")).alias("message")))
    rest = F.array_compact(F.array(
        _broken(F.col("run") & _not(F.col("gate") == want), F.lit("summary.gate"), "gate-matches-counts", F.concat(F.lit("should be "), want)),
        _broken(F.col("run") & F.col("found") & F.expr("severity_3_threshold > 0 AND n4 = 0 AND n3 > 0 AND n3 <= severity_3_threshold"), F.lit("summary.severity_3_threshold"), "producer-declared-threshold", F.concat(F.col("n3").cast("string"), F.lit(" findings of severity 3 pass")), "warning"),
        _broken(F.col("low") > 5, F.lit("findings"), "output-bound", F.concat(F.col("low").cast("string"), F.lit(" findings below severity 3")), "warning"),
    ))
    return j.select("run_id", F.inline(F.concat(ids, rest)))


def unique_ids(findings: DataFrame) -> DataFrame:
    d = findings.where("finding_id IS NOT NULL").groupBy("run_id", "finding_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return _rows(d, F.concat(F.lit("findings."), F.col("finding_id"), F.lit(".id")), "unique-finding-ids", F.concat(F.lit("occurs "), F.col("k").cast("string"), F.lit(" times")))


def gates(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """The declared gate against the one the emitted findings give."""
    h = runs.join(histogram(findings, ["run_id"]), "run_id", "left")
    n3, n4 = F.coalesce("n3", F.lit(0)), F.coalesce("n4", F.lit(0))
    want = gate(n3, n4, F.coalesce("severity_3_threshold", F.lit(0)))
    return _rows(h.where(F.coalesce(F.col("gate") != want, F.lit(True))), F.lit("summary.gate"), "gate-matches-counts", F.concat(F.lit("should be "), want))


def threshold_only(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """A warning where the gate passes only through the producer's own threshold."""
    h = runs.join(histogram(findings, ["run_id"]), "run_id")
    only = h.where("severity_3_threshold > 0 AND n4 = 0 AND n3 > 0 AND n3 <= severity_3_threshold")
    return _rows(only, F.lit("summary.severity_3_threshold"), "producer-declared-threshold", F.concat(F.col("n3").cast("string"), F.lit(" findings of severity 3 pass")), "warning")


def namespaces(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Criteria whose namespace the run's rubrics lack."""
    f = findings.where("criterion IS NOT NULL").join(runs.select("run_id", "rubrics"), "run_id")
    space = F.substring_index("criterion", "-", 1)
    return _rows(f.where(~F.array_contains(F.coalesce("rubrics", F.array().cast("array<string>")), space)), F.concat(F.lit("findings."), F.coalesce("finding_id", F.lit("?")), F.lit(".criterion")), "rubrics-cover-findings", F.concat(F.lit("no rubric "), space))


def low_findings(findings: DataFrame) -> DataFrame:
    d = findings.groupBy("run_id").agg(F.count_if(F.col("severity") < 3).alias("k")).where("k > 5")
    return _rows(d, F.lit("findings"), "output-bound", F.concat(F.col("k").cast("string"), F.lit(" findings below severity 3")), "warning")


def instants(runs: DataFrame) -> DataFrame:
    return _rows(runs.where(~real_instant(F.col("run_timestamp"))), F.lit("run.timestamp"), "real-instants", F.lit("names no real instant"))


def histogram_sums(docs: DataFrame) -> DataFrame:
    """Over JSON envelopes (``run_id``, ``doc``): sums of the declared histogram against findings and suppressed count,
    counts of each severity, and literals that are no integers. Integral floats count but are reported."""
    v = docs.withColumn("v", F.try_parse_json("doc"))
    num = lambda p: F.expr(f"try_variant_get(v, '{p}', 'double')")
    kind = lambda p: F.expr(f"schema_of_variant(variant_get(v, '{p}'))")
    sev = F.expr("transform(try_variant_get(v, '$.findings', 'array<variant>'), x -> try_variant_get(x, '$.severity', 'double'))")
    b = v.select("run_id", *[num(f"$.summary.by_severity.{i}").alias(f"b{i}") for i in range(5)], num("$.summary.suppressed_count").alias("sup"), sev.alias("sev"), *[kind(p).alias(f"k{i}") for i, p in enumerate(_COUNTS)])
    whole = reduce(lambda x, y: x & y, [F.col(f"b{i}").isNotNull() & (F.col(f"b{i}") % 1 == 0) for i in range(5)])
    total = sum((F.col(f"b{i}") for i in range(5)), F.lit(0.0))
    n = F.size(F.coalesce("sev", F.array().cast("array<double>")))
    sums = _rows(b.where(whole & (total != n + F.coalesce("sup", F.lit(0.0)))), F.lit("summary.by_severity"), "histogram-sum", F.concat(F.lit("sums to "), total.cast("bigint").cast("string")))
    wrong = F.expr("array_compact(array(" + ", ".join(f"CASE WHEN b{i} {'<>' if i >= 3 else '<'} size(filter(coalesce(sev, array()), s -> s = {i})) THEN '{i}' END" for i in range(5)) + "))")
    each = b.where(whole).withColumn("w", F.explode(wrong))
    counts = _rows(each, F.concat(F.lit("summary.by_severity."), F.col("w")), "histogram-counts", F.lit("does not match the findings"))
    lit = b.withColumn("w", F.explode(F.array_compact(F.array(*[F.when(F.col(f"k{i}").isNotNull() & ~F.col(f"k{i}").isin("BIGINT", "VOID"), F.lit(p[2:])) for i, p in enumerate(_COUNTS)]))))
    return sums.unionByName(counts).unionByName(_rows(lit, F.col("w"), "integer-literals", F.lit("is no integer literal")))


_COUNTS = [*[f"$.summary.by_severity.{i}" for i in range(5)], "$.summary.suppressed_count", "$.summary.severity_3_threshold"]


def violations(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """All rules over normalized runs and findings: one projection of the findings beside their run's rubrics, one of the
    runs, and one grouped pass for what needs a run's findings together."""
    rub = runs.select("run_id", F.coalesce("rubrics", F.array().cast("array<string>")).alias("_rubrics"))
    f = findings.join(rub, "run_id", "left").select("run_id", F.inline(finding_rules(F.col("_rubrics"))))
    return f.unionByName(runs.select("run_id", F.inline(run_rules()))).unionByName(count_rules(runs, findings))


def dispositions(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Decisions (decision_id, item_id, criterion) on findings that do not exist, or that name another criterion."""
    f = findings.select(F.col("row_id").alias("item_id"), F.col("criterion").alias("_c"), F.lit(True).alias("_f"))
    j = decisions.join(f, "item_id", "left")
    lost = F.col("_f").isNull()
    other = F.coalesce(F.col("criterion") != F.col("_c"), F.lit(False))
    return j.where(lost | other).select("decision_id", F.when(lost, "finding is not in the envelope").otherwise("criterion differs").alias("message"))


_WALK = "run_id string, path string, rule string, level string, message string"


def json_texts(docs: DataFrame) -> DataFrame:
    """Over JSON envelopes (``run_id`` as text, ``doc``): dashes in any string or key at any depth, and timestamps
    (run.timestamp, envelope.timestamp, decided_at) that name no real instant. Documents that do not parse give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    value = json.loads(d) if d else None
                except ValueError:
                    continue
                rows += [(k, *x) for x in _walk(value)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], names=["run_id", "path", "rule", "level", "message"])

    return docs.select(F.col("run_id").cast("string"), "doc").mapInArrow(run, _WALK)


def _walk(value: object) -> Iterator[tuple[str, str, str, str]]:
    todo: list[tuple[str, object]] = [("", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            for k, x in v.items():
                at = f"{path}.{k}" if path else k
                if re.search(_DASH, k):
                    yield at, "no-dashes", "error", "em dash" if "—" in k else "en dash"
                todo.append((at, x))
        elif isinstance(v, list):
            todo += [(f"{path}.{i}", x) for i, x in enumerate(v)]
        elif isinstance(v, str):
            if re.search(_DASH, v):
                yield path, "no-dashes", "error", "em dash" if "—" in v else "en dash"
            if path.rsplit(".", 1)[-1] in ("timestamp", "decided_at") and (m := re.fullmatch(TIMESTAMP.replace("\\z", "").lstrip("^"), v)):
                y, mo, d, h, mi, sec = (int(x) for x in m.groups())
                try:
                    datetime(y, mo, d, h, mi, 59 if sec == 60 else sec)
                except ValueError:
                    yield path, "real-instants", "error", "names no real instant"


def report(found: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that pass and fail, and how many errors and warnings there are."""
    per = found.groupBy("run_id").agg(F.count_if(F.col("level") == "error").alias("e"), F.count_if(F.col("level") == "warning").alias("w"))
    j = runs.select("run_id").join(per, "run_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_runs"), F.count_if(F.coalesce("e", F.lit(0)) > 0).alias("n_failed"), F.coalesce(F.sum("e"), F.lit(0)).alias("n_errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("n_warnings"))
