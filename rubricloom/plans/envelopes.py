"""Queries of envelopes and the contract over runs and findings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricloom.operators import contract as C
from rubricloom.operators import envelope as E
from rubricloom.operators import nested
from rubricloom.session import table


def envelope_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.histogram(table(spark, sf_dir, "findings"), ["run_id"])


def envelope_rank_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = E.rank_and_bound(table(spark, sf_dir, "findings"), ["run_id"], "row_id")
    return k.select("run_id", "row_id", "rank", "id", "suppressed_count")


def envelope_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summary(table(spark, sf_dir, "findings"), ["run_id"])


def envelope_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "runs").drop("suppressed_count", "gate")
    e = E.assemble(r, table(spark, sf_dir, "findings"))
    return e.select("run_id", F.size("findings").alias("n_emitted"), F.try_element_at("findings", F.lit(1))["criterion"].alias("first_criterion"), F.array_join("findings.id", " ").alias("ids"), F.col("summary.suppressed_count").alias("suppressed_count"), F.col("summary.gate").alias("gate"))


def envelope_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.merge_lanes(table(spark, sf_dir, "findings")).select("row_id", "error", "lane", "confidence", "severity", "location", "evidence", "violation", "fix")


def envelope_rubrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rubrics(table(spark, sf_dir, "findings"), ["run_id"]).select("run_id", F.array_join("rubrics", " ").alias("rubrics"))


def envelope_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "findings").where("location IS NOT NULL AND evidence IS NOT NULL")
    p = E.pack(f, ["run_id", "criterion"], "row_id")
    return p.select("run_id", "criterion", "location", "evidence", F.coalesce(F.size("instances"), F.lit(0)).alias("n_instances"))


def envelope_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.baseline(table(spark, sf_dir, "documents"))


def envelope_exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, f = table(spark, sf_dir, "runs"), table(spark, sf_dir, "findings")
    wrong = C.violations(r, f).where("level = 'error'").select("run_id").distinct().withColumn("valid", F.lit(False))
    h = r.select("run_id", "severity_3_threshold").join(E.histogram(f, ["run_id"]), "run_id", "left").join(wrong, "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return h.select("run_id", E.exit_code(zero("n3"), zero("n4"), zero("severity_3_threshold"), F.coalesce("valid", F.lit(True))).alias("code"))


def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.violations(table(spark, sf_dir, "runs"), table(spark, sf_dir, "findings")).groupBy("rule", "level", "message").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("n_runs"))


def contract_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.unique_ids(table(spark, sf_dir, "findings"))


def contract_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gates(table(spark, sf_dir, "runs"), table(spark, sf_dir, "findings"))


def contract_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.instants(table(spark, sf_dir, "runs"))


def contract_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.namespaces(table(spark, sf_dir, "runs"), table(spark, sf_dir, "findings"))


def contract_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "runs")
    return C.report(C.violations(r, table(spark, sf_dir, "findings")), r)


def contract_json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nested.envelopes(table(spark, sf_dir, "golden_records"))
    found = C.histogram_sums(e.select(F.struct("record_id", "example_no").alias("run_id"), "doc"))
    return found.select(F.col("run_id.record_id").alias("run_id"), "run_id.example_no", *C.COLUMNS[1:])


def contract_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as decisions on findings: unknown findings and other criteria."""
    a = table(spark, sf_dir, "annotations")
    d = a.select(F.col("annotation_id").alias("decision_id"), "item_id", F.upper(F.regexp_replace("criterion", r"^\s+|\s+$", "")).alias("criterion"))
    return C.dispositions(d, table(spark, sf_dir, "findings"))


def contract_json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes and impossible instants in every example's envelope."""
    e = nested.envelopes(table(spark, sf_dir, "golden_records"))
    return C.json_texts(e.select(F.concat_ws("/", "record_id", "example_no").alias("run_id"), "doc"))


QUERIES = {f.__name__: f for f in (envelope_histogram, envelope_rank_and_bound, envelope_summary, envelope_assemble, envelope_merge, envelope_rubrics, envelope_pack, envelope_baseline, envelope_exit_code, contract_violations, contract_unique_ids, contract_gates, contract_instants, contract_namespaces, contract_report, contract_json_counts, contract_dispositions, contract_json_texts)}

_H = "h AS (SELECT run_id, " + ", ".join(f"count(*) FILTER (severity = {i}) AS n{i}" for i in range(5)) + ", count(*) AS n_findings FROM findings GROUP BY run_id)"
_ORDER = "severity DESC NULLS LAST, criterion NULLS LAST, location NULLS LAST, row_id"
_RB = f"""lo AS (SELECT *, coalesce(severity < 3, true) AS low FROM findings),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, low ORDER BY {_ORDER}) AS r, count(*) FILTER (low) OVER (PARTITION BY run_id) AS nl FROM lo),
k AS (SELECT *, greatest(nl - 5, 0) AS suppressed_count, row_number() OVER (PARTITION BY run_id ORDER BY {_ORDER}) AS rank FROM r WHERE NOT low OR r <= 5),
e AS (SELECT *, 'F-' || CASE WHEN rank < 1000 THEN lpad(rank::VARCHAR, 3, '0') ELSE rank::VARCHAR END AS id FROM k)"""
_TS = r"""regexp_matches(run_timestamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z$') AND try_cast(regexp_replace(regexp_replace(regexp_replace(run_timestamp, '(\.[0-9]+)?Z$', ''), ':60$', ':59'), 'T', ' ') AS TIMESTAMP) IS NULL"""
_GATES = "SELECT run_id, 'summary.gate' AS path, 'gate-matches-counts' AS rule, 'error' AS level, 'should be ' || want AS message FROM (SELECT r.*, CASE WHEN coalesce(n4, 0) > 0 OR coalesce(n3, 0) > coalesce(severity_3_threshold, 0) THEN 'fail' ELSE 'pass' END AS want FROM runs r LEFT JOIN h USING (run_id)) WHERE coalesce(gate <> want, true)"
_UNIQ = "SELECT run_id, 'findings.' || finding_id || '.id' AS path, 'unique-finding-ids' AS rule, 'error' AS level, 'occurs ' || count(*) || ' times' AS message FROM findings WHERE finding_id IS NOT NULL GROUP BY run_id, finding_id HAVING count(*) > 1"
_LOW = "SELECT run_id, 'findings' AS path, 'output-bound' AS rule, 'warning' AS level, count(*) FILTER (severity < 3) || ' findings below severity 3' AS message FROM findings GROUP BY run_id HAVING count(*) FILTER (severity < 3) > 5"


def _clean(c: str, n: int) -> str:
    return rf"regexp_replace(left(regexp_replace(regexp_replace(regexp_replace({c}, '\s*[—–]\s*', ' - ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), {n}), '\s+$', '') AS {c}"


def _label(n: str) -> str:
    return rf"nullif(regexp_replace(regexp_replace(split_part(regexp_extract(b, '(?s)(?:^|\n)\s*{n}:[ \t]*(.*)', 1), chr(1), 1), '\s*\n\s*', ' ', 'g'), '^\s+|\s+$', '', 'g'), '')"


SQL = {
    "envelope_histogram": f"WITH {_H} SELECT * FROM h",
    "envelope_rank_and_bound": f"WITH {_RB} SELECT run_id, row_id, rank, id, suppressed_count FROM e",
    "envelope_summary": f"WITH {_H} SELECT *, 0 AS severity_3_threshold, greatest(n0 + n1 + n2, n_findings - n3 - n4) - least(greatest(n_findings - n3 - n4, 0), 5) AS suppressed_count, CASE WHEN n4 > 0 OR n3 > 0 THEN 'fail' ELSE 'pass' END AS gate FROM h",
    "envelope_assemble": f"""WITH {_H}, {_RB}, g AS (SELECT run_id, count(*) AS n, string_agg(id, ' ' ORDER BY rank) AS ids, arg_min(criterion, rank) AS fc, max(suppressed_count) AS sc FROM e GROUP BY run_id)
SELECT run_id, coalesce(n, 0) AS n_emitted, fc AS first_criterion, coalesce(ids, '') AS ids, coalesce(sc, 0) AS suppressed_count, CASE WHEN coalesce(n4, 0) > 0 OR coalesce(n3, 0) > coalesce(severity_3_threshold, 0) THEN 'fail' ELSE 'pass' END AS gate FROM runs LEFT JOIN g USING (run_id) LEFT JOIN h USING (run_id)""",
    "envelope_merge": "SELECT row_id, CASE WHEN len(m) > 0 THEN 'missing ' || array_to_string(m, ', ') END AS error, coalesce(lane, 'scripted') AS lane, CASE WHEN coalesce(lane, 'scripted') = 'scripted' THEN 'high' ELSE coalesce(confidence, 'high') END AS confidence, severity, " + ", ".join(_clean(c, n) for c, n in E.LIMITS.items()) + " FROM (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in E.REQUIRED) + "], lambda x: x IS NOT NULL) AS m FROM findings)",
    "envelope_rubrics": "SELECT run_id, string_agg(ns, ' ' ORDER BY ns) AS rubrics FROM (SELECT DISTINCT run_id, split_part(criterion, '-', 1) AS ns FROM findings) GROUP BY run_id",
    "envelope_pack": """WITH o AS (SELECT run_id, criterion, location, evidence, min(row_id) AS o FROM findings WHERE location IS NOT NULL AND evidence IS NOT NULL GROUP BY ALL), n AS (SELECT *, count(*) OVER (PARTITION BY run_id, criterion) AS k, row_number() OVER (PARTITION BY run_id, criterion ORDER BY o) AS r FROM o)
SELECT run_id, criterion, location, evidence, CASE WHEN k >= 3 THEN k ELSE 0 END AS n_instances FROM n WHERE k < 3 OR r = 1""",
    "envelope_baseline": r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\r\n?|[\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n(?:[ \t\f\r\x0B]*\n)+', chr(2), 'g'), chr(2)) AS l FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, i - 1 AS block, regexp_replace(l[i], '\n(\s*(?:Location|Evidence|Problem|Fix):)', chr(1) || chr(10) || '\1', 'g') AS b FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM t)),
f AS (SELECT doc_id, block, """ + ", ".join(f"{_label(n)} AS {c}" for n, c in (("Location", "location"), ("Evidence", "evidence"), ("Problem", "violation"), ("Fix", "fix"))) + " FROM b) SELECT *, 'BASELINE-GENERIC' AS criterion, 3 AS severity, 'judged' AS lane, 'medium' AS confidence FROM f WHERE location IS NOT NULL AND evidence IS NOT NULL AND violation IS NOT NULL AND fix IS NOT NULL",
    "contract_unique_ids": _UNIQ,
    "contract_gates": f"WITH {_H} {_GATES}",
    "contract_instants": f"SELECT run_id, 'run.timestamp' AS path, 'real-instants' AS rule, 'error' AS level, 'names no real instant' AS message FROM runs WHERE {_TS}",
    "contract_namespaces": "SELECT run_id, 'findings.' || coalesce(finding_id, '?') || '.criterion' AS path, 'rubrics-cover-findings' AS rule, 'error' AS level, 'no rubric ' || split_part(criterion, '-', 1) AS message FROM findings JOIN runs USING (run_id) WHERE criterion IS NOT NULL AND NOT list_contains(coalesce(rubrics, []), split_part(criterion, '-', 1))",
    "contract_dispositions": r"SELECT annotation_id AS decision_id, CASE WHEN f.row_id IS NULL THEN 'finding is not in the envelope' ELSE 'criterion differs' END AS message FROM annotations a LEFT JOIN findings f ON f.row_id = a.item_id WHERE f.row_id IS NULL OR coalesce(upper(regexp_replace(a.criterion, '^\s+|\s+$', '', 'g')) <> f.criterion, false)",
}


def _v(source: str, where: str, path: str, rule: str, message: str, level: str = "error") -> str:
    p = path if path.startswith("'") else f"'findings.' || coalesce(finding_id, '?') || '.{path}'"
    return f"SELECT run_id, {p} AS path, '{rule}' AS rule, '{level}' AS level, {message} AS message FROM {source} WHERE {where}"


_TS_OK = r"regexp_full_match(run_timestamp, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z')"
_DASHES = lambda t: f"CASE WHEN contains({t}, '—') THEN 'em dash' ELSE 'en dash' END"
_RULES = [
    *[_v("findings", f"{c} IS NULL OR {c} = ''", c, "schema", "'is required'") for c in ("criterion", "location", "evidence", "violation", "fix")],
    *[_v("findings", f"length({c}) > {n}", c, "schema", f"'is longer than {n}'") for c, n in (("criterion", 64), ("location", 400), ("evidence", 2000), ("violation", 1000), ("fix", 1000))],
    _v("findings", r"NOT regexp_full_match(criterion, '[A-Z][A-Z0-9]*(?:-[A-Z0-9]+(?:\.[A-Z0-9]+)*)+')", "criterion", "schema", "'is no criterion id'"),
    _v("findings", "NOT coalesce(regexp_full_match(finding_id, 'F-[0-9]{1,6}'), false)", "id", "schema", "'is no finding id'"),
    _v("findings", "NOT coalesce(lane IN ('scripted', 'judged'), false)", "lane", "schema", "'is not scripted or judged'"),
    _v("findings", "NOT coalesce(confidence IN ('high', 'medium', 'low'), false)", "confidence", "schema", "'is not high, medium or low'"),
    _v("findings", "NOT coalesce(severity BETWEEN 0 AND 4, false)", "severity", "schema", "'is not 0 to 4'"),
    _v("findings", "lane = 'scripted' AND confidence <> 'high'", "confidence", "schema", "'scripted findings are of high confidence'"),
    _v("findings", "len(instances) = 1", "instances", "schema", "'holds fewer than two'"),
    _v("findings", "len(list_distinct([x::VARCHAR FOR x IN instances])) < len(instances)", "instances", "schema", "'holds one twice'"),
    _v("findings", "criterion LIKE 'BYOR-%' AND NOT coalesce(rubric_source = 'byor', false)", "rubric_source", "schema", "'is not byor'"),
    *[_v("findings", f"regexp_matches({c}, '[—–]')", c, "no-dashes", _DASHES(c)) for c in ("criterion", "location", "evidence", "violation", "fix")],
    *[_v(f"(SELECT *, array_to_string([x.{c} FOR x IN instances], ' ') AS t FROM findings)", "regexp_matches(t, '[—–]')", f"instances.{c}", "no-dashes", _DASHES("t")) for c in ("location", "evidence")],
    _v("runs", "NOT coalesce(regexp_full_match(artifact_sha256, '[0-9a-f]{64}'), false)", "'run.artifact_sha256'", "schema", "'is no SHA-256'"),
    _v("runs", f"NOT coalesce({_TS_OK}, false)", "'run.timestamp'", "schema", "'is no UTC timestamp'"),
    _v("runs", _TS, "'run.timestamp'", "real-instants", "'names no real instant'"),
    *[_v("runs", f"regexp_matches({c}, '[—–]')", f"'run.{c}'", "no-dashes", _DASHES(c)) for c in ("skill", "skill_version", "model")],
    SQL["contract_namespaces"], _UNIQ, _GATES, _LOW,
    "SELECT run_id, 'summary.severity_3_threshold' AS path, 'producer-declared-threshold' AS rule, 'warning' AS level, n3 || ' findings of severity 3 pass' AS message FROM runs JOIN h USING (run_id) WHERE severity_3_threshold > 0 AND n4 = 0 AND n3 > 0 AND n3 <= severity_3_threshold",
]
_VIOLATIONS = f"WITH {_H}, v AS ({' UNION ALL '.join(_RULES)})"
SQL["contract_violations"] = _VIOLATIONS + " SELECT rule, level, message, count(*) AS n, count(DISTINCT run_id) AS n_runs FROM v GROUP BY rule, level, message"
SQL["contract_report"] = _VIOLATIONS + ", p AS (SELECT run_id, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w FROM v GROUP BY run_id) SELECT count(*) AS n_runs, count(*) FILTER (coalesce(e, 0) > 0) AS n_failed, coalesce(sum(e), 0) AS n_errors, coalesce(sum(w), 0) AS n_warnings FROM runs LEFT JOIN p USING (run_id)"
SQL["envelope_exit_code"] = _VIOLATIONS + ", x AS (SELECT DISTINCT run_id FROM v WHERE level = 'error') SELECT run_id, CASE WHEN x.run_id IS NOT NULL THEN 3 WHEN coalesce(n4, 0) > 0 THEN 1 WHEN coalesce(n3, 0) > coalesce(severity_3_threshold, 0) THEN 2 ELSE 0 END AS code FROM runs LEFT JOIN h USING (run_id) LEFT JOIN x USING (run_id)"
