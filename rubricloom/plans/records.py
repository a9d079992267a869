"""Queries of the core record operators: failed lines (problem 1) and nested records (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricloom.operators import nested, rejects
from rubricloom.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(rejects.parse_lines(table(spark, sf_dir, "raw_lines")))


def p1_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.loaded(rejects.parse_lines(table(spark, sf_dir, "raw_lines"))).select("line_id", "finding_id", "criterion", "lane", "severity", "location", "evidence", "confidence")


def p1_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, failed lines and failures by reason of each feed."""
    why = rejects.parse_lines(table(spark, sf_dir, "raw_lines"), also=("feed",))
    per = [F.count_if(F.array_contains("reasons", r)).alias(f"n_{r}") for r in ("quoting", "column_count", "severity", "confidence", "lane")]
    return why.groupBy("feed").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.size("reasons") > 0).alias("n_failed"), *per)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(table(spark, sf_dir, "golden_records"), "instances", outer=True).drop("instance_evidence")


def p6_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(table(spark, sf_dir, "golden_records"), "examples")


def p6_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(table(spark, sf_dir, "golden_records"), "findings")


QUERIES = {f.__name__: f for f in (p1_found, p1_loaded, p1_feeds, p6_found, p6_examples, p6_findings)}


def _fields(sep: str) -> str:
    one = f'(?:"(?:[^"]|"")*"|[^"{sep}]*)'
    return f"""SELECT line_id, feed, regexp_full_match(line, '{one}(?:{sep}{one})*') AS well, regexp_extract_all('{sep}' || line, '{sep}({one})', 1) AS f
    FROM raw_lines WHERE fmt = '{ {',': 'csv', ';': 'ssv'}.get(sep, 'tsv') }'"""


_PARSED = f"""WITH split AS ({' UNION ALL '.join(_fields(s) for s in (',', ';', chr(9)))}),
plain AS (SELECT line_id, feed, well, [CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END FOR x IN f] AS f FROM split),
why AS (SELECT line_id, feed, f, CASE WHEN NOT well THEN ['quoting'] WHEN len(f) <> 8 THEN ['column_count'] ELSE list_filter([
  CASE WHEN f[4] NOT IN ('0', '1', '2', '3', '4') THEN 'severity' END,
  CASE WHEN f[7] NOT IN ('high', 'medium', 'low', '') THEN 'confidence' END,
  CASE WHEN f[3] NOT IN ('scripted', 'judged', '') THEN 'lane' END], lambda x: x IS NOT NULL) END AS reasons FROM plain)
"""

SQL = {
    "p1_found": _PARSED + "SELECT line_id, unnest(reasons) AS reason FROM why",
    "p1_loaded": _PARSED + "SELECT line_id, f[1] AS finding_id, f[2] AS criterion, nullif(f[3], '') AS lane, CAST(f[4] AS INTEGER) AS severity, f[5] AS location, f[6] AS evidence, nullif(f[7], '') AS confidence FROM why WHERE len(reasons) = 0",
    "p1_feeds": _PARSED + "SELECT feed, count(*) AS n_lines, count(*) FILTER (len(reasons) > 0) AS n_failed, " + ", ".join(f"count(*) FILTER (list_contains(reasons, '{r}')) AS n_{r}" for r in ("quoting", "column_count", "severity", "confidence", "lane")) + " FROM why GROUP BY feed",
}

_EX = """WITH r AS (SELECT record_id, CAST(record AS JSON) AS j FROM golden_records),
lists AS (SELECT record_id, CASE WHEN json_type(j) = 'ARRAY' THEN CAST(j AS JSON[]) WHEN json_type(j, '$.examples') = 'ARRAY' THEN CAST(j->'$.examples' AS JSON[]) ELSE [j] END AS l FROM r),
ex AS (SELECT record_id, i - 1 AS example_no, l[i] AS e FROM (SELECT record_id, l, unnest(range(1, len(l) + 1)) AS i FROM lists)),
env AS (SELECT record_id, example_no, e, CASE WHEN json_type(e, '$.expected_envelope') = 'VARCHAR' THEN CAST(e->>'$.expected_envelope' AS JSON) ELSE e->'$.expected_envelope' END AS v FROM ex),
fl AS (SELECT record_id, example_no, coalesce(v->>'$.run.skill', '') AS skill, CASE json_type(v, '$.findings') WHEN 'ARRAY' THEN CAST(v->'$.findings' AS JSON[]) WHEN 'OBJECT' THEN [v->'$.findings'] ELSE [] END AS l FROM env),
fi AS (SELECT record_id, example_no, skill, i - 1 AS finding_no, l[i] AS f FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM fl)),
il AS (SELECT *, CASE json_type(f, '$.instances') WHEN 'ARRAY' THEN CAST(f->'$.instances' AS JSON[]) WHEN 'OBJECT' THEN [f->'$.instances'] WHEN 'VARCHAR' THEN [f->'$.instances'] ELSE [] END AS l FROM fi)
"""
SQL["p6_found"] = _EX + """SELECT record_id, example_no, skill, finding_no, coalesce(f->>'$.id', '') AS finding_id, CAST(i - 1 AS BIGINT) AS instance_no,
coalesce(CASE WHEN i = 0 THEN '' WHEN json_type(l[i]) = 'VARCHAR' THEN l[i]->>'$' ELSE l[i]->>'$.location' END, '') AS instance_location
FROM (SELECT *, unnest(CASE WHEN len(l) = 0 THEN [0] ELSE range(1, len(l) + 1) END) AS i FROM il)"""
SQL["p6_examples"] = _EX + "SELECT record_id, example_no, " + ", ".join(f"e->>'$.{n}' AS {n}" for n in ("kind", "artifact", "note", "query")) + ", coalesce(json_type(v), 'NULL') <> 'NULL' AS has_envelope, " + ", ".join(f"v->>'$.run.{n}' AS \"{n}\"" for n in ("skill", "skill_version", "contract_version", "model", "timestamp")) + " FROM env"
SQL["p6_findings"] = _EX + "SELECT record_id, example_no, skill, finding_no, coalesce(f->>'$.id', '') AS finding_id, " + ", ".join(f"f->>'$.{n}' AS {n}" for n in ("criterion", "lane", "severity", "location", "evidence", "violation", "fix", "confidence")) + " FROM fi"
