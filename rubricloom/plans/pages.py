"""Queries of the microcopy and documentation rules over documents, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from rubricloom.functions import text as T
from rubricloom.operators.checks import docs, microcopy
from rubricloom.plans.checks import BLOCKS, _documents, _q


def _microcopy(spark: SparkSession, sf_dir: str, criterion: str) -> DataFrame:
    return microcopy.run(microcopy.messages(_documents(spark, sf_dir)), criterion)


def blocks_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = microcopy.messages(_documents(spark, sf_dir)).where("annotated")
    return m.select("doc_id", "sec", "heading", "n", "text", "signal", "fires", "suggested_fix", "total")


def check_diataxis_heading_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.heading_depth(_documents(spark, sf_dir))


def check_diataxis_nav_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.nav_length(_documents(spark, sf_dir))


def check_diataxis_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs.mode(_documents(spark, sf_dir))


def check_microcopy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six microcopy rules from one reading of the messages."""
    return microcopy.check(_documents(spark, sf_dir))


QUERIES = {"check_" + c.lower().replace("-", "_"): partial(_microcopy, criterion=c) for c in microcopy.CRITERIA} | {f.__name__: f for f in (check_microcopy, blocks_messages, check_diataxis_heading_depth, check_diataxis_nav_length, check_diataxis_mode)}

_L = "|".join(microcopy.LABELS)


def _field(n: str) -> str:
    return rf"CASE WHEN regexp_matches(b, '(?m)^{n}:') THEN regexp_replace(replace(split_part(regexp_extract(m, '(?s)(?:^|\n){n}:[ \t]*(.*)', 1), chr(1), 1), chr(10), ' '), '^\s+|\s+$', '', 'g') END"


_MSG = BLOCKS + rf""", b0 AS (SELECT doc_id, sec, heading, i, list_filter([regexp_replace(l, '^\s+|\s+$', '', 'g') FOR l IN string_split(bs[i], chr(10))], lambda l: l <> '') AS ls FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM chunks)),
b1 AS (SELECT *, array_to_string(ls, chr(10)) AS b FROM b0), b2 AS (SELECT *, regexp_replace(b, '\n((?:{_L}):)', chr(1) || chr(10) || '\1', 'g') AS m FROM b1 WHERE regexp_matches(b, '^(?:{_L}):') AND regexp_matches(b, '(?m)^Message:')),
msg AS (SELECT doc_id, sec, heading, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i) AS n, {_field('Message')} AS text, {', '.join(f"{_field(x)} AS {x.lower().replace(' ', '_')}" for x in microcopy.LABELS[1:])}, count(*) OVER (PARTITION BY doc_id, heading) AS total FROM b2),
ann AS (SELECT DISTINCT doc_id FROM b1 WHERE regexp_matches(b, '^(?:{_L}):')),
bare0 AS (SELECT doc_id, sec, heading, i, CASE WHEN regexp_matches(ls[1], '^[-*+]\s+') THEN [regexp_replace(regexp_replace(x, '^[-*+]\s+', ''), '^\s+|\s+$', '', 'g') FOR x IN list_filter(ls, lambda y: regexp_matches(y, '^[-*+]\s+'))] ELSE [array_to_string(ls, ' ')] END AS xs FROM b1 WHERE doc_id NOT IN (SELECT doc_id FROM ann)),
bare1 AS (SELECT doc_id, sec, heading, i, k, xs[k] AS text FROM (SELECT *, unnest(range(1, len(xs) + 1)) AS k FROM bare0)),
bare AS (SELECT doc_id, sec, heading, row_number() OVER (PARTITION BY doc_id, sec ORDER BY i, k) AS n, text, {', '.join(f"NULL::VARCHAR AS {x.lower().replace(' ', '_')}" for x in microcopy.LABELS[1:])}, count(*) OVER (PARTITION BY doc_id, heading) AS total FROM bare1 WHERE text <> ''),
every AS (SELECT * FROM msg UNION ALL SELECT * FROM bare)
"""


def _sql(criterion: str, where: str, severity: str, evidence: str, part: str = "") -> str:
    tail = f" || ', {part}'" if part else ""
    return _MSG + f"SELECT doc_id, sec, n, '{criterion}' AS criterion, CASE WHEN {severity} END AS severity, CASE WHEN coalesce(heading, '') <> '' THEN heading || ', ' ELSE '' END || 'message ' || n{tail} AS location, {evidence} AS evidence FROM every WHERE {where}"


def _m(phrases: list[str]) -> str:
    return f"regexp_matches(text, '{_q(T.lexicon(phrases))}')"


SQL = {
    "blocks_messages": _MSG + "SELECT doc_id, sec, heading, n, text, signal, fires, suggested_fix, total FROM msg",
    "check_nng_em_constructive": _sql("NNG-EM-CONSTRUCTIVE", f"NOT {_m(microcopy.INSTRUCTIONS)}", "lower(suggested_fix) IN ('described', 'selectable') THEN 2 ELSE 3", "text"),
    "check_nng_em_neutral_tone": _sql("NNG-EM-NEUTRAL-TONE", _m(microcopy.BLAME), f"{_m(microcopy.REPETITION)} THEN 3 ELSE 2", "text"),
    "check_nng_em_not_color_only": _sql("NNG-EM-NOT-COLOR-ONLY", r"lower(regexp_replace(string_split(signal, ',')[-1], '^\s+|\s+$', '', 'g')) = 'none'", "lower(container) = 'toast' THEN 3 ELSE 2", "signal", "Signal"),
    "check_nng_em_preserve_input": _sql("NNG-EM-PRESERVE-INPUT", "lower(input_on_resubmission) = 'cleared'", "total >= 3 THEN 3 ELSE 2", "input_on_resubmission", "Input on resubmission"),
    "check_nng_em_timing": _sql("NNG-EM-TIMING", "lower(fires) IN ('mid-keystroke', 'on-load-before-input')", f"{_m(microcopy.ERROR_TONE)} THEN 3 ELSE 2", "fires", "Fires"),
    "check_diataxis_heading_depth": BLOCKS + """, h AS (SELECT doc_id, level, heading, row_number() OVER w - 1 AS i, lag(level) OVER w AS before FROM secs WHERE heading IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY sec)),
j AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM h WHERE level > before + 1)
SELECT doc_id, i AS at_, 'DIATAXIS-HEADING-DEPTH' AS criterion, CASE WHEN k >= 2 THEN 3 ELSE 2 END AS severity, 'the ' || heading || ' heading' AS location, 'level ' || before || ' to ' || level AS evidence FROM j""".replace("at_", '"at"'),
}
_CODE = r"(?:^|[^A-Za-z0-9])((?:[A-Z]{2,}[_-][A-Z0-9_-]*|0x[0-9A-Fa-f]+|ERR\d+|E\d{3,4}))(?:[^A-Za-z0-9]|$)"
_SPAN = f"coalesce(nullif(regexp_extract(text, '{_CODE}', 1), ''), nullif(regexp_extract(text, '{_q(microcopy.STATUS)}', 0), ''), nullif(regexp_extract(text, '{_q(T.lexicon(microcopy.JARGON))}', 0), ''))"
SQL["check_nng_em_plain_language"] = _sql("NNG-EM-PLAIN-LANGUAGE", "span IS NOT NULL", r"len(regexp_extract_all(left(text, strpos(text, span) - 1) || ' ' || substr(text, strpos(text, span) + length(span)), '\S+')) <= 3 THEN 3 ELSE 2", "span").replace("FROM every", f"FROM (SELECT *, {_SPAN} AS span FROM every)")
SQL["check_microcopy"] = " UNION ALL ".join("SELECT doc_id, sec, n, criterion, severity, location, evidence FROM (" + SQL["check_" + c.lower().replace("-", "_")] + ")" for c in microcopy.CRITERIA)
