"""Queries of the prose rule checks over documents, one for each criterion, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import lanes, prose
from rubricloom.operators.checks import argument, clarity, toy
from rubricloom.operators.checks import lexicons as L
from rubricloom.session import spread, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def _clarity(spark: SparkSession, sf_dir: str, criterion: str) -> DataFrame:
    return clarity.run(_documents(spark, sf_dir), criterion)


def _name(criterion: str) -> str:
    return "check_" + criterion.lower().replace("-", "_").replace(".", "_")


def check_toulmin_claim_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return argument.claim_marker(_documents(spark, sf_dir))


def check_toulmin_hedge_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return argument.hedge_density(_documents(spark, sf_dir))


def blocks_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = prose.sections(_documents(spark, sf_dir))
    return s.select("doc_id", "sec", "level", "heading", T.words(F.col("body")).alias("n_words"))


def blocks_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = prose.paragraphs(_documents(spark, sf_dir))
    return p.select("doc_id", "sec", "heading", "n", "text", F.size("sentences").alias("n_sentences"))


def blocks_normative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the scoring grammar by document and kind."""
    return prose.blocks(_documents(spark, sf_dir)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("n_lines"))


def blocks_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path of headings to each heading."""
    h = prose.heading_paths(_documents(spark, sf_dir))
    return h.select("doc_id", "at", "level", F.array_join("path", " > ").alias("path"))


def blocks_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = prose.pipe_tables(_documents(spark, sf_dir))
    return t.select("doc_id", "row", F.size("cells").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


def lane_scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emitted findings of the argument skill's scripted lane."""
    e = lanes.envelopes(_documents(spark, sf_dir), "critique-argument")
    return e.select("doc_id", "id", "criterion", "severity", "lane", "confidence", "suppressed_count")


def check_toy_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toy.first_sentences(_documents(spark, sf_dir))


def check_toy_orphan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toy.orphans(_documents(spark, sf_dir))


def check_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fifteen clarity rules from one parse."""
    return clarity.check(_documents(spark, sf_dir))


QUERIES = {_name(c): partial(_clarity, criterion=c) for c in clarity.CRITERIA} | {f.__name__: f for f in (check_clarity, check_toulmin_claim_marker, check_toulmin_hedge_density, blocks_sections, blocks_paragraphs, blocks_normative, blocks_paths, blocks_tables, lane_scripted, check_toy_first, check_toy_orphan)}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
BLOCKS = r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\r\n?|[\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS u, text FROM documents WHERE text IS NOT NULL),
cut AS (SELECT doc_id, string_split(regexp_replace(u, '(?m)^(#{1,6}[ \t]+[^\n]*)$', chr(1) || '\1', 'g'), chr(1)) AS l FROM t),
parts AS (SELECT doc_id, i - 1 AS sec, l[i] AS part, i > 1 OR regexp_matches(l[i], '^#{1,6}[ \t]+') AS inside FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM cut)),
allsecs AS (SELECT doc_id, sec, CASE WHEN inside THEN length(regexp_extract(part, '^#*')) END AS level, CASE WHEN inside THEN regexp_replace(regexp_extract(part, '^#{1,6}[ \t]+([^\n]*)', 1), '^\s+|\s+$', '', 'g') END AS heading,
  CASE WHEN inside THEN regexp_replace(part, '^[^\n]*\n?', '') ELSE part END AS body FROM parts),
secs AS (SELECT * FROM allsecs WHERE level IS NOT NULL OR regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''),
chunks AS (SELECT doc_id, sec, level, heading, list_filter(string_split(regexp_replace(body, '\n(?:[ \t\f\r\x0B]*\n)+', chr(1), 'g'), chr(1)), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g') <> '') AS bs FROM secs),
paras AS (SELECT doc_id, sec, level, heading, i AS n, regexp_replace(replace(regexp_replace(bs[i], '^\n+|\n+$', '', 'g'), chr(10), ' '), '^\s+|\s+$', '', 'g') AS text, len(bs) AS n_paras FROM (SELECT *, unnest(range(1, len(bs) + 1)) AS i FROM chunks)),
ps AS (SELECT *, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS ss FROM paras),
ss AS (SELECT doc_id, sec, heading, n, ss, len(ss) AS n_all, unnest(ss) AS s FROM ps)
"""
_LOC = "CASE WHEN coalesce(heading, '') <> '' THEN heading || ', paragraph ' || n ELSE 'paragraph ' || n END"


def _q(p: str) -> str:
    return p.replace("'", "''")


def _sel(criterion: str, severity: str, source: str, where: str, evidence: str = "s", location: str = _LOC, n: str = "n") -> str:
    return BLOCKS + f"SELECT doc_id, sec, {n} AS n, '{criterion}' AS criterion, {severity} AS severity, {location} AS location, {evidence} AS evidence FROM {source} WHERE {where}"


def _hit(criterion: str, pattern: str, ratio: float | None, severity: str = "") -> str:
    p = _q(pattern)
    sev = severity or f"CASE WHEN n_all >= 3 AND len(list_filter(ss, lambda x: regexp_matches(x, '{p}'))) / n_all >= {ratio} THEN 3 ELSE 2 END"
    return _sel(criterion, sev, "ss", f"regexp_matches(s, '{p}')")


def _n(pattern: str, c: str = "s") -> str:
    return f"len(regexp_extract_all({c}, '{_q(pattern)}'))"


_SERIES_T = r"regexp_replace(regexp_replace(regexp_replace(s, '^\s+|\s+$', '', 'g'), '[.!?]+$', ''), ';', ',', 'g')"
_ITEMS = rf"""CASE WHEN {_SERIES_T} = '' THEN [] WHEN contains({_SERIES_T}, ',') AND regexp_matches({_SERIES_T}, '(?i),?\s+(?:and|or)\s+') THEN
 list_filter([regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(regexp_replace({_SERIES_T}, '(?i),?\s+(?:and|or)\s+', ', ', 'g'), ',')], lambda x: x <> '') ELSE [{_SERIES_T}] END"""
_SEG = r"[regexp_replace(x, '^\s+|\s+$', '', 'g') FOR x IN string_split(s, ',')]"
_IT = f"(SELECT *, {_ITEMS} AS items, {_SEG} AS seg, {_n(T.lexicon(L.SUBORDINATORS))} AS m, {_n(L.STEPS)} AS steps, {_n(chr(92) + 'S+')} AS w FROM ss)"
_OK = r"len(seg) >= 3 AND len(regexp_extract_all(seg[1], '\S+')) <= 8"
_IT2 = rf"(SELECT *, CASE WHEN {_OK} THEN len(seg) - 2 ELSE 0 END AS k, CASE WHEN {_OK} THEN len(regexp_extract_all(array_to_string(seg[2:len(seg) - 1], ' '), '\S+')) ELSE 0 END AS aw FROM {_IT})"
_CONTENT = "list_filter(regexp_extract_all(lower({}), '[a-z'']+'), lambda w: length(w) > 2 AND w NOT IN ({}))"
_STOP = ", ".join(f"'{w}'" for w in L.STOPWORDS)
_MUST = T.lexicon(L.NON_MUST)
_HEADCLASS = rf"""list_transform(items, lambda x, i: CASE WHEN len(list_filter(regexp_split_to_array(ITEM, '\s+'), lambda y: y <> '')) = 0 THEN 'other'
 WHEN regexp_matches(lower(regexp_replace(ITEM, '^\s+', '')), '^[.,;:]*to[.,;:]*\s+\S') THEN 'infinitive'
 WHEN regexp_matches(regexp_replace(lower(regexp_extract(regexp_replace(ITEM, '^\s+', ''), '^\S+')), '^[.,;:]+|[.,;:]+$', '', 'g'), '^[a-z]+ing$') THEN 'gerund' ELSE 'other' END)""".replace("ITEM", rf"(CASE WHEN i = 1 THEN regexp_replace(x, '(?is)^.*\b(?:{'|'.join(L.INTRODUCERS)})\s+', '') ELSE x END)")
_START = rf"(?i)^(?:{T.alternation(L.TRANSITIONS)})\b"
_PCLASS = f"(SELECT *, list_distinct({_HEADCLASS}) AS classes FROM {_IT})"

SQL = {
    "blocks_sections": BLOCKS + r"SELECT doc_id, sec, level, heading, len(regexp_extract_all(body, '\S+')) AS n_words FROM secs",
    "blocks_paragraphs": BLOCKS + "SELECT doc_id, sec, heading, n, text, len(ss) AS n_sentences FROM ps",
    "check_plain_active": _hit("PLAIN-ACTIVE", L.PASSIVE, 0.75),
    "check_plain_concise": _hit("PLAIN-CONCISE", T.lexicon(L.WORDY), None, f"CASE WHEN list_sum([{_n(T.lexicon(L.WORDY), 'x')} FOR x IN ss]) >= 3 THEN 3 ELSE 2 END"),
    "check_plain_double_negative": _sel("PLAIN-DOUBLE-NEGATIVE", f"CASE WHEN {_n(T.lexicon(L.NEGATIONS))} >= 3 THEN 3 ELSE 2 END", "ss", f"{_n(T.lexicon(L.NEGATIONS))} >= 2"),
    "check_plain_headings": BLOCKS + r""", h AS (SELECT *, len(regexp_extract_all(body, '\S+')) AS k FROM secs WHERE heading IS NOT NULL)
SELECT doc_id, sec, 0 AS n, 'PLAIN-HEADINGS' AS criterion, 2 AS severity, 'the ' || heading || ' heading' AS location, 'heading: ' || heading AS evidence FROM h WHERE lower(heading) IN ('overview', 'general', 'miscellaneous', 'other', 'details')
UNION ALL SELECT doc_id, sec, 0, 'PLAIN-HEADINGS', CASE WHEN k > 800 THEN 3 ELSE 2 END, 'the ' || heading || ' heading', k || ' words up to the next heading' FROM h WHERE k > 400""",
    "check_plain_jargon": BLOCKS + rf""", x AS (SELECT *, list_filter(range(1, len(ss) + 1), lambda i: regexp_matches(ss[i], '{_q(T.lexicon(L.JARGON))}') AND NOT contains(ss[i], '(') AND NOT ({' OR '.join(f"contains(lower(ss[i] || ' ' || coalesce(ss[i + 1], '')), '{d}')" for d in L.DEFINITIONS)})) AS hits FROM ps)
SELECT doc_id, sec, n, 'PLAIN-JARGON' AS criterion, CASE WHEN len(hits) >= 3 THEN 3 ELSE 2 END AS severity, {_LOC} AS location, ss[unnest(hits)] AS evidence FROM x WHERE len(hits) > 0""",
    "check_plain_lists": _sel("PLAIN-LISTS", "CASE WHEN len(items) >= 5 OR steps >= 5 THEN 3 ELSE 2 END", _IT, "len(items) >= 3 OR steps >= 3"),
    "check_plain_must": BLOCKS + f"SELECT doc_id, sec, n, 'PLAIN-MUST' AS criterion, CASE WHEN {_n(_MUST, 't.text')} >= 2 AND regexp_matches(t.text, '{_q(T.lexicon(['must', 'should']))}') THEN 3 ELSE 2 END AS severity, {_LOC} AS location, s AS evidence FROM ss JOIN t USING (doc_id) WHERE regexp_matches(s, '{_q(_MUST)}')",
    "check_plain_nominalization": _hit("PLAIN-NOMINALIZATION", L.NOMINAL, 0.8),
    "check_plain_pronouns": _hit("PLAIN-PRONOUNS", T.lexicon(L.SUBSTITUTES), 0.75),
    "check_plain_paragraph": BLOCKS + rf""", x AS (SELECT *, list_distinct({_CONTENT.format('ss[1]', _STOP)}) AS f, {_CONTENT.format("array_to_string(ss[2:], ' ')", _STOP)} AS r, len(regexp_extract_all(text, '\S+')) AS k FROM ps WHERE len(ss) > 0),
y AS (SELECT *, len(ss) >= 3 AND len(f) > 0 AND len(list_intersect(f, r)) / len(f) < 0.15 AS alone FROM x)
SELECT doc_id, sec, n, 'PLAIN-PARAGRAPH' AS criterion, CASE WHEN alone THEN 3 ELSE 2 END AS severity, {_LOC} AS location, CASE WHEN alone THEN ss[1] ELSE k || ' words in one paragraph' END AS evidence FROM y WHERE alone OR k > 150""",
    "check_plain_sentence_length": _sel("PLAIN-SENTENCE-LENGTH", "CASE WHEN w >= 50 OR m >= 4 THEN 3 ELSE 2 END", _IT, "w > 30 OR m > 3"),
    "check_plain_subject_verb_object": _sel("PLAIN-SUBJECT-VERB-OBJECT", "CASE WHEN k >= 2 AND aw >= 15 THEN 3 ELSE 2 END", _IT2, "len(items) < 3 AND (k >= 2 OR aw >= 6)"),
    "check_plain_transitions": BLOCKS + rf""", f AS (SELECT *, n = 1 OR regexp_matches(text, '{_START}') AS brk FROM paras), g AS (SELECT *, sum(brk::INT) OVER (PARTITION BY doc_id, sec ORDER BY n) AS isl FROM f),
c AS (SELECT *, count(*) FILTER (NOT brk) OVER (PARTITION BY doc_id, sec, isl) AS run, regexp_extract_all(text, '\S+') AS w FROM g)
SELECT doc_id, sec, n, 'PLAIN-TRANSITIONS' AS criterion, CASE WHEN run >= 4 THEN 3 ELSE 2 END AS severity, {_LOC} AS location, array_to_string(w[1:12], ' ') || CASE WHEN len(w) > 12 THEN '...' ELSE '' END AS evidence FROM c WHERE NOT brk""",
    "check_williams_parallelism": _sel("WILLIAMS-PARALLELISM", "CASE WHEN len(items) >= 4 AND len(classes) >= 3 THEN 3 ELSE 2 END", _PCLASS, "len(items) >= 2 AND len(classes) >= 2"),
    "check_williams_shape": _sel("WILLIAMS-SHAPE", "CASE WHEN w >= 60 THEN 3 ELSE 2 END", _IT2, "w >= 40 AND len(items) < 3 AND (k >= 2 OR m >= 2)"),
}
_DOCS = BLOCKS + r""", o AS (SELECT doc_id, string_agg(CASE WHEN heading IS NOT NULL THEN heading END, chr(1) ORDER BY sec) AS hs, list(heading ORDER BY sec) FILTER (level = 1) AS tops FROM secs GROUP BY doc_id),
pieces AS (SELECT doc_id, sec, 0 AS n, heading AS x FROM secs WHERE heading IS NOT NULL UNION ALL SELECT doc_id, sec, n, text FROM paras),
prose AS (SELECT doc_id, string_agg(x, ' ' ORDER BY sec, n) AS prose FROM pieces GROUP BY doc_id),
loc AS (SELECT doc_id, CASE WHEN len(tops) > 0 THEN 'the whole document, under its "' || tops[1] || '" heading' ELSE 'the whole document, starting at line 1' END AS location FROM o)
"""
SQL["check_toulmin_claim_marker"] = _DOCS + rf"SELECT doc_id, 'TOULMIN-CLAIM-MARKER' AS criterion, CASE WHEN len(regexp_extract_all(prose, '\S*\w\S*')) >= 300 THEN 3 ELSE 2 END AS severity, location, 'no conclusion marker in ' || len(regexp_extract_all(prose, '\S*\w\S*')) || ' words' AS evidence FROM prose JOIN loc USING (doc_id) WHERE regexp_replace(prose, '^\s+|\s+$', '', 'g') <> '' AND NOT regexp_matches(prose, '{_q(T.lexicon(L.CLAIM_MARKERS))}')"
SQL["check_toulmin_hedge_density"] = _DOCS + f", d AS (SELECT doc_id, count(*) AS k, count(*) FILTER (regexp_matches(s, '{_q(T.lexicon(L.HEDGES))}')) AS h FROM ss GROUP BY doc_id) SELECT doc_id, 'TOULMIN-HEDGE-DENSITY' AS criterion, CASE WHEN h / k > 0.5 THEN 3 ELSE 2 END AS severity, location, h || ' of ' || k || ' sentences hedge' AS evidence FROM d JOIN loc USING (doc_id) WHERE h / k > 0.35"
_TOY = "CASE WHEN coalesce(heading, '') <> '' THEN heading || ', ' ELSE '' END || 'paragraph ' || k || ', first sentence'"
SQL["check_toy_first"] = BLOCKS + f", f AS (SELECT doc_id, sec, n, heading, ss[1] AS s, row_number() OVER (PARTITION BY doc_id ORDER BY sec, n) AS k FROM ps) SELECT doc_id, sec, n, 'TOY-ACTIVE' AS criterion, 2 AS severity, {_TOY} AS location, s AS evidence FROM f WHERE {' OR '.join(f"contains(s, '{x}')" for x in toy.PASSIVES)} UNION ALL SELECT doc_id, sec, n, 'TOY-HEDGE', 2, {_TOY}, s FROM f WHERE {' OR '.join(f"starts_with(lower(s), '{x}')" for x in toy.HEDGES)}"
SQL["check_toy_orphan"] = BLOCKS + r""", w AS (SELECT *, len(regexp_extract_all(body, '\S+')) AS k FROM secs WHERE heading IS NOT NULL)
SELECT doc_id, sec, 'TOY-ORPHAN' AS criterion, 3 AS severity, 'the ' || heading || ' heading' AS location FROM w x WHERE level > 1 AND (SELECT sum(k) FROM w y WHERE y.doc_id = x.doc_id AND y.sec >= x.sec AND y.sec < coalesce((SELECT min(z.sec) FROM w z WHERE z.doc_id = x.doc_id AND z.sec > x.sec AND z.level <= x.level), 1000000000)) = 0"""
_ALL = "doc_id, sec, n, criterion, severity, location, evidence"
SQL["check_clarity"] = " UNION ALL ".join(f"SELECT {_ALL} FROM ({SQL[_name(c)]})" for c in clarity.CRITERIA)
SQL["blocks_paths"] = BLOCKS + """, h AS (SELECT doc_id, level, heading, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS i FROM secs WHERE heading IS NOT NULL)
SELECT doc_id, i AS "at", level, (SELECT string_agg(a.heading, ' > ' ORDER BY a.i) FROM h a WHERE a.doc_id = x.doc_id AND a.i <= x.i AND NOT EXISTS (SELECT 1 FROM h z WHERE z.doc_id = x.doc_id AND z.i > a.i AND z.i <= x.i AND z.level <= a.level)) AS path FROM h x"""
SQL["blocks_tables"] = r"""WITH l AS (SELECT doc_id, list_filter(regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^[ \t\f\r]*(\|[^\n]*\|)[ \t\f\r]*$', 1), lambda x: NOT regexp_full_match(x, '\|[\s:|-]*\|')) AS l FROM documents WHERE text IS NOT NULL),
r AS (SELECT doc_id, i - 1 AS row, [trim(x) FOR x IN string_split(l[i][2:-2], '|')] AS c FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM l)) SELECT doc_id, row, len(c) AS n_cells, array_to_string(c, '|') AS cells FROM r"""
SQL["lane_scripted"] = "WITH f AS (SELECT doc_id, criterion, severity, evidence FROM (" + SQL["check_toulmin_claim_marker"] + ") UNION ALL SELECT doc_id, criterion, severity, evidence FROM (" + SQL["check_toulmin_hedge_density"] + ")) SELECT doc_id, 'F-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY severity DESC, criterion, evidence))::VARCHAR, 3, '0') AS id, criterion, severity, 'scripted' AS lane, 'high' AS confidence, 0 AS suppressed_count FROM f"
