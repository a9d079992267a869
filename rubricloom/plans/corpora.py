"""Queries of pages, the generated corpus, leaks, evals and sources, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import corpus, evals, markup, nested, places
from rubricloom.operators.checks import clarity, usability
from rubricloom.plans.checks import BLOCKS
from rubricloom.plans.records import SQL as RECORDS
from rubricloom.session import table

SEED = "corpus-1"


def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements by document and tag."""
    return markup.nodes(table(spark, sf_dir, "documents")).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"))


def html_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.check(table(spark, sf_dir, "documents"))


def html_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each page and how many of them a label names by its for."""
    n = markup.nodes(table(spark, sf_dir, "documents"))
    fields = n.where("tag IN ('input', 'select', 'textarea')").select("doc_id", "node_id", F.col("attrs")["id"].alias("i"))
    labels = n.where("tag = 'label'").select("doc_id", F.col("attrs")["for"].alias("i")).where("i IS NOT NULL").distinct().withColumn("named", F.lit(1))
    return fields.join(labels, ["doc_id", "i"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fields"), F.count("named").alias("n_named"))


def corpus_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted defects of a generated corpus (a recipe for each artifact) and whether their own rule finds them there."""
    made = corpus.build(table(spark, sf_dir, "artifacts").select(F.col("artifact_id").alias("recipe")), SEED)
    planted = made.select(F.col("recipe").alias("doc_id"), F.explode("defects").alias("d")).select("doc_id", "d.criterion", F.concat("d.heading", F.lit(", paragraph "), F.col("d.paragraph").cast("string")).alias("location"))
    found = clarity.check(made.select(F.col("recipe").alias("doc_id"), "text")).select("doc_id", "criterion", "location").distinct().withColumn("found", F.lit(True))
    j = planted.join(found, ["doc_id", "criterion", "location"], "left")
    return j.groupBy("criterion").agg(F.count(F.lit(1)).alias("n_planted"), F.count("found").alias("n_found"))


def corpus_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus made again against a lock in which the first domain is missing, the last was changed and one recipe for
    each domain is not in the corpus."""
    a = table(spark, sf_dir, "artifacts").select(F.col("artifact_id").alias("recipe"), "domain")
    ends = a.agg(F.min("domain").alias("lo"), F.max("domain").alias("hi")).first()
    made = corpus.build(a.select("recipe"), SEED)
    kept = corpus.lock(corpus.build(a.select("recipe"), SEED)).join(a, "recipe").where(F.col("domain") != ends["lo"])
    kept = kept.withColumn("sha256", F.when(F.col("domain") == ends["hi"], F.reverse("sha256")).otherwise(F.col("sha256")))
    more = a.select((-F.min("recipe").over(Window.partitionBy("domain")) - 1).alias("recipe")).distinct().withColumn("sha256", F.lit(""))
    return corpus.verify(made, kept.select("recipe", "sha256").unionByName(more)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def leak_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share six tokens in a row with an evaluation passage."""
    return corpus.description_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), "doc_id", "text", "item_id", "text")


def leak_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.path_leaks(table(spark, sf_dir, "artifacts"), "path", table(spark, sf_dir, "criteria")).select("artifact_id", "path", "leaks")


def places_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four places of each HTML page: an id, the first field, the last heading, and one that is not there."""
    d = table(spark, sf_dir, "documents").where(F.startswith(F.ltrim("text"), F.lit("<")))
    asks = F.explode(F.array(*[F.lit(x) for x in ("#s1", "the first field", "the last heading", "nowhere at all")]))
    pages = d.select(F.col("doc_id").alias("artifact_id"), F.lit("html").alias("artifact_type"), "text")
    claims = d.select(F.col("doc_id").alias("artifact_id"), asks.alias("location")).withColumn("key", F.col("location"))
    return places.resolve(pages, claims).select("artifact_id", F.col("key").alias("location"), "resolvable", "canonical")


def places_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three places of each string list that parses."""
    d = table(spark, sf_dir, "documents").where("artifact_type = 'string-list'").where(F.try_parse_json(F.ltrim("text")).isNotNull())
    pages = d.select(F.col("doc_id").alias("artifact_id"), "artifact_type", "text")
    claims = d.select(F.col("doc_id").alias("artifact_id"), F.explode(F.array(F.lit("item 2"), F.lit("last item"), F.lit("item 9999"))).alias("location")).withColumn("key", F.col("location"))
    return places.resolve(pages, claims).select("artifact_id", F.col("key").alias("location"), "resolvable", "canonical")


def check_nng_h3_deadend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usability.dead_ends(table(spark, sf_dir, "documents"))


def check_nng_h4_control_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usability.control_naming(table(spark, sf_dir, "documents"))


def check_nng_h6_labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usability.bare_controls(table(spark, sf_dir, "documents"))


def check_usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead ends, varying labels and bare controls of pages that are no HTML."""
    return usability.check(table(spark, sf_dir, "documents"))


def usability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of markdown pages with their anchors."""
    d = table(spark, sf_dir, "documents")
    return usability.states(d).select("doc_id", "pos", "label", "anchor", F.size("links").alias("n_links"))


def _rule(spark: SparkSession, sf_dir: str, criterion: str) -> DataFrame:
    c = markup.check(table(spark, sf_dir, "documents")).where(F.col("criterion") == criterion)
    return c.groupBy("doc_id", "criterion", "severity").agg(F.count(F.lit(1)).alias("n"))


RULES = ["WCAG-1.1.1", "WCAG-1.3.1", "WCAG-1.4.3", "WCAG-1.4.4", "WCAG-1.4.10", "WCAG-1.4.11", "WCAG-1.4.12", "WCAG-2.4.1", "WCAG-2.4.2", "WCAG-2.4.4", "WCAG-2.5.3", "WCAG-3.1.1", "WCAG-3.3.2"]


def evals_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = nested.flatten(table(spark, sf_dir, "golden_records"), "examples").join(table(spark, sf_dir, "golden_records").select("record_id", "feed"), "record_id")
    return evals.example_rules(e, "feed")


def evals_modal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotated item's most frequent severity."""
    a = table(spark, sf_dir, "annotations").where("severity IS NOT NULL")
    return evals.modal(a, ["item_id"], "severity", "annotation_id")


def evals_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.lanes(table(spark, sf_dir, "criteria"), table(spark, sf_dir, "findings"))


def evals_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as routing cases of their workspace: those of its commonest domain should trigger it."""
    d = table(spark, sf_dir, "documents").where("workspace IS NOT NULL AND domain IS NOT NULL")
    own = d.groupBy("workspace", "domain").agg(F.count(F.lit(1)).alias("n")).groupBy("workspace").agg(F.min_by("domain", F.struct(-F.col("n"), "domain")).alias("own_domain"))
    return evals.triggers(d.join(own, "workspace").withColumn("expected", F.col("domain") == F.col("own_domain")), "workspace")


def evals_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.long_quotes(table(spark, sf_dir, "documents"), "doc_id", "text")


def evals_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.lengths(table(spark, sf_dir, "documents"), "doc_id", "text", 30)


def evals_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a generated copy in which one language is missing, another changed and one is new."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text", "lang")
    made = d.where("lang IS DISTINCT FROM 'fr'").withColumn("text", F.when(F.col("lang") == "de", F.concat(F.coalesce("text", F.lit("")), F.lit("."))).otherwise(F.col("text")))
    return evals.drift(d.where("lang IS DISTINCT FROM 'es'"), made).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def evals_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "artifacts").select("artifact_id", "domain")
    s = a.select("domain").distinct().withColumn("skill", F.concat(F.lit("critique-"), "domain"))
    return evals.grid(s, a, ["tier-small", "tier-large"], 5).groupBy("skill", "tier", "condition").agg(F.count(F.lit(1)).alias("n_cells"))


def evals_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "runs").withColumn("ok", F.col("gate") == "pass")
    return evals.totals(r, "skill", "ok")


def evals_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.version_drift(table(spark, sf_dir, "runs"), "skill", "skill_version").select("skill", F.array_join("versions", " ").alias("versions"))


def text_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "sections")
    return s.select("section_id", T.normal_heading(F.col("heading")).alias("normal"), T.slug(F.col("heading")).alias("slug"))


QUERIES = {"check_" + c.lower().replace("-", "_").replace(".", "_"): partial(_rule, criterion=c) for c in RULES} | {f.__name__: f for f in (places_html, places_items, check_nng_h3_deadend, check_nng_h4_control_naming, check_nng_h6_labeled, check_usability, usability_states, html_nodes, html_checks, html_labels, corpus_round_trip, corpus_verify, leak_descriptions, leak_paths, evals_examples, evals_modal, evals_lanes, evals_grid, evals_triggers, evals_quotes, evals_lengths, evals_drift, evals_totals, evals_versions, text_normal)}

_TAGS = r"""WITH p AS (SELECT doc_id, regexp_replace(text, '(?s)<!--.*?-->', '', 'g') AS t FROM documents WHERE ltrim(text) LIKE '<%'), g AS (SELECT doc_id, unnest(regexp_extract_all(t, '<[a-zA-Z][a-zA-Z0-9]*\b[^<>]*>')) AS x FROM p)"""
SQL = {
    "html_nodes": _TAGS + " SELECT doc_id, lower(regexp_extract(x, '<([a-zA-Z0-9]+)', 1)) AS tag, count(*) AS n FROM g GROUP BY ALL",
    "html_labels": _TAGS + r""", f AS (SELECT doc_id, regexp_extract(x, '\bid="([^"]*)"', 1) AS i FROM g WHERE regexp_matches(x, '^<(input|select|textarea)\b')), l AS (SELECT DISTINCT doc_id, regexp_extract(x, '\bfor="([^"]*)"', 1) AS i FROM g WHERE regexp_matches(x, '^<label\b[^>]*\bfor="'))
SELECT f.doc_id, count(*) AS n_fields, count(l.i) AS n_named FROM f LEFT JOIN l ON f.doc_id = l.doc_id AND f.i = l.i GROUP BY f.doc_id""",
    "leak_descriptions": """WITH d AS (SELECT doc_id AS doc, list_filter([regexp_replace(x, '[^0-9a-z]', '', 'g') FOR x IN regexp_split_to_array(lower(text), '\\s+')], lambda x: x <> '') AS t FROM documents), e AS (SELECT item_id AS item, list_filter([regexp_replace(x, '[^0-9a-z]', '', 'g') FOR x IN regexp_split_to_array(lower(text), '\\s+')], lambda x: x <> '') AS t FROM eval_items),
ds AS (SELECT DISTINCT doc, array_to_string(t[i:i + 5], ' ') AS s FROM (SELECT *, unnest(range(1, len(t) - 4)) AS i FROM d)), es AS (SELECT DISTINCT item, array_to_string(t[i:i + 5], ' ') AS s FROM (SELECT *, unnest(range(1, len(t) - 4)) AS i FROM e)) SELECT doc, item, count(*) AS n_shared FROM ds JOIN es USING (s) GROUP BY doc, item""",
    "leak_paths": "SELECT artifact_id, path, len(list_intersect(regexp_split_to_array(lower(path), '[^a-z0-9]+'), ['clean', 'defect', 'seed', 'plant', 'bug'])) > 0 OR EXISTS (SELECT 1 FROM criteria c WHERE contains(lower(path), lower(c.criterion))) AS leaks FROM artifacts",
    "evals_modal": "WITH n AS (SELECT item_id, severity, count(*) AS n, min(annotation_id) AS f FROM annotations WHERE severity IS NOT NULL GROUP BY ALL) SELECT item_id, severity, n, count(*) OVER (PARTITION BY item_id) = 1 AS unanimous FROM n QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, f) = 1",
    "evals_lanes": "SELECT criterion, 'not implemented' AS problem FROM (SELECT criterion FROM criteria EXCEPT SELECT criterion FROM findings) UNION ALL SELECT criterion, 'not declared' FROM (SELECT criterion FROM findings EXCEPT SELECT criterion FROM criteria)",
    "evals_grid": "SELECT 'critique-' || domain AS skill, tier, condition, count(*) * 5 AS n_cells FROM artifacts, (VALUES ('tier-small'), ('tier-large')) t(tier), (VALUES ('skill'), ('baseline')) c(condition) GROUP BY ALL",
    "evals_totals": "SELECT skill, count(*) FILTER (gate = 'pass') AS n_correct, count(*) AS n_cases FROM runs GROUP BY ROLLUP (skill)",
    "evals_versions": "SELECT skill, string_agg(v, ' ' ORDER BY v) AS versions FROM (SELECT DISTINCT skill, skill_version AS v FROM runs) GROUP BY skill HAVING count(*) > 1",
    "text_normal": r"SELECT section_id, regexp_replace(lower(regexp_replace(regexp_replace(heading, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), '[.,:;!?]+$', '') AS normal, regexp_replace(regexp_replace(lower(regexp_replace(heading, '^\s+|\s+$', '', 'g')), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '-', 'g') AS slug FROM sections",
}
SQL["check_wcag_2_4_1"] = r"""WITH p AS (SELECT doc_id, text AS t, regexp_replace(text, '(?is)<h[1-6][\s>].*$', '') AS before FROM documents WHERE ltrim(text) LIKE '<%' AND regexp_matches(text, '(?i)<(?:html|body)[\s>]') AND NOT regexp_matches(text, '(?i)<main[\s>]|role="main"'))
SELECT doc_id, 'WCAG-2.4.1' AS criterion, CASE WHEN len(regexp_extract_all(before, '(?i)<(?:button|input|select|textarea)\b|<a\s[^>]*href="[^"]')) >= 2 THEN 3 ELSE 2 END AS severity, 1::BIGINT AS n FROM p"""
SQL["corpus_verify"] = "WITH d AS (SELECT min(domain) AS lo, max(domain) AS hi FROM artifacts) SELECT CASE WHEN domain = lo THEN 'missing' WHEN domain = hi THEN 'differs' ELSE 'same' END AS status, count(*) AS n FROM artifacts, d GROUP BY ALL UNION ALL SELECT 'extra', count(DISTINCT domain) FROM artifacts"
SQL["places_html"] = r"""WITH p AS (SELECT doc_id, text AS t, regexp_extract_all(text, '<h[1-6] id="([^"]*)"', 1) AS hs, regexp_extract_all(text, '<(?:input|select|textarea) id="([^"]*)"', 1) AS fs FROM documents WHERE ltrim(text) LIKE '<%')
SELECT doc_id AS artifact_id, '#s1' AS location, contains(t, 'id="s1"') AS resolvable, CASE WHEN contains(t, 'id="s1"') THEN '#s1' ELSE '?:#s1' END AS canonical FROM p
UNION ALL SELECT doc_id, 'the first field', len(fs) > 0, CASE WHEN len(fs) > 0 THEN '#' || fs[1] ELSE '?:the first field' END FROM p
UNION ALL SELECT doc_id, 'the last heading', len(hs) > 0, CASE WHEN len(hs) > 0 THEN '#' || hs[-1] ELSE '?:the last heading' END FROM p
UNION ALL SELECT doc_id, 'nowhere at all', false, '?:nowhere at all' FROM p"""
SQL["places_items"] = r"""WITH a AS (SELECT doc_id, try_cast(ltrim(text) AS JSON) AS j FROM documents WHERE artifact_type = 'string-list'), n AS (SELECT doc_id, CASE json_type(j) WHEN 'ARRAY' THEN json_array_length(j) WHEN 'OBJECT' THEN len(json_keys(j)) END AS k FROM a WHERE json_type(j) IN ('ARRAY', 'OBJECT'))
SELECT doc_id AS artifact_id, 'item 2' AS location, k >= 2 AS resolvable, CASE WHEN k >= 2 THEN '2' ELSE '?:item 2' END AS canonical FROM n UNION ALL SELECT doc_id, 'last item', k >= 1, CASE WHEN k >= 1 THEN k::VARCHAR ELSE '?:last item' END FROM n UNION ALL SELECT doc_id, 'item 9999', false, '?:item 9999' FROM n"""
SQL["usability_states"] = r"""WITH t AS (SELECT doc_id, string_split(regexp_replace(chr(10) || regexp_replace(text, '\r\n?|[\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '\n(##[ \t][^\n]*)', chr(1) || '\1', 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, i - 2 AS pos, regexp_replace(regexp_extract(l[i], '^##[ \t]+([^\n]*)', 1), '^\s+|\s+$', '', 'g') AS label, regexp_replace(l[i], '^[^\n]*', '') AS body FROM (SELECT *, unnest(range(2, len(l) + 1)) AS i FROM t)),
b AS (SELECT *, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(label), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s-]+', '-', 'g'), '-{2,}', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'section') AS base FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY pos) - 1 AS k FROM b)
SELECT doc_id, pos, label, CASE WHEN k = 0 THEN base ELSE base || '-' || k END AS anchor, len(list_filter(regexp_extract_all(body, '\[([^\]]+)\]\(([^)]*)\)', 2), lambda u: starts_with(ltrim(u), '#'))) AS n_links FROM n"""
_STATES = SQL["usability_states"].replace("SELECT doc_id, pos, label, CASE WHEN k = 0", ", st AS (SELECT doc_id, pos, label, CASE WHEN k = 0", 1).replace("len(list_filter(", "list_transform(list_filter(").replace("starts_with(ltrim(u), '#'))) AS n_links FROM n", "starts_with(ltrim(u), '#')), lambda u: substr(trim(u), 2)) AS links FROM n)")
SQL["check_nng_h3_deadend"] = _STATES + """, m AS (SELECT doc_id FROM st GROUP BY doc_id HAVING count(*) >= 2), g AS (SELECT s.*, (SELECT count(*) FROM st y, unnest(s.links) u(t) WHERE y.doc_id = s.doc_id AND y.anchor = u.t AND u.t <> s.anchor) AS o, (SELECT count(*) FROM st y, unnest(y.links) u(t) WHERE y.doc_id = s.doc_id AND y.anchor <> s.anchor AND u.t = s.anchor) AS k FROM st s SEMI JOIN m USING (doc_id))
SELECT doc_id, 'NNG-H3-DEADEND' AS criterion, CASE WHEN k > 0 THEN 3 ELSE 2 END AS severity, 'the ' || label || ' state' AS location, k || ' ways in' AS evidence FROM g WHERE o = 0"""
SQL["check_nng_h4_control_naming"] = r"""WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '\[([^\]]+)\]\(([^)]*)\)', 1)) AS x FROM documents), c AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(x, '[*_`]', '', 'g'), '^[\s[:punct:]“”‘’]+|[\s[:punct:]“”‘’…]+$', '', 'g'), '\s+', ' ', 'g')) AS x FROM l), a AS (SELECT DISTINCT doc_id, x, CASE """ + " ".join(f"WHEN x IN ({', '.join(repr(v) for v in names)}) THEN '{a}'" for a, names in markup.CONTROLS.items()) + """ END AS a FROM c)
SELECT doc_id, 'NNG-H4-CONTROL-NAMING' AS criterion, CASE WHEN count(*) >= 3 THEN 3 ELSE 2 END AS severity, a AS location, string_agg(x, ', ' ORDER BY x) AS evidence FROM a WHERE a IS NOT NULL GROUP BY doc_id, a HAVING count(*) >= 2"""
SQL["check_nng_h6_labeled"] = BLOCKS + r""", i AS (SELECT doc_id, sec, heading, regexp_extract_all(body, '(?m)^[ \t\f\r]*(?:[-*+]|\d+[.)])[ \t\f\r]+([^\n]*)', 1) AS l FROM secs WHERE contains(lower(heading), 'control') OR contains(lower(heading), 'field')),
e AS (SELECT doc_id, sec, heading, n, trim(l[n]) AS x, lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(l[n], '[*_`]', '', 'g')), '(?i)^(?:a|an|the)\s+', ''), '(?i)\s+(?:control|field)$', ''), ' .:;,')) IN ('button', 'link', 'icon', 'field', 'toggle', 'checkbox', 'menu', 'control', 'input', 'dropdown', 'tab') AS bare FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM i)),
q AS (SELECT *, count(*) OVER w = count(*) FILTER (bare) OVER w AS every FROM e WINDOW w AS (PARTITION BY doc_id, sec))
SELECT doc_id, 'NNG-H6-LABELED' AS criterion, CASE WHEN every THEN 3 ELSE 2 END AS severity, 'the ' || heading || ' list, item ' || n AS location, x AS evidence FROM q WHERE bare"""
SQL["evals_examples"] = "WITH e AS (" + RECORDS["p6_examples"] + "), g AS (SELECT feed, count(*) FILTER (kind = 'golden') AS n_golden, count(*) FILTER (kind = 'anti') AS n_anti, count(*) FILTER (kind = 'golden' AND length(note) < 40) AS n_short_notes FROM e JOIN golden_records USING (record_id) GROUP BY feed) SELECT *, n_golden >= 3 AND n_anti >= 1 AND n_short_notes = 0 AS passes FROM g"
SQL["evals_triggers"] = """WITH d AS (SELECT * FROM documents WHERE workspace IS NOT NULL AND domain IS NOT NULL), o AS (SELECT workspace, first(domain ORDER BY n DESC, domain) AS own FROM (SELECT workspace, domain, count(*) AS n FROM d GROUP BY ALL) GROUP BY workspace),
g AS (SELECT workspace, count(*) AS n_cases, count(*) FILTER (domain = own) AS n_positive, count(*) FILTER (domain <> own) AS n_negative, count(*) FILTER (domain <> own) AS n_cross FROM d JOIN o USING (workspace) GROUP BY workspace)
SELECT *, n_cases >= 20 AND n_positive >= 1 AND n_negative >= 3 AND n_cross >= 3 AS passes FROM g"""
SQL["evals_quotes"] = r"""WITH s AS (SELECT doc_id, list_concat(regexp_extract_all(text, '“([^”\n]*)”', 1), regexp_extract_all(text, '"([^"\n]*)"', 1)) AS l FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, i - 1 AS "at", len(regexp_extract_all(l[i], '\S+')) AS n_words FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM s)) SELECT * FROM e WHERE n_words > 25"""
SQL["evals_lengths"] = r"""WITH n AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(regexp_extract_all(regexp_replace(text, '\n\z', ''), '\n')) + 1 END AS n_lines FROM documents) SELECT doc_id, n_lines, n_lines <= 30 AS passes FROM n"""
SQL["evals_drift"] = "SELECT CASE WHEN lang = 'fr' THEN 'untracked' WHEN lang = 'es' THEN 'missing' WHEN lang = 'de' THEN 'stale' ELSE 'same' END AS status, count(*) AS n FROM documents GROUP BY ALL"
SQL["check_usability"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM ({SQL[c]})" for c in ("check_nng_h3_deadend", "check_nng_h4_control_naming", "check_nng_h6_labeled")) + ") WHERE doc_id IN (SELECT doc_id FROM documents WHERE NOT starts_with(ltrim(text), '<'))"
