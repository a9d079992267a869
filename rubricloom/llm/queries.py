"""Queries of the llm operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricloom.llm import canonical, consensus, leakage, neardup, survivor, tokenize, truncation
from rubricloom.session import broadcast_if_small, table

#: What a usable lane and confidence may be.
LANES = ["scripted", "judged"]
CONFIDENCES = ["high", "medium", "low"]
_TRIM = r"^\s+|\s+$"


def _merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merge_inputs with the finding's number, the producer's trust and the usable value of each field."""
    def clean(c: str):
        return F.regexp_replace(F.col(c), _TRIM, "")

    m = table(spark, sf_dir, "merge_inputs")
    trust = broadcast_if_small(table(spark, sf_dir, "producers").groupBy("producer").agg(F.max("trust").alias("trust")), 200_000)
    known = broadcast_if_small(table(spark, sf_dir, "criteria").select(F.col("criterion").alias("criterion_ok"), F.upper("criterion").alias("_key")).dropDuplicates(["_key"]), 200_000)
    one_of = lambda c, ok: F.when(F.lower(clean(c)).isin(ok), F.lower(clean(c)))
    m = m.withColumn("finding_no", F.expr(r"try_cast(regexp_extract(finding_id, '([0-9]+)', 1) AS bigint)")).where("run_id IS NOT NULL AND finding_no IS NOT NULL")
    m = m.join(trust, "producer", "left").withColumn("_key", F.upper(clean("criterion"))).join(known, "_key", "left")
    return m.select("rec_id", "run_id", "finding_no", "producer", "trust", "received_at", "criterion_ok", one_of("lane", LANES).alias("lane_ok"), one_of("confidence", CONFIDENCES).alias("confidence_ok"), "severity", F.nullif(clean("location"), F.lit("")).alias("location_ok"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"criterion": F.col("criterion_ok"), "lane": F.col("lane_ok"), "confidence": F.col("confidence_ok")}
    return survivor.best_fields(_merge_rows(spark, sf_dir), ["run_id", "finding_no"], fields, {"trust": True, "received_at": True, "rec_id": False})


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole record that survives of each finding: most usable values, then trust, then recency."""
    rows = _merge_rows(spark, sf_dir)
    full = survivor.completeness([F.col(c) for c in ("criterion_ok", "lane_ok", "confidence_ok", "severity", "location_ok")])
    rows = rows.withColumn("n_usable", full)
    best = survivor.best_record(rows, ["run_id", "finding_no"], [F.desc("n_usable"), F.desc_nulls_last("trust"), F.desc_nulls_last("received_at"), F.col("rec_id")])
    return best.select("run_id", "finding_no", "rec_id", "producer", "n_usable")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every typed location of findings and defects in one shape."""
    f = table(spark, sf_dir, "findings").where("location IS NOT NULL")
    f = f.select(F.lit("findings").alias("origin"), "row_id", "artifact_id", F.col("location").alias("text"), F.lit(None).cast("array<string>").alias("path"))
    d = table(spark, sf_dir, "defects").where("location_text IS NOT NULL OR heading_path IS NOT NULL")
    return f.unionByName(d.select(F.lit("defects").alias("origin"), F.col("defect_id").alias("row_id"), "artifact_id", F.col("location_text").alias("text"), F.col("heading_path").alias("path")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.to_entries(_typed(spark, sf_dir), table(spark, sf_dir, "sections")).select("origin", "row_id", "section_id")


def p3_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each origin that name an entry exactly, by a near spelling, or not at all."""
    found = canonical.to_entries(_typed(spark, sf_dir), table(spark, sf_dir, "sections"))
    kind = F.when(F.col("section_id") < 0, "none").when(F.col("cost") == 0, "exact").otherwise("near")
    return found.groupBy("origin", kind.alias("match")).agg(F.count(F.lit(1)).alias("n_values"), F.countDistinct("section_id").alias("n_sections"))


def _near_findings(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(table(spark, sf_dir, "findings"), "row_id", ["evidence", "violation", "fix"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_findings(spark, sf_dir).pairs().select(F.col("x").alias("row_id_a"), F.col("y").alias("row_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_findings(spark, sf_dir).classes()


_FIELDS = ["criterion", "severity", "location"]


def _consensus(spark: SparkSession, sf_dir: str) -> consensus.Consensus:
    """Labels in the spelling of the reference tables, the latest of each annotator and item, with the items' own values."""
    key = lambda c: F.lower(F.regexp_replace(F.regexp_replace(F.col(c), _TRIM, ""), r"\s+", " "))
    criteria, sections = table(spark, sf_dir, "criteria"), table(spark, sf_dir, "sections")
    a = consensus.latest(table(spark, sf_dir, "annotations"), "item_id", "annotator_id", ["labelled_at", "received_at", "annotation_id"], _FIELDS)
    names = criteria.groupBy(key("criterion").alias("_c")).agg(F.min("criterion").alias("criterion_ok"))
    heads = sections.groupBy(key("heading").alias("_h")).agg(F.min("heading").alias("location_ok"))
    a = a.withColumn("_c", key("criterion")).withColumn("_h", key("location")).join(broadcast_if_small(names, 200_000), "_c", "left").join(broadcast_if_small(heads, 200_000), "_h", "left")
    stack = "stack(3, 'criterion', criterion_ok, 'severity', cast(severity AS string), 'location', location_ok) AS (field, label)"
    votes = a.selectExpr("item_id", "annotator_id", stack)
    items = a.select("item_id").distinct()
    f = table(spark, sf_dir, "findings").select(F.col("row_id").alias("item_id"), "criterion", "severity", "location").join(items, "item_id", "left_semi")
    own = f.selectExpr("item_id", "stack(3, 'criterion', criterion, 'severity', cast(severity AS string), 'location', location) AS (field, own)")
    n_c, n_d = criteria.agg(F.count("criterion"), F.countDistinct("domain")).first()
    n_s, n_a = sections.agg(F.count("heading"), F.countDistinct("artifact_id")).first()
    return consensus.Consensus(votes, own, {"criterion": n_c / max(n_d, 1), "severity": 5.0, "location": n_s / max(n_a, 1)})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).labels().select("item_id", "field", "label")


def p5_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).labels().select("item_id", "field", "n_votes", "agreement", F.round("probability", 6).alias("probability"))


def p5_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).reliability.select("annotator_id", "field", F.round("n_labels").cast("long").alias("n_labels"), F.round("reliability", 6).alias("reliability"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilings with a tile as long as a leaked passage."""
    return leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), passage=leakage.PASSAGE).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which tiles of eight words or more cover at least half of an item, in whatever order."""
    t = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), coverage=0.5)
    return t.select("doc_id", "item_id", "longest", "tiled_words", "item_words", "n_tiles")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.scores(table(spark, sf_dir, "documents")).where(F.col("p_cut") > truncation.CUT).select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts its texts."""
    cut = F.count_if(F.col("p_cut") > truncation.CUT)
    return truncation.scores(table(spark, sf_dir, "documents")).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), cut.alias("n_cut"), F.round(cut / F.count(F.lit(1)), 6).alias("share_cut"))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p3_found, p3_misses, p4_found, p4_groups, p5_found, p5_agreement, p5_reliability, p7_ids, p8_found, p8_coverage, p9_found, p9_sources)}

_USABLE = r"""WITH u AS (SELECT m.rec_id, m.run_id, CAST(regexp_extract(m.finding_id, '([0-9]+)', 1) AS BIGINT) AS finding_no, m.producer, p.trust, m.received_at, m.severity, c.criterion AS criterion_ok,
 CASE WHEN lower(regexp_replace(m.lane, '^\s+|\s+$', '', 'g')) IN ('scripted', 'judged') THEN lower(regexp_replace(m.lane, '^\s+|\s+$', '', 'g')) END AS lane_ok,
 CASE WHEN lower(regexp_replace(m.confidence, '^\s+|\s+$', '', 'g')) IN ('high', 'medium', 'low') THEN lower(regexp_replace(m.confidence, '^\s+|\s+$', '', 'g')) END AS confidence_ok,
 nullif(regexp_replace(m.location, '^\s+|\s+$', '', 'g'), '') AS location_ok
 FROM merge_inputs m LEFT JOIN producers p USING (producer) LEFT JOIN criteria c ON upper(c.criterion) = upper(regexp_replace(m.criterion, '^\s+|\s+$', '', 'g')))
"""


def _first(field: str) -> str:
    return f"arg_max({field}, {{'t': trust, 'r': received_at, 'i': -rec_id}}) FILTER ({field} IS NOT NULL)"


_MULTI = r"""WITH w AS (SELECT row_id, regexp_extract_all(lower(concat_ws(chr(10), evidence, violation, fix)), '[a-z0-9]+') AS w FROM findings),
e AS (SELECT row_id, x || ' ' || row_number() OVER (PARTITION BY row_id, x) AS x FROM (SELECT row_id, unnest(w) AS x FROM w)), n AS (SELECT row_id, count(*) AS n FROM e GROUP BY row_id), f AS (SELECT x, count(*) AS k FROM e GROUP BY x),
r AS (SELECT row_id, x, n, row_number() OVER (PARTITION BY row_id ORDER BY k, x) AS i FROM e JOIN f USING (x) JOIN n USING (row_id)),
c AS (SELECT DISTINCT a.row_id AS a, b.row_id AS b FROM r a JOIN r b ON a.x = b.x AND a.row_id < b.row_id AND a.n * 100 >= 85 * b.n AND b.n * 100 >= 85 * a.n WHERE a.i <= a.n - ceil(0.85 * a.n) + 1 AND b.i <= b.n - ceil(0.85 * b.n) + 1)
"""
SQL = {
    "p2_found": _USABLE + f"SELECT run_id, finding_no, {_first('criterion_ok')} AS criterion, {_first('lane_ok')} AS lane, {_first('confidence_ok')} AS confidence FROM u GROUP BY run_id, finding_no HAVING count(*) >= 2",
    "p2_records": _USABLE + """, n AS (SELECT *, (criterion_ok IS NOT NULL)::INT + (lane_ok IS NOT NULL)::INT + (confidence_ok IS NOT NULL)::INT + (severity IS NOT NULL)::INT + (location_ok IS NOT NULL)::INT AS n_usable FROM u)
SELECT run_id, finding_no, rec_id, producer, n_usable FROM n QUALIFY row_number() OVER (PARTITION BY run_id, finding_no ORDER BY n_usable DESC, trust DESC NULLS LAST, received_at DESC NULLS LAST, rec_id) = 1""",
    "p4_found": _MULTI + "SELECT a AS row_id_a, b AS row_id_b FROM c JOIN e x ON x.row_id = a JOIN e y ON y.row_id = b AND x.x = y.x JOIN n na ON na.row_id = a JOIN n nb ON nb.row_id = b GROUP BY a, b, na.n, nb.n HAVING count(*) * 100 >= 85 * greatest(na.n, nb.n)",
    "p8_found": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
dw AS (SELECT doc_id, list_aggregate(w[i:i + 13], 'string_agg', ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 12)) AS i FROM w)),
ew AS (SELECT item_id, list_aggregate(w[i:i + 13], 'string_agg', ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 12)) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items)))
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)""",
}
