import pytest
from pyspark.sql import functions as F

from rubricloom.operators import evals, report
from rubricloom.sources import files


def test_floor_strip_and_table(spark):
    e = spark.createDataFrame([("b", 0.5, None), ("a", 0.5, None), ("c", 0.9, None), ("d", None, None)], "name string, recall double, precision double")
    assert [tuple(r) for r in report.floor_strip(e, ["recall", "precision"], ["name"]).collect()] == [("recall", 0.5, "a", 0.9, "c")]
    assert [r.line for r in report.table_lines(e, ["name", "recall"], ["name"]).collect()] == ["| a | 0.500 |", "| b | 0.500 |", "| c | 0.900 |", "| d | n/a |"]
    assert report.floor_strip(e.where("name = 'z'"), ["recall"], ["name"]).count() == 0


def test_guard(spark):
    now = spark.createDataFrame([("x", 1, 2), ("y", 0, None), (None, 3, 4)], "k string, num int, den int")
    same = report.guard(report.compare(now, now.where("k IS NOT NULL"), ["k"], ["num", "den"])).first()
    assert tuple(same) == (2, 0, 1, True)
    for then in (now.withColumn("num", F.lit(9)), now.where("k = 'z'")):
        with pytest.raises(Exception, match="not reproduced"):
            report.guard(report.compare(now, then, ["k"], ["num", "den"])).collect()


def test_run_sets(spark):
    a, b = spark.range(2), spark.range(1).withColumn("extra", F.lit("e"))
    got = sorted((r.run_set, r.id, r.extra) for r in report.run_sets({"a": a, "b": b}).collect())
    assert got == [("a", 0, None), ("a", 1, None), ("b", 0, "e")]


def test_frontmatter_and_drift(spark):
    good = {"name": "critique-x", "version": "1.0.0", "description": "A long enough description.", "scripted": "[A-1, A-2]", "judged": "B-1"}
    bad = {"name": "Critique X", "version": "1.0", "description": "short", "scripted": "A-1", "judged": "A-1"}
    p = spark.createDataFrame([(1, good), (2, bad), (3, {})], "id int, f map<string,string>")
    got = sorted((r.id, r.problem) for r in evals.frontmatter_rules(p, "id", "f").collect())
    assert got == [(2, "a criterion is in both lanes"), (2, "description is too short or too long"), (2, "name is no slug"), (2, "version is not semantic"), (3, "both lanes are empty"), (3, "description is missing"), (3, "name is missing"), (3, "version is missing")]
    a = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "path string, text string")
    b = spark.createDataFrame([("a", "x"), ("b", "z"), ("d", "w"), ("c", None)], "path string, text string")
    assert sorted((r.path, r.status) for r in evals.drift(a, b).collect()) == [("a", "same"), ("b", "stale"), ("c", "same"), ("d", "missing")]
    assert [r.problem for r in evals.lanes(spark.createDataFrame([("A",)], "criterion string"), spark.createDataFrame([("B",)], "criterion string")).orderBy("criterion").collect()] == ["not implemented", "not declared"]


def test_readers_and_writers(spark, tmp_path):
    p = spark.createDataFrame([("steering/a.json",), ("runs/a.json",), ("runs/results.json",), ("steering",)], "path string")
    assert [r.scored for r in files.scoring_view(p).collect()] == [False, True, False, True]
    d = spark.createDataFrame([('{"findings": [{"id": 1}]}',), ('[{"id": 2}, 3]',), ('{"other": 1}',), (None,)], "d string")
    assert [r[0] for r in d.select(files.findings(F.col("d"))).collect()] == [['{"id":1}'], ['{"id":2}', "3"], None, None]
    c = spark.createDataFrame([('{"components": {"skills": ["a", {"name": "b"}, {"x": 1}]}}',)], "d string")
    assert c.select(files.components(F.col("d"))).first()[0] == ["a", "b"]
    files.write_text("e\u0301\r\nx\n\n", str(tmp_path / "t"))
    assert (tmp_path / "t").read_bytes() == "\u00e9\nx\n".encode()
