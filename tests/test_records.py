from rubricloom.operators import nested, rejects

LINES = "line_id long, fmt string, line string, lane string, feed string"
GOOD = "F-001,CLAR-EXIT,judged,3,Intro,text,high,2031-01-01T00:00:00Z"


def reasons(spark, rows):
    df = spark.createDataFrame([(i, f, t, "clash", None) for i, f, t in rows], LINES)
    return {(r.line_id, r.reason) for r in rejects.rejected(rejects.parse_lines(df)).collect()}


def test_reasons(spark):
    rows = [
        (1, "csv", GOOD),
        (2, "csv", GOOD.replace("text", 'te"xt')),
        (3, "csv", GOOD.replace("text", '"te""x,t\nmore"')),
        (4, "csv", ""),
        (5, "csv", None),
        (6, "tsv", GOOD),
        (7, "ssv", GOOD.replace(",", ";").replace("3", "3.0").replace("high", "HIGH").replace("judged", "both")),
        (8, "csv", GOOD.replace("judged", "").replace("high", "")),
        (9, "csv", '"open,' + GOOD),
        (10, "odd", GOOD),
        (11, "csv", GOOD.replace("text", "two\nlines")),
        (12, "csv", GOOD.replace(",3,", ',"3",')),
        (12, "csv", GOOD.replace(",3,", ",,")),
    ]
    want = {(2, "quoting"), (4, "column_count"), (5, "column_count"), (6, "column_count"), (7, "severity"), (7, "confidence"), (7, "lane"), (9, "quoting"), (12, "severity")}
    assert reasons(spark, rows) == want


def test_loaded_values_and_long_text(spark):
    long = "word " * 200_000
    df = spark.createDataFrame([(1, "csv", GOOD.replace("text", f'"{long}, ""q"""'), "x", "f"), (2, "csv", GOOD.replace("text", "two\r\nlines"), "x", "f")], LINES)
    rows = {r.line_id: r for r in rejects.loaded(rejects.parse_lines(df)).collect()}
    assert rows[1].evidence == f'{long}, "q"' and rows[1].severity == 3
    assert rows[2].evidence == "two\r\nlines" and rows[2].lane == "judged"


def test_no_lines(spark):
    assert reasons(spark, []) == set()


def leaves(spark, rows):
    df = spark.createDataFrame(rows, "record_id long, record string, skill string")
    out = nested.flatten(df, "instances", outer=True).drop("instance_evidence").collect()
    return [tuple(r) for r in sorted(out)]


def test_nested_shapes(spark):
    one = '{"expected_envelope": {"run": {"skill": "s"}, "findings": [{"id": "F-1", "instances": ["[A], ¶1", {"location": "b", "selector": {"instances": [{"location": "no"}]}}, {}]}, {"id": null}]}}'
    lone = '{"expected_envelope": "{\\"findings\\": {\\"id\\": 7, \\"instances\\": {\\"location\\": null}}}"}'
    rows = [(1, one, "c"), (2, f"[{lone}, {lone}]", "c"), (3, f'{{"examples": [{lone}], "batch": 1}}', "c"), (4, None, "c"), (5, "not json", "c"), (6, '{"expected_envelope": null}', "c"), (7, '{"expected_envelope": {"findings": {"instances": "here"}}}', "c")]
    assert leaves(spark, rows) == [
        (1, 0, "s", 0, "F-1", 0, "[A], ¶1"), (1, 0, "s", 0, "F-1", 1, "b"), (1, 0, "s", 0, "F-1", 2, ""), (1, 0, "s", 1, "", -1, ""),
        (2, 0, "", 0, "7", 0, ""), (2, 1, "", 0, "7", 0, ""), (3, 0, "", 0, "7", 0, ""), (7, 0, "", 0, "", 0, "here"),
    ]


def test_nested_empty_and_examples(spark):
    assert leaves(spark, []) == []
    df = spark.createDataFrame([(1, '{"kind": "anti", "query": "q"}'), (2, "[]")], "record_id long, record string")
    ex = nested.flatten(df, "examples").collect()
    assert [(r.record_id, r.kind, r.query, r.has_envelope) for r in ex] == [(1, "anti", "q", False)]
