from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import lanes, prose
from rubricloom.operators.checks import argument, clarity, microcopy


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def fired(spark, criterion, *texts):
    return [(r.doc_id, r.severity, r.location) for r in clarity.run(docs(spark, *texts), criterion).orderBy("doc_id", "sec", "n").collect()]


def test_paragraphs(spark):
    rows = prose.paragraphs(docs(spark, "intro a\nb\r\n\r\nsecond\n# One\ntext. More? yes\n\n  \nlast\n## Two", None, "", "   \n")).orderBy("sec", "n").collect()
    assert [(r.sec, r.heading, r.n, r.text) for r in rows] == [(0, None, 1, "intro a b"), (0, None, 2, "second"), (1, "One", 1, "text. More? yes"), (1, "One", 2, "last")]
    assert rows[2].sentences == ["text.", "More?", "yes"]


def test_series_and_asides(spark):
    df = spark.createDataFrame([("File it, sign it, and send it.",), ("One, two.",), ("",), ("The clerk, who is new, after lunch, signs",)], "s string")
    rows = df.select(F.size(T.series(F.col("s"))), *T.asides(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [(3, 1, 2), (1, 0, 0), (0, 0, 0), (1, 2, 5)]


def test_active_boundaries(spark):
    hit, miss = "The form was signed.", "The clerk signs."
    assert fired(spark, "PLAIN-ACTIVE", hit, miss, " ".join([hit] * 3 + [miss]), " ".join([hit] * 2 + [miss] * 2), "# T\n\n" + hit) == [(0, 2, "paragraph 1"), (2, 3, "paragraph 1"), (2, 3, "paragraph 1"), (2, 3, "paragraph 1"), (3, 2, "paragraph 1"), (3, 2, "paragraph 1"), (4, 2, "T, paragraph 1")]


def test_sentence_length_boundaries(spark):
    words = lambda n: " ".join(["w"] * n)
    assert [x[:2] for x in fired(spark, "PLAIN-SENTENCE-LENGTH", words(30), words(31), words(49), words(50))] == [(1, 2), (2, 2), (3, 3)]


def test_transition_runs(spark):
    text = "# A\n\nfirst\n\n" + "\n\n".join(["plain"] * 4) + "\n\nHowever so\n\nplain"
    assert [x[1] for x in fired(spark, "PLAIN-TRANSITIONS", text)] == [3, 3, 3, 3, 2]


def test_must_needs_two_and_a_mix(spark):
    assert [x[:2] for x in fired(spark, "PLAIN-MUST", "You shall go. You must stay.", "You shall go. You shall stay. You must sit.")] == [(0, 2), (1, 3), (1, 3)]


def test_argument(spark):
    d = docs(spark, "# T\n\nIt may rain. It may not. Sun.", "Therefore we go.", "", None)
    assert [(r.doc_id, r.severity, r.location) for r in argument.claim_marker(d).collect()] == [(0, 2, 'the whole document, under its "T" heading')]
    assert [(r.doc_id, r.severity) for r in argument.hedge_density(d).collect()] == [(0, 3)]


def test_all_rules_run(spark):
    assert clarity.check(docs(spark, "# General\n\nThe form was signed by it in order to go.")).where("criterion IN ('PLAIN-HEADINGS', 'PLAIN-CONCISE')").count() == 2


def test_normative_blocks(spark):
    text = "# A #\n\npara\nmore\n\n```\ncode\n\nstill\n~~~\nafter\n\nSetext\n---\n\n- item\n\n    code\n\n#\n\n> q\n\n| t |\n\n#x\n\n~~~ open\n\nrest"
    rows = prose.blocks(docs(spark, text, None, "")).orderBy("pos").collect()
    assert [(r.kind, r.level, r.title) for r in rows] == [("heading", 1, "A"), ("paragraph", None, None), ("other", None, None), ("paragraph", None, None), ("heading", 2, "Setext"), ("other", None, None), ("other", None, None), ("heading", 1, ""), ("other", None, None), ("other", None, None), ("paragraph", None, None), ("other", None, None)]
    assert rows[2].text == "```\ncode\n\nstill\n~~~" and rows[2].n_lines == 5 and rows[-1].text == "~~~ open\n\nrest"


def test_very_long_texts(spark):
    from rubricloom.operators.checks import docs as D

    d = docs(spark, "a" + "\n" * 200_000 + "b", "\n".join(["- item"] * 50_000), "word " * 200_000, "line\n" * 100_000)
    assert prose.paragraphs(d).groupBy("doc_id").count().count() == 4
    assert prose.blocks(d).count() == 5
    assert [r.severity for r in D.nav_length(d).collect()] == [3]
    assert clarity.run(d, "PLAIN-SENTENCE-LENGTH").count() == 3


def test_toy(spark):
    from rubricloom.operators.checks import toy

    d = docs(spark, "# A\n\n## B\n\nIt is filed. ok\n\n# C\n\n## D\n\n# E\n\nIt may possibly be the case that so.")
    assert sorted((r.criterion, r.location) for r in toy.first_sentences(d).collect()) == [("TOY-ACTIVE", "B, paragraph 1, first sentence"), ("TOY-HEDGE", "E, paragraph 2, first sentence")]
    assert sorted((r.location, r.severity) for r in toy.orphans(d).collect()) == [("the D heading", 3)]


def test_rules_that_the_tables_lack(spark):
    assert fired(spark, "PLAIN-CONCISE", "Wait in order to go. We left due to the fact that a number of us ran.") == [(0, 3, "paragraph 1")] * 2
    assert fired(spark, "PLAIN-NOMINALIZATION", "We make a decision on it. It rains.") == [(0, 2, "paragraph 1")]
    m = microcopy.check(docs(spark, "You failed to sign again. Add a name."))
    assert ("NNG-EM-NEUTRAL-TONE", 3) in {(r.criterion, r.severity) for r in m.collect()}


def test_paths_tables_and_sections(spark):
    d = docs(spark, "# A\n\nx\n\n### B\n\n## C\n\n| a | b |\n|---|:-:|\n| 1 \\| 2 | |\n\n### D\n\ny\n\n## c\n\nz")
    assert [r.path for r in prose.heading_paths(d).orderBy("at").collect()] == [["A"], ["A", "B"], ["A", "C"], ["A", "C", "D"], ["A", "c"]]
    assert [r.cells for r in prose.pipe_tables(d).orderBy("row").collect()] == [["a", "b"], ["1 \\| 2", ""]]
    got = [r.body for r in prose.section_texts(d, "C").orderBy("at").collect()]
    assert got[0].endswith("### D\n\ny") and got[1] == "z"


def test_lanes(spark):
    import pytest

    d = docs(spark, "The form was signed by it.", None)
    got = lanes.envelopes(d, "critique-clarity").collect()
    assert {(r.id, r.criterion, r.lane, r.confidence) for r in got} == {("F-001", "PLAIN-ACTIVE", "scripted", "high")}
    for skill in lanes.SKILLS:
        assert lanes.run_checks(d, skill).columns == ["doc_id", "criterion", "severity", "location", "evidence", "lane", "confidence"]
    with pytest.raises(ValueError):
        lanes.run_checks(d, "critique-nothing")
    e = spark.createDataFrame([(1, ("claimed", "m"))], "run_id int, run struct<skill:string,model:string>")
    from pyspark.sql import functions as F

    assert lanes.own_run(e, {"skill": F.lit("known")}).first().run == ("known", "m")
