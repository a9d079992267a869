import json

import pytest
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import corpus, envelope, evals, markup, places
from rubricloom.operators.checks import clarity, docs, microcopy, usability
from rubricloom.sources import files

PAGE = """<!doctype html><html><head><style>.low { color: #777; background: #fff } .wide { width: 700px }</style></head>
<body><a href="#">Home</a><button>Save</button><h1>T</h1><h3>Skip</h3><p class="low">grey</p><div class="wide">x</div>
<img src="a.png"><img src="b.png" alt="photo"><a href="/x">click here</a><input id="f"><label for="g">g</label><input id="g">
<button aria-label="Other">Apply</button><table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table></body></html>"""


def test_page_findings():
    got = {}
    for c, s, *_ in markup.findings(PAGE):
        got.setdefault(c, []).append(s)
    assert got["WCAG-1.1.1"] == [3, 3] and got["WCAG-1.3.1"] == [3, 3] and got["WCAG-1.4.3"] == [2] and got["WCAG-1.4.10"] == [3]
    assert got["WCAG-2.4.1"] == [3] and got["WCAG-2.4.2"] == [3] and got["WCAG-2.4.4"] == [2] and got["WCAG-2.5.3"] == [2]
    assert got["WCAG-3.1.1"] == [3] and got["WCAG-3.3.2"] == [2] and got["NNG-H4-CONTROL-NAMING"] == [2, 2]
    assert markup.findings("<p") == [] and markup.findings("") == []


def test_contrast_and_colors():
    assert round(markup.contrast((0, 0, 0), (255, 255, 255)), 2) == 21.0
    assert markup.color("1px solid #0f0") == (0, 255, 0) and markup.color("rgb(100%, 0, 0)") == (255, 0, 0) and markup.color("var(--x)") is None


def test_nodes(spark):
    df = spark.createDataFrame([(1, "<div><p>a<p>b</div>"), (2, "no page"), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.tag, r.parent_id, r.place) for r in markup.nodes(df).orderBy("doc_id", "node_id").collect()]
    assert got == [(1, "div", -1, "div"), (1, "p", 0, "div > p"), (1, "p", 1, "div > p > p")]


def test_microcopy(spark):
    block = "Message: You forgot it again.\nSignal: red, none\nContainer: toast\nFires: mid-keystroke\nInput on resubmission: cleared\nSuggested fix: described"
    df = spark.createDataFrame([(1, f"# S\n\nintro\n\n{block}\n\n{block}\nmore\n\n{block}"), (2, "- Enter a date\n- ERR42 null\n\nplain"), (3, None)], "doc_id long, text string")
    m = microcopy.messages(df)
    assert [(r.doc_id, r.n, r.total, r.suggested_fix) for r in m.orderBy("doc_id", "n").collect()] == [(1, 1, 3, "described"), (1, 2, 3, "described more"), (1, 3, 3, "described"), (2, 1, 3, None), (2, 2, 3, None), (2, 3, 3, None)]
    got = {(r.criterion, r.doc_id, r.n): r.severity for r in microcopy.check(df).collect()}
    assert got["NNG-EM-NEUTRAL-TONE", 1, 1] == 3 and got["NNG-EM-NOT-COLOR-ONLY", 1, 1] == 3 and got["NNG-EM-PRESERVE-INPUT", 1, 1] == 3 and got["NNG-EM-TIMING", 1, 1] == 2
    assert got["NNG-EM-CONSTRUCTIVE", 1, 1] == 2 and got["NNG-EM-CONSTRUCTIVE", 1, 2] == 3 and got["NNG-EM-PLAIN-LANGUAGE", 2, 2] == 3 and ("NNG-EM-CONSTRUCTIVE", 2, 1) not in got


def test_docs(spark):
    flat = "\n".join(f"- item {i}" for i in range(8))
    page = f"---\nmode: how-to\n---\n# A\n\n### C\n\n{flat}\n\nBecause it rains. Go.\n\n# B\n\n{flat}\n  - deeper"
    df = spark.createDataFrame([(1, page), (2, flat + "\n" + flat + "\n\n" + flat), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.severity, r.location) for r in docs.heading_depth(df).collect()] == [(1, 2, "the C heading")]
    assert sorted((r.doc_id, r.severity, r.evidence) for r in docs.nav_length(df).collect()) == [(1, 2, "8 flat items"), (2, 3, "24 flat items")]
    assert [(r.doc_id, r.evidence) for r in docs.mode(df).collect()] == [(1, "Because it rains.")]


def test_generated_corpus_round_trip(spark):
    made = corpus.build(spark.range(40).withColumnRenamed("id", "recipe"), "s")
    again = corpus.build(spark.range(39).withColumnRenamed("id", "recipe").repartition(3), "s")
    assert {r.status: r.n for r in corpus.verify(made, again).groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()} == {"same": 39, "missing": 1}
    found = {(r.doc_id, r.criterion, r.location) for r in clarity.check(made.select(F.col("recipe").alias("doc_id"), "text")).select("doc_id", "criterion", "location").collect()}
    planted = {(r.recipe, d.criterion, f"{d.heading}, paragraph {d.paragraph}") for r in made.collect() for d in r.defects}
    assert planted <= found and len(planted) == 80


def test_dice_are_uniform_and_stable():
    r = corpus.Dice("k", "a")
    draws = [r.upto(6) for _ in range(6000)]
    assert all(800 < draws.count(i) < 1200 for i in range(6)) and corpus.Dice("k", "a").upto(6) == draws[0]
    assert [corpus.Dice("ab", "c").upto(1000) for _ in range(1)] != [corpus.Dice("a", "bc").upto(1000)] or corpus.Dice("ab", "c").upto(1 << 30) != corpus.Dice("a", "bc").upto(1 << 30)
    assert sorted(r.some(range(5), 9)) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        r.upto(0)


def test_leaks(spark):
    d = spark.createDataFrame([(1, "One two, three four five six seven."), (2, None)], "doc_id long, text string")
    e = spark.createDataFrame([(9, "two three FOUR five six seven eight"), (8, "too short"), (7, None)], "item_id long, text string")
    assert [tuple(r) for r in corpus.description_leaks(d, e, "doc_id", "text", "item_id", "text").collect()] == [(1, 9, 1)]
    p = spark.createDataFrame([("a/clean-1.md",), ("a/cleaning.md",), ("a/plain-active.md",), (None,), ("",)], "path string")
    c = spark.createDataFrame([("PLAIN-ACTIVE",), ("X-1",), (None,)], "criterion string")
    for most in (10_000, 1):
        assert sorted((r.path or "", r.leaks) for r in corpus.path_leaks(p, "path", c, most).collect()) == [("", False), ("", False), ("a/clean-1.md", True), ("a/cleaning.md", False), ("a/plain-active.md", True)]


def test_evals(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "x", 5), (2, "y", 4)], "case int, answer string, o int")
    assert sorted(tuple(r) for r in evals.modal(t, ["case"], "answer", "o").collect()) == [(1, "b", 2, False), (2, "y", 1, False)]
    a, b = spark.createDataFrame([("A",), ("B",)], "criterion string"), spark.createDataFrame([("B",), ("C",)], "criterion string")
    assert sorted(tuple(r) for r in evals.lanes(a, b).collect()) == [("A", "not implemented"), ("C", "not declared")]


def test_merge_and_baseline(spark):
    cols = "criterion string, severity string, location string, evidence string, violation string, fix string, lane string, confidence string"
    df = spark.createDataFrame([("C-A", "3", "x — y", " a\n b ", "v", "f", None, "low"), ("C-A", "3.5", "l", "e", "v", "f", "judged", None), ("C-A", "3", None, "e", "v", None, "judged", "low")], cols)
    got = [(r.error, r.lane, r.confidence, r.severity, r.location, r.evidence) for r in envelope.merge_lanes(df).collect()]
    assert got[0] == (None, "scripted", "high", 3, "x - y", "a b") and got[1][0] == "severity is not an integer" and got[1][2] == "high" and got[2][0] == "missing location, fix"
    text = "Location: a\nEvidence: b\nmore b\nProblem: c\nFix: d\n\nLocation: only\n\nNo problems found."
    out = envelope.baseline(spark.createDataFrame([(1, text), (2, "No problems found."), (3, None)], "doc_id long, text string")).collect()
    assert [(r.location, r.evidence, r.violation, r.fix, r.criterion) for r in out] == [("a", "b more b", "c", "d", "BASELINE-GENERIC")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_bytes(b"\xef\xbb\xbf# T\n")
    (tmp_path / "in/b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "in/c.md").write_bytes(b"")
    got = {r.path: (r.text, r.error) for r in files.artifacts(spark, str(tmp_path / "in"), "*.md").collect()}
    assert got == {"a.md": ("# T\n", None), "b.md": (None, "not UTF-8")}
    files.write_json({"b": 1, "a": "é"}, str(tmp_path / "x.json"))
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        files.write_json({}, str(tmp_path / "x.json"))
    (tmp_path / "d").mkdir()
    for n, d in (("haiku-r2.json", {"findings": []}), ("log.json", {"dispositions": None}), ("bad.json", None), ("results.json", {})):
        (tmp_path / "d" / n).write_text(json.dumps(d) if d is not None else "{oops")
    docs_ = files.documents(spark, str(tmp_path / "d"))
    got = {r.path.rsplit("/", 1)[1]: (r.kind, r.t, r.n) for r in docs_.select("path", "kind", files.repetition(F.col("path"))[0].alias("t"), files.repetition(F.col("path"))[1].alias("n")).collect()}
    assert got == {"haiku-r2.json": ("envelope", "haiku", 2), "log.json": ("dispositions", None, None), "bad.json": ("invalid", None, None)}
    good = '{"findings": [], "run": {}, "summary": {}}'
    assert files.last_object(f'text {{"a": 1}} ```json\n{good}\n``` {{oops') == good and files.last_object("none {") is None
    page = spark.createDataFrame([('---\nname: "x"\nversion: 1.0\nname: y\n---\nbody',), ("no block",)], "t string")
    assert [r[0] for r in page.select(files.frontmatter(F.col("t"))).collect()] == [{"name": "x", "version": "1.0"}, {}]
    assert files.splice("a<b>old</b>c", "<b>", "</b>", "new") == "a<b>\nnew\n</b>c"


def test_text_helpers(spark):
    df = spark.createDataFrame([(" Some  Title. ", "a — b"), ("Ärger & Co: 2", "")], "a string, b string")
    rows = df.select(T.normal_heading(F.col("a")), T.slug(F.col("a")), T.sanitize(F.col("b"), 3)).collect()
    assert [tuple(r) for r in rows] == [("some title", "some-title", "a -"), ("ärger & co: 2", "ärger-co-2", "")]


def test_stream(spark, tmp_path):
    from rubricloom.streaming import envelopes as S

    rows = [(1, "csv", "F-1,C,judged,3,l,e,high,2031-01-01T00:00:00Z"), (2, "csv", "bad"), (2, "csv", "bad")]
    schema = "line_id long, fmt string, line string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = S.each_batch(S.read(spark, str(tmp_path / "in"), schema), lambda b: S.rejects(b).select("line_id", F.size("reasons").alias("k")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(90)
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(str(tmp_path / "out")).select("line_id", "k").collect()) == [(1, 0), (2, 1), (2, 1)]


def test_contrast_defaults_and_edges():
    crit = lambda html: sorted((c, s) for c, s, *_ in markup.findings("<html lang='en'><title>T</title><body><main>" + html + "</main></body></html>"))
    assert crit('<p style="color:#ccc">x</p>') == [("WCAG-1.4.3", 3)]
    assert crit('<div style="background:#000"><p style="background:none;color:#222">x</p></div>') == [("WCAG-1.4.3", 3)]
    assert crit('<p style="color:var(--x)">x</p>') == [] and crit('<b style="color:#888;font-size:19px">x</b>') == []
    assert crit('<button style="border:1px solid #aaa">x</button>') == [("WCAG-1.4.11", 2)]
    assert crit('<button style="border:1px solid #eee">x</button>') == [("WCAG-1.4.11", 3)]
    for off in ("border:0 none #eee", "border:1px none #eee", "border:0px solid #eee"):
        assert crit(f'<button style="{off}">x</button>') == []
    assert crit('<a style="border:1px solid #eee">x</a>') == []
    assert crit('<p style="max-height:20px;overflow-y:hidden">x</p>') == [("WCAG-1.4.12", 2)]


def test_bypass_counts_reachable_stops():
    sev = lambda body: [s for c, s, *_ in markup.findings(body) if c == "WCAG-2.4.1"]
    assert sev('<html><p hidden><a href="/a">a</a><a href="/b">b</a></p><h1>T</h1></html>') == [2]
    assert sev('<body><input type="hidden"><a href="/b">b</a><h1>T</h1></body>') == [3]
    assert sev("<p>part</p>") == [] and sev('<body><a href="#m">s</a><div id="m"></div></body>') == []


def test_page_usability():
    html = '<section id="a"><a href="#b">go</a></section><section id="b"><a href="#b">stay</a></section><section id="c">x</section><form><button></button><input id="f"><label for="f">n</label></form><nav><a href="/x"><i></i></a></nav>'
    got = sorted((c, s, w) for c, s, w, *_ in markup.findings(html) if c.startswith("NNG"))
    assert got == [("NNG-H3-DEADEND", 2, "#c"), ("NNG-H3-DEADEND", 3, "#b"), ("NNG-H6-LABELED", 2, "form > button"), ("NNG-H6-LABELED", 3, "nav > a")]


def test_markdown_usability(spark):
    page = "# P\n\n## Start\n\nGo to [Save](#end), [Apply...](#x) or [Cancel](#end).\n\n### More\n\n## End\n\n[back](#end)\n\n## End\n\n[up](#start)\n\n## Controls\n\n- the **button**\n- Search field for names\n- A link.\n"
    d = spark.createDataFrame([(1, page), (2, None), (3, "## Alone\n\ntext"), (4, "<p>## x</p>")], "doc_id long, text string")
    got = sorted((r.criterion, r.severity, r.location, r.evidence) for r in usability.check(d).collect())
    assert got == [("NNG-H3-DEADEND", 2, "the Controls state", "0 ways in"), ("NNG-H3-DEADEND", 3, "the End state", "2 ways in"), ("NNG-H4-CONTROL-NAMING", 2, "commit", "apply, save"), ("NNG-H6-LABELED", 2, "the Controls list, item 1", "the **button**"), ("NNG-H6-LABELED", 2, "the Controls list, item 3", "A link.")]
    assert d.limit(1).select(usability.anchors(F.array(F.lit("A b"), F.lit("A b"), F.lit("?"), F.lit("a  B!")))).first()[0] == ["a-b", "a-b-1", "section", "a-b-2"]


def test_places(spark):
    html = '<div id="top"><ul class="x y"><li>one long item</li><li><a href="/">two</a></li></ul></div><h2>T</h2>'
    pages = spark.createDataFrame([(1, "html", html), (2, "string-list", '[{"key": "k.a", "value": "some long value"}, "two"]'), (3, "string-list", "broken"), (4, "markdown-prose", "# x")], "artifact_id long, artifact_type string, text string")
    asks = [(1, "#top", "#top", True), (1, 'the "ul.y > li:nth-of-type(2)" element', "div > ul > li:nth-of-type(2)", True), (1, "the first link", "div > ul > li:nth-of-type(2) > a", True), (1, '"One  long item"', "div > ul > li:nth-of-type(1)", True), (1, "the ninth link", "?:the ninth link", False), (1, "`div a`", "div > ul > li:nth-of-type(2) > a", True), (2, "item 2", "2", True), (2, "last item", "2", True), (2, "k.a is long", "key:k.a", True), (2, '"Some long VALUE"', "1", True), (2, "item 9", "?:item 9", False), (3, "item 1", "?:item 1", False), (4, "x", "?:x", False), (9, None, "?:", False)]
    claims = spark.createDataFrame([(a, str(i), t) for i, (a, t, *_) in enumerate(asks)], "artifact_id long, key string, location string")
    got = {int(r.key): (r.canonical.replace("#top > ", ""), r.resolvable) for r in places.resolve(pages, claims).collect()}
    assert [got[i] for i in range(len(asks))] == [(c, ok) for *_, c, ok in asks]
    truths = spark.createDataFrame([(1, "t", "css", "li:nth-of-type(2)"), (1, "u", "css", "li"), (1, "v", "element-id", "top"), (2, "w", "item-key", "k.a"), (2, "x", "item-index", "2")], "artifact_id long, key string, kind string, value string")
    met = {(int(r.claim), r.truth) for r in places.hits(places.resolve(pages, claims), places.truth(pages, truths)).collect()}
    assert met == {(0, "t"), (1, "t"), (2, "t"), (5, "t"), (0, "v"), (6, "x"), (7, "x"), (9, "w")}
    bad = spark.createDataFrame([(1, "pdf", "x")], "artifact_id long, artifact_type string, text string")
    with pytest.raises(Exception, match="unknown artifact type"):
        places.resolve(bad, claims).collect()
    p = spark.createDataFrame([("see guide\\Intro.md, top", "docs/guide/intro.md"), ("intro.md", "docs/guide/intro.md"), ("other.md", "docs/intro.md"), ("nothing", "a.md")], "l string, p string")
    assert [r[0] for r in p.select(places.page_matches(F.col("l"), F.col("p"))).collect()] == [True, True, False, None]
