import random

import numpy as np
from pyspark.sql import functions as F

from rubricloom.operators import contract, envelope, graph, match, resolve, score


def test_rank_and_bound(spark):
    rows = [(1, i, s, f"C-{i}", f"L{i}") for i, s in enumerate([0, 1, 2, 3, 4, 2, 2, 1])] + [(2, 99, None, None, None)]
    df = spark.createDataFrame(rows, "run_id int, row_id int, severity int, criterion string, location string")
    got = envelope.rank_and_bound(df, ["run_id"], "row_id").orderBy("run_id", "rank").collect()
    assert [(r.row_id, r.id) for r in got if r.run_id == 1] == [(4, "F-001"), (3, "F-002"), (2, "F-003"), (5, "F-004"), (6, "F-005"), (1, "F-006"), (7, "F-007")]
    assert {r.suppressed_count for r in got if r.run_id == 1} == {1} and got[-1].id == "F-001"


def test_greedy_against_brute_force(spark):
    rng = random.Random(5)
    rows = sorted({(g, rng.randint(0, 6), rng.randint(0, 6), rng.choice("abc")) for g in range(30) for _ in range(15)})
    df = spark.createDataFrame(rows, "g int, l int, r int, k string")
    got = {tuple(x) for x in match.greedy(df, ["g"], F.col("l"), F.col("r"), [F.col("k")]).select("g", "l", "r").collect()}
    want = set()
    for g in range(30):
        used_l, used_r = set(), set()
        for _, l, r in sorted((k, l, r) for gg, l, r, k in rows if gg == g):
            if l not in used_l and r not in used_r:
                used_l.add(l), used_r.add(r), want.add((g, l, r))
    assert got == want


def test_real_instants(spark):
    rows = ["2030-02-30T00:00:00Z", "2030-02-28T23:59:60Z", "2030-13-01T00:00:00Z", "nonsense", "2030-01-01T00:00:00.123Z", "2030-01-01T25:00:00Z"]
    got = spark.createDataFrame([(x,) for x in rows], "t string").select(contract.real_instant(F.col("t"))).collect()
    assert [r[0] for r in got] == [False, True, False, True, True, False]


def test_json_counts(spark):
    doc = lambda b3, sup, sev: '{"findings": [%s], "summary": {"by_severity": {"0": 0, "1": 0, "2": 0, "3": %s, "4": 0}, "suppressed_count": %s, "severity_3_threshold": 0}}' % (",".join(f'{{"severity": {s}}}' for s in sev), b3, sup)
    df = spark.createDataFrame([(1, doc("1", "0", [3])), (2, doc("1.0", "0", [3])), (3, doc("2", "0", [3])), (4, doc("1", "1", [3])), (5, "no json")], "run_id int, doc string")
    got = {(r.run_id, r.rule) for r in contract.histogram_sums(df).collect()}
    assert got == {(2, "integer-literals"), (3, "histogram-sum"), (3, "histogram-counts"), (4, "histogram-sum")}


def test_json_texts_at_any_depth(spark):
    doc = '{"run": {"timestamp": "2030-02-30T00:00:00Z", "a\u2013b": 1}, "findings": [{"x": [{"y": "p \u2014 q \u2013"}]}], "dispositions": [{"decided_at": "2030-01-01T00:00:60Z"}, {"decided_at": "2030-01-01T24:00:00Z"}]}'
    df = spark.createDataFrame([("1", doc), ("2", "no json"), ("3", None), ("4", "[1, 2]")], "run_id string, doc string")
    got = sorted((r.path, r.rule, r.message) for r in contract.json_texts(df).collect())
    assert got == [("dispositions.1.decided_at", "real-instants", "names no real instant"), ("findings.0.x.0.y", "no-dashes", "em dash"), ("run.a\u2013b", "no-dashes", "en dash"), ("run.timestamp", "real-instants", "names no real instant")]


def test_structure_rules(spark):
    rows = [("F-001", "BYOR-A", "l", "e", "v", "f", "judged", "low", 2, [("a", "b"), ("a", "b")], None), ("F-1234567", "lower", "l", "e" * 2001, "", None, "other", "sure", 5, [("a", "b \u2013")], None)]
    f = spark.createDataFrame([(1, *r) for r in rows], "run_id long, finding_id string, criterion string, location string, evidence string, violation string, fix string, lane string, confidence string, severity int, instances array<struct<location:string,evidence:string>>, rubric_source string")
    got = sorted((r.path.split(".", 1)[1].split(".", 1)[1], r.message) for r in f.select(F.inline(contract.finding_rules())).collect())
    assert got == sorted([("instances", "holds one twice"), ("rubric_source", "is not byor"), ("criterion", "is no criterion id"), ("id", "is no finding id"), ("evidence", "is longer than 2000"), ("violation", "is required"), ("fix", "is required"), ("lane", "is not scripted or judged"), ("confidence", "is not high, medium or low"), ("severity", "is not 0 to 4"), ("instances", "holds fewer than two"), ("instances.evidence", "en dash")])


def test_gates_and_namespaces(spark):
    runs = spark.createDataFrame([(1, ["C"], "fail", 0), (2, ["C"], "pass", 0), (3, ["D"], "pass", 2), (4, None, None, 0)], "run_id long, rubrics array<string>, gate string, severity_3_threshold int")
    f = spark.createDataFrame([(1, "F-001", "C-A", 1), (2, "F-001", "C-A", 4), (3, "F-001", "C-A", 3), (3, "F-001", "C-B", 3)], "run_id long, finding_id string, criterion string, severity int")
    assert sorted((r.run_id, r.message) for r in contract.gates(runs, f).collect()) == [(1, "should be pass"), (2, "should be fail"), (4, "should be pass")]
    assert sorted((r.run_id, r.message) for r in contract.namespaces(runs, f).collect()) == [(3, "no rubric C"), (3, "no rubric C")]
    assert sorted((r.run_id, r.rule) for r in contract.count_rules(runs, f).collect()) == [(1, "gate-matches-counts"), (2, "gate-matches-counts"), (3, "producer-declared-threshold"), (3, "unique-finding-ids"), (4, "gate-matches-counts")]


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51), (51, 50), (60, 60), (None, 1)], "a int, b int")
    got = {r.node: r.component for r in graph.components(df).collect()}
    assert {got[i] for i in range(21)} == {0} and got[50] == got[51] == 50 and got[60] == 60
    assert graph.components(df.where("a > 99")).count() == 0


def test_resolve_tolerance(spark):
    s = spark.createDataFrame([(1, 1, "Alpha Part", 2, 2), (1, 2, "Beta Part", 2, 3), (1, 3, "Deep", 3, 1)], "artifact_id int, position int, heading string, level int, n_paragraphs int")
    rows = [(1, t) for t in ("Beta Part, paragraph 2", "Beta Part", "section 2", "section 9", "paragraph 6", "first paragraph of Alpha Part", "nothing", None, "last paragraph", '"deep"')]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, artifact_id int, location string")
    got = [(r.exact, r.lo, r.hi, r.canonical) for r in resolve.resolve(d, resolve.laid_out(s)).orderBy("i").collect()]
    assert got == [(4, 3, 5, "4"), (None, 3, 6, "H:beta part"), (None, 3, 6, "H:beta part"), (None, None, None, "?:section 9"), (6, 5, 7, "6"), (1, 1, 2, "1"), (None, None, None, "?:nothing"), (None, None, None, "?:"), (6, 5, 7, "6"), (None, 6, 6, "H:deep")]


def test_bands_enumerate_all_draws(spark):
    df = spark.createDataFrame([("c", "m", 1, 1, 2), ("c", "m", 2, 2, 2)], "cell string, metric string, rep int, num long, den long")
    r = score.bands(df, ["cell"]).first()
    assert (r.pooled, r.band_low, r.band_high, r.rep_min, r.rep_max) == (0.75, 0.5, 1.0, 0.5, 1.0) and abs(r.bootstrap_sd - 0.125**0.5 / 2) < 1e-9


def test_pack(spark):
    df = spark.createDataFrame([(1, "a", str(i % 3), "e", i) for i in range(6)] + [(2, "b", "x", "e", 9)], "run_id int, criterion string, location string, evidence string, o int")
    got = sorted((r.run_id, r.location, r.instances and len(r.instances)) for r in envelope.pack(df, ["run_id", "criterion"], "o").collect())
    assert got == [(1, "0", 3), (2, "x", None)]


def test_items(spark):
    df = spark.createDataFrame([(1, '["a", "b"]'), (2, '[{"key": "k", "value": "v"}]'), (3, '[["k", "v"]]'), (4, '{"z": "1", "a": "2"}'), (5, "text"), (6, None)], "doc_id int, text string")
    got = [tuple(r) for r in resolve.items(df, "doc_id", "text").orderBy("doc_id", "index").collect()]
    assert got == [(1, 0, None, "a"), (1, 1, None, "b"), (2, 0, "k", "v"), (3, 0, "k", "v"), (4, 0, "z", "1"), (4, 1, "a", "2")]


def _planted(spark):
    """Runs over one artifact whose defects are many and alike, and the pairs that trying every candidate in order takes."""
    rng = random.Random(7)
    heads = ["h one", "h two"]
    claims = []
    for row in range(60):
        lo = rng.choice([None, 1, 2, 3])
        claims.append((row % 6, row, 0, 1, f"F-{rng.randint(0, 2)}", rng.choice("AB"), rng.choice(["scripted", "judged"]), lo, lo and lo + rng.randint(0, 2), rng.choice([None, *heads]), rng.choice("xyz"), True))
    paths = [["h one"], ["h two"], ["a/h one"], ["a", "h one"]]
    truths = []
    for i in range(120):
        at, path = rng.randint(0, 4), rng.choice(paths)
        if rng.random() < 0.5:
            truths.append((i, 1, rng.choice("AB"), "paragraph", at, path[-1], [], f"p:{at:012}"))
        else:
            truths.append((i, 1, rng.choice("AB"), "heading-path", None, path[-1], [0, 1] if path[-1] == "h one" else [2, 3], "h:" + "/".join(path)))
    truths += [truths[5], (7, 1, "A", "paragraph", 2, "h one", [], f"p:{2:012}")]
    c = spark.createDataFrame(claims, "run_id long, row_id long, claim int, artifact_id long, finding_id string, criterion string, lane string, lo int, hi int, title string, canonical string, resolvable boolean").withColumn("cid", F.struct("row_id", "claim"))
    t = spark.createDataFrame(truths, "defect_id long, artifact_id long, criterion string, kind string, at int, head string, near array<int>, anchor string")

    def meet(x, y):
        inside = lambda n: x[7] is not None and x[7] <= n <= x[8]
        return inside(y[4]) if y[3] == "paragraph" else x[9] == y[5] or any(map(inside, y[6]))

    def want(same):
        out = set()
        for run in range(6):
            used_l, used_r = set(), set()
            for key in sorted({((x[5] if same else ""), y[7], x[10], x[4], x[1], y[0]) for x in claims if x[0] == run for y in truths if meet(x, y) and (not same or x[5] == y[2])}):
                if key[4] not in used_l and key[5] not in used_r:
                    used_l.add(key[4]), used_r.add(key[5]), out.add((run, key[4], 0, key[5]))
        return out

    return c, t, want


def test_matching_over_classes_of_defects_against_brute_force(spark):
    c, t, want = _planted(spark)
    for same in (True, False):
        assert {tuple(r) for r in score.matches(c, t, same).collect()} == want(same) != set()
    runs = spark.createDataFrame([(i, 1) for i in range(7)], "run_id long, artifact_id long")
    for few in (score.MAX_CLASSES, 0):
        old, score.MAX_CLASSES = score.MAX_CLASSES, few
        try:
            got = {r.run_id: (r.n_claims, r.n_matched, r.n_matched_location) for r in score.scores(runs, c, t).collect()}
        finally:
            score.MAX_CLASSES = old
        assert got == {i: (10 * (i < 6), *[sum(x[0] == i for x in want(s)) for s in (True, False)]) for i in range(7)}


def test_equal_defects_do_not_multiply_candidates(spark):
    claims = [(r, r, 0, 1, "F", "A", "judged", 1, 3, None, "2", True) for r in range(20)]
    c = spark.createDataFrame(claims, "run_id long, row_id long, claim int, artifact_id long, finding_id string, criterion string, lane string, lo int, hi int, title string, canonical string, resolvable boolean").withColumn("cid", F.struct("row_id", "claim"))
    t = spark.range(500).select(F.col("id").alias("defect_id"), F.lit(1).cast("long").alias("artifact_id"), F.lit("A").alias("criterion"), F.lit("paragraph").alias("kind"), F.lit(2).alias("at"), F.lit(None).cast("string").alias("head"), F.array().cast("array<int>").alias("near"), F.lit("p:2").alias("anchor"))
    r = score._of_runs(c, score.classes(t), ["run_id"], [True, False]).select(F.max(F.size("by")), F.max(F.size("place"))).first()
    assert tuple(r) == (1, 1)
    assert {tuple(x) for x in score.matches(c, t).collect()} == {(i, i, 0, 0) for i in range(20)}


def test_pairs_of_runs_by_blocks_against_brute_force(spark, monkeypatch):
    from rubricloom.operators import pairs

    rng = random.Random(11)
    runs = [(i, 1 + (i % 5 == 4), "s", rng.choice([None, "v"])) for i in range(40)] + [(99, None, "s", "v")]
    claims = []
    for row in range(300):
        ok, at = rng.random() < 0.7, rng.randint(1, 5)
        exact = at if ok and rng.random() < 0.6 else None
        title = rng.choice(["a", "b"]) if ok and exact is None else None
        claims.append((rng.randint(0, 37), row // 2, row % 2, rng.choice(["A", "B", None]), str(exact) if exact else f"H:{title}" if ok else rng.choice(["?:x", "?:é"]), exact, at - 1 if ok else None, at + 1 if ok else None, title, ok))
    c = spark.createDataFrame(claims, "run_id long, row_id long, claim int, criterion string, canonical string, exact int, lo int, hi int, title string, resolvable boolean")
    r = spark.createDataFrame(runs, "run_id long, artifact_id long, skill string, skill_version string")
    inside = lambda x, y: x[5] is not None and y[6] is not None and y[6] <= x[5] <= y[7]
    meet = lambda x, y: x[3] is not None and x[3] == y[3] and (inside(x, y) or inside(y, x) or x[8] is not None and x[8] == y[8] or not x[9] and not y[9] and x[4] == y[4])
    want = {}
    for a in runs:
        for b in runs:
            if a[0] < b[0] and a[1:] == b[1:] and a[1] is not None:
                ca, cb = [x for x in claims if x[0] == a[0]], [x for x in claims if x[0] == b[0]]
                m, used_a, used_b = 0, set(), set()
                for _, i, j in sorted(((x[3], *sorted((x[4].encode(), y[4].encode()))), x[1:3], y[1:3]) for x in ca for y in cb if meet(x, y)):
                    if i not in used_a and j not in used_b:
                        used_a.add(i), used_b.add(j)
                        m += 1
                sa, sb = ({"\x01".join(k for k in x[3:5] if k is not None) for x in z} for z in (ca, cb))
                want[a[0], b[0]] = (round(m / (len(ca) + len(cb) - m), 9) if ca or cb else 1.0, round(len(sa & sb) / len(sa | sb), 9) if sa or sb else 1.0, *a[1:])
    for block, step in ((512, 1_000_000), (4, 7)):
        monkeypatch.setattr(pairs, "BLOCK", block)
        monkeypatch.setattr(pairs, "STEP", step)
        got = {(x.run_id_a, x.run_id_b): (round(x.tolerant, 9), round(x.exact, 9)) for x in score.run_pairs(c, r, ["skill", "skill_version"]).collect()}
        assert got == {k: v[:2] for k, v in want.items()}
        cells = {}
        for v in want.values():
            cells.setdefault(v[3:], {}).setdefault(v[2], []).append(v)
        for x in score.consistency(c, r, ["skill", "skill_version"]).collect():
            arts = cells.pop((x.skill, x.skill_version))
            mean = lambda k: sum(sum(v[k] for v in vs) / len(vs) for vs in arts.values()) / len(arts)  # noqa: B023, E731
            assert abs(x.consistency - mean(0)) < 1e-6 and abs(x.consistency_exact - mean(1)) < 1e-6 and (x.artifacts_with_pairs, x.total_pairs) == (len(arts), sum(map(len, arts.values())))
        assert not cells


def test_no_pair_of_runs_is_shuffled(spark):
    c = spark.createDataFrame([(i, i, 0, "A", "1", 1, 1, 2, None, True) for i in range(60)], "run_id long, row_id long, claim int, criterion string, canonical string, exact int, lo int, hi int, title string, resolvable boolean")
    r = spark.range(60).select(F.col("id").alias("run_id"), F.lit(1).cast("long").alias("artifact_id"), F.lit("s").alias("skill"))
    df = score.run_pairs(c, r, ["skill"])
    assert df.count() == 60 * 59 // 2 and "Join" not in df._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    assert score.pairs.units(c, r, ["skill"]).count() == 60


def test_classes_a_run_cannot_reach_are_no_candidates(spark):
    from rubricloom.operators import meeting

    claims = [(r, 2 * r + i, 0, 1, "F", "A", "judged", None, None, "h", "H:h", True) for r in range(20) for i in range(2)]
    c = spark.createDataFrame(claims, "run_id long, row_id long, claim int, artifact_id long, finding_id string, criterion string, lane string, lo int, hi int, title string, canonical string, resolvable boolean").withColumn("cid", F.struct("row_id", "claim"))
    truths = [(i, 1, "A", "heading-path", None, "h", [], f"h:{i:03}/h") for i in range(500)]
    t = spark.createDataFrame(truths, "defect_id long, artifact_id long, criterion string, kind string, at int, head string, near array<int>, anchor string")
    k = score.classes(t)
    r = score._of_runs(c, k, ["run_id"], [True, False]).select(F.max(F.size("by")), F.max(F.size("place"))).first()
    assert tuple(r) == (4, 4)
    told = score._told(k, [True, False]).value
    x = score._by_run(c, ["run_id"]).select("xs").toArrow().column("xs").combine_chunks().flatten()
    for same in (True, False):
        assert told[same].ranges(x, np.full(len(x), 2), same)[2].tolist() == [2] * 40
        got = {tuple(v) for v in score.matches(c, t, same).collect()}
        assert got == {(i // 2, i, 0, i % 2) for i in range(40)}
    assert not list(meeting.matched(score._by_run(c, ["run_id"]).select("xs").toArrow().column("xs").combine_chunks(), meeting.Index(score._class_places(k.where("false"), [True]).toArrow()), True))[0][0].size


def test_many_classes_go_to_shards_and_no_candidate_is_a_row(spark, monkeypatch):
    c, t, _ = _planted(spark)
    c = c.withColumn("artifact_id", F.when(F.col("row_id") % 7 < 2, F.col("row_id") % 7).otherwise(1)).withColumn("artifact_id", F.when(F.col("row_id") == 3, None).otherwise(F.col("artifact_id")))
    t = t.where("defect_id <> 5").withColumn("artifact_id", F.when(F.col("defect_id") % 5 == 0, 0).otherwise(1).cast("long"))
    runs = spark.createDataFrame([(i, i % 2) for i in range(7)], "run_id long, artifact_id long")
    rows = lambda df: sorted(map(str, df.collect()))
    want = [rows(score.matches(c, t, s)) for s in (True, False)] + [rows(score.scores(runs, c, t, lane)) for lane in (True, False)]
    monkeypatch.setattr(score, "MAX_CLASSES", 0)
    monkeypatch.setattr(score, "SHARD", 10)
    got = [score.matches(c, t, s) for s in (True, False)] + [score.scores(runs, c, t, lane) for lane in (True, False)]
    assert all(want) and [rows(x) for x in got] == want
    for x in got:
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroupsInArrow" in plan and "posexplode" not in plan


def test_few_classes_are_told_and_no_candidate_is_a_row(spark):
    c, t, want = _planted(spark)
    runs = spark.createDataFrame([(i, 1) for i in range(7)], "run_id long, artifact_id long")
    for lane in (False, True):
        x = score.scores(runs, c, t, lane)
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        # each run's claims are matched in its one row: beside the runs and the counts of defects nothing is joined
        assert plan.count("MapInArrow") == 1 and "posexplode" not in plan and plan.count("Join ") == 2
    got = {r.run_id: (r.n_matched, r.n_matched_location) for r in score.scores(runs, c, t).collect()}
    assert got == {i: tuple(sum(v[0] == i for v in want(s)) for s in (True, False)) for i in range(7)}
