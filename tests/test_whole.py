import json

import numpy as np

from rubricloom.operators import score
from rubricloom.plans import envelopes


def _tables(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_report_covers_every_error_rule(spark, tmp_path):
    sha, at, good = "0" * 64, "2030-01-01T00:00:00Z", ("F-001", "C-A", "loc", "ev", "vi", "fix", "judged", "low", 2)
    runs = [(i, sha, at, ["C"], "pass", 0, "s", "1", "m") for i in range(6)] + [(6, sha, "2030-02-30T00:00:00Z", ["C"], "pass", 0, "s", "1", "m")]
    broken = {1: {6: "other"}, 2: {1: "D-A"}, 3: {3: "a \u2014 b"}, 4: {2: None}, 5: {7: None}}
    found = [(i, *[broken.get(i, {}).get(k, v) for k, v in enumerate(good)], None, None) for i in range(7)]
    d = _tables(
        spark, tmp_path,
        runs=(runs, "run_id long, artifact_sha256 string, run_timestamp string, rubrics array<string>, gate string, severity_3_threshold int, skill string, skill_version string, model string"),
        findings=(found, "run_id long, finding_id string, criterion string, location string, evidence string, violation string, fix string, lane string, confidence string, severity int, instances array<struct<location:string,evidence:string>>, rubric_source string"),
    )
    assert tuple(envelopes.contract_report(spark, d).first()) == (7, 6, 6, 0)


def test_json_counts_cover_every_example(spark, tmp_path):
    doc = lambda b3, found="[%s]": '{"expected_envelope": {"findings": ' + found % '{"severity": 3}' + ', "summary": {"by_severity": {"0": 0, "1": 0, "2": 0, "3": ' + b3 + ', "4": 0}, "suppressed_count": 0, "severity_3_threshold": 0}}}'
    text = json.dumps({"expected_envelope": json.dumps(json.loads(doc("2"))["expected_envelope"])})
    rows = [(1, doc("1")), (2, f'[{doc("1")}, {doc("2")}]'), (3, '{"examples": [%s, {"expected_envelope": null}, %s]}' % (doc("1.0"), doc("3"))), (4, doc("1", "%s")), (5, text), (6, None), (7, "no json"), (8, '{"kind": "anti"}')]
    d = _tables(spark, tmp_path, golden_records=(rows, "record_id long, record string"))
    got = {(r.run_id, r.example_no, r.rule) for r in envelopes.contract_json_counts(spark, d).collect()}
    both = ("histogram-sum", "histogram-counts")
    assert got == {(2, 1, r) for r in both} | {(3, 2, r) for r in both} | {(5, 0, r) for r in both} | {(3, 0, "integer-literals")}


def test_bands_of_many_repetitions(spark):
    reps = [(1, 3), (2, 5), (0, 2), (4, 4), (3, 7), (2, 5), (0, 0)]
    rows = [("c", "m", i, n, d) for i, (n, d) in enumerate(reps)] + [("e", "m", 1, 1, 2)]
    got = {r.cell: r for r in score.bands(spark.createDataFrame(rows, "cell string, metric string, rep int, num long, den long"), ["cell"]).collect()}
    draws = np.indices((7,) * 7).reshape(7, -1)
    n, d = (np.array([x[i] for x in reps])[draws].sum(axis=0) for i in (0, 1))
    v = np.sort(np.where(d > 0, n / np.maximum(d, 1), 0.0))
    r = got["c"]
    assert (r.k, r.pooled, r.rep_min, r.rep_max) == (7, 12 / 26, 0.0, 1.0) and got["e"].k == 1
    assert (r.band_low, r.band_high) == (v[round(0.025 * (7**7 - 1))], v[round(0.975 * (7**7 - 1))]) and abs(r.bootstrap_sd - v.std()) < 1e-9
    low, high, sd = score._band([(i % 3, 3) for i in range(20)], 0.025, 0.975)
    assert 0 < low < 19 / 60 < high < 1 and sd > 0
