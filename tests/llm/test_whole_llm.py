import random

import pytest

pytest.importorskip("rubricloom.llm")
from rubricloom.llm import consensus  # noqa: E402


def test_confusion_counts_at_any_number_of_labels(spark):
    rng, rows = random.Random(4), []
    for i in range(400):
        truth = rng.choice("ABCD")
        for a in range(1, 6):
            swapped = {"A": "B", "B": "A"}.get(truth, truth) if a > 3 else truth
            rows.append(("location", i, a, swapped if rng.random() < 0.9 else rng.choice("ABCD")))
    other = [("location", 1000 + i, 99, f"heading {i}") for i in range(300)]
    schema = "field string, item_id long, annotator_id long, label string"
    none = spark.createDataFrame([], "field string, item_id long, own string")
    got = []
    for votes in (rows, rows + other):
        c = consensus.Consensus(spark.createDataFrame(votes, schema), none, {"location": 4.0})
        got.append({r.item_id: (r.label, round(r.probability, 6)) for r in c.labels().where("item_id < 1000").collect()})
    assert got[0] == got[1]
