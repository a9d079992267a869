import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("rubricloom.llm")

from rubricloom.llm import canonical, consensus, leakage, neardup, survivor, tokenize, truncation  # noqa: E402


# -- best representative -----------------------------------------------------------------------------------------------
def test_best_fields(spark):
    rows = [(1, 1, "a", None, 2, 5), (1, 2, None, "x", 2, 5), (1, 3, "b", "y", 1, 9), (1, 4, "c", "z", None, 9), (2, 5, "a", "a", 1, 1), (None, 6, None, None, 1, 1), (None, 7, None, None, 1, 1)]
    df = spark.createDataFrame(rows, "g int, id int, f string, h string, trust int, t int")
    from pyspark.sql import functions as F

    best = lambda d: {tuple(r) for r in survivor.best_fields(d, ["g"], {"f": F.col("f"), "h": F.col("h")}, {"trust": True, "t": True, "id": False}).collect()}
    assert best(df) == {(1, "a", "x"), (None, None, None)}
    assert best(df.where("id > 99")) == set()
    top = survivor.best_record(df, ["g"], [F.desc_nulls_last("trust"), F.col("id")]).collect()
    assert {(r.g, r.id) for r in top} == {(1, 1), (2, 5), (None, 6)}


# -- tokenizer ---------------------------------------------------------------------------------------------------------
def test_encoding_equals_the_public_one():
    tokenizers = pytest.importorskip("tokenizers")
    folder = tokenize.TOKENIZER_DIR
    try:
        ref = tokenizers.Tokenizer.from_file(f"{folder}/byte_bpe_50k.json")
    except Exception:
        pytest.skip("no vocabulary files")
    ref.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["", None, " ", "\n\n a", "it's we'LL 're", "<|endoftext|>", "a" * 5000, "日本 é'm ½²", "x'\n's", "end '"]
    texts += ["".join(rng.choice("ab 's\n\té’.,'re ll日") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    got = tokenize.Encoder(f"{folder}/byte_bpe_50k.tiktoken").encode(pa.array(texts, pa.string())).to_pylist()
    want = [x.ids for x in ref.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "hello", "x"), (2, None, "x"), (3, "", "x"), (1, "hello", "x"), (4, " " * 100_000, "x")], "doc_id long, text string, ids string")
    try:
        got = [(r.doc_id, len(r.ids)) for r in tokenize.encode(df).collect()]
    except Exception as e:
        if "No such file" in str(e):
            pytest.skip("no vocabulary files")
        raise
    assert [g[0] for g in got] == [1, 2, 3, 1, 4] and got[1][1] == got[2][1] == 0 and got[0] == got[3]
    assert tokenize.encode(df.where("doc_id > 9")).count() == 0


# -- leakage -----------------------------------------------------------------------------------------------------------
def words(rng, n):
    return [f"w{rng.randint(0, 400)}" for _ in range(n)]


def runs_of(a, b, n):
    return {tuple(a[i : i + n]) for i in range(len(a) - n + 1)} & {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    items = {i: words(rng, 40) for i in range(6)}
    docs = {}
    for d in range(60):
        w = words(rng, 100)
        if d % 3 == 0:
            i, k = rng.randint(0, 5), rng.choice([12, 13, 14, 15, 40])
            s = rng.randint(0, 40 - k)
            w[50:50] = items[i][s : s + k]
        docs[d] = w
    ddf = spark.createDataFrame([(d, " - ".join(w).upper(), "clash") for d, w in docs.items()] + [(900, None, ""), (901, "", ""), (0, " ".join(docs[0]), "")], "doc_id long, text string, item_id string")
    idf = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(90, None), (91, "too short")], "item_id long, text string")
    want = {(d, i) for d, w in docs.items() for i, x in items.items() if runs_of(w, x, 14)}
    for limit in (leakage.BLOCK_CHARS, 400):
        for seed in (leakage.SEED, 14):
            got = sorted((r.doc_id, r.item_id) for r in leakage.leaks(ddf, idf, seed=seed, shortest=seed, block_chars=limit, passage=14 if seed == 8 else 0).where("longest >= 14").collect())
            assert sorted(set(got)) == sorted(want) and want and len(got) == len(want) + sum(d == 0 for d, _ in want)
    assert leakage.leaks(ddf.where("doc_id > 999"), idf).count() == 0


def test_tiles_catch_reordered_parts():
    item = np.arange(30, dtype=np.uint64)
    doc = np.concatenate([item[20:], np.full(5, 999, np.uint64), item[:10], item[10:20]])
    assert sorted(leakage.tiles(doc, item, 8)) == [(0, 20, 10), (15, 0, 20)]
    assert leakage.tiles(item[:3], item, 8) == []


def _slow_tiles(doc, item, shortest):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for i in range(len(item)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, i)
        n, d, i = best
        if n < shortest:
            return out
        free_d[d : d + n], free_i[i : i + n] = [False] * n, [False] * n
        out.append((d, i, n))


def test_tiles_against_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 25))]
        doc = [rng.randint(0, 4) for _ in range(rng.randint(1, 40))]
        want = _slow_tiles(doc, item, 3)
        got = leakage.tiles(np.array(doc, np.uint64), np.array(item, np.uint64), 3)
        assert got == want, (doc, item)


def test_equal_words_cost_no_product():
    import time

    start = time.time()
    t = leakage.tiles(np.full(20_000, 7, np.uint64), np.full(4_000, 7, np.uint64), 8)
    assert t == [(0, 0, 4000)] and time.time() - start < 2
    held = leakage.Items([(1, "word " * 4000)], 8, 8, 0.0)
    assert list(held.match(pa.array([5]), pa.array(["word " * 20_000]))) == [(5, 1, 4000, 4000, 4000, 1)] and time.time() - start < 4


# -- typed headings ----------------------------------------------------------------------------------------------------
SECTIONS = [(1, 10, "Boundary Inventory", 2, 1, "boundary-inventory", ["T 1", "Boundary Inventory"]), (1, 11, "Appeals", 3, 2, "boundary-inventory-appeals", ["T 1", "Boundary Inventory", "Appeals"]), (1, 12, "How to Publish Ledgers", 2, 3, "how-to-publish-ledgers", ["T 1", "How to Publish Ledgers"]), (1, 13, "Appeals", 3, 4, "how-to-publish-ledgers-appeals", ["T 1", "How to Publish Ledgers", "Appeals"]), (2, 20, "Loading Contacts", 2, 1, "loading-contacts", ["T 2", "Loading Contacts"])]
TYPED = [("Boundary Inventory, paragraph 3", 10), ("1st par. under inventory boundary", 10), ("§2", 12), ("section 9", -1), ("Bounadry Inventroy", 10), ("#boundary-inventory", 10), ("Bound. Invent…", 10), ("T 1 > How to Publish Ledgers > Appeals", 13), ("Appeals, line 4 (in boundary inventory)", 11), ("Publish", 12), ("Boundary Contacts", -1), ("whole page", -1), ("", -1), ("the the How to Publish Ledgérs bit heading", 12), ("HOW_TO_PUBLISH_LEDGERS (2nd par.)", 12), ("Loading Contacts", -1)]


def test_typed_headings(spark):
    cols = "artifact_id long, section_id long, heading string, level int, position int, anchor string, heading_path array<string>"
    s = spark.createDataFrame(SECTIONS, cols)
    rows = [("f", i, 1, t, None) for i, (t, _) in enumerate(TYPED)] + [("d", 0, 1, "see above", ["T 1", "Appeals"]), ("d", 1, 1, "Boundary Inventory, Appeals", ["Appeals"]), ("d", 2, None, "x", None), ("d", 3, 1, "x" * 50_000, None), ("d", 4, 1, None, None)]
    v = spark.createDataFrame(rows, "origin string, row_id long, artifact_id long, text string, path array<string>")
    for limit in (canonical.BROADCAST_ENTRIES, 0):
        got = {(r.origin, r.row_id): r.section_id for r in canonical.to_entries(v, s, limit).collect()}
        assert [got["f", i] for i in range(len(TYPED))] == [w for _, w in TYPED]
        assert got["d", 0] in (11, 13) and got["d", 1] == 11 and got["d", 2] == got["d", 3] == got["d", 4] == -1
    assert canonical.to_entries(v.where("row_id < 0"), s).count() == 0


def test_both_ways_decide_alike(spark):
    cols = "artifact_id long, section_id long, heading string, level int, position int, anchor string, heading_path array<string>"
    rows = [(1, 10, "Budget Review", 2, 1, None, None), (1, 12, "Staff Rules", 2, 2, None, []), (2, 20, "Midget Review", 2, 1, None, ["x"]), (2, 21, "Stuff Rules", 2, 2, "", None), (1, 13, "Fees for Late Return of Borrowed Garden Tools", 2, 3, None, None), (3, 30, None, None, None, None, None)]
    s = spark.createDataFrame(rows, cols)
    typed = [(1, "Midget Review", -1), (2, "Midget Review", 20), (1, "Stuff Rules", -1), (1, "Budgt Review", 10), (2, "Contractural", -1), (1, "borrowed garden tools: late return of fees for", 13), (3, "x", -1), (None, "x", -1)]
    v = spark.createDataFrame([("f", i, a, t, None) for i, (a, t, _) in enumerate(typed)], "origin string, row_id long, artifact_id long, text string, path array<string>")
    for limit in (canonical.BROADCAST_ENTRIES, 0):
        got = {r.row_id: r.section_id for r in canonical.to_entries(v, s, limit).collect()}
        assert [got[i] for i in range(len(typed))] == [w for *_, w in typed]


def _edited(rng, t, k):
    t = list(t)
    for _ in range(k):
        i = rng.randrange(len(t) - 1)
        how = rng.randrange(4)
        if how == 0 and len(t) > 3:
            t.pop(i)
        elif how == 1:
            t.insert(i, rng.choice("abcxyz"))
        elif how == 2:
            t[i] = rng.choice("abcxyz")
        else:
            t[i], t[i + 1] = t[i + 1], t[i]
    return "".join(t)


def test_deletes_against_every_distance():
    d = canonical.Deletes()
    strings = ["boundary", "contacts", "quality", "penalties", "boundaryinventory", "howtopublishledgers", "fees", "feed"]
    for x in strings:
        d.add(x)
    rng = random.Random(2)
    for target in strings:
        for k in (0, 1, 2, 3):
            for _ in range(40):
                t = _edited(rng, target, k)
                for most in (1, 2, 3) if len(t) > 3 else (1,):
                    assert d.near(t, most) == {w: c for w in strings if (c := canonical.distance(t, w, float(most))) is not None}
                cut = t[: rng.randint(min(4, len(t)), len(t))]
                begun = d.begun(cut, 2.0)
                for w in strings:
                    cs = [c for x in (-1, 0, 1) if (c := canonical.distance(cut, w[: len(cut) + x], 2.0)) is not None]
                    assert begun.get(w) == (0.0 if w.startswith(cut) else min(cs) if cs else None), (cut, w)


def test_assignment_against_permutations():
    from itertools import permutations

    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 5)
        table = [[rng.choice([None, 0.0, 0.3, 0.8, 1.0, 2.6]) for _ in range(n)] for _ in range(n)]
        all_ = [sum(cs) for o in permutations(range(n)) if None not in (cs := [table[a][b] for a, b in enumerate(o)])]
        got = canonical.assign(table)
        assert (got is None) == (not all_) and (got is None or abs(got - min(all_)) < 1e-6)


# -- near duplicates ---------------------------------------------------------------------------------------------------
def overlap(a, b):
    from collections import Counter

    return sum((Counter(a) & Counter(b)).values())


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    texts = [[f"t{rng.randint(0, 300)}" for _ in range(rng.randint(40, 70))] for _ in range(150)]
    for i in range(0, 150, 3):
        t = list(texts[i])
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"n{rng.randint(0, 999)}"
        rng.shuffle(t)
        texts.append(t)
    rows = [(i, " ".join(t), None, "x") for i, t in enumerate(texts)] + [(900, None, None, "x"), (901, "", None, "x"), (902, " ".join(texts[0]), None, "x")]
    df = spark.createDataFrame(rows, "row_id long, e string, f string, class_id string")
    near = neardup.NearDuplicates(df, "row_id", ["e", "f"])
    got = {tuple(r) for r in near.pairs().collect()}
    t = dict(enumerate(texts)) | {902: texts[0]}
    want = {(a, b) for a in t for b in t if a < b and overlap(t[a], t[b]) * 100 >= 85 * max(len(t[a]), len(t[b]))}
    assert got == want and len(want) > 40
    classes = {r.row_id: (r.class_id, r.n_links, r.group_id) for r in near.classes().collect()}
    assert len(classes) == len(t) and classes[902][0] == 0 and 900 not in classes
    none = neardup.NearDuplicates(df.where("row_id > 999"), "row_id", ["e", "f"])
    assert none.pairs().count() == 0 and none.classes().count() == 0


def test_joint_estimate_is_near_j():
    rng = np.random.default_rng(3)
    for n_a, n_b, both in ((60, 60, 52), (60, 60, 30), (50, 60, 50), (40, 60, 0)):
        texts = [" ".join(f"{p}{i}" for p, k in (("s", both), (c, n - both)) for i in range(k)) for c, n in (("a", n_a), ("b", n_b))]
        r = neardup.Batch(pa.array(texts)).registers(np.array([0, 1]), 400, 3000, neardup.JOINT_BASE, neardup.JOINT_LEVELS).astype(int)
        more, less, equal = neardup.compare(r[:1], r[1:])
        one = lambda k: np.array([k])
        assert abs(neardup.estimate(one(n_a), one(n_b), more, less, equal)[0] - both / (n_a + n_b - both)) < 0.04
    # a pair at the threshold is hardly ever lost
    lost = 0
    for k in range(300):
        a, b = rng.permutation(10_000)[:40].tolist(), rng.permutation(10_000)[:6].tolist()
        t = [" ".join(f"x{v}" for v in a), " ".join(f"x{v}" for v in a[:34]) + " " + " ".join(f"y{v}" for v in b)]
        r = neardup.Batch(pa.array(t)).registers(np.array([0, 1]), 400, neardup.JOINT, neardup.JOINT_BASE, neardup.JOINT_LEVELS).astype(np.uint8)
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([r[0].tobytes()]), pa.array([r[1].tobytes()]), pa.array([40]), pa.array([40])], names=list("abcdef"))
        lost += sum(x.num_rows for x in neardup._likely_rows(iter([batch]), 85)) == 0
    assert lost <= 2


def test_sketch_estimates_overlap():
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join([f"a{i}" for i in range(50)] + [f"b{i}" for i in range(10)])
    r = neardup.Batch(pa.array([a, b])).registers(np.array([0, 1]), 0, 2000)
    assert abs((r[0] == r[1]).mean() - 50 / 70) < 0.05


def test_recall_just_above_the_threshold(spark):
    """Planted pairs of 85 to 90 % common words: nine in ten are met by the bands, all by the exact way."""
    rng = random.Random(8)
    texts = []
    for _ in range(400):
        n = rng.randint(40, 80)
        t = [f"t{rng.randint(0, 5000)}" for _ in range(n)]
        u = list(t)
        for i in rng.sample(range(n), rng.randint(int(0.10 * n), int(0.15 * n))):
            u[i] = f"n{rng.randint(0, 100_000)}"
        rng.shuffle(u)
        texts += [t, u]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "row_id long, e string")
    want = {(a, a + 1) for a in range(0, 800, 2) if overlap(texts[a], texts[a + 1]) * 100 >= 85 * len(texts[a])}
    got = {tuple(r) for r in neardup.NearDuplicates(df, "row_id", ["e"]).pairs().collect()}
    every = {tuple(r) for r in neardup.NearDuplicates(df, "row_id", ["e"], exact=True).pairs().collect()}
    assert got <= want and len(want) > 300 and len(got) >= 0.93 * len(want)
    assert every == want


def test_hot_class_of_copies(spark):
    rows = [(i, "the same eight words stand in this text") for i in range(700)] + [(1000 + i, f"text number w{i} of its own a{i} b{i} c{i}") for i in range(300)] + [(None, "a b")]
    df = spark.createDataFrame(rows, "row_id long, e string")
    near = neardup.NearDuplicates(df, "row_id", ["e"])
    assert near.pairs().count() == 700 * 699 // 2
    assert near.members().where("class_id = 0").count() == 700 and near.members().count() == 1001


# -- consensus ---------------------------------------------------------------------------------------------------------
def test_consensus_follows_reliable_annotators(spark):
    rng = random.Random(9)
    good, bad, rows, truth = [1, 2, 3], [4, 5, 6, 7], [], {}
    for i in range(300):
        truth[i] = rng.choice("ABCD")
        for a in good + bad:
            wrong = rng.choice([x for x in "ABCD" if x != truth[i]])
            rows.append(("criterion", i, a, truth[i] if rng.random() < (0.93 if a in good else 0.3) else wrong))
    rows += [("criterion", 900, 1, None), ("criterion", 901, 4, "A"), ("severity", 0, 1, "3")]
    v = spark.createDataFrame(rows, "field string, item_id long, annotator_id long, label string")
    f = spark.createDataFrame([], "field string, item_id long, own string")
    c = consensus.Consensus(v, f, {"criterion": 4.0, "severity": 5.0})
    got = {(r.field, r.item_id): r for r in c.labels().collect()}
    assert sum(got["criterion", i].label == truth[i] for i in truth) >= 285
    assert ("criterion", 900) not in got and got["criterion", 901].label == "A" and got["criterion", 901].agreement is None
    rel = {r.annotator_id: r.reliability for r in c.reliability.where("field = 'criterion'").collect()}
    assert min(rel[a] for a in good) > 0.8 and max(rel[a] for a in bad) < 0.5
    many = consensus.BROADCAST_CELLS
    consensus.BROADCAST_CELLS = 0
    try:
        joined = {(r.field, r.item_id): r for r in consensus.Consensus(v, f, {"criterion": 4.0, "severity": 5.0}).labels().collect()}
    finally:
        consensus.BROADCAST_CELLS = many
    assert {k: (r.label, round(r.probability, 6)) for k, r in joined.items()} == {k: (r.label, round(r.probability, 6)) for k, r in got.items()}
    empty = consensus.Consensus(v.where("item_id < 0"), f, {"criterion": 4.0})
    assert empty.labels().count() == 0 and empty.reliability.count() == 0


def test_many_confusion_cells_do_not_go_through_the_driver(spark):
    v = spark.range(60_000).select(F.lit("criterion").alias("field"), F.expr("id div 2").alias("item_id"), F.col("id").alias("annotator_id"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("label"))
    c = consensus.Consensus(v, spark.createDataFrame([], "field string, item_id long, own string"), {"criterion": 4.0}, rounds=1)
    assert c.counted.count() == 120_000 and not c.few
    assert c.labels().where("n_votes = 2 AND agreement = 0").count() == 30_000


def test_votes_do_not_come_to_the_driver_and_are_shuffled_narrow(spark):
    v = spark.range(3_000).select(F.lit("criterion").alias("field"), F.expr("id div 30").alias("item_id"), F.expr("id % 30").alias("annotator_id"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("label"))
    c = consensus.Consensus(v, spark.createDataFrame([("criterion", 5, "a")], "field string, item_id long, own string"), {"criterion": 4.0}, rounds=1)
    assert c.votes.count() == 6_000 and {len(x) for x in c.fit_on.values()} == {200}
    assert [tuple(float(c.fit_on[n][i]) for n in ("item_id", "k", "own", "near")) for i in (9, 10, 11)] == [(4, 1, 0, 0), (5, 0, 1, 1), (5, 1, 0, 0)]
    assert "share" not in c.votes.columns and abs(np.exp(c.fit_on["share"][:2]).sum() - 1) < 1e-9


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", 1), (1, 1, 2, "b", 2), (1, 1, 2, "b", 2), (1, None, 3, "c", 3)], "item int, who int, t int, label string, id int")
    assert [tuple(r) for r in consensus.latest(df, "item", "who", ["t", "id"], ["label"]).collect()] == [(1, 1, "b")]


# -- cut texts ---------------------------------------------------------------------------------------------------------
def _article(rng):
    s = [" ".join(rng.choice("the clerk signs every form before noon and sends a copy to our office in town".split()) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(12)]
    return " ".join(s) + rng.choice(["", "\n\n- a last item", "\n\nVersion 1.22", "\n\n— The clerk, Town"])


def test_cut_texts_held_out():
    rng = random.Random(1)
    train, test = [_article(rng) for _ in range(500)], [_article(rng) for _ in range(150)]
    words = {w for t in train for w in t.lower().replace(".", " ").split()[:-1]}
    known = lambda t: truncation.last_word(t) in words
    made = [truncation.examples(t, 0, known(t), i) for i, t in enumerate(train)]
    m = truncation.fit([own for own, _ in made], [0] * len(made), [[y if w in words else n for w, y, n in cuts] for _, cuts in made])
    cuts = [c for t in test if (c := truncation._cut(t, rng))]
    right = sum(m.score(t, 0, known(t)) < truncation.CUT for t in test) + sum(m.score(c, 0, known(c)) > truncation.CUT for c in cuts)
    assert right / (len(test) + len(cuts)) > 0.93


def test_whole_last_line_and_quotes_count():
    bullet = "Intro.\n- " + "word " * 200 + "end"
    assert "kind=bullet" in truncation.features(bullet, 0, True)
    quote = "He said “" + "a very long speech " * 60
    assert "quote" in truncation.features(quote, 0, True)
    assert truncation.last_word("x y\nthe clerk's\r\n") == "clerk's" and truncation.last_word("ends. ") == "" and truncation.last_word("") == ""


def test_words_are_counted_over_all_documents(spark):
    """A closing word outside the sample still is a whole word."""
    df = spark.createDataFrame([(i, f"We keep the zymurgy{"abcdefghijklmnopqrst"[i // 2]} log and all the other papers in one place.") for i in range(40)], "doc_id long, text string")
    got = {r.word for r in truncation._inner_words(df).collect()}
    assert {f"zymurgy{k}" for k in "abcdefghijklmnopqrst"} <= got and {"we", "keep", "one"} <= got and "place" not in got
    java = spark.createDataFrame([("Ünïcode-wörd's x½ end it’s",)], "text string").selectExpr("1 AS doc_id", "text")
    from pyspark.sql import functions as F

    assert java.select(F.regexp_extract_all(F.lower("text"), F.lit(truncation._WORD), 0)).first()[0] == [t.lower() for t in truncation._TOKEN.findall("Ünïcode-wörd's x½ end it’s") if t.strip()]


def test_cut_frame_edges(spark):
    rng = random.Random(2)
    rows = [(i, _article(rng), "s", 1.0) for i in range(60)] + [(900, None, "s", 1.0), (901, "", None, 1.0), (902, " \n ", "s", 1.0), (903, "word " * 50_000, "s", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, p_cut double")
    got = {r.doc_id: r.p_cut for r in truncation.scores(df).collect()}
    assert len(got) == 64 and got[900] == got[901] == got[902] == 0.0
    assert truncation.scores(df.where("doc_id > 999")).count() == 0


def test_open_markup():
    assert truncation.open_markup("<p>a <b>c</b><br></p>") == (0, False)
    assert truncation.open_markup("<div><p>text") == (2, False)
    assert truncation.open_markup('<p>x</p><a href="y')[1]
