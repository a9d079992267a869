"""Scores of runs against planted defects, consistency between repetitions, bands and verdicts.

Ratios keep numerator and denominator until the last projection; a ratio over nothing is null.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import accumulate
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rubricloom.operators import meeting, pairs, resolve
from rubricloom.session import broadcast_if_small

METRICS = ["recall", "precision", "recall_location", "precision_location"]
CELL = ["skill", "skill_version", "model"]
#: Rows of places of classes of defects that are told to every task; more go to shards of runs.
MAX_CLASSES = 1_000_000
#: About so many claims lie in a shard.
SHARD = 200_000


def ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d)


def resolved_claims(findings: DataFrame, lay: DataFrame) -> DataFrame:
    """Claims of all findings with their resolved places; ``cid`` is a claim's finding row and its number in it."""
    c = resolve.claims(findings, "run_id", "artifact_id", "row_id", "finding_id", "criterion", "severity", "lane")
    return resolve.resolve(c, lay).withColumn("cid", F.struct("row_id", "claim"))


def classes(truths: DataFrame) -> DataFrame:
    """The defects of each artifact in classes of equal ones: by place, and (``same``) by criterion ``t`` and place.

    Defects of one class differ in their id alone, so a run's claims take them in the order of ids, and a claim has to
    meet a class only once, however many defects it holds. ``g`` numbers an artifact's anchors in the matching order, ``c``
    names a class, ``k`` is a defect's number in it. Where one anchor has several sets of places, or an id occurs twice,
    each defect is a class of its own.
    """
    d = truths.withColumn("ps", resolve.truth_places()).where((F.size("ps") > 0) & F.col("artifact_id").isNotNull() & F.col("defect_id").isNotNull())
    kinds = F.array(F.struct(F.lit(False).alias("same"), F.lit("").alias("t")), F.struct(F.lit(True).alias("same"), F.col("criterion").alias("t")))
    d = d.select("artifact_id", "defect_id", "anchor", "ps", F.inline(kinds)).where("t IS NOT NULL").distinct()
    d = d.withColumn("twice", F.count(F.lit(1)).over(Window.partitionBy("same", "defect_id")) > 1)
    of, anchor = ["artifact_id", "same"], Window.partitionBy("artifact_id", "same", "t", "anchor")
    d = d.withColumn("g", F.dense_rank().over(Window.partitionBy(*of).orderBy("t", "anchor")))
    d = d.withColumn("alone", F.when(F.max("twice").over(anchor) | (F.min("ps").over(anchor) != F.max("ps").over(anchor)), F.col("defect_id")))
    own = Window.partitionBy(*of, "t", "anchor", "ps", "alone")
    return d.select(*of, "t", "ps", "g", "defect_id", F.min("defect_id").over(own).alias("c"), (F.row_number().over(own.orderBy("defect_id")) - 1).alias("k"))


def _by_run(claims: DataFrame, group: list[str]) -> DataFrame:
    """One row for each run (and lane) with its claims ``xs`` in the matching order, ``n_claims`` and ``n_unresolvable``.

    A run's claims are shuffled once, in narrow form.
    """
    x = F.struct("canonical", F.coalesce("finding_id", F.lit("")).alias("fid"), "row_id", "claim", "artifact_id", "criterion", "lo", "hi", "title")
    runs = claims.groupBy(*group).agg(F.array_sort(F.collect_list(x)).alias("xs"), F.count_if(~F.col("resolvable")).alias("n_unresolvable"))
    return runs.select(*group, F.size("xs").cast("long").alias("n_claims"), "n_unresolvable", "xs")


def _class_places(truth_classes: DataFrame, kinds: list[bool]) -> DataFrame:
    """Each class at each of its places, with the number ``n`` of its defects."""
    b = truth_classes.where(F.col("same").isin(kinds)).groupBy("artifact_id", "same", "t", "g", "c", "ps").agg(F.count(F.lit(1)).alias("n"))
    return b.select("artifact_id", "same", "t", "g", "c", "n", F.explode("ps").alias("p")).select("artifact_id", "same", "t", "g", "c", "n", F.col("p.n").alias("pn"), F.col("p.title").alias("pt"))


def _of_runs(claims: DataFrame, truth_classes: DataFrame, group: list[str], kinds: list[bool]) -> DataFrame:
    """The same in plain joins, to compare with: one row for each run (and lane) with ``n_claims``, ``n_unresolvable`` and
    for each kind of ``same`` (by, place) the classes that its claims meet, sorted in the matching order.

    Of a place's classes a claim meets those before which fewer defects lie than its run has claims: it is matched with
    one of these at the latest.
    """
    runs = _by_run(claims, group)
    keep = [*group, "n_claims", "n_unresolvable"]
    a = runs.select(*keep, F.posexplode("xs").alias("j", "x")).select(*keep, "j", "x.*")
    at = F.explode_outer(resolve.claim_places()).alias("p")
    a = a.select(*keep, "artifact_id", "j", F.struct("row_id", "claim").alias("l"), "criterion", at)
    a = a.withColumns({"pn": F.coalesce("p.n", F.lit(-1)), "pt": F.coalesce("p.title", F.lit(""))}).drop("p")
    ways = [F.struct(F.lit(k).alias("same"), (F.col("criterion") if k else F.lit("")).alias("t")) for k in kinds]
    a = a.select("*", F.inline(F.array(*ways))).drop("criterion")
    on = ["artifact_id", "same", "t", "pn", "pt"]
    b = _class_places(truth_classes, kinds).withColumns({"pn": F.coalesce("pn", F.lit(-1)), "pt": F.coalesce("pt", F.lit(""))})
    # a class that a place holds twice, under another anchor, counts once
    b = b.groupBy(*on, "c").agg(F.min_by(F.struct("g", "n"), "g").alias("x")).select(*on, "c", "x.*")
    b = b.withColumn("before", F.sum("n").over(Window.partitionBy(*on).orderBy("g", "c").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    b = broadcast_if_small(b, MAX_CLASSES)
    met = a.join(b, [*[a[k].eqNullSafe(b[k]) if k == "same" else a[k] == b[k] for k in on], b["before"] < a["n_claims"]], "left").select(*keep, a["same"], "j", "l", "g", "c", "n")
    one = lambda k: F.array_sort(F.collect_list(F.when(F.col("c").isNotNull() & (F.col("same") == k), F.struct("g", "j", "l", "c", "n"))))
    return met.groupBy(*keep).agg(*[one(k).alias("by" if k else "place") for k in kinds])


def _told(truth_classes: DataFrame, kinds: list[bool]) -> Broadcast | None:
    """The index of the classes' places for every task, or none where they are too many."""
    b = _class_places(truth_classes, kinds)
    if b.limit(MAX_CLASSES + 1).count() > MAX_CLASSES:
        return None
    t = b.toArrow()
    return b.sparkSession.sparkContext.broadcast({k: meeting.Index(t.filter(pc.equal(t.column("same"), k))) for k in kinds})


def _sharded(claims: DataFrame, truth_classes: DataFrame, group: list[str], kinds: list[bool], work: Callable, schema: str) -> DataFrame:
    """``work`` over runs in shards, each with an index of the classes of its own artifacts alone.

    A run goes to a shard of its first artifact, whose runs are spread over several where they hold many claims; a shard
    gets the classes of all artifacts of its runs. Runs travel once more and classes once for each shard that needs
    them; candidates stay within a shard's batch.
    """
    n = claims.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_shards = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    # no more rows than shards
    heavy = F.broadcast(n.where(F.col("n") > SHARD).select(F.col("artifact_id").alias("home"), F.ceil(F.col("n") / SHARD).alias("parts")))

    def placed(df: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(*group), F.coalesce("parts", F.lit(1)))
        return df.join(heavy, "home", "left").withColumn("shard", F.pmod(F.xxhash64("home", part), F.lit(n_shards))).drop("home", "parts")

    needed = placed(claims.groupBy(*group).agg(F.min("artifact_id").alias("home"), F.collect_set("artifact_id").alias("of")))
    needed = needed.select("shard", F.explode("of").alias("artifact_id")).distinct()
    b = _class_places(truth_classes, kinds).join(needed, "artifact_id")
    runs = placed(_by_run(claims, group).withColumn("home", F.array_min(F.transform("xs", lambda x: x["artifact_id"]))))
    empty = to_arrow_schema(StructType.fromDDL(schema))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = SimpleNamespace(value={k: meeting.Index(right.filter(pc.equal(right.column("same"), k))) for k in kinds})
        out = [x.cast(empty) for x in work(held)(iter(left.combine_chunks().to_batches()))]
        return pa.Table.from_batches(out, empty)

    return runs.groupBy("shard").cogroup(b.groupBy("shard")).applyInArrow(run, schema)


def matches(claims: DataFrame, truths: DataFrame, by_criterion: bool = True) -> DataFrame:
    """(run_id, row_id, claim, defect_id) of the greedy matching of claims with defects; by place alone if
    ``by_criterion`` is off."""
    c, claims = classes(truths), claims.where("run_id IS NOT NULL")
    ids = c.where(F.col("same") == by_criterion).select("c", F.col("k").cast("int").alias("k"), "defect_id").distinct()
    kinds = dict(claims.dtypes) | dict(c.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("run_id", "row_id", "claim", "c")) + ", k int"
    work = lambda index: meeting.listed(index, by_criterion)
    if told := _told(c, [by_criterion]):
        m = _by_run(claims, ["run_id"]).select("run_id", "xs").mapInArrow(work(told), schema)
    else:
        m = _sharded(claims, c, ["run_id"], [by_criterion], work, schema)
    return m.join(ids, ["c", "k"]).select("run_id", "row_id", "claim", "defect_id")


def scores(runs: DataFrame, claims: DataFrame, truths: DataFrame, lane: bool = False) -> DataFrame:
    """One row for each run (and lane of its claims): claims, defects, matches by criterion and by place, unresolvable
    claims, whether it is clean. Both matchings are made over a run's one row."""
    group = ["run_id", "lane"] if lane else ["run_id"]
    d = truths.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_defects"))
    c, claims = classes(truths), claims.where("run_id IS NOT NULL")
    keep, kinds = [*group, "n_claims", "n_unresolvable"], dict(claims.dtypes) | {"n_claims": "bigint", "n_unresolvable": "bigint"}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keep) + ", n_matched int, n_matched_location int"
    work = lambda index: meeting.counted(index, {True: "n_matched", False: "n_matched_location"}, keep)
    if told := _told(c, [True, False]):
        m = _by_run(claims, group).mapInArrow(work(told), schema)
    else:
        m = _sharded(claims, c, group, [True, False], work, schema)
    if lane:
        runs = runs.withColumn("lane", F.explode(F.array(F.lit("scripted"), F.lit("judged"))))
    out = runs.join(m, group, "left").join(d, "artifact_id", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_claims", "n_unresolvable", "n_defects", "n_matched", "n_matched_location")})
    return out.withColumn("clean", F.col("n_defects") == 0)


def pooled(scores_: DataFrame, cell: list[str]) -> DataFrame:
    """Recall over seeded artifacts, precision over all, claims for each clean artifact-run, with their counts."""
    g = scores_.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("artifact_runs"), F.sum("n_unresolvable").alias("unresolvable_claims"),
        F.sum(F.when(~F.col("clean"), F.col("n_matched")).otherwise(0)).alias("matched"), F.sum(F.when(~F.col("clean"), F.col("n_matched_location")).otherwise(0)).alias("matched_location"),
        F.sum("n_defects").alias("defects"), F.sum("n_matched").alias("claims_matched"), F.sum("n_matched_location").alias("claims_matched_location"), F.sum("n_claims").alias("claims"),
        F.sum(F.when(F.col("clean"), F.col("n_claims")).otherwise(0)).alias("clean_claims"), F.count_if(F.col("clean")).alias("clean_runs"),
    )
    c = F.col
    return g.withColumns({"recall": ratio(c("matched"), c("defects")), "precision": ratio(c("claims_matched"), c("claims")), "recall_location": ratio(c("matched_location"), c("defects")), "precision_location": ratio(c("claims_matched_location"), c("claims")), "clean_fp_rate": ratio(c("clean_claims"), c("clean_runs"))})


def run_pairs(claims: DataFrame, runs: DataFrame, cell: list[str]) -> DataFrame:
    """Each unordered pair of runs of one cell and artifact, with tolerant and exact Jaccard similarity of their claims."""
    u = pairs.units(claims, runs, cell)
    return u.groupBy("of", "i", "j").applyInArrow(pairs.compared(cell, False), "run_id_a bigint, run_id_b bigint, tolerant double, exact double")


def consistency(claims: DataFrame, runs: DataFrame, cell: list[str]) -> DataFrame:
    """Mean similarity of the pairs of each artifact, then the equal-weight mean over artifacts; pairs are summed where
    they are compared."""
    kinds = dict(runs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*cell, "artifact_id"]) + ", tolerant double, exact double, pairs bigint"
    g = pairs.units(claims, runs, cell).groupBy("of", "i", "j").applyInArrow(pairs.compared(cell, True), schema)
    a = g.groupBy(*cell, "artifact_id").agg(F.sum("pairs").alias("k"), *[(F.sum(c) / F.sum("pairs")).alias(c) for c in ("tolerant", "exact")])
    return a.groupBy(*cell).agg(F.avg("tolerant").alias("consistency"), F.avg("exact").alias("consistency_exact"), F.count(F.lit(1)).alias("artifacts_with_pairs"), F.sum("k").alias("total_pairs"))


def repetitions(scores_: DataFrame, cell: list[str], rep: str = "rep") -> DataFrame:
    """Numerator and denominator of each metric for each cell and repetition, in long form."""
    g = pooled(scores_, [*cell, rep])
    parts = {"recall": ("matched", "defects"), "precision": ("claims_matched", "claims"), "recall_location": ("matched_location", "defects"), "precision_location": ("claims_matched_location", "claims")}
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(n).cast("long").alias("num"), F.col(d).cast("long").alias("den")) for m, (n, d) in parts.items()]))
    return g.select(*cell, F.col(rep).alias("rep"), long.alias("x")).select(*cell, "rep", "x.*")


def _band(reps: list[tuple[int, int]], low: float, high: float) -> tuple[float, float, float]:
    """Band and standard deviation over all k^k resamples of (num, den), counted in whole numbers."""
    k, stride = len(reps), len(reps) * max(d for _, d in reps) + 1
    kind = np.int64 if k**k < 2**63 else object
    one, ways = np.unique(np.array([n * stride + d for n, d in reps], np.int64), return_counts=True)
    ways = np.array(ways.tolist(), kind)
    at, count = np.zeros(1, np.int64), np.ones(1, kind)
    for _ in range(k):
        s, c = (at[:, None] + one).ravel(), (count[:, None] * ways).ravel()
        order = np.argsort(s, kind="stable")
        s = s[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        at, count = s[first], np.add.reduceat(c[order], first)
    num, den = at // stride, at % stride
    v = np.where(den > 0, num / np.maximum(den, 1), 0.0)
    order = np.argsort(v, kind="stable")
    v, upto = v[order], list(accumulate(count[order].tolist()))
    share = np.array([c / k**k for c in count[order].tolist()])
    cut = lambda f: float(v[bisect_right(upto, round(Fraction(str(f)) * (k**k - 1)))])
    mean = float((v * share).sum())
    return cut(low), cut(high), float(np.sqrt((share * (v - mean) ** 2).sum()))


def bands(reps: DataFrame, cell: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Range over repetitions and the exact bootstrap band of each cell and metric.

    All k^k resamples of k repetitions count, so the band needs no random draws: up to 6 repetitions they are listed,
    beyond that the joint distribution of numerator and denominator is convolved. Percentiles take the nearest index,
    halves to even.
    """
    key = [*cell, "metric"]
    g = reps.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rep", "num", "den"))).alias("r")).withColumn("k", F.size("r"))
    one = F.try_divide(F.col("x.num").cast("double"), F.col("x.den"))
    span = g.select(*key, "k", F.explode("r").alias("x")).groupBy(*key).agg(F.max("k").alias("k"), F.sum("x.num").alias("num"), F.sum("x.den").alias("den"), F.min(one).alias("rep_min"), F.max(one).alias("rep_max"))
    draws = g.where("k <= 6").select(*key, "k", "r", F.explode(F.expr("sequence(0L, cast(pow(k, k) AS bigint) - 1)")).alias("d"))
    pick = F.expr("transform(sequence(0, k - 1), i -> r[cast(cast(d AS bigint) div cast(pow(k, i) AS bigint) % k AS int)])")
    v = draws.select(*key, "k", pick.alias("p")).select(*key, F.expr("aggregate(p, 0L, (s, x) -> s + x.num)").alias("n"), F.expr("aggregate(p, 0L, (s, x) -> s + x.den)").alias("e"))
    v = v.select(*key, F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("e")), F.lit(0.0)).alias("v"))
    hist = v.groupBy(*key, "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*key)
    hist = hist.withColumns({"upto": F.sum("c").over(w.orderBy("v")), "n": F.sum("c").over(w)})
    at = lambda f: F.min(F.when(F.col("upto") > F.bround(F.lit(f) * (F.col("n") - 1)), F.col("v")))
    mean = F.sum(F.col("v") * F.col("c")) / F.sum("c")
    sd = F.sqrt(F.greatest(F.sum(F.col("v") * F.col("v") * F.col("c")) / F.sum("c") - mean * mean, F.lit(0.0)))
    b = hist.groupBy(*key).agg(at(low).alias("band_low"), at(high).alias("band_high"), sd.alias("bootstrap_sd"))
    more = g.where("k > 6").select(*key, "r")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in more.schema[:-1]) + ", band_low double, band_high double, bootstrap_sd double"

    def convolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*key, "band_low", "band_high", "bootstrap_sd"]
        for x in batches:
            found = [_band([(d["num"], d["den"]) for d in r], low, high) for r in x.column(len(key)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(key)], *[pa.array([f[i] for f in found], pa.float64()) for i in range(3)]], names=names)

    out = span.join(b.unionByName(more.mapInArrow(convolved, schema)), key)
    return out.withColumns({"pooled": F.try_divide(F.col("num").cast("double"), F.col("den")), "spread": F.col("rep_max") - F.col("rep_min"), "band_width": F.col("band_high") - F.col("band_low")})


def verdict(r: str, br: str, p: str, bp: str) -> Column:
    """Recall and precision against a baseline's; any null gives n/a."""
    a, b, c, d = F.col(r), F.col(br), F.col(p), F.col(bp)
    return F.when(a.isNull() | b.isNull() | c.isNull() | d.isNull(), "n/a").when((a > b) & (c >= d), "beats baseline").when((a == b) & (c >= d), "ties baseline").when((a <= b) & (c <= d), "below baseline").otherwise("no pass on this tier")


def against_baseline(entries: DataFrame, tier: str, group: list[str], baseline: Column) -> DataFrame:
    """Entries beside the baseline entry of their tier and group, with the verdict and, for a failed one, the first other
    tier that qualifies. The baseline of lowest version counts where there are several."""
    e = entries.withColumn("_b", baseline)
    b = e.where("_b").groupBy(tier, *group).agg(F.min_by(F.struct("recall_location", "precision_location"), F.transform(F.split("skill_version", r"\."), lambda x: x.try_cast("int"))).alias("b"))
    j = e.where("NOT _b").join(b, [tier, *group]).withColumns({"baseline_recall": F.col("b.recall_location"), "baseline_precision": F.col("b.precision_location")})
    j = j.withColumn("verdict", verdict("recall_location", "baseline_recall", "precision_location", "baseline_precision"))
    ok = F.col("verdict").isin("beats baseline", "ties baseline")
    w = Window.partitionBy("skill", "skill_version", *group)
    via = F.min(F.when(ok, F.col(tier))).over(w)
    return j.withColumn("qualifies_via", F.when(F.col("verdict") == "no pass on this tier", via)).drop("_b", "b")


def acceptance(decisions: DataFrame, findings: DataFrame) -> DataFrame:
    """Accepted share of the decided findings of each criterion; deferred and unresolved decisions are counted beside it."""
    j = decisions.join(findings.select(F.col("row_id").alias("item_id"), F.col("criterion").alias("f_criterion")), "item_id", "left")
    decided = F.col("f_criterion").isNotNull() & F.col("disposition").isin("accept", "reject")
    g = j.groupBy(F.col("f_criterion").alias("criterion")).agg(F.count_if(decided & (F.col("disposition") == "accept")).alias("accepted"), F.count_if(decided).alias("decided"), F.count_if(F.col("disposition") == "defer").alias("deferred"))
    return g.withColumn("acceptance", ratio(F.col("accepted"), F.col("decided")))
