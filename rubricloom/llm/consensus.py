"""Consensus of annotators' labels by expectation-maximisation.

Each (field, item) has the labels its annotators gave as candidates. The E-step weighs them by the annotators'
confusion matrices, with the item-feature classifier's output as label prior; the M-step counts the matrices again
from the posteriors and refits the classifier. Matrices are smoothed towards an annotator's overall reliability, so
that rare labels borrow from frequent ones; the classifier is a conditional logistic regression with an L2 penalty on
features of item and candidate.

Confusion counts are sparse, one cell for each annotator, true and given label that occur together, so there are at most
as many as pairs of a vote and a candidate. They stay a distributed table: a round joins them to the votes, which lie by
item, and sums the partial counts of each task again. The cells are counted; where they are few they are told to every
task and the votes never move, else both are shuffled. Votes and counts are written to the shared checkpoint folder.
Rounds end when no reliability moves any more. Only the reliabilities and the candidates of the classifier's sample, each
one's features and posterior, come to the driver, as columns; votes never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricloom.session import checkpoint

#: Pseudo-counts that pull a confusion row towards the annotator's overall reliability.
SMOOTH = 30.0
#: Items (about) on which the classifier is fitted, taken by the hash of their id; everything else covers all items.
SAMPLE_ITEMS = 20_000
L2 = 1.0
#: The most rounds, and the change of every annotator's reliability below which they end.
ROUNDS, STILL = 8, 1e-3
#: Confusion cells that are told to every task instead of being joined by a shuffle.
BROADCAST_CELLS = 100_000
FEATURES = ["own", "near", "share"]
_VOTE = ["item_id", "k", "annotator_id", "l", "own", "near", "cell", "total"]


def latest(df: DataFrame, item: str, annotator: str, order: list[str], columns: Iterable[str]) -> DataFrame:
    """The last row of each item and annotator by ``order``; partial maxima are taken before the shuffle."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return df.where(F.col(item).isNotNull() & F.col(annotator).isNotNull()).groupBy(item, annotator).agg(last.alias("_l")).select(item, annotator, "_l.*")


def _starts(*cols: np.ndarray) -> np.ndarray:
    new = np.zeros(len(cols[0]), bool)
    new[0] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Names:
    """The labels by their number: text, field and how often each is given. Votes carry the number alone."""

    def __init__(self, label: list[str], f: np.ndarray, n: np.ndarray) -> None:
        """Sorted by field, so that a field's numbers are neighbours."""
        self.label, self.f, self.n = label, f, n
        self.share = np.log(n / np.bincount(f, n)[f])

    def field(self, k: Column) -> Column:
        out = F.lit(None).cast("int")
        for f in np.unique(self.f):
            at = np.flatnonzero(self.f == f)
            out = F.when(k.between(int(at[0]), int(at[-1])), int(f)).otherwise(out)
        return out


class Params:
    """Parameters of one round, without the confusion counts."""

    def __init__(self, fields: list[str], choices: list[float], reliability: pd.DataFrame) -> None:
        """``reliability`` has the sums right and n by f and a."""
        self.fields, self.choices = fields, np.array(choices)
        self.theta = np.zeros((len(fields), len(FEATURES)))
        rel = reliability.astype({"f": int, "a": np.int64, "right": float, "n": float})
        rel["reliability"] = (rel["right"] + 2.0) / (rel["n"] + 3.0)
        self.reliability = rel
        self.annotators = np.unique(rel["a"].to_numpy())
        self.acc = np.full((len(self.fields), len(self.annotators)), 2.0 / 3.0)
        self.acc[rel["f"].to_numpy(), np.searchsorted(self.annotators, rel["a"].to_numpy())] = rel["reliability"]

    def log_chance(self, v: Votes) -> np.ndarray:
        """log P(annotator says l | truth is k) of each vote, smoothed towards the overall reliability."""
        acc = self.acc[v.f, np.searchsorted(self.annotators, v.a)]
        base = np.where(v.k == v.l, acc, (1.0 - acc) / (self.choices[v.f] - 1.0))
        return np.log((v.cell + SMOOTH * base) / (v.total + SMOOTH))


class Votes:
    """All votes of one partition beside each candidate, sorted by field, item and candidate."""

    def __init__(self, batches: Iterator[pa.RecordBatch], names: Names) -> None:
        parts = [b for b in batches if b.num_rows]
        self.n = sum(b.num_rows for b in parts)
        if not self.n:
            return
        t = pa.Table.from_batches(parts)
        c = {n: t[n].to_numpy() for n in _VOTE}
        self.order = np.lexsort((c["k"], c["item_id"], names.f[c["k"]]))
        c = {n: v[self.order] for n, v in c.items()}
        self.item, self.k, self.a, self.l = (c[n] for n in _VOTE[:4])
        self.f = names.f[self.k]
        self.cell, self.total = c["cell"], c["total"]  # counts of (annotator, k, l) and of (annotator, k)
        self.cand = _starts(self.f, self.item, self.k)  # first vote of each candidate
        self.votes = np.diff(np.append(self.cand, self.n))
        self.cf, self.ci, self.ck = self.f[self.cand], self.item[self.cand], self.k[self.cand]
        self.x = np.stack([c["own"][self.cand], c["near"][self.cand], names.share[self.ck]], axis=1)
        self.group = _starts(self.cf, self.ci)  # first candidate of each item
        self.size = np.diff(np.append(self.group, len(self.cand)))

    def posterior(self, p: Params | None) -> np.ndarray:
        """Probability of each candidate; without parameters, its share of the votes."""
        if p is None:
            return np.add.reduceat((self.k == self.l).astype(float), self.cand) / self.votes
        s = np.add.reduceat(p.log_chance(self), self.cand) + (self.x * p.theta[self.cf]).sum(axis=1)
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, self.group), self.size))
        return e / np.repeat(np.add.reduceat(e, self.group), self.size)


class Consensus:
    """Labels, agreement and reliability for a table of votes.

    ``votes`` has field, item_id, annotator_id and label (one row for each; null labels are ignored). ``features`` has
    field, item_id and own (text: the value the item itself carries, may be null); without them the classifier has only
    the labels' frequencies. ``choices`` gives for each field from how many labels an annotator typically chooses.
    Labels must come from reference lists: the distinct ones are sent to the executors. Ties end at the more frequent
    label, then the smaller one. An item or field without a label has no row; one vote alone is the consensus. An
    item's votes are at most one for each annotator, so no item is large; a hot annotator's counts are partial sums.
    """

    def __init__(self, votes: DataFrame, features: DataFrame, choices: dict[str, float], rounds: int = ROUNDS) -> None:
        spark = votes.sparkSession
        votes = votes.select("field", F.col("item_id").cast("long").alias("item_id"), F.col("annotator_id").cast("long").alias("annotator_id"), "label").where(F.col("label").isNotNull() & F.col("field").isin(list(choices)))
        names = votes.groupBy("field", "label").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["field", "label"], kind="stable", ignore_index=True)
        self.fields = list(choices)
        if not len(names):
            self.votes = self.params = None
            self._spark = spark
            return
        names["code"] = range(len(names))
        self.names = Names(names["label"].tolist(), names["field"].map(self.fields.index).to_numpy(np.int64), names["n"].to_numpy(np.int64))
        known = F.broadcast(spark.createDataFrame(names[["field", "label", "code"]]))
        coded = votes.join(known, ["field", "label"]).select("field", "item_id", "annotator_id", F.col("code").alias("l"), F.struct(F.col("code").alias("k"), "label").alias("c"))
        items = coded.groupBy("field", "item_id").agg(F.collect_list(F.struct("annotator_id", "l")).alias("v"), F.collect_set("c").alias("cs"))
        wide = items.join(features.select("field", F.col("item_id").cast("long").alias("item_id"), F.lower("own").alias("own")), ["field", "item_id"], "left").select("field", "item_id", "own", "v", F.explode("cs").alias("c"))
        label = F.lower("c.label")
        near = F.when(F.col("field") == "severity", -F.abs(F.expr("try_cast(own AS double)") - F.expr("try_cast(c.label AS double)"))).otherwise(F.when(F.contains("own", label), 1.0).otherwise(F.when(F.substring_index("own", "-", 1) == F.substring_index(label, "-", 1), 0.5)))
        zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
        flat = wide.select("item_id", F.col("c.k").cast("int").alias("k"), F.explode("v").alias("x"), zero(F.col("own") == label).alias("own"), zero(near).alias("near"))
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # written by item: a partition holds all votes of its items, in every round
        self.votes = checkpoint(flat.select("item_id", "k", F.col("x.annotator_id").alias("annotator_id"), F.col("x.l").cast("int").alias("l"), "own", "near"))
        n_items = self.votes.agg(F.approx_count_distinct("item_id", 0.01)).first()[0]
        sampled = F.pmod(F.xxhash64("item_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE_ITEMS / max(n_items, 1)) * (1 << 30)))
        zeros = {"cell": F.lit(0.0), "total": F.lit(0.0)}
        self.fit_on = _sorted(self.votes.where(sampled).withColumns(zeros).mapInArrow(_candidates(self.names), "item_id bigint, k int, own double, near double, share double"), self.names)
        self.counted: DataFrame | None = None
        params: Params | None = None
        for _ in range(rounds):
            step = checkpoint(self._expect(params, sampled))
            self.counted = step.where("item_id IS NULL").select(F.col("a").alias("annotator_id"), "k", "l", F.col("c").alias("cell"), "total")
            self.few = self.counted.count() <= BROADCAST_CELLS
            rel = self.counted.groupBy(self.names.field(F.col("k")).alias("f"), F.col("annotator_id").alias("a")).agg(F.sum(F.when(F.col("k") == F.col("l"), F.col("cell")).otherwise(0.0)).alias("right"), F.sum("cell").alias("n")).toPandas().sort_values(["f", "a"], ignore_index=True)
            p = _sorted(step.where("item_id IS NOT NULL").select("item_id", "k", "c"), self.names)["c"]
            nxt = Params(self.fields, [max(float(v), 2.0) for v in choices.values()], rel)
            nxt.theta = _fit(self.fit_on, p, params.theta if params else nxt.theta)
            still = params is not None and np.abs(nxt.acc - params.acc).max() < STILL
            params = nxt
            if still:
                break
        self.params = params

    def _joined(self, params: Params | None) -> DataFrame:
        """The votes with their confusion counts (none without parameters), each item's in one partition."""
        if params is None:
            return self.votes.withColumns({"cell": F.lit(0.0), "total": F.lit(0.0)})
        on = ["annotator_id", "k", "l"]
        if self.few:
            return self.votes.join(F.broadcast(self.counted), on).select(*_VOTE)
        return self.votes.join(self.counted.hint("merge"), on).select(*_VOTE).repartition(self.parts, "item_id")

    def _expect(self, params: Params | None, sampled: Column) -> DataFrame:
        """Expected counts of each annotator's labels by true label, under ``params``, with the total of each true label,
        and, with an item_id, the posteriors of the sampled items' candidates."""
        sent = self.votes.sparkSession.sparkContext.broadcast((params, self.names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: list[np.ndarray] = []

            def votes() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    seen.append(b.column("sampled").to_numpy(zero_copy_only=False))
                    yield b

            params, known = sent.value
            v = Votes(votes(), known)
            if not v.n:
                return
            p = v.posterior(params)
            rows = pd.DataFrame({"a": v.a, "k": v.k, "l": v.l, "c": np.repeat(p, v.votes)}).groupby(["a", "k", "l"], as_index=False).sum()
            out = pa.RecordBatch.from_pandas(rows.astype({"a": "int64", "k": "int32", "l": "int32"}), preserve_index=False)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.nulls(len(out), pa.int64())], names=names)
            at = np.flatnonzero(np.concatenate(seen)[v.order][v.cand])
            none = lambda kind: pa.nulls(len(at), kind)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), pa.array(v.ck[at], pa.int32()), none(pa.int32()), pa.array(p[at]), pa.array(v.ci[at], pa.int64())], names=names)

        names = ["a", "k", "l", "c", "item_id"]
        out = self._joined(params).withColumn("sampled", sampled).mapInArrow(run, "a bigint, k int, l int, c double, item_id bigint")
        sums = out.repartition(self.parts, "a", "k").groupBy("a", "k", "l", "item_id").agg(F.sum("c").alias("c"))
        return sums.withColumn("total", F.sum("c").over(Window.partitionBy("a", "k")))

    @property
    def reliability(self) -> DataFrame:
        """field, annotator_id, the number of labels, and the estimated share of right ones."""
        spark = self._spark if self.params is None else self.votes.sparkSession
        rows = [] if self.params is None else [(self.fields[int(f)], int(a), float(n), float(r)) for f, a, n, r in self.params.reliability[["f", "a", "n", "reliability"]].itertuples(index=False)]
        return spark.createDataFrame(rows, "field string, annotator_id bigint, n_labels double, reliability double")

    def labels(self) -> DataFrame:
        """field, item_id, label, its probability, the votes, and the share of agreeing pairs of annotators (null for one vote)."""
        schema = "field string, item_id bigint, label string, probability double, n_votes bigint, agreement double"
        if self.params is None:
            return self._spark.createDataFrame([], schema)
        sent = self.votes.sparkSession.sparkContext.broadcast((self.params, self.fields, self.names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            params, fields, names = sent.value
            v = Votes(batches, names)
            if not v.n:
                return
            p = np.round(v.posterior(params), 9)
            g = np.repeat(np.arange(len(v.group)), v.size)
            order = np.lexsort((v.ck, -names.n[v.ck], -p, g))
            best = order[v.group]
            mine = np.add.reduceat((v.k == v.l).astype(np.int64), v.cand)
            n = v.votes[v.group]
            pairs = n * (n - 1)
            agree = np.add.reduceat(mine * (mine - 1), v.group) / np.maximum(pairs, 1)
            yield pa.RecordBatch.from_arrays([pa.array([fields[i] for i in v.cf[best]]), pa.array(v.ci[best]), pa.array([names.label[i] for i in v.ck[best]]), pa.array(p[best]), pa.array(n), pa.array(agree, mask=pairs == 0)], names=["field", "item_id", "label", "probability", "n_votes", "agreement"])

        return self._joined(self.params).mapInArrow(run, schema)


def _candidates(names: Names) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each candidate of a partition's votes, with its features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Votes(batches, names)
        if v.n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (v.ci, v.ck, *v.x.T)], names=["item_id", "k", *FEATURES])

    return run


def _sorted(df: DataFrame, names: Names) -> dict[str, np.ndarray]:
    """Rows of candidates in the driver, in the order of field, item and candidate; columns, never row objects."""
    t = df.toArrow()
    c = {n: t[n].to_numpy() for n in t.column_names}
    c["f"] = names.f[c["k"]]
    order = np.lexsort((c["k"], c["item_id"], c["f"]))
    return {n: v[order] for n, v in c.items()}


def _fit(at: dict[str, np.ndarray], p: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Penalised conditional logistic regression of the posteriors ``p`` of the candidates ``at``, by Newton steps."""
    out = theta.copy()
    for f in range(len(theta)):
        rows = np.flatnonzero(at["f"] == f)
        if not len(rows):
            continue
        x, q, start = np.stack([at[n][rows] for n in FEATURES], axis=1), p[rows], _starts(at["item_id"][rows])
        size, t = np.diff(np.append(start, len(rows))), theta[f].copy()
        for _ in range(8):
            s = x @ t
            e = np.exp(s - np.repeat(np.maximum.reduceat(s, start), size))
            e /= np.repeat(np.add.reduceat(e, start), size)
            d = x - np.repeat(np.add.reduceat(x * e[:, None], start, axis=0), size, axis=0)
            step = np.linalg.solve((d * e[:, None]).T @ d + L2 * np.eye(len(t)), x.T @ (q - e) - L2 * t)
            t += np.clip(step, -2.0, 2.0)
        out[f] = t
    return out
