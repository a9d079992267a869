"""Similarity of all pairs of runs of one cell and artifact, by blocks of runs.

The pairs of a cell and artifact grow with the square of its runs, so no pair and no pair of claims is ever shuffled: runs
travel with their claims as one row to the units that compare two blocks of runs (small cells share a unit), and a unit
compares all its claims at once in native arrays. A unit holds at most about two blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Runs of a block, and pairs of claims that are tested at once.
BLOCK, STEP = 512, 1_000_000


def units(claims: DataFrame, runs: DataFrame, cell: list[str]) -> DataFrame:
    """Runs with their claims in each unit (``of``, ``i``, ``j``) that compares them; ``first`` marks those of block i."""
    n_buckets = max(1, -(-runs.count() // BLOCK))
    r = runs.where("artifact_id IS NOT NULL").select("run_id", "artifact_id", F.struct(*cell).alias("cell"))
    r = r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("artifact_id", "cell"))).where("n > 1")
    r = r.withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("b", F.pmod(F.xxhash64("run_id"), F.col("nb")).cast("int"))
    mine = F.struct("artifact_id", "cell")
    bucket = F.pmod(F.xxhash64("artifact_id", F.col("cell").cast("string")), F.lit(n_buckets)).cast("int")
    shared = F.array(F.struct(F.lit(None).cast(r.select(mine.alias("x")).schema["x"].dataType).alias("of"), bucket.alias("i"), bucket.alias("j"), F.lit(True).alias("first")))
    own = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(mine.alias("of"), F.least("b", o).alias("i"), F.greatest("b", o).alias("j"), (F.col("b") <= o).alias("first")))
    r = r.select("run_id", "artifact_id", "cell", F.when(F.col("nb") == 1, shared).otherwise(own).alias("us"))
    x = F.struct("row_id", "claim", "criterion", "canonical", "exact", "lo", "hi", "title", "resolvable")
    c = claims.groupBy("run_id").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    return r.join(c, "run_id", "left").select("run_id", "artifact_id", "cell", "xs", F.inline("us"))


def _codes(a: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Values as numbers that keep their order (null is -1), and how many there are."""
    d = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).dictionary_encode()
    rank = np.empty(len(d.dictionary), np.int64)
    rank[pc.sort_indices(d.dictionary).to_numpy()] = np.arange(len(rank))
    at = d.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return np.where(at >= 0, np.append(rank, 0)[at], -1), len(rank)


def _together(cols: list[pa.Array | pa.ChunkedArray]) -> np.ndarray:
    """One number for each combination of values, nulls alike."""
    code = np.zeros(len(cols[0]), np.int64)
    for c in cols:
        one, n = _codes(c)
        code = np.unique(code * (n + 1) + one + 1, return_inverse=True)[1]
    return code


def _ends(same: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place after its last equal."""
    last = np.append(np.flatnonzero(same[1:] != same[:-1]) + 1, len(same))
    return np.repeat(last, np.diff(np.append(0, last))) if len(same) else np.zeros(0, np.int64)


def _meetings(key: np.ndarray, run: np.ndarray):
    """Places (x, y) of one key and of a smaller and a larger run, in parts; ``key``, then ``run`` are sorted."""
    start = _ends(np.unique(key * (run.max(initial=0) + 1) + run, return_inverse=True)[1])
    many = _ends(key) - start
    upto = np.cumsum(many)
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + STEP, "right")))
        x = np.repeat(np.arange(at, to), many[at:to])
        yield x, np.arange(len(x)) - np.repeat(upto[at:to] - many[at:to] - (upto[at - 1] if at else 0), many[at:to]) + start[x]
        at = to


def _matched(crit: np.ndarray, run: np.ndarray, cid: np.ndarray, c: dict[str, np.ndarray], pair: Callable, apart: np.ndarray | None, n_runs: int, n_pairs: int) -> np.ndarray:
    """Matches of each pair of runs: claims of one criterion that name one place, taken in the order of their keys.

    A candidate that is the first left for both its claims is taken; those left with neither claim used come again. That
    takes the same ones as going through them one by one.
    """
    ls, rs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    exact, lo, hi, title, lost, canon = (c[k] for k in ("exact", "lo", "hi", "title", "lost", "canonical"))
    for x, y in _meetings(crit, run):
        if apart is not None:
            k = apart[run[x]] != apart[run[y]]
            x, y = x[k], y[k]
        ex, ey, tx, cx = exact[x], exact[y], title[x], canon[x]
        meet = (ex >= lo[y]) & (ex <= hi[y]) | (ey >= lo[x]) & (ey <= hi[x]) | (tx >= 0) & (tx == title[y]) | lost[x] & lost[y] & (cx == canon[y])
        ls.append(x[meet]), rs.append(y[meet])
    x, y = np.concatenate(ls), np.concatenate(rs)
    k1, k2 = np.minimum(canon[x], canon[y]), np.maximum(canon[x], canon[y])
    order = np.argsort(k1 * (canon.max(initial=0) + 1) + k2, kind="stable")
    x, y = x[order], y[order]
    p, a, b = pair(run[x], run[y]), cid[x] * n_runs + run[y], cid[y] * n_runs + run[x]
    a, b = np.unique(a, return_inverse=True)[1], np.unique(b, return_inverse=True)[1]
    first_a, first_b, m = np.empty(len(a), np.int64), np.empty(len(b), np.int64), np.zeros(n_pairs, np.int64)
    while len(p):
        i = np.arange(len(p))
        first_a[a[::-1]] = first_b[b[::-1]] = i[::-1]
        ok = (first_a[a] == i) & (first_b[b] == i)
        m += np.bincount(p[ok], minlength=n_pairs)
        first_a[a[ok]] = first_b[b[ok]] = -1
        left = (first_a[a] >= 0) & (first_b[b] >= 0)
        p, a, b = p[left], a[left], b[left]
    return m


def compared(cell: list[str], totals: bool) -> Callable[[pa.Table], pa.Table]:
    """A unit's pairs with tolerant and exact similarity, or their sums and number for each cell and artifact."""

    def compare(t: pa.Table) -> pa.Table:
        cells = t.column("cell").combine_chunks()
        group = _together([t.column("artifact_id"), *[pc.struct_field(cells, [k]) for k in cell]])
        order = np.lexsort((t.column("run_id").to_numpy(), group))
        t, group = t.take(pa.array(order)), group[order]
        ids, n = t.column("run_id").to_numpy(), len(order)
        first = t.column("first").to_numpy()
        apart = first if t.column("i")[0].as_py() != t.column("j")[0].as_py() else None
        many = _ends(group) - np.arange(n) - 1
        base = np.cumsum(many) - many
        pair = lambda x, y: base[x] + y - x - 1
        a = np.repeat(np.arange(n), many)
        b = np.arange(len(a)) - base[a] + a + 1
        xs = t.column("xs").combine_chunks()
        f = pa.StructArray.from_arrays(xs.flatten().flatten(), names=[v.name for v in xs.type.value_type])
        run = np.repeat(np.arange(n), pc.list_value_length(xs).fill_null(0).to_numpy(zero_copy_only=False))
        size = np.bincount(run, minlength=n)
        crit, n_crit = _codes(f.field("criterion"))
        number = lambda k: f.field(k).cast(pa.int64()).fill_null(-(2**40)).to_numpy(zero_copy_only=False)
        row, no = number("row_id"), number("claim")
        cid = np.cumsum(np.append(True, (run[1:] != run[:-1]) | (row[1:] != row[:-1]) | (no[1:] != no[:-1]))[: len(run)])
        c = {k: number(k) for k in ("exact", "lo")} | {"hi": f.field("hi").cast(pa.int64()).fill_null(-(2**41)).to_numpy(zero_copy_only=False), "title": _codes(f.field("title"))[0], "canonical": _codes(f.field("canonical"))[0], "lost": ~f.field("resolvable").to_numpy(zero_copy_only=False)}
        named = np.flatnonzero(crit >= 0)
        key = group[run[named]] * (n_crit + 1) + crit[named]
        named, key = named[o := np.argsort(key, kind="stable")], key[o]
        m = _matched(key, run[named], cid[named], {k: v[named] for k, v in c.items()}, pair, apart, n, len(a))
        text, n_text = _codes(pc.binary_join_element_wise(f.field("criterion"), f.field("canonical"), "\x01", null_handling="skip"))
        both = np.unique(run * (n_text + 1) + text)
        own, text = both // (n_text + 1), both % (n_text + 1)
        kinds, key = np.bincount(own, minlength=n), group[own] * (n_text + 1) + text
        key, own = key[o := np.argsort(key, kind="stable")], own[o]
        inter = np.zeros(len(a), np.int64)
        for x, y in _meetings(key, own):
            inter += np.bincount(pair(own[x], own[y]), minlength=len(a))
        real = ids[a] < ids[b]
        if apart is not None:
            real &= apart[a] != apart[b]
        a, b, m, inter = a[real], b[real], m[real], inter[real]
        share = lambda part, whole: np.where(whole == 0, 1.0, part / np.maximum(whole, 1))
        tolerant, exact = share(m, size[a] + size[b] - m), share(inter, kinds[a] + kinds[b] - inter)
        if not totals:
            return pa.table({"run_id_a": ids[a], "run_id_b": ids[b], "tolerant": tolerant, "exact": exact})
        k = np.bincount(group[a], minlength=group[-1] + 1)
        some = np.flatnonzero(k)
        one = t.take(pa.array(np.searchsorted(group, some)))
        cells = one.column("cell").combine_chunks()
        return pa.table({x: pc.struct_field(cells, [x]) for x in cell} | {"artifact_id": one.column("artifact_id"), "tolerant": np.bincount(group[a], tolerant)[some], "exact": np.bincount(group[a], exact)[some], "pairs": k[some]})

    return compare
