"""Runs' claims matched with classes of equal defects, in native arrays, a batch of runs at a time.

The classes of each place lie sorted in the matching order, in an index that every task holds. A claim looks up its
places, and of a place only as many classes as its run could fill: once these hold as many defects as the run has claims,
the claim has one of them or an earlier one, so no later class can matter. Candidates therefore exist only within a batch;
they are never shuffled, sorted or spilled by Spark, and a run with few claims has few, however many defects there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rubricloom.operators.pairs import _codes, _together

#: Claims that are looked up, and candidates that are matched, at once; a single run may have more.
CLAIMS, STEP = 100_000, 1_000_000


def _firsts(same: np.ndarray) -> np.ndarray:
    """For each place of a sorted array the place of its first equal."""
    first = np.flatnonzero(np.append(True, same[1:] != same[:-1])[: len(same)])
    return np.repeat(first, np.diff(np.append(first, len(same))))


def _find(values: pa.Array, known: pa.Array) -> np.ndarray:
    """Places in ``known``, -1 where a value is null or unknown."""
    return pc.index_in(values, value_set=known, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(values: pa.Array, none: int) -> np.ndarray:
    return values.cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False)


class Index:
    """Classes by artifact, criterion ``t`` and place (paragraph ``pn``, or title ``pt``), each place's in the matching order."""

    def __init__(self, t: pa.Table) -> None:
        t = t.combine_chunks()
        c = {n: t.column(n).combine_chunks() if t.num_rows else pa.array([], t.schema.field(n).type) for n in t.column_names}
        self.artifacts, self.ts, self.titles = pc.unique(c["artifact_id"]), pc.unique(c["t"]), pc.unique(c["pt"].drop_null())
        n = _numbers(c["pn"], 0)[is_n := c["pn"].is_valid().to_numpy(zero_copy_only=False)]
        self.low, self.high = (int(n.min()), int(n.max())) if len(n) else (0, -1)
        self.width = len(self.titles) + self.high - self.low + 1
        at = _find(c["pt"], self.titles)
        at[is_n] = len(self.titles) + n - self.low
        key = (_find(c["artifact_id"], self.artifacts) * len(self.ts) + _find(c["t"], self.ts)) * self.width + at
        self.names = pc.unique(c["c"])
        name, rank, g, many = _find(c["c"], self.names), _codes(c["c"])[0], _numbers(c["g"], 0), _numbers(c["n"], 0)
        order = np.lexsort((rank, g, key))
        # a class that a place holds twice, under another anchor, changes nothing the second time
        order = order[np.sort(np.unique(_together([pa.array(key[order]), pa.array(name[order])]), return_index=True)[1])] if len(order) else order
        key, self.name, self.rank, self.g, self.n = key[order], name[order], rank[order], g[order], many[order]
        before = np.cumsum(self.n) - self.n
        before -= before[_firsts(key)]
        self.keys, self.start = np.unique(key, return_index=True)
        self.most = int(before.max(initial=0)) + 1
        self.reach = np.searchsorted(self.keys, key) * self.most + before

    def ranges(self, x: pa.StructArray, rivals: np.ndarray, by_criterion: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Claims (by number) with the first class and the number of classes to try at each of their places."""
        a = _find(x.field("artifact_id"), self.artifacts)
        t = _find(x.field("criterion"), self.ts) if by_criterion else np.zeros(len(x), np.int64)
        base = (a * len(self.ts) + t) * self.width
        known = (a >= 0) & (t >= 0)
        lo, hi = _numbers(x.field("lo"), 1), _numbers(x.field("hi"), 0)
        lo = np.maximum(lo, self.low)
        many = np.where(known, np.maximum(np.minimum(hi, self.high) - lo + 1, 0), 0)
        who = np.repeat(np.arange(len(x)), many)
        n = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + lo[who]
        title = _find(x.field("title"), self.titles)
        named = np.flatnonzero(known & (title >= 0))
        key = np.concatenate([base[who] + len(self.titles) + n - self.low, base[named] + title[named]])
        who = np.concatenate([who, named])
        q = np.searchsorted(self.keys, key)
        hit = q < len(self.keys)
        hit[hit] = self.keys[q[hit]] == key[hit]
        who, q = who[hit], q[hit]
        upto = np.searchsorted(self.reach, q * self.most + np.minimum(rivals[who], self.most))
        return who, self.start[q], upto - self.start[q]


def _taken(run: np.ndarray, who: np.ndarray, claim: np.ndarray, name: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidates taken, and each one's number within its run's class. Candidates are in their order.

    A candidate that is the first left for its claim, with fewer before it in its class than the class has free, is taken;
    those left with a free claim and class come again. That takes the same ones as going through them one by one.
    """
    cls = _together([pa.array(run), pa.array(name)])
    claim = np.unique(claim, return_inverse=True)[1]
    free = np.zeros(cls.max(initial=-1) + 1, np.int64)
    free[cls] = n
    open_, left, got = np.ones(claim.max(initial=-1) + 1, bool), np.arange(len(run)), []
    first = np.empty(len(open_), np.int64)
    while len(left):
        i, a, b = np.arange(len(left)), claim[left], cls[left]
        first[a[::-1]] = i[::-1]
        by = np.argsort(b, kind="stable")
        before = np.empty(len(left), np.int64)
        before[by] = i - _firsts(b[by])
        ok = (first[a] == i) & (before < free[b])
        got.append(left[ok])
        open_[a[ok]] = False
        free -= np.bincount(b[ok], minlength=len(free))
        left = left[open_[a] & (free[b] > 0)]
    at = np.sort(np.concatenate([np.zeros(0, np.int64), *got]))
    by = np.argsort(cls[at], kind="stable")
    k = np.empty(len(at), np.int64)
    k[by] = np.arange(len(at)) - _firsts(cls[at][by])
    return at, k


def _parts(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes together stay within ``most``; one alone may be larger."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def matched(xs: pa.ListArray, index: Index, by_criterion: bool) -> Iterator[tuple[np.ndarray, pa.StructArray, np.ndarray, np.ndarray]]:
    """The matches of runs whose sorted claims are ``xs``, in parts: run (by number), claim, class name (its number in
    ``index.names``) and the number within the class."""
    size = pc.list_value_length(xs).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for at, to in _parts(size, CLAIMS):
        part = xs.slice(at, to - at)
        flat = part.flatten()
        x = pa.StructArray.from_arrays(flat.flatten(), names=[f.name for f in flat.type])
        run = np.repeat(np.arange(at, to), size[at:to])
        if not len(run):
            continue
        who, start, many = index.ranges(x, size[run], by_criterion)
        order = np.argsort(who, kind="stable")
        who, start, many = who[order], start[order], many[order]
        identity = _together([pa.array(run), x.field("row_id"), x.field("claim")])
        bound = np.searchsorted(who, np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run)))
        for i, j in _parts(np.diff(np.append(0, np.cumsum(many))[bound]), STEP):
            w, s, m = (v[bound[i] : bound[j]] for v in (who, start, many))
            c = np.repeat(np.arange(len(w)), m)
            cls = np.arange(len(c)) - np.repeat(np.cumsum(m) - m, m) + s[c]
            c = w[c]
            order = np.lexsort((index.rank[cls], c, index.g[cls], run[c]))
            c, cls = c[order], cls[order]
            new = np.append(True, (c[1:] != c[:-1]) | (index.name[cls[1:]] != index.name[cls[:-1]]))[: len(c)]
            c, cls = c[new], cls[new]
            taken, k = _taken(run[c], c, identity[c], index.name[cls], index.n[cls])
            yield run[c[taken]], x.take(pa.array(c[taken])), index.name[cls[taken]], k


def counted(sent, kinds: dict[bool, str], keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The columns ``keep`` of each run and its number of matches, one column for each of ``kinds``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {}
            for same, name in kinds.items():
                n = np.zeros(b.num_rows, np.int64)
                for r, *_ in matched(b.column("xs"), sent.value[same], same):
                    n += np.bincount(r, minlength=b.num_rows)
                out[name] = pa.array(n, pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *out.values()], names=[*keep, *out])

    return run


def listed(sent, by_criterion: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row (run_id, row_id, claim, c, k) for each match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value[by_criterion]
        for b in batches:
            for r, x, name, k in matched(b.column("xs"), index, by_criterion):
                yield pa.RecordBatch.from_arrays([b.column("run_id").take(pa.array(r)), x.field("row_id"), x.field("claim"), index.names.take(pa.array(name)), pa.array(k, pa.int32())], names=["run_id", "row_id", "claim", "c", "k"])

    return run
