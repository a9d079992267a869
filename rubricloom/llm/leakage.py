"""Evaluation passages inside a corpus, by greedy string tiling over running Karp-Rabin hashes.

Shared windows of words are the seeds: window hashes of the evaluation items are looked up for every window of every
document. For a document and an item that share a seed, the longest common unmarked runs of words are marked as tiles,
longest first and never overlapping, until no run of the minimum length is left. The longest tile tells a verbatim
passage; the share of the item under tiles also tells a passage whose parts were reordered.

The items go to the executors in blocks of bounded size, each block against all documents, so nothing is shuffled
however many items there are or how hot a passage is.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import arrow_text as at
from rubricloom.session import measured_size

_CHUNK = 8_000_000
#: Characters of the items that are sent to the executors at once (about; one longer item is a block of its own).
BLOCK_CHARS = 32_000_000
#: Words of the seeds and of the shortest tiles, and of the longest tile that makes a leaked passage.
SEED, PASSAGE = 8, 14
_SCHEMA = "doc_id bigint, item_id bigint, longest int, tiled_words int, item_words int, n_tiles int"


def tiles(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length), longest first, at least ``shortest`` words.

    The greatest length of a common unmarked run is found by bisection over running window hashes; the runs of that
    length are then marked from the left. Repeated words cost no products: a window counts once on each side.
    """
    found: list[tuple[int, int, int]] = []
    first = _common(doc, item, np.ones(len(doc), bool), np.ones(len(item), bool), shortest)
    if first is None:
        return found
    # only the words under shared windows can be in a tile; what lies between is one marked word
    doc, at_d, free_d, most_d = _covered(doc, first[1], shortest)
    item, at_i, free_i, most_i = _covered(item, first[3], shortest)
    top = min(most_d, most_i)
    while top >= shortest:
        low, high, size, hit = shortest, top, top, None
        while low <= high:
            pair = _common(doc, item, free_d, free_i, size)
            if pair is None:
                high = size - 1
            else:
                hit, low = (size, *pair), size + 1
            size = (low + high) // 2
        if hit is None:
            break
        top = hit[0] - 1
        found += [(int(at_d[d]), int(at_i[i]), n) for d, i, n in _mark(*hit, free_d, free_i)]
    return found


def _covered(words: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(words, positions, unmarked) of the stretches under windows of ``size`` words, a marked word after each, and the
    longest stretch."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    under = np.cumsum(step) > 0
    # the word after a stretch stays, marked; past the end a word of no meaning stands for it
    keep = under.copy()
    keep[1:] |= under[:-1]
    at_ = np.flatnonzero(keep)
    free = under[at_]
    out = np.append(words, np.uint64(0))[at_]
    gaps = np.flatnonzero(~free)
    return out, at_, free, int(np.diff(np.concatenate([[-1], gaps])).max() - 1)


def _windows(words: np.ndarray, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the windows of ``size`` unmarked words."""
    if len(words) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    marked = np.concatenate([np.zeros(1, np.int64), np.cumsum(~free)])
    start = np.flatnonzero(marked[size:] == marked[:-size])
    return at.slice_hashes(words, start, start + size), start


def _common(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, size: int) -> tuple[np.ndarray, ...] | None:
    """The unmarked windows of ``size`` words that both sides hold; None if there is none."""
    hi, pi = _windows(item, free_i, size)
    hd, pd = _windows(doc, free_d, size)
    kd = np.isin(hd, hi)
    if not kd.any():
        return None
    ki = np.isin(hi, hd)
    return hd[kd], pd[kd], hi[ki], pi[ki]


def _mark(size: int, hd: np.ndarray, pd: np.ndarray, hi: np.ndarray, pi: np.ndarray, free_d: np.ndarray, free_i: np.ndarray) -> list[tuple[int, int, int]]:
    """Marks runs of ``size`` words from the left of the document, each with the leftmost unmarked one of the item."""
    order = np.argsort(hi, kind="stable")
    hi, pi = hi[order], pi[order]
    next_, end = np.searchsorted(hi, hd).tolist(), np.searchsorted(hi, hd, side="right").tolist()
    at_: dict[int, int] = {}
    out, upto = [], -1
    for k, d in enumerate(pd.tolist()):
        if d < upto:
            continue
        i = at_.get(next_[k], next_[k])
        # a window that overlaps a mark stays unusable, so the pointer never goes back
        while i < end[k] and not free_i[pi[i] : pi[i] + size].all():
            i += 1
        if i < end[k]:
            p = int(pi[i])
            free_d[d : d + size] = free_i[p : p + size] = False
            out.append((d, p, size))
            upto, i = d + size, i + 1
        at_[next_[k]] = i
    return out


class Items:
    """The evaluation items as word hashes, with a sorted table of their seeds."""

    def __init__(self, rows: list[tuple[int, str]], seed: int, shortest: int, coverage: float, passage: int = 0) -> None:
        self.seed, self.shortest, self.coverage, self.passage = seed, shortest, coverage, passage
        self.ids = [r[0] for r in rows]
        _, _, _, doc, h = at.words(pa.array([r[1] for r in rows], pa.string()))
        cut = at.spans(doc, len(rows))
        self.words = [h[cut[k] : cut[k + 1]] for k in range(len(rows))]
        seeds, pos = at.windows(h, doc, seed)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], doc[pos][order]
        self.at = (pos - cut[doc[pos]])[order]
        self.sizes = np.diff(cut)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[seeds >> np.uint64(42)] = True

    def match(self, ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        _, _, _, doc, h = at.words(texts)
        seeds, pos = at.windows(h, doc, self.seed)
        maybe = np.flatnonzero(self.sieve[seeds >> np.uint64(42)])
        seeds, owner = seeds[maybe], doc[pos[maybe]]
        # each seed of a document once, so that a repeated window meets the item's own only once
        order = np.lexsort((seeds, owner))
        seeds, owner = seeds[order], owner[order]
        once = np.ones(len(seeds), bool)
        once[1:] = (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])
        seeds, owner = seeds[once], owner[once]
        lo, up = np.searchsorted(self.seeds, seeds), np.searchsorted(self.seeds, seeds, side="right")
        n = up - lo
        hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        shared = np.stack([np.repeat(owner, n), self.owner[hit], self.at[hit]])
        shared = shared[:, np.lexsort(shared[::-1])]
        cut = at.spans(doc, len(texts))
        for d, i in self._enough(shared):
            yield self._row(ids[d].as_py(), i, h[cut[d] : cut[d + 1]])

    def _enough(self, shared: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs of which shared windows cover the asked part of the item, some of them in as long a stretch as the asked
        passage; tiles can cover no more than they do."""
        d, i, p = shared
        if not len(d):
            return
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
        step = np.full(len(d), self.seed)
        step[:-1] = np.where(new[1:], self.seed, np.minimum(self.seed, p[1:] - p[:-1]))
        first = np.flatnonzero(new)
        covered = np.add.reduceat(step, first)
        # windows at positions in a row are one stretch
        apart = new.copy()
        apart[1:] |= p[1:] - p[:-1] > 1
        start = np.flatnonzero(apart)
        stretch = np.diff(np.append(start, len(p))) + self.seed - 1
        longest = np.maximum.reduceat(stretch, np.searchsorted(start, first))
        for k in first[(covered >= self.coverage * self.sizes[i[first]]) & (longest >= self.passage)]:
            yield int(d[k]), int(i[k])

    def _row(self, doc_id: int, i: int, words: np.ndarray) -> tuple:
        t = tiles(words, self.words[i], self.shortest)
        return doc_id, self.ids[i], max((n for _, _, n in t), default=0), sum(n for _, _, n in t), len(self.words[i]), len(t)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    cols = list(zip(*rows)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "item_id", "longest", "tiled_words", "item_words", "n_tiles"])


def leaks(corpus: DataFrame, items: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", seed: int = SEED, shortest: int = SEED, coverage: float = 0.0, passage: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents and items that share ``seed`` consecutive words, with the tiling of the item in the document.

    Words are the runs of a-z and 0-9 in the lower-cased text. ``longest`` is the longest tile, ``tiled_words`` the
    item's words under tiles of at least ``shortest`` words, ``item_words`` its words in all. Rows with a smaller share
    of tiled words than ``coverage`` or a longest tile of fewer words than ``passage`` are left out (untiled, where
    shared seeds show it; needs seed <= shortest). Null and empty texts and texts of fewer words share nothing; copies
    and repeated rows of a document each give their rows; an item listed twice gives its rows twice. Every whole document is read, once for each block of items of
    about ``block_chars`` characters (measured); nothing is shuffled.
    """
    docs = corpus.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    its = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("item_text")).where("item_text IS NOT NULL")
    _, chars = measured_size(its, F.col("item_text"))
    blocks = -(-chars // block_chars) or 1
    out = None
    for k in range(blocks):
        part = its if blocks == 1 else its.where(F.pmod(F.xxhash64("item_id", "item_text"), F.lit(blocks)) == k)
        rows = _by_broadcast(docs, [tuple(r) for r in part.collect()], seed, shortest, coverage, passage)
        out = rows if out is None else out.unionByName(rows)
    return out.where((F.col("tiled_words") >= F.lit(coverage) * F.col("item_words")) & (F.col("longest") >= passage))


#: The items of the last broadcast block, kept by a worker for its next task.
_HELD: dict[str, Items] = {}


def _by_broadcast(docs: DataFrame, rows: list[tuple[int, str]], seed: int, shortest: int, coverage: float, passage: int) -> DataFrame:
    sent, name = docs.sparkSession.sparkContext.broadcast(rows), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if name not in _HELD:
                _HELD.clear()
                _HELD[name] = Items(sent.value, seed, shortest, coverage, passage)
            for part in at.pieces(b, 1, _CHUNK):
                yield _rows(list(_HELD[name].match(part.column(0), part.column(1))))

    return docs.mapInArrow(run, _SCHEMA)
