"""Near-duplicate records among very many, by SetSketch registers.

The words of a record, with their repetitions, are a set of (word, occurrence) elements. A register holds the
truncated exponentially spaced minimum of the elements' exponential hash values (kept as the maximum of the integer
levels), so sketches of parts merge by maximum. Register values in bands of equal ones give the candidates. For each
candidate pair the similarity is estimated jointly from the numbers of larger, smaller and equal further registers,
given both cardinalities: a pair goes on unless the likelihood of the best similarity below the threshold beats the
threshold's own by far. The pairs left are verified on the words themselves.

Banding is probabilistic: a pair just at the threshold (85 % of the words, equal lengths) is met with probability 0.90,
one of 88 % with 0.98, one of 92 % with 0.999. ``exact=True`` replaces the bands by prefixes of rare words, which lose no pair and cost more.

Copies share a multiset fingerprint and are one class from the first step on, so that a hot group of copies costs a
band one entry for each batch that holds some of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import arrow_text as at
from rubricloom.operators.graph import components
from rubricloom.session import checkpoint

#: SetSketch parameters of the bands: base, rate and the largest level; a base this near 1 makes equal registers as likely as J.
BASE, RATE, LEVELS = 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 34, 9
#: Further registers for the joint estimate, with a base that lets a level fit a byte.
JOINT, JOINT_BASE, JOINT_LEVELS = 32, 1.1, 254
#: Half the likelihood ratio beyond which a pair cannot reach the threshold: a pair exactly there is lost once in 1,000.
RATIO = 9.55 / 2
#: Classes of more rows than this share of all are told to every task; there are fewer of them than its inverse.
HEAVY = 1e-3
_CHUNK = 4_000_000
_STEP = 2000
#: A class travels as 40 bits of its fingerprint and a byte that tells its length (exact up to 127 words, then by steps
#: of about 3 %); classes that share all of it are told apart by their sketches and texts.
_ID_BYTES = 6
_HASH_BITS = 40
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Batch:
    """Elements of a batch of texts: hash of each (word, occurrence), and each text's span."""

    def __init__(self, texts: pa.Array) -> None:
        _, _, _, doc, h = at.words(texts)
        n = len(texts)
        order = np.argsort(h ^ at.mix64(doc.astype(np.uint64) + np.uint64(1)))
        d, w = doc[order], h[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        e = np.empty(len(order), np.uint64)
        e[order] = at.mix64(w + nth.astype(np.uint64) * _SALT)
        self.elements, self.doc = e, doc
        self.cut = at.spans(doc, n)
        self.sizes = np.diff(self.cut)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that are equal for equal multisets of words: two sums of scrambled element hashes."""
        sums = []
        for salt in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(at.mix64(self.elements ^ salt), dtype=np.uint64)])
            sums.append(at.mix64(total[self.cut[1:]] - total[self.cut[:-1]] + salt))
        return sums[0], sums[1]

    def registers(self, rows: np.ndarray, first: int, count: int, base: float = BASE, levels: int = LEVELS) -> np.ndarray:
        """Registers ``first`` .. ``first + count`` of the given texts, as levels of at most 16 bits."""
        uniq, inverse = np.unique(self.elements, return_inverse=True)
        table = _levels(uniq, first, count, base, levels)
        rows = rows[np.argsort(-self.sizes[rows], kind="stable")]
        out = np.zeros((len(self.sizes), count), np.uint16)
        buffer = np.empty((_STEP, count), np.uint16)
        for k in range(0, len(rows), _STEP):
            part = rows[k : k + _STEP]
            size, start = self.sizes[part], self.cut[part]
            reg = np.zeros((len(part), count), np.uint16)
            live = len(part)
            for j in range(int(size[0]) if len(part) else 0):
                while live and size[live - 1] <= j:
                    live -= 1
                np.take(table, inverse[start[:live] + j], axis=0, out=buffer[:live])
                np.maximum(reg[:live], buffer[:live], out=reg[:live])
            out[part] = reg
        return out


def _levels(elements: np.ndarray, first: int, count: int, base: float, levels: int) -> np.ndarray:
    """The level each element gives each register."""
    out = np.empty((len(elements), count), np.uint16)
    scale = -1.0 / log(base)
    for i in range(count):
        u = at.mix64(elements + np.uint64((first + i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        h = -np.log(((u >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / RATE
        out[:, i] = np.clip(np.floor(1.0 + scale * np.log(np.maximum(h, 1e-300))), 0, levels + 1)
    return out


def _length_codes(sizes: np.ndarray) -> np.ndarray:
    n = np.maximum(sizes, 1)
    return np.where(n < 128, n, np.minimum(128 + np.floor(np.log(n / 128.0) / log(1.03)), 255)).astype(np.uint64)


def _ids(lo: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return lo & np.uint64((1 << _HASH_BITS) - 1) | _length_codes(sizes) << np.uint64(_HASH_BITS)


def _reach(percent: int) -> np.ndarray:
    """Whether classes of two length codes may share ``percent`` of the longer's words."""
    code = np.arange(256)
    low = np.where(code < 128, code, np.floor(128 * 1.03 ** (code - 128.0)))
    high = np.where(code < 128, code, np.ceil(128 * 1.03 ** (code - 127.0)))
    high[255] = np.inf
    return (high[:, None] * 100 >= percent * low[None, :]) & (high[None, :] * 100 >= percent * low[:, None])


def _text(parts: list[str]) -> Column:
    return F.concat_ws("\n", *[F.col(p).cast("string") for p in parts])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from at.pieces(b, 1, _CHUNK)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches):
        t = Batch(b.column(1))
        lo, hi = t.fingerprints()
        has = np.flatnonzero(t.sizes)
        # copies within a batch are one row from here on
        _, once, back = np.unique(lo[has] ^ at.mix64(hi[has]), return_index=True, return_inverse=True)
        ids = pc.fill_null(b.column(0), np.iinfo(np.int64).max).to_numpy()[has]
        least = np.full(len(once), np.iinfo(np.int64).max)
        np.minimum.at(least, back, ids)
        count, has = np.bincount(back, minlength=len(once)), has[once]
        reg = np.ascontiguousarray(t.registers(has, BANDS * ROWS, JOINT, JOINT_BASE, JOINT_LEVELS)[has].astype(np.uint8))
        joint = pa.Array.from_buffers(pa.binary(JOINT), len(has), [None, pa.py_buffer(reg)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(lo[has].view(np.int64)), pa.array(hi[has].view(np.int64)), pa.array(_ids(lo[has], t.sizes[has]).view(np.int64)), pa.array(least), pa.array(count), pa.array(t.sizes[has].astype(np.int32)), joint], names=["lo", "hi", "id", "row_id", "n", "n_words", "joint"])


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _pieces(batches):
        t = Batch(b.column(1))
        lo, hi = t.fingerprints()
        has = np.flatnonzero(t.sizes)
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(has)), pa.array(lo[has].view(np.int64)), pa.array(hi[has].view(np.int64))], names=["row_id", "lo", "hi"])


def _texts(df: DataFrame, key: str, parts: list[str]) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("row_id"), _text(parts).alias("text"))


def classes_of(texts: DataFrame) -> DataFrame:
    """One row for each multiset of words: 128-bit fingerprint, smallest row, number of rows and of words, and the
    registers for the joint estimate. Texts without words are left out."""
    rows = texts.mapInArrow(_sketch_rows, "lo bigint, hi bigint, id bigint, row_id bigint, n bigint, n_words int, joint binary")
    return rows.groupBy("lo", "hi").agg(F.first("id").alias("id"), F.min("row_id").alias("class_id"), F.sum("n").alias("n_rows"), F.first("n_words").alias("n_words"), F.first("joint").alias("joint"))


def _band_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries (bucket; 32-bit band key; class id) in blobs, one for each bucket of a batch."""
    for b in _pieces(batches):
        t = Batch(b.column(1))
        lo, _ = t.fingerprints()
        _, once = np.unique(lo, return_index=True)
        once = once[t.sizes[once] > 0]
        if not len(once):
            continue
        reg = t.registers(once, 0, BANDS * ROWS)[once].reshape(len(once), BANDS, ROWS)
        key = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[None, :], len(once), axis=0)
        for r in range(ROWS):
            key = at.mix64(key * _SALT + reg[:, :, r].astype(np.uint64) + np.uint64(1))
        key = key.reshape(-1)
        ids = np.repeat(_ids(lo[once], t.sizes[once]), BANDS)
        bucket = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        bucket, short, ids = bucket[order], (key[order] >> np.uint64(32)).astype(np.uint32), ids[order]
        first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(first[1:], len(bucket))
        planes = ids.view(np.uint8).reshape(-1, 8)[:, :_ID_BYTES]
        blobs = [short[s:e].tobytes() + planes[s:e].tobytes() for s, e in zip(first, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(blobs, pa.binary())], names=["bucket", "entries"])


def _pair_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """All pairs of different classes of like lengths with a band key in common, of the buckets of one partition."""
    keys, ids, reach = [], [], _reach(percent)
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
            data = np.frombuffer(blob.as_buffer(), np.uint8)
            n = len(data) // (4 + _ID_BYTES)
            keys.append(data[: 4 * n].view(np.uint32).astype(np.uint64) | np.uint64(bucket) << np.uint64(32))
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :_ID_BYTES] = data[4 * n :].reshape(n, _ID_BYTES)
            ids.append(wide.view(np.uint64).reshape(-1))
    if not keys:
        return
    k, v = np.concatenate(keys), np.concatenate(ids)
    del keys, ids
    order = np.argsort(k, kind="stable")
    k, v = k[order], v[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    # only the entries whose key occurs again
    keep = same[:-1] | same[1:]
    k, v = k[keep], v[keep]
    order = np.lexsort((v, k))
    k, v = k[order], v[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    k, v = k[fresh], v[fresh]
    gap = 1
    live = np.arange(len(k))
    while True:
        live = live[live + gap < len(k)]
        live = live[k[live] == k[live + gap]]
        if not len(live):
            return
        for s in range(0, len(live), 1_000_000):
            part = live[s : s + 1_000_000]
            part = part[reach[v[part] >> np.uint64(_HASH_BITS), v[part + gap] >> np.uint64(_HASH_BITS)]]
            yield pa.RecordBatch.from_arrays([pa.array(v[part].view(np.int64)), pa.array(v[part + gap].view(np.int64))], names=["a", "b"])
        gap += 1


def _chance(x: np.ndarray, base: float) -> np.ndarray:
    """Chance that a register is larger on the side of which the share ``x`` of both cardinalities is not shared."""
    return -np.log1p(-np.maximum(x, 0.0) * (base - 1.0) / base) / log(base)


def likelihood(j: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, base: float = JOINT_BASE) -> np.ndarray:
    """Log-likelihood of similarity ``j`` of sets of n_a and n_b elements with ``more`` registers larger in the first,
    ``less`` larger in the second and ``equal`` equal ones."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = _chance(u - v * j, base), _chance(v - u * j, base)
    return sum(k * np.log(np.maximum(x, 1e-12)) for k, x in ((more, p), (less, q), (equal, 1.0 - p - q)))


def threshold(n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """The similarity of two sets that share the asked part of the longer one; above 1 where they cannot."""
    need = -(-percent * np.maximum(n_a, n_b) // 100)
    return np.where(need > np.minimum(n_a, n_b), 2.0, need / np.maximum(n_a + n_b - need, 1))


def estimate(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray, steps: int = 200) -> np.ndarray:
    """The most likely similarity of each pair, on an even grid."""
    top = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.array([likelihood(top * k / steps, n_a, n_b, more, less, equal) for k in range(steps + 1)])
    return top * grid.argmax(axis=0) / steps


def compare(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (x > y).sum(axis=1), (x < y).sum(axis=1), (x == y).sum(axis=1)


def _likely_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(v.as_buffer() for v in b.column(i)), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
        n_a, n_b = (b.column(i).to_numpy().astype(np.int64) for i in (4, 5))
        least, counts = threshold(n_a, n_b, percent), compare(x, y)
        there = likelihood(np.minimum(least, 1.0), n_a, n_b, *counts)
        best = np.max([likelihood(np.minimum(least, 1.0) * k / 20, n_a, n_b, *counts) for k in range(20)], axis=0)
        yield pa.RecordBatch.from_struct_array(pa.StructArray.from_arrays([b.column(0), b.column(1)], names=["ra", "rb"])).filter(pa.array((least <= 1.0) & (best - there <= RATIO)))


def overlap(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words in common, words of the longer) for each pair of texts, order ignored and repetitions counted."""
    s, t = Batch(a), Batch(b)
    ka = at.mix64(s.elements + at.mix64(s.doc.astype(np.uint64) + np.uint64(7)))
    kb = at.mix64(t.elements + at.mix64(t.doc.astype(np.uint64) + np.uint64(7)))
    both = np.bincount(s.doc[np.isin(ka, kb)], minlength=len(a)) if len(ka) else np.zeros(len(a), np.int64)
    return both, np.maximum(s.sizes, t.sizes)


def _verify_rows(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        both, longer = overlap(b.column(2), b.column(3))
        ok = both * 100 >= percent * longer
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(both / np.maximum(longer, 1))], names=["ra", "rb", "share"]).filter(pa.array(ok))


def _rare(texts: DataFrame, percent: int) -> DataFrame:
    """Candidates without loss: of each class's elements in order of rarity, only the first that a partner must share.

    Two texts that share the asked part of the longer one share an element among each one's n - ceil(part * n) + 1 rarest.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            t = Batch(b.column(1))
            lo, _ = t.fingerprints()
            _, once = np.unique(lo, return_index=True)
            rows = np.isin(t.doc, once)
            yield pa.RecordBatch.from_arrays([pa.array(_ids(lo, t.sizes)[t.doc[rows]].view(np.int64)), pa.array(t.sizes[t.doc[rows]].astype(np.int32)), pa.array(t.elements[rows].view(np.int64))], names=["id", "n", "e"])

    each = texts.mapInArrow(elements, "id bigint, n int, e bigint").distinct()
    often = each.groupBy("e").agg(F.count(F.lit(1)).alias("k"))
    first = F.array_sort(F.collect_list(F.struct("k", "e")))
    keep = each.join(often, "e").groupBy("id", "n").agg(first.alias("x")).select("id", "n", F.explode(F.slice("x", 1, F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)).alias("x")).select("id", "n", "x.e")
    a, b = keep.select(F.col("id").alias("a"), F.col("n").alias("na"), "e"), keep.select(F.col("id").alias("b"), F.col("n").alias("nb"), "e")
    met = a.join(b, "e").where(f"a < b AND 100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")
    return met.distinct()


class NearDuplicates:
    """Classes of copies and verified links between them, for one table.

    ``links`` has (a, b, share: verified pairs of classes, a < b) and ``members()`` has (row_id, class_id: the smallest
    row of the same multiset of words). Rows whose texts hold no word belong to no class. Null parts count as empty;
    repeated rows are copies; other columns are left out; an empty table gives empty results. With ``exact`` no pair is
    lost (candidates by prefixes of rare words); else a pair is met with the probability the bands give.
    """

    def __init__(self, df: DataFrame, key: str, parts: list[str], percent: int = 85, exact: bool = False) -> None:
        spark = df.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._texts = texts = _texts(df, key, parts)
        self._classes = classes = checkpoint(classes_of(texts))
        if exact:
            pairs = _rare(texts, percent)
        else:
            bands = texts.mapInArrow(lambda it: _band_rows(it, n), "bucket int, entries binary").repartitionById(n, F.col("bucket"))
            pairs = bands.mapInArrow(lambda it: _pair_rows(it, percent), "a bigint, b bigint").distinct()
        side = lambda s: classes.select(F.col("id").alias(s), F.col("class_id").alias(f"r{s}"), F.col("n_words").alias(f"n{s}"), F.col("joint").alias(f"j{s}"))
        near = pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("ra"), F.col("rb"), "ja", "jb", "na", "nb").where("ra <> rb")
        likely = near.mapInArrow(lambda it: _likely_rows(it, percent), "ra bigint, rb bigint")
        long = likely.select("ra", "rb", F.explode(F.array("ra", "rb")).alias("row_id"))
        met = long.join(texts, "row_id").groupBy("ra", "rb").agg(F.max(F.when(F.col("row_id") == F.col("ra"), F.col("text"))).alias("ta"), F.max(F.when(F.col("row_id") == F.col("rb"), F.col("text"))).alias("tb"))
        found = met.mapInArrow(lambda it: _verify_rows(it, percent), "ra bigint, rb bigint, share double")
        self.links = checkpoint(found.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "share"))

    def members(self, of: DataFrame | None = None) -> DataFrame:
        """row_id with class_id, n_rows and any other columns of ``of`` (some of the classes; all if None).

        Classes of more than ``HEAVY`` of all rows, fewer than 1 / HEAVY, are told to every task, and their rows take
        keys of their own in the join for the others, so no key of it is hot.
        """
        of = self._classes.select("lo", "hi", "class_id", "n_rows") if of is None else of
        edge = (self._classes.agg(F.sum("n_rows")).first()[0] or 0) * HEAVY
        cols = [c for c in of.columns if c not in ("lo", "hi")]
        heavy = of.where(F.col("n_rows") > edge).select("lo", "hi", F.struct(*cols).alias("h"))
        light = of.where(F.col("n_rows") <= edge).select(F.col("lo").alias("l"), F.col("hi").alias("r"), F.struct(*cols).alias("c"))
        rows = self._texts.mapInArrow(_print_rows, "row_id bigint, lo bigint, hi bigint").join(F.broadcast(heavy), ["lo", "hi"], "left")
        key_ = lambda c, k: F.when(F.col("h").isNull(), F.col(c)).otherwise(F.xxhash64("row_id", F.lit(k)))
        rows = rows.select("row_id", "h", key_("lo", 1).alias("l"), key_("hi", 2).alias("r"))
        both = rows.join(light, ["l", "r"], "left").select("row_id", F.coalesce("h", "c").alias("m")).where("m IS NOT NULL")
        return both.select("row_id", "m.*")

    def pairs(self) -> DataFrame:
        """Every pair of rows, copies and links expanded; as many as the data's groups hold."""
        linked = self.links.select(F.explode(F.array("a", "b")).alias("class_id")).distinct().withColumn("linked", F.lit(True))
        of = self._classes.select("lo", "hi", "class_id", "n_rows").join(linked, "class_id", "left").where("n_rows > 1 OR linked")
        m = checkpoint(self.members(of))
        # the rows of a class are split over tasks that each meet all of its rows
        parts = F.least(F.lit(64), F.greatest(F.lit(1), F.ceil(F.col("n_rows") / 500))).cast("int")
        x = m.select(F.col("row_id").alias("x"), F.col("class_id").alias("a"), F.pmod(F.xxhash64("row_id"), parts).cast("int").alias("part"))
        y = m.select(F.col("row_id").alias("y"), F.col("class_id").alias("b"))
        copies = x.join(m.where("n_rows > 1").select(F.col("row_id").alias("y"), F.col("class_id").alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")), ["a", "part"]).where("x < y").select("x", "y")
        cross = self.links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        return copies.union(cross)

    def classes(self) -> DataFrame:
        """One row for each row: class, number of links of its class to other classes, and group of linked classes."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
        group = components(self.links).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
        of = self._classes.select("lo", "hi", "class_id", "n_rows").join(ends.join(group, "class_id"), "class_id", "left")
        return self.members(of).select("row_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
