"""Vectorised word and character work on Arrow string batches; nothing here visits a single text in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1 = np.uint64(0x9E3779B97F4A7C15)
_INV1 = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_ALNUM = np.zeros(256, bool)
_ALNUM[ord("0") : ord("9") + 1] = True
_ALNUM[ord("a") : ord("z") + 1] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) <= n:
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        have = _POWERS[int(base)] = np.cumprod(p, dtype=np.uint64)
    return have[: n + 1]


def slice_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each slice units[start:end], from prefix sums; equal slices hash equal."""
    n = len(units)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * _powers(_M1, n)[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _powers(_INV1, n)[starts]
    return mix64(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def lower(texts: pa.Array) -> pa.Array:
    """Lower case with the one full mapping that differs from the simple ones (dotted capital I)."""
    texts = pc.replace_substring(texts, "İ", "i̇")
    return pc.utf8_lower(texts)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal runs of a-z and 0-9 in the lower-cased texts: (bytes, starts, ends, text index, word hash)."""
    data, offsets = raw(lower(texts))
    if not len(data):
        z = np.zeros(0, np.int64)
        return data, z, z, z, np.zeros(0, np.uint64)
    m = _ALNUM[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = m[:-1]
    before &= ~first[:-1]
    after[:-1] = m[1:]
    after &= ~first[1:]
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return data, starts, ends, doc, slice_hashes(data, starts, ends)


def windows(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of ``size`` words that lies in one text, its first word's position)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * _M1 + hashes[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix64(h[at]), at


def spans(groups: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of ``n`` groups in a sorted array of group numbers."""
    return np.searchsorted(groups, np.arange(n + 1))


def pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most about ``limit`` bytes of text in ``column``; one text is never split."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, k in enumerate(sizes):
        if total and total + k > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(k)
    if start < batch.num_rows:
        yield batch.slice(start)
