"""Encoding of whole texts by a byte-level BPE vocabulary.

Pre-tokens are found for whole batches with array operations on code-point classes. Each distinct pre-token is
encoded once per worker: a segment tree over the ranks of adjacent pairs yields the leftmost lowest-rank merge at its
root, and each merge updates two leaves, until no mergeable pair remains.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import arrow_text as at

#: Folder of the public vocabulary files.
TOKENIZER_DIR = "/opt/tokenizers"
_NONE = 1 << 62
_LETTER, _DIGIT, _SPACE, _OTHER = 1, 2, 3, 0
#: Pre-tokens up to this many characters are looked up by a 64-bit hash, longer ones by their text.
_SHORT = 64
_CHUNK = 4_000_000
_MAX_CACHED = 2_000_000


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codes = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    table = np.zeros(0x110000, np.uint8)
    for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _DIGIT), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            table[codes[m.start() : m.end()]] = kind
    return table


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: lowest rank first, the leftmost among equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        r = ranks.get(parts[i] + parts[i + 1])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def pair(i: int) -> int:
        j = nxt[i]
        r = ranks.get(parts[i] + parts[j]) if j < n else None
        return _NONE if r is None else r << 32 | i

    while (low := tree[1]) < _NONE:
        i = low & 0xFFFFFFFF
        j = nxt[i]
        parts[i] += parts[j]
        parts[j] = b""
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        put(j, _NONE)
        put(i, pair(i))
        if prv[i] >= 0:
            put(prv[i], pair(prv[i]))
    return [ranks[p] for p in parts if p]


def _starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions at which a pre-token starts, for the joined code points of texts that start at ``first``."""
    n = len(cp)
    cls = _classes()[cp]
    text_start = np.zeros(n + 1, bool)
    text_start[first] = True
    text_start[n] = True
    run = np.zeros(n, bool)
    run[0] = True
    run[1:] = cls[1:] != cls[:-1]
    run |= text_start[:n]
    begin = run.copy()
    space = cls == _SPACE
    # the last character of a space run before other text: a blank joins what follows, another space stands alone
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & run[1:] & ~text_start[1:n]
    blank = last & (cp == 32)
    begin |= last
    follows = np.flatnonzero(blank) + 1
    begin[follows] = False
    # contractions: a lone apostrophe that starts a pre-token, and the letters it takes
    q = np.flatnonzero((cp == 39) & begin)
    q = q[(q + 1 < n)]
    q = q[(cls[q + 1] == _LETTER) & run[q + 1] & ~text_start[q + 1]]
    if len(q):
        a = cp[q + 1]
        has2 = q + 2 < n
        two = np.where(has2, cp[np.minimum(q + 2, n - 1)], 0)
        inside = has2 & ~run[np.minimum(q + 2, n - 1)]
        one_letter = (a == ord("s")) | (a == ord("t")) | (a == ord("m")) | (a == ord("d"))
        two_letters = inside & (((a == ord("r")) & (two == ord("e"))) | ((a == ord("v")) & (two == ord("e"))) | ((a == ord("l")) & (two == ord("l"))))
        take = np.where(one_letter, 1, np.where(two_letters, 2, 0))
        q, take = q[take > 0], take[take > 0]
        begin[q + 1] = False
        rest = q + 1 + take
        rest = rest[rest < n]
        rest = rest[~run[rest]]
        begin[rest] = True
    return np.flatnonzero(begin)


class Encoder:
    """Encodes batches of texts; keeps the ids of every pre-token it has met, up to a bound."""

    def __init__(self, path: str) -> None:
        self.ranks = load_ranks(path)
        self._reset()

    def _reset(self) -> None:
        self.known: dict = {}
        self.ids: list[np.ndarray] = []

    def _slot(self, key, piece: str) -> int:
        slot = self.known.get(key)
        if slot is None:
            slot = self.known[key] = len(self.ids)
            self.ids.append(np.array(merge(piece.encode(), self.ranks), np.int32))
        return slot

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as list<int32>; null and empty texts give empty lists."""
        n = len(texts)
        if len(self.known) > _MAX_CACHED:
            self._reset()
        joined = [t or "" for t in texts.to_pylist()]
        lengths = np.fromiter(map(len, joined), np.int64, n)
        text = "".join(joined)
        if not text:
            return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int32()))
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(lengths) - lengths
        starts = _starts(cp, first[lengths > 0])
        ends = np.append(starts[1:], len(cp))
        keys = at.slice_hashes(cp, starts, ends)
        long = np.flatnonzero(ends - starts > _SHORT)
        uniq, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        slots = np.empty(len(uniq), np.int64)
        get = self.known.get
        for k, (key, i) in enumerate(zip(uniq.tolist(), index.tolist())):
            s = get(key)
            slots[k] = self._slot(key, text[starts[i] : ends[i]]) if s is None else s
        of = slots[inverse]
        for i in long.tolist():
            piece = text[starts[i] : ends[i]]
            of[i] = self._slot(piece, piece)
        used, back = np.unique(of, return_inverse=True)
        rows = [self.ids[s] for s in used.tolist()]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat, base = np.concatenate(rows), np.cumsum(sizes) - sizes
        per = sizes[back]
        stop = np.cumsum(per)
        values = flat[np.arange(stop[-1]) - np.repeat(stop - per, per) + np.repeat(base[back], per)]
        counts = np.concatenate([[0], stop])[np.searchsorted(starts, np.append(first, len(cp)))]
        return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array(values))


_ENCODERS: dict[str, Encoder] = {}


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = _ENCODERS.setdefault(path, Encoder(path)) if path not in _ENCODERS else _ENCODERS[path]
    for b in batches:
        for part in at.pieces(b, 1, _CHUNK):
            yield pa.RecordBatch.from_arrays([part.column(0), enc.encode(part.column(1))], names=["doc_id", "ids"])


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``doc_id`` and the ids of each whole text, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list; repeated rows are encoded each; other columns of ``df`` are left out.
    ``vocabulary`` is a rank file that every executor can read. Narrow: no shuffle.
    """
    src = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return src.mapInArrow(lambda it: _encode(it, vocabulary), "doc_id bigint, ids array<int>")
