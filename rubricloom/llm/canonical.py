"""Freely typed headings to the entries of a reference list.

Words and headings of the list stand in symmetric-delete indexes: each under all strings that deleting up to three of
its first characters leaves. The deletes of a typed word, or of the beginning of an abbreviated one, meet the words
within that many edits there; a typed heading whose separators were hit meets the headings written as one word. Each
candidate is verified by weighted Damerau-Levenshtein distance (one edit for short words; three only where two find
nothing in the list), then ranked by distance and by how often its words occur in the whole list. A typed word that
is itself a word of the list, of whatever artifact, stands for no other, so a different heading that shares a word is
not taken for a misspelling. Values that name no entry come out as -1.

A list within the documented bound (rows and characters are counted first) is sent to the executors; a larger one is
joined by artifact, and what the whole list says of each typed word is joined to the values, so both ways decide alike.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricloom.session import measured_size

MAX_EDITS = 3
#: Characters of a string that the index covers; edits that spare them are left to the distance itself, so none is lost.
PREFIX = 7
#: Reference lists of at most this many entries and characters are sent to the executors.
BROADCAST_ENTRIES, BROADCAST_CHARS = 200_000, 20_000_000
#: Copies of a joined list's entries, so that the values of a hot artifact are spread over as many tasks.
SALTS = 8
_MAX_CACHED = 400_000

_NUM = r"(?:\d+|first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|last)"
_UNIT = r"(?:paragraphs?|para\.?|pars?\.?|pp?\.|¶|lines?|sentences?)"
_POS = rf"(?:{_UNIT}\s*{_NUM}|{_NUM}(?:st|nd|rd|th)?\s+{_UNIT})"
_TAIL = re.compile(rf"[\s,;:–—-]*\(?\s*\b{_POS}\s*\)?\s*$|[\s,;:–—-]*\(?\s*¶\s*\d+\s*\)?\s*$")
_HEAD = re.compile(rf"^\s*{_POS}\s+(?:under|of|in)\s+")
_INSIDE = re.compile(r"^(.*\S)\s*\(\s*in\s+(.*?)\s*\)$")
#: How people announce a heading, with the heading itself as the group.
_WRAPS = [re.compile(p) for p in (r"^in the (.*) section$", r"^section\s*:\s*(.*)$", r"^the (.*) (?:bit|heading|section)$", r"^our (.*) text$", r"^(.*)\(top\)$", r'^"(.*)"(?: section)?$', r"^'(.*)'(?: section)?$", r"^«(.*)»$", r"^“(.*)”(?: section)?$", r"^\[(.*)\]$", r"^\((.*)\)$")]
_NTH = re.compile(r"^(?:section|sect?\.?|§)\s*(?:no\.?|number|#)?\s*(\d+)$")
_PATH = re.compile(r"\s+(?:>|/|»|→|›)\s+|\s*>\s*")
_WORD = re.compile(r"([a-z0-9]+)([.…]*)")
#: Words too common to tell one heading from another.
_SMALL = {"how", "to", "for", "the", "of", "and", "in", "a"}
_VOWELS = set("aeiouy")


def plain(s: str) -> str:
    """Lower case without accents, with ordinary blanks."""
    if not s.isascii():
        s = "".join(c for c in unicodedata.normalize("NFKD", s.replace("…", "\0")) if not unicodedata.combining(c)).replace("\0", "…")
    return re.sub(r"\s+", " ", s.casefold().replace("...", "…")).strip()


def tokens(s: str | None) -> tuple[str, ...]:
    return tuple(w for w, _ in _WORD.findall(plain(s or "")))


def distance(a: str, b: str, most: float) -> float | None:
    """Weighted Damerau-Levenshtein distance (adjacent transpositions and doubled letters 0.8, vowel for vowel 0.9), or None beyond ``most``."""
    if abs(len(a) - len(b)) * 0.8 > most:
        return None
    before: list[float] = []
    last = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            if x == y:
                c = last[j - 1]
            else:
                c = last[j - 1] + (0.9 if x in _VOWELS and y in _VOWELS else 1.0)
            c = min(c, last[j] + (0.8 if i > 1 and a[i - 2] == x else 1.0), now[-1] + (0.8 if j > 1 and b[j - 2] == y else 1.0))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, before[j - 2] + 0.8)
            now.append(c)
        if min(now) > most:
            return None
        before, last = last, now
    return last[-1] if last[-1] <= most else None


def deletes(word: str, most: int = MAX_EDITS) -> set[str]:
    """``word`` with up to ``most`` characters left out."""
    out = {word}
    for k in range(1, min(most, len(word) - 1) + 1):
        for gone in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in gone))
    return out


class Deletes:
    """Symmetric-delete index of a set of strings, whole and by their beginnings.

    Two strings within k edits leave a common string when up to k characters of each one's first ``PREFIX`` are deleted.
    The left strings are held as sorted hashes; what they find is verified by the distance itself.
    """

    def __init__(self) -> None:
        self.strings: list[str] = []
        self.have: set[str] = set()
        self.table: tuple[np.ndarray, np.ndarray] | None = None
        self.sorted: list[str] = []
        self.seen: dict[tuple, dict[str, float]] = {}
        self.longest = 0

    def add(self, s: str) -> None:
        if s not in self.have:
            self.have.add(s)
            self.strings.append(s)
            self.longest = max(self.longest, len(s))
            self.table = None

    def _build(self) -> tuple[np.ndarray, np.ndarray]:
        keys, ids = [], []
        for k, s in enumerate(self.strings):
            own = [hash(d) for d in deletes(s[:PREFIX])]
            own += [hash((n, d)) for n in range(3, min(len(s), PREFIX) + 1) for d in deletes(s[:n], 2)]
            keys += own
            ids += [k] * len(own)
        h, at = np.array(keys, np.int64), np.array(ids, np.int32)
        order = np.argsort(h, kind="stable")
        self.sorted = sorted(self.strings)
        self.seen.clear()
        return h[order], at[order]

    def _met(self, keys: list) -> set[str]:
        h, at = self.table
        want = np.array([hash(k) for k in keys], np.int64)
        lo, up = np.searchsorted(h, want), np.searchsorted(h, want, side="right")
        return {self.strings[k] for a, b in zip(lo.tolist(), up.tolist()) if b > a for k in at[a:b].tolist()}

    def _cached(self, key: tuple, make: Callable[[], dict[str, float]]) -> dict[str, float]:
        if self.table is None:
            self.table = self._build()
        hit = self.seen.get(key)
        if hit is None:
            if len(self.seen) > _MAX_CACHED:
                self.seen.clear()
            hit = self.seen[key] = make()
        return hit

    def near(self, s: str, most: int = MAX_EDITS) -> dict[str, float]:
        """The strings within ``most`` weighted edits of ``s``, with their distances."""
        if len(s) > self.longest + MAX_EDITS + 1:
            return {}
        return self._cached((s, most), lambda: {w: c for w in self._met(list(deletes(s[:PREFIX], most))) if (c := distance(s, w, float(most))) is not None})

    def begun(self, s: str, most: float) -> dict[str, float]:
        """The strings of which a beginning about as long as ``s`` is within ``most`` edits of it (0.0 if it is ``s``)."""
        if len(s) > self.longest + MAX_EDITS + 1:
            return {}

        def make() -> dict[str, float]:
            out: dict[str, float] = {}
            for w in self.sorted[bisect_left(self.sorted, s) :]:
                if not w.startswith(s):
                    break
                out[w] = 0.0
            if most > 0:
                gone = deletes(s[:PREFIX], 2)
                found = self._met([*gone, *((n, d) for n in {min(len(s) + k, PREFIX) for k in (-1, 0, 1)} for d in gone)])
                for w in found - out.keys():
                    cs = [c for k in (-1, 0, 1) if (c := distance(s, w[: len(s) + k], most)) is not None]
                    if cs:
                        out[w] = min(cs)
            return out

        return self._cached((s, most, "begun"), make)


def assign(table: list[list[float | None]]) -> float | None:
    """The least cost of giving each row a column of its own (as many columns as rows; None forbids), by shortest
    augmenting paths."""
    n, far = len(table), 1e9
    u, v, to = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        to[0], j0 = i, 0
        least, way, used = [far * n] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = to[j0], far * n, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = table[i0 - 1][j - 1]
                    cur = (far if c is None else c) - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[to[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if to[j0] == 0:
                break
        while j0:
            to[j0], j0 = to[way[j0]], way[j0]
    cs = [table[to[j] - 1][j - 1] for j in range(1, n + 1)]
    return None if None in cs else sum(cs)


class Owner:
    """The entries of one artifact. ``words`` and ``heads`` index at least its own words and headings; ``count`` tells how
    many entries of the whole list hold a typed word and ``close`` whether any word of the list is within two edits of
    one that none holds; ``rarest`` is how often each row's rarest word occurs in the list."""

    def __init__(self, rows: list[tuple], words: Deletes, heads: Deletes, rarest: list[int] | None = None) -> None:
        at = sorted(range(len(rows)), key=lambda k: (rows[k][3], rows[k][0]))
        self.rows = [rows[k] for k in at]  # (section_id, heading, level, position, anchor, path)
        self.ids = [r[0] for r in self.rows]
        self.rarest = [rarest[k] for k in at] if rarest is not None else None
        self.tokens = [tokens(r[1]) for r in self.rows]
        self.parents = [["".join(tokens(p)) for p in (r[5] or [])[1:-1] if p] for r in self.rows]
        self.squash: dict[str, list[int]] = defaultdict(list)
        self.by_word: dict[str, list[int]] = defaultdict(list)
        for i, (r, t) in enumerate(zip(self.rows, self.tokens)):
            self.squash["".join(t)].append(i)
            alias = "".join(tokens(r[4]))
            if alias and i not in self.squash[alias]:
                self.squash[alias].append(i)
            for w in set(t):
                words.add(w)
                self.by_word[w].append(i)
        for h in self.squash:
            heads.add(h)
        self.second = [i for i, r in enumerate(self.rows) if r[2] == 2]
        self.cache: dict[str, list[tuple[float, int]]] = {}
        self.words, self.heads = words, heads
        self.count: Callable[[str], int] = lambda w: 0
        self.close: Callable[[str], bool] = lambda w: False

    # -- one heading -------------------------------------------------------------------------------------------

    def heading(self, text: str) -> list[tuple[float, int]]:
        """(cost, entry) of the best entries for one typed heading; several where they cost the same."""
        hit = self.cache.get(text)
        if hit is None:
            hit = self._heading(text)
            if len(self.cache) > 20_000:
                self.cache.clear()
            self.cache[text] = hit
        return hit

    def _heading(self, text: str) -> list[tuple[float, int]]:
        if m := _NTH.match(text):
            n = int(m.group(1))
            return [(0.0, self.second[n - 1])] if 1 <= n <= len(self.second) else []
        typed = _WORD.findall(text)
        if not typed:
            return []
        squash = "".join(w for w, _ in typed)
        if i := self.squash.get(squash):
            return [(0.0, k) for k in i]
        known = all(self.count(w) for w, _ in typed)
        costs = self._by_words(typed)
        if not costs and not known:
            costs = self._by_squash(squash, text)
        if not costs:
            costs = self._by_part(typed)
        if not costs:
            return []
        low = min(costs.values())
        return [(low, i) for i, c in costs.items() if c == low]

    def _stands_for(self, word: str, cut: bool) -> dict[str, float]:
        """Words of the artifact that a typed word may stand for, with their costs."""
        out: dict[str, float] = {}
        if self.count(word):
            if word in self.by_word:
                out[word] = 0.0
        else:
            most = 1 if len(word) <= 4 else 2 if len(word) <= 6 or self.close(word) else MAX_EDITS
            out = {w: c for w, c in self.words.near(word, most).items() if w in self.by_word}
        if cut and len(word) >= 2:
            for w, c in self.words.begun(word, 0.0 if len(word) < 4 else 2.0 if len(word) > 5 else 1.0).items():
                if w in self.by_word and w != word:
                    out[w] = 0.3 + c
        return out

    def _by_words(self, typed: list[tuple[str, str]]) -> dict[int, float]:
        """Entries with the same words: in any order, misspelt, or cut short where a full stop or an ellipsis tells so."""
        n, out = len(typed), {}
        if n > max(map(len, self.tokens), default=0):
            return out
        ends = bool(typed[-1][1])
        cost = [self._stands_for(w, bool(mark)) for w, mark in typed]
        for i in sorted({i for w in cost[0] for i in self.by_word[w]}):
            target = self.tokens[i]
            m = len(target)
            if m != n and not (ends and n < m):
                continue
            straight = [c.get(t) for c, t in zip(cost, target)]
            if m == n:
                best = None if None in straight else sum(straight)
                other = None
                if best is None or best > 0.5:
                    table = [[c.get(t) for t in target] for c in cost]
                    if all(any(c is not None for c in row) for row in table):
                        other = assign(table)
                cs = [c for c in (best, None if other is None else other + 0.5) if c is not None]
                if cs:
                    out[i] = min(cs)
            elif None not in straight:
                out[i] = 0.3 + sum(straight)
        return out

    def _by_squash(self, squash: str, text: str) -> dict[int, float]:
        """Entries whose letters as a whole are within the bounded distance, as where a separator was hit."""
        out: dict[int, float] = {}
        most = 1 if len(squash) <= 6 else 2 if len(squash) <= 10 else MAX_EDITS
        if text.rstrip().endswith("…") and len(squash) >= 4:
            for s, c in self.heads.begun(squash, 1.0).items():
                out.update(dict.fromkeys(self.squash.get(s, ()), c))
        for s, c in self.heads.near(squash, most).items():
            out.update(dict.fromkeys(self.squash.get(s, ()), c))
        return out

    def _by_part(self, typed: list[tuple[str, str]]) -> dict[int, float]:
        """The one entry that holds the few words typed, if no other of the artifact does."""
        left = [(w, m) for w, m in typed if w not in _SMALL]
        if not left:
            return {}
        sets, total = [], 0.0
        for w, mark in left:
            best: dict[int, float] = {}
            for target, c in self._stands_for(w, bool(mark)).items():
                if target not in _SMALL:
                    for i in self.by_word[target]:
                        best[i] = min(best.get(i, 9.0), c)
            if not best:
                return {}
            low = min(best.values())
            total += low
            sets.append({i for i, c in best.items() if c == low})
        both = set.intersection(*sets)
        return {i: 1.0 + total for i in both} if len(both) == 1 else {}

    # -- a whole value -----------------------------------------------------------------------------------------

    def path(self, parts: list[str]) -> list[tuple[float, int]]:
        """The entries a path names: those of its last part, told apart by the parts before it."""
        parts = [p for p in parts if p]
        if not parts:
            return []
        last = self.heading(parts[-1])
        if len(last) > 1 and len(parts) > 1:
            above = ["".join(w for w, _ in _WORD.findall(p)) for p in parts[:-1]]
            rank = {}
            for c, i in last:
                d = [x for p in self.parents[i] for a in above if a and (x := distance(a, p, 3.0)) is not None]
                rank[i] = min(d, default=9.0)
            low = min(rank.values())
            if low == 9.0:
                parent = {j for a in parts[:-1] for _, j in self.heading(a)}
                names = {"".join(self.tokens[j]) for j in parent}
                near = [x for x in last if set(self.parents[x[1]]) & names]
                return near or last
            last = [(c, i) for c, i in last if rank[i] == low]
        return last

    def value(self, text: str) -> list[tuple[float, int]]:
        s = plain(text)
        parts = parse(s)
        hit = self.path(parts)
        if not hit and len(parts) == 1 and "," in parts[0]:
            hit = self.path([unwrap(p) for p in parts[0].split(",")])
        return hit

    def resolve(self, text: str | None, path: list[str] | None) -> tuple[int, float]:
        """(section id, cost) named by a text and a heading path together; (-1, -1) if they name none."""
        a = self.value(text) if text else []
        b = self.path([unwrap(plain(p)) for p in path if p]) if path else []
        if a and b:
            ids = {i for _, i in a}
            both = [x for x in b if x[1] in ids]
            if both:
                a = both
            elif len(b) > 1 and text:
                # the text may name the parent of an ambiguous entry
                names = {"".join(self.tokens[i]) for i in ids}
                a = [x for x in b if set(self.parents[x[1]]) & names] or b
            else:
                a = b if b[0][0] <= a[0][0] or len(a) > 1 else a
        best = a or b
        if not best:
            return -1, -1.0
        rarest = (lambda i: self.rarest[i]) if self.rarest is not None else lambda i: min((self.count(w) for w in self.tokens[i]), default=0)
        c, i = min(best, key=lambda x: (x[0], -rarest(x[1]), x[1]))
        return self.ids[i], c


def unwrap(s: str) -> str:
    """A typed heading without positions, quotes and the words that only announce a heading."""
    while True:
        t = s.strip().strip(",;").strip()
        t = _TAIL.sub("", _HEAD.sub("", t))
        for w in _WRAPS:
            if m := w.match(t):
                t = m.group(1)
        t = t.strip().lstrip("#").strip()
        if t == s:
            return t
        s = t


def parse(s: str) -> list[str]:
    """The headings a typed value consists of, outermost first."""
    if m := _INSIDE.match(s):
        return [unwrap(m.group(2)), unwrap(m.group(1))]
    parts = [unwrap(p) for p in _PATH.split(s)]
    out: list[str] = []
    for p in parts:
        if m := _INSIDE.match(p):
            out += [unwrap(m.group(2)), unwrap(m.group(1))]
        elif " under " in p:
            out += [unwrap(x) for x in reversed(p.split(" under "))]
        else:
            out.append(p)
    return out


class Reference:
    """The whole list, by artifact."""

    def __init__(self, rows: list[tuple]) -> None:
        words, heads = Deletes(), Deletes()
        by: dict[int, list[tuple]] = defaultdict(list)
        counts: Counter[str] = Counter()
        for owner, *row in rows:
            by[owner].append(tuple(row))
            counts.update(set(tokens(row[1])))
        self.owners = {k: Owner(v, words, heads) for k, v in by.items()}
        for o in self.owners.values():
            o.count = lambda w: counts.get(w, 0)
            o.close = lambda w: any(c <= 2.0 for c in words.near(w, 2).values())


_OUT = "origin string, row_id bigint, section_id bigint, cost double"
_COLS = ["origin", "row_id", "section_id", "cost"]
_ENTRY = ["section_id", "heading", "level", "position", "anchor", "heading_path"]
#: The reference of the last broadcast list, kept by a worker for its next task.
_HELD: dict[str, Reference] = {}


def _emit(b: pa.RecordBatch, found: list[tuple[int, float]]) -> pa.RecordBatch:
    ids, costs = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(costs, pa.float64())], names=_COLS)


def _entries(sections: DataFrame) -> DataFrame:
    return sections.select(F.col("artifact_id").cast("long").alias("artifact_id"), F.col("section_id").cast("long").alias("section_id"), "heading", F.coalesce(F.col("level"), F.lit(0)).alias("level"), F.coalesce(F.col("position"), F.lit(0)).alias("position"), "anchor", "heading_path").where("artifact_id IS NOT NULL AND section_id IS NOT NULL")


def to_entries(values: DataFrame, sections: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """``origin``, ``row_id``, ``section_id`` and the cost of the match for each typed value.

    ``values`` has origin, row_id, artifact_id, text and path (null where there is none); ``sections`` is the reference
    list. -1 (cost -1) for values that name no entry of their artifact: null, empty and meaningless values, headings of
    other artifacts, section numbers out of range, unknown or null artifacts. Ties go to the entry with the more
    frequent words, then to the earlier one. Repeated rows come out repeated; texts of any length are read whole.
    Up to ``broadcast_entries`` entries and BROADCAST_CHARS characters (counted) nothing is shuffled; a longer list is
    joined by artifact, with the same results.
    """
    values = values.select("origin", F.col("row_id").cast("long").alias("row_id"), F.col("artifact_id").cast("long").alias("artifact_id"), "text", "path")
    entries = _entries(sections)
    n, chars = measured_size(entries, F.concat_ws("", "heading", "anchor", F.array_join("heading_path", "")))
    if n > broadcast_entries or chars > BROADCAST_CHARS:
        return _by_join(values, entries)
    sent, name = values.sparkSession.sparkContext.broadcast([tuple(r) for r in entries.collect()]), uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if name not in _HELD:
                _HELD.clear()
                _HELD[name] = Reference(sent.value)
            owners = _HELD[name].owners
            done: dict[tuple, tuple[int, float]] = {}
            found = []
            for owner, text, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()):
                key = (owner, text, tuple(path) if path else None)
                hit = done.get(key)
                if hit is None:
                    own = owners.get(owner)
                    hit = done[key] = own.resolve(text, path) if own else (-1, -1.0)
                found.append(hit)
            yield _emit(b, found)

    return values.mapInArrow(run, _OUT)


def _words_of(df: DataFrame, key: str, kind: str, columns: list[str]) -> DataFrame:
    """(key, word): the distinct words of the texts (or lists of texts) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words = [], []
            for k, *texts in zip(*(c.to_pylist() for c in b.columns)):
                flat = [x for t in texts for x in (t if isinstance(t, list) else [t]) if x]
                for w in sorted({w for x in flat for w in tokens(x)}):
                    keys.append(k)
                    words.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(words, pa.string())], names=[key, "word"])

    return df.select(key, *columns).mapInArrow(run, f"{key} {kind}, word string")


def _close(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """The typed words with a listed word within two weighted edits; the deletes of both sides meet by equality."""

    def left(batches: Iterator[pa.RecordBatch], other: str) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, w) for w in b.column(0).to_pylist() for d in deletes(w[:PREFIX], 2)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["d", other])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if distance(a, w, 2.0) is not None], pa.string())], names=["word"])

    met = typed.mapInArrow(lambda it: left(it, "word"), "d string, word string").join(listed.mapInArrow(lambda it: left(it, "w"), "d string, w string"), "d").select("word", "w").distinct()
    return met.mapInArrow(near, "word string").distinct()


def _by_join(values: DataFrame, entries: DataFrame) -> DataFrame:
    """The same for reference lists beyond the bound: each artifact's entries travel to its values, and the list-wide
    counts of their words to each distinct value."""
    owned = _words_of(entries, "section_id", "bigint", ["heading"])
    counts = owned.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = owned.join(counts, "word").groupBy("section_id").agg(F.min("n").alias("rarest"))
    lists = entries.join(rarest, "section_id", "left").groupBy("artifact_id").agg(F.collect_list(F.struct(*_ENTRY, F.coalesce("rarest", F.lit(0)).alias("rarest"))).alias("entries"))
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = values.withColumn("k", F.md5(F.to_json(F.struct("text", "path"))))
    typed = keyed.groupBy("k").agg(F.first("text").alias("text"), F.first("path").alias("path"))
    said = _words_of(typed, "k", "string", ["text", "path"])
    listed = said.select("word").distinct().join(counts.select("word", F.lit(True).alias("known")), "word", "left")
    told = listed.where("known").unionByName(_close(listed.where("known IS NULL AND length(word) > 6").select("word"), counts.select("word")).withColumn("known", F.lit(False)))
    known = said.join(told, "word").groupBy("k").agg(F.collect_list(F.struct("word", "known")).alias("known")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    both = keyed.join(known, ["k", "salt"], "left").join(lists, ["artifact_id", "salt"], "left").select("origin", "row_id", "artifact_id", "text", "path", "known", "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Owner] = {}
        for b in batches:
            found = []
            for owner, text, path, known_, rows in zip(*(b.column(k).to_pylist() for k in range(2, 7))):
                if not rows:
                    found.append((-1, -1.0))
                    continue
                own = held.get(owner)
                if own is None:
                    if len(held) > 2000:
                        held.clear()
                    own = held[owner] = Owner([tuple(r[c] for c in _ENTRY) for r in rows], Deletes(), Deletes(), [r["rarest"] for r in rows])
                # what a word is depends on the list alone, so cached headings hold for every value
                said_ = {x["word"]: x["known"] for x in known_ or ()}
                own.count = lambda w, said_=said_: int(said_.get(w) is True)
                own.close = lambda w, said_=said_: said_.get(w) is False
                found.append(own.resolve(text, path))
            yield _emit(b, found)

    return both.mapInArrow(run, _OUT)
