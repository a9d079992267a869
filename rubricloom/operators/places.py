"""Free-text locations in HTML pages and string lists, planted truth there, and whether they meet.

Pages and their locations come as one sorted stream: a page's row, then the locations on it. So each page is parsed once
for many locations, no group is held in memory, and a hot page is copied to a fixed number of tasks. What comes out are
numbers of elements or items, so claims and truth meet by equality: a truth carries all elements that count as a hit.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.operators.markup import Node, parse, place
from rubricloom.operators.resolve import ORDINALS

#: Artifact types, nouns of elements, and what marks a place in a text.
TYPES = ("markdown-prose", "markdown-tree", "html", "string-list")
NOUNS = {"link": ("a",), "image": ("img",), "button": ("button",), "heading": ("h1", "h2", "h3", "h4", "h5", "h6"), "field": ("input", "select", "textarea"), "table": ("table",), "list": ("ul", "ol")}
_ORDINAL = re.compile(rf"\bthe\s+([a-zA-Z]+)\s+({'|'.join(NOUNS)})\b", re.I)
_QUOTED = re.compile(r"[`\"“]([^`\"”]{1,400})[`\"”]")
_STEP = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)?(#[\w-]+)?((?:\.[\w-]+)*)(?::nth-of-type\((\d+)\))?")
_ITEM = re.compile(r"\b(?:item|string|message)\s+(\d+)\b", re.I)
_NTH_ITEM = re.compile(r"\b([A-Za-z]+)\s+item\b", re.I)
_KEY = re.compile(r"[\w][\w.:-]*")
#: Copies of a page, so that the locations of a hot one are spread over as many tasks.
SALTS = 8


def loose(s: str) -> str:
    return " ".join(unicodedata.normalize("NFC", s).casefold().split())


def ordinal(word: str, total: int) -> int | None:
    n = total if word == "last" else ORDINALS.index(word) + 1 if word in ORDINALS else 0
    return n if 1 <= n <= total else None


class Selector:
    """A bounded selector: tags, ids, classes and nth-of-type, joined by child or descendant steps.

    As results must equal the known ones, a joiner acts one step further left than it is written: in ``a > b c`` it binds
    b to c, and the first step may always stand anywhere above.
    """

    def __init__(self, text: str) -> None:
        self.steps: list[tuple[bool, re.Match | None]] = []
        child = False
        for part in re.findall(r">|[^\s>]+", text):
            if part == ">":
                child = True
            else:
                self.steps.append((child, _STEP.fullmatch(part)))
                child = False

    def _one(self, n: Node, m: re.Match | None) -> bool:
        if m is None or n.parent is None:
            return False
        tag, id_, classes, nth = m.groups()
        return (not tag or n.tag == tag.lower()) and (not id_ or n.attrs.get("id") == id_[1:]) and set(classes.split(".")[1:]) <= set(n.attrs.get("class", "").split()) and (not nth or n.nth == int(nth))

    def _above(self, n: Node, k: int) -> bool:
        """Whether what stands above ``n`` satisfies the steps before step ``k``; the nearest fitting ancestor counts."""
        while k > 0:
            child = self.steps[k - 1][0]
            x = n.parent
            while x is not None and not self._one(x, self.steps[k - 1][1]):
                x = None if child else x.parent
            if x is None:
                return False
            n, k = x, k - 1
        return True

    def select(self, nodes: list[Node]) -> list[Node]:
        last = len(self.steps) - 1
        return [n for n in nodes if self._one(n, self.steps[last][1]) and self._above(n, last)] if self.steps else []


class Html:
    def __init__(self, text: str) -> None:
        self.nodes = parse(text)
        self.ids: dict[str, Node] = {}
        self.by_text: dict[str, list[Node]] | None = None
        for n in self.nodes:
            if n.attrs.get("id"):
                self.ids.setdefault(n.attrs["id"], n)

    def _whole(self, text: str) -> list[Node]:
        if self.by_text is None:
            self.by_text = {}
            for n in self.nodes:
                self.by_text.setdefault(loose("".join(_strings(n))), []).append(n)
        return self.by_text.get(text, [])

    def resolve(self, text: str) -> tuple[list[int], list[str], list[int], str]:
        """(elements, no keys, elements and their ancestors up to two above, canonical key)."""
        found: dict[int, Node] = {}
        mark = re.search(r"#([A-Za-z][\w-]*)", text)
        for w in [mark.group(1)] if mark else re.findall(r"[A-Za-z][\w-]*", text):
            if w in self.ids:
                found[self.ids[w].id] = self.ids[w]
        for q in _QUOTED.findall(text):
            found |= {n.id: n for n in Selector(q).select(self.nodes)}
            whole = self._whole(loose(q)) if len(loose(q)) >= 8 else []
            if len(whole) == 1:
                found[whole[0].id] = whole[0]
        if m := _ORDINAL.search(text):
            same = [n for n in self.nodes if n.tag in NOUNS[m.group(2).lower()]]
            k = ordinal(m.group(1).lower(), len(same))
            if k:
                found[same[k - 1].id] = same[k - 1]
        near = {x.id for n in found.values() for x in _upto(n, 2)}
        return sorted(found), [], sorted(near), place(found[min(found)]) if found else "?:" + loose(text)

    def truth(self, kind: str, value: str) -> list[int]:
        """Elements that hit a planted one: itself, its parent and grandparent, its children."""
        hit = [self.ids[value]] if kind == "element-id" and value in self.ids else Selector(value).select(self.nodes) if kind == "css" else []
        if len(hit) != 1:
            return []
        return sorted({x.id for x in _upto(hit[0], 2)} | {c.id for c in hit[0].children})


def _strings(n: Node) -> Iterator[str]:
    todo: list = [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo.extend(reversed(x.parts))


def _upto(n: Node, k: int) -> list[Node]:
    return [x for x in list(n.up())[: k + 1] if x.parent is not None]


class Strings:
    """A JSON array of strings, {key, value} objects or [key, value] pairs, or an object; items count from 1."""

    def __init__(self, text: str) -> None:
        data = json.loads(text)
        pairs = [(None, e) if isinstance(e, str) else (e.get("key"), e.get("value", "")) if isinstance(e, dict) else (e[0], e[1]) for e in data] if isinstance(data, list) else list(data.items())
        self.items = [(None if k is None else str(k), str(v)) for k, v in pairs]

    def resolve(self, text: str) -> tuple[list[int], list[str], list[int], str]:
        at, keys = set(), set()
        if m := _ITEM.search(text):
            at |= {int(m.group(1))} & set(range(1, len(self.items) + 1))
        elif m := _NTH_ITEM.search(text):
            at |= {ordinal(m.group(1).lower(), len(self.items))} - {None}
        known = {k for k, _ in self.items if k is not None}
        keys |= known & set(_KEY.findall(text))
        for q in _QUOTED.findall(text):
            whole = [i for i, (_, v) in enumerate(self.items, 1) if loose(v) == loose(q)] if len(loose(q)) >= 8 else []
            if len(whole) == 1:
                at.add(whole[0])
                keys |= {self.items[whole[0] - 1][0]} - {None}
        name = str(min(at)) if at else "key:" + min(keys) if keys else "?:" + loose(text)
        return sorted(at), sorted(keys), sorted(at), name

    def truth(self, kind: str, value: str) -> list[int]:
        if kind == "item-index":
            return [int(value)] if value.isdigit() and 1 <= int(value) <= len(self.items) else []
        return [i for i, (k, _) in enumerate(self.items, 1) if kind == "item-key" and k == value]


def _stream(pages: DataFrame, asked: DataFrame, columns: list[Column]) -> DataFrame:
    """Pages and what is asked about them, each page before its own rows."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    none = F.lit(None).cast("string")
    p = pages.select("artifact_id", salts.alias("salt"), F.lit(0).alias("ord"), none.alias("key"), F.col("artifact_type").alias("a"), F.col("text").alias("b"))
    q = asked.select("artifact_id", F.pmod(F.xxhash64(columns[0]), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("ord"), *columns)
    return p.unionByName(q).repartition("artifact_id", "salt").sortWithinPartitions("artifact_id", "salt", "ord")


def _read(kind: str | None, text: str | None) -> Html | Strings | None:
    if kind not in TYPES:
        raise ValueError(f"unknown artifact type {kind!r}")
    if kind == "html":
        return Html(text or "")
    if kind == "string-list":
        try:
            return Strings(text or "")
        except (ValueError, TypeError, AttributeError, IndexError):
            return None
    return None


def _answers(batches: Iterator[pa.RecordBatch], answer) -> Iterator[tuple]:
    held: tuple = (None, None)
    for b in batches:
        for owner, _, order, key, a, text in zip(*(c.to_pylist() for c in b.columns)):
            if order == 0:
                held = (owner, _read(a, text))
            else:
                yield answer(owner, key, held[1] if held[0] == owner else None, a, text)


def resolve(pages: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims (artifact_id, key as text, location) on pages (artifact_id, artifact_type, text; one row each) of HTML or of
    string lists: resolvable, at (elements or items), keys, near (at with ancestors up to two above), canonical.

    An unknown artifact type is an error; a claim on a missing or markdown page resolves to nothing here (markdown is
    resolved over its sections). Null locations resolve to nothing; lists that do not parse hold no item.
    """
    def answer(owner, key, doc, _, text):
        at, keys, near, name = doc.resolve(text or "") if doc else ([], [], [], "?:" + loose(text or ""))
        return owner, key, bool(at or keys), at, keys, near, name

    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string()]
    names = ["artifact_id", "key", "resolvable", "at", "keys", "near", "canonical"]
    rows = _stream(pages, claims, [F.col("key").cast("string").alias("key"), F.lit(None).cast("string").alias("a"), F.col("location").alias("b")])
    return rows.mapInArrow(lambda it: _batches(_answers(it, answer), kinds, names), "artifact_id bigint, key string, resolvable boolean, at array<int>, keys array<string>, near array<int>, canonical string")


def truth(pages: DataFrame, truths: DataFrame) -> DataFrame:
    """Planted truth (artifact_id, key, kind: element-id, css, item-index or item-key, value) as the elements or items
    that hit it; none where it does not name just one."""
    def answer(owner, key, doc, kind, value):
        return owner, key, doc.truth(kind, value or "") if doc else []

    rows = _stream(pages, truths, [F.col("key").cast("string").alias("key"), F.col("kind").alias("a"), F.col("value").alias("b")])
    return rows.mapInArrow(lambda it: _batches(_answers(it, answer), [pa.int64(), pa.string(), pa.list_(pa.int32())], ["artifact_id", "key", "hits"]), "artifact_id bigint, key string, hits array<int>")


def _batches(rows: Iterator[tuple], kinds: list[pa.DataType], names: list[str], size: int = 5000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def hits(claims: DataFrame, truths: DataFrame) -> DataFrame:
    """(artifact_id, claim, truth) of resolved claims and truths that share an element or item."""
    a = claims.select("artifact_id", F.col("key").alias("claim"), F.explode("at").alias("x"))
    b = truths.select("artifact_id", F.col("key").alias("truth"), F.explode("hits").alias("x"))
    return a.join(b, ["artifact_id", "x"]).select("artifact_id", "claim", "truth").distinct()


def self_match(a: str = "a", b: str = "b") -> Column:
    """Whether two resolved claims name one place: an element of one is one of the other's or up to two above it, a key in
    common, or the same unresolved text."""
    c = lambda x, f: F.col(f"{x}.{f}")
    same = F.arrays_overlap(c(a, "at"), c(b, "near")) | F.arrays_overlap(c(b, "at"), c(a, "near")) | F.arrays_overlap(c(a, "keys"), c(b, "keys"))
    lost = ~c(a, "resolvable") & ~c(b, "resolvable") & (c(a, "canonical") == c(b, "canonical"))
    return F.coalesce(same, F.lit(False)) | lost


def page_matches(location: Column, path: Column) -> Column:
    """Whether a location names the artifact's own page (null where it names none): a path that ends in .md."""
    named = F.lower(F.nullif(F.regexp_extract(F.replace(location, F.lit("\\"), F.lit("/")), r"(?i)[\w./-]+\.md\b", 0), F.lit("")))
    own = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    return F.when(named.isNotNull(), (stem(named) == stem(own)) | F.endswith(own, F.concat(F.lit("/"), named)))
