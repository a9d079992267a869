"""Texts cut off by a length limit or a broken transfer.

Intact values are cut artificially (between characters, between words, with an ellipsis) to create positives; a hashed
logistic regression learns closing characters, closing words, the shape of the last line, open markup and the length's
relation to its source's limits; then every record is scored. The sample holds cut records too, so the fit is repeated
without the sampled records that the fit before scored as cut.

Whether a closing word is a whole one is told by how many documents of the whole corpus hold it inside their text; the
counts are a distributed table that is joined to the closing words. The sample's texts are turned into hashed features
where they lie, so only numbers reach the driver, however long the texts are.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricloom.session import broadcast_if_small, checkpoint

#: Records (in expectation) on which the classifier is fitted, taken by the hash of their key; all counts, statistics and
#: scores cover all records.
SAMPLE = 10_000
DIM = 1 << 18
ROUNDS = 3
#: Records scored above this are reported as cut.
CUT = 0.7
_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|\s+|[^\w\s]|_")
#: A word, as the Java engine and as _TOKEN read it.
_WORD = r"[\p{L}\p{Nl}\p{No}]+(?:['’\-][\p{L}\p{Nl}\p{No}]+)*+"
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b[^<>]*?(/?)>")
#: HTML's elements without an end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_KINDS = [(k, re.compile(p)) for k, p in (
    ("fence", r"\s*(```|~~~)"), ("row", r"\s*\|"), ("head", r"#{1,6}(\s|$)"), ("bullet", r"\s*[-*+](\s|$)"), ("number", r"\s*\d+[.)](\s|$)"),
    ("link", r"\s*https?:"), ("sign", r"\s*(—|--)\s"), ("tag", r"\s*<"), ("field", r"[A-Z][\w ]{0,30}:"), ("json", r'\s*["\[{}\]]'), ("mark", r"\*"))]


def _kind(line: str) -> str:
    return next((k for k, p in _KINDS if p.match(line)), "text")


def _token(t: str) -> str:
    if t.isspace():
        return " "
    if t[0].isdigit():
        return str(min(len(t), 5))
    if t[0].isalpha():
        return "A" if t.isupper() else "W" if t[0].isupper() else "w"
    return t


def open_markup(text: str) -> tuple[int, bool]:
    """(elements left open, whether the text ends inside a tag), over the whole text."""
    stack: list[str] = []
    for close, name, self_closed in _TAG.findall(text):
        name = name.lower()
        if name in _VOID or self_closed:
            continue
        if not close:
            stack.append(name)
        elif name in stack:
            while stack.pop() != name:
                pass
    return len(stack), text.rfind("<") > text.rfind(">") and bool(re.match(r"</?[a-zA-Z!]?[^<>\n]*$", text[text.rfind("<") :]))


def last_line(text: str) -> str:
    """The last line that is not empty, whole."""
    text = text.rstrip("\r\n")
    return text[max(text.rfind("\n"), text.rfind("\r")) + 1 :]


def last_word(text: str) -> str:
    """The word a text ends in, in lower case; empty where it ends in something else."""
    tokens = _TOKEN.findall(last_line(text))
    return tokens[-1].lower() if tokens and tokens[-1][0].isalpha() else ""


def features(text: str, spike: int, known: bool) -> list[str]:
    """What a text's end and its open structures look like; ``spike`` tells how its length stands out in its source and
    ``known`` whether its last word is a whole word of the corpus."""
    tail = text.rstrip("\r\n")
    line = last_line(text)
    kind = _kind(line)
    tokens = _TOKEN.findall(line) or [""]
    last = tokens[-1]
    out = ["1", "kind=" + kind, "last=" + last.lower(), f"kind,last={kind},{last.lower()}", f"spike={spike}"]
    types = [_token(t) if t else "" for t in tokens[-12:]]
    out.append(f"{kind},t3={''.join(types[-3:])}")
    out.append(f"{kind},t6={''.join(types[-6:])}")
    if len(tokens) <= 14:
        out.append(f"{kind},line={''.join(_token(t) if t else '' for t in tokens)}")
    out.append(f"{kind},n={min(len(tokens), 8)}")
    if kind in ("bullet", "number"):
        item = "".join(_token(t) if t else "" for t in _TOKEN.findall(re.sub(r"^\s*\S+\s*", "", line))[:16])
        out += [f"item={item}", f"item,known={known},{item}"]
    if kind in ("field", "sign", "head"):
        head = line.split(":")[0] if kind == "field" else "".join(types)
        out.append(f"{kind}:{head}")
        if kind == "field":
            value = line.split(":", 1)[1].strip().lower()
            out += [f"field,empty={not value}", f"value={head}:{value[:40] if len(value) <= 40 else len(value) > 40}"]
    if last[:1].isalpha():
        out += [f"known={known}", f"{kind},known={known}"]
        if len(tokens) > 2:
            out.append("two=" + "".join(tokens[-3:]).lower())
            out.append(f"{kind},before={tokens[-3].lower()},{known}")
    bare = tail.rstrip("”»\"')")
    closed = bare != tail and tail.count("“") <= tail.count("”") and tail.count("«") <= tail.count("»")
    out.append(f"closed={closed}")
    stop = bare[-1:] in tuple(".!?。！？؟…") and not tail.endswith(("...", "…")) or closed and tail.endswith(("”", "»"))
    out.append(f"stop={stop}")
    out.append(f"{kind},stop={stop}")
    if tail.endswith(("...", "…")):
        out.append("ellipsis")
    if tail[-1:].isspace():
        out.append("blank")
    if line.count("(") != line.count(")"):
        out.append("paren")
    for a, b in ("“”", "«»"):
        if tail.count(a) > tail.count(b):
            out.append("quote")
    if text.count("```") % 2:
        out.append("fence odd")
    if kind == "row":
        out.append(f"row={line.rstrip().endswith('|')},{line.count('|')}")
    if "</" in text or "<" in tail:
        n, inside = open_markup(text)
        out += [f"open={min(n, 2)}", f"inside={inside}", f"{kind},open={min(n, 2)}"]
    head = text.lstrip()[:1]
    if head and head in "[{":
        try:
            json.loads(text)
            out.append("json whole")
        except ValueError:
            out.append("json broken")
    return out


def _hash(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % DIM for n in names]


def _cut(text: str, rng: random.Random) -> str | None:
    """A truncated version of an intact text, or None where the cut would end at a whole unit."""
    if len(text) < 40:
        return None
    at = rng.randint(max(20, len(text) // 8), len(text) - 1)
    how = rng.random()
    out = text[:at]
    marked = "</" in text or text.lstrip()[:1] in ("[", "{")
    wide = [i for i in range(20, len(text)) if text[i] > "\x7f"] if how > 0.95 and not text.isascii() else []
    if wide:
        # a broken transfer inside a character leaves the mark of an undecodable byte
        return text[: rng.choice(wide)] + "\ufffd"
    if how < 0.3:
        out = out[: max(out.rfind(" "), 20)].rstrip(" ")
    rest = text[len(out) :]
    if not out.strip() or not rest.strip():
        return None
    whole = out.rstrip()[-1:] in ".!?”»" or rest[:1] in "\r\n" or out[-1:] in "\r\n" or (rest[:1] in ".!?" and rest[1:2] in ("", " ", "\n", "<", '"'))
    if whole and not marked:
        return None
    if how > 0.85:
        out += rng.choice(["…", "..."])
    return out


class Model:
    """Weights of the hashed regression."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights

    def score(self, text: str, spike: int, known: bool) -> float:
        z = float(self.weights[_hash(features(text, spike, known))].sum())
        return 1.0 / (1.0 + np.exp(-max(min(z, 30.0), -30.0)))


def _regress(rows: list[list[int]], y: np.ndarray, l2: float = 2e-5, rounds: int = 120) -> np.ndarray:
    """L2-penalised logistic regression by AdaGrad on the whole sample; hashed features, no intercept of its own."""
    index = np.concatenate([np.array(r) for r in rows])
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    start = np.cumsum(size) - size
    used, compact = np.unique(index, return_inverse=True)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-8)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.add.reduceat(w[compact], start)))
        grad = np.bincount(compact, np.repeat((p - y) * weight, size), len(used)) + l2 * w
        g2 += grad * grad
        w -= 0.5 * grad / np.sqrt(g2)
    out = np.zeros(DIM)
    out[used] = w
    return out


def examples(text: str, spike: int, known: bool, seed: int) -> tuple[list[int], list[tuple[str, list[int], list[int]]]]:
    """Hashed features of a text, and of two cut versions of it: last word, features if it is a word, features if not."""
    rng = random.Random(seed)
    cuts = []
    for _ in range(2):
        c = _cut(text, rng)
        if c is not None:
            # half of the cuts play a length limit: their length then stands out in the source
            at = rng.choice((0, 3))
            cuts.append((last_word(c), _hash(features(c, at, True)), _hash(features(c, at, False))))
    return _hash(features(text, spike, known)), cuts


def fit(own: list[list[int]], spikes: list[int], cuts: list[list[list[int]]]) -> Model:
    """A model from the hashed features of records, most of which are intact, and of cut versions of each."""
    # a first guess at the intact ones: lengths that stand out are suspect
    intact = [i for i, spike in enumerate(spikes) if spike < 2]
    for _ in range(ROUNDS - 1):
        # each half is judged by a fit on the other half, so that no cut record vouches for itself
        halves = [_train(own, cuts, [i for i in intact if i % 2 == h]) for h in (0, 1)]
        intact = [i for i, o in enumerate(own) if halves[1 - i % 2][o].sum() < 0]
    return Model(_train(own, cuts, intact))


def _train(own: list[list[int]], cuts: list[list[list[int]]], intact: list[int]) -> np.ndarray:
    rows = [own[i] for i in intact] + [c for i in intact for c in cuts[i]]
    y = np.zeros(len(rows))
    y[len(intact) :] = 1.0
    return _regress(rows, y) if intact and len(rows) > len(intact) else np.zeros(DIM)


def _spikes(df: DataFrame) -> DataFrame:
    """For each source and length, how far more records have about this length than lengths around it (0 to 3)."""
    w = Window.partitionBy("source").orderBy("bin").rangeBetween(-12, 12)
    n = df.groupBy("source", F.floor(F.col("n") / 8).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    around = (F.sum("c").over(w) - F.col("c")) / 24.0
    ratio = F.col("c") / (around + 1.0)
    return n.select("source", "bin", "c", F.when((F.col("c") >= 5) & (ratio >= 10), 3).when((F.col("c") >= 5) & (ratio >= 4), 2).when(ratio >= 2.5, 1).otherwise(0).alias("spike"))


def _inner_words(docs: DataFrame) -> DataFrame:
    """``word`` for each word that two documents or more hold before their last word."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), 0)
    each = docs.where("text IS NOT NULL").select(w.alias("w")).select(F.explode(F.array_distinct(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("word")


def scores(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``source`` and the probability that the text was cut, for every record.

    Null, empty and blank texts were not cut (0.0). Repeated rows are scored each; a null source is a source of its
    own; other columns of ``df`` are left out; an empty table gives no rows. The classifier is fitted on about
    ``sample`` records by hash (all, where there are fewer); words and length statistics cover all records, and whole
    texts are read. The tables of lengths (a row for each source and length) and of words are broadcast only if counted
    small.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"))
    filled = docs.where("trim(text) <> ''")
    lengths = checkpoint(_spikes(filled.select("doc_id", "source", F.length("text").alias("n"))))
    words = checkpoint(_inner_words(docs))
    n = lengths.agg(F.sum("c")).first()[0] or 0
    # from the right end, so that the pattern sees the text's last stretch without blanks only
    line = F.substring_index(F.translate(F.rtrim("text", F.lit("\r\n")), "\r", "\n"), "\n", -1)
    last = F.lower(F.regexp_extract(F.substring_index(line, " ", -1), rf"(?<![\p{{L}}\p{{Nl}}\p{{No}}])({_WORD})\z", 1))
    small = broadcast_if_small(words.select(F.col("word").alias("last"), F.lit(True).alias("known")), 2_000_000)
    docs = docs.withColumns({"bin": F.floor(F.length("text") / 8).cast("long"), "last": F.nullif(last, F.lit(""))})
    docs = docs.join(broadcast_if_small(lengths.drop("c"), 200_000), ["source", "bin"], "left").join(small, "last", "left")
    docs = docs.select("doc_id", "source", "text", F.coalesce("spike", F.lit(0)).alias("spike"), F.coalesce("known", F.lit(False)).alias("known"))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t, s, w in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                own, cuts = examples(t, s, w, zlib.crc32(t.encode("utf-8", "surrogatepass")) ^ 7)
                rows.append({"doc_id": k, "spike": s, "own": own, "cuts": [{"last": a, "yes": y, "no": z} for a, y, z in cuts]})
            yield pa.RecordBatch.from_pylist(rows, _LEARNT)

    chosen = docs.where("trim(text) <> ''").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / max(n, 1)) * (1 << 30))))
    rows = sorted(chosen.mapInArrow(learn, "doc_id bigint, spike int, own array<int>, cuts array<struct<last:string,yes:array<int>,no:array<int>>>").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["own"]))
    ends = spark.createDataFrame([(w,) for w in sorted({c["last"] for r in rows for c in r["cuts"]})], "word string")
    whole = {r[0] for r in words.join(F.broadcast(ends), "word", "left_semi").collect()}
    model = fit([r["own"] for r in rows], [r["spike"] for r in rows], [[c["yes" if c["last"] in whole else "no"] for c in r["cuts"]] for r in rows])
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = sent.value
            p = [m.score(t, s, w) if t and t.strip() else 0.0 for t, s, w in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64())], names=["doc_id", "source", "p_cut"])

    return docs.mapInArrow(run, "doc_id bigint, source string, p_cut double")


_LEARNT = pa.schema([("doc_id", pa.int64()), ("spike", pa.int32()), ("own", pa.list_(pa.int32())), ("cuts", pa.list_(pa.struct([("last", pa.string()), ("yes", pa.list_(pa.int32())), ("no", pa.list_(pa.int32()))])))])
