"""Free-text locations to places of an artifact, and whether two places meet within tolerance.

Artifacts come as their table of sections in order (heading, level, number of own paragraphs); each artifact's sections
travel to its claims as one array, so resolving needs no window or theta join over claims. A resolved place is an exact
paragraph (or none), a window of paragraphs as an interval, a section title (or none) and a canonical key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.session import broadcast_if_small

#: Ordinal words one to twenty.
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth",
    "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth",
]
NOTHING = 0


def claims(findings: DataFrame, *keep: str) -> DataFrame:
    """One row for the location of each finding and of each of its instances (repetitions count)."""
    all_ = F.concat(F.array("location"), F.coalesce(F.transform("instances", lambda x: x["location"]), F.array().cast("array<string>")))
    return findings.select(*keep, F.posexplode(all_).alias("claim", "location"))


def layout(sections: DataFrame) -> DataFrame:
    """Each artifact's sections as one array in order: title (normal form), level, first and last paragraph (numbered
    over the document) under the heading, up to the next heading of the same or a higher level."""
    s = F.array_sort(F.collect_list(F.struct("position", F.col("level").alias("level"), T.normal_heading(F.col("heading")).alias("title"), F.coalesce("n_paragraphs", F.lit(0)).alias("k"))))
    a = sections.where("artifact_id IS NOT NULL").groupBy("artifact_id").agg(s.alias("s"), F.sum(F.coalesce("n_paragraphs", F.lit(0))).cast("int").alias("n_paragraphs"))
    upto = lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0), lambda x, y: x + y["k"])

    def place(x: Column, i: Column) -> Column:
        later = F.slice("s", i + 2, F.size("s"))
        end = F.coalesce(F.array_min(F.filter(F.transform(later, lambda y, j: F.when(y["level"] <= x["level"], j)), lambda j: j.isNotNull())), F.size(later))
        return F.struct(x["title"].alias("title"), x["level"].alias("level"), (upto(i) + 1).alias("lo"), upto(i + 1 + end).alias("hi"))

    return a.select("artifact_id", "n_paragraphs", F.transform("s", place).alias("secs"))


def _ordinal(word: Column, total: Column) -> Column:
    n = F.array_position(F.array(*[F.lit(o) for o in ORDINALS]), word).cast("int")
    n = F.when(word == "last", total).otherwise(n)
    return F.when((n >= 1) & (n <= total), n)


def laid_out(sections: DataFrame, max_artifacts: int = 100_000) -> DataFrame:
    """``layout``, marked for broadcast where it is counted small."""
    return broadcast_if_small(layout(sections), max_artifacts)


def resolve(df: DataFrame, lay: DataFrame) -> DataFrame:
    """``df`` (artifact_id, location, ...) over ``laid_out`` sections, with resolvable, exact, lo, hi, title and canonical key of each location.

    A numbered section is the n-th of level 2 (none out of range); else a quoted exact title that is unique; else the
    longest title of four characters or more that the text holds, if unique. A paragraph number or ordinal is read
    within the section, else over the document; its window is one paragraph wider on both sides, clipped to the
    section. A section alone gives all its paragraphs. Null locations and unknown artifacts resolve to nothing.
    """
    t = F.coalesce("location", F.lit(""))
    d = df.join(lay, "artifact_id", "left")
    secs = F.coalesce("secs", F.array().cast("array<struct<title:string,level:int,lo:int,hi:int>>"))
    d = d.withColumns({"_s": secs, "_t": t, "_n": F.expr(r"try_cast(regexp_extract(coalesce(location, ''), '(?i)\\bsection\\s+(\\d+)\\b', 1) AS int)")})
    second = F.filter("_s", lambda s: s["level"] == 2)
    quoted = F.transform(F.regexp_extract_all("_t", F.lit('[`"“]([^`"”]{1,200})[`"”]'), 1), T.normal_heading)
    exact = F.filter(F.transform(quoted, lambda q: F.filter("_s", lambda s: s["title"] == q)), lambda m: F.size(m) == 1)
    norm = T.normal_loose(F.col("_t"))
    held = T.let(norm, lambda n: F.filter("_s", lambda s: (F.length(s["title"]) >= 4) & F.contains(n, s["title"])))

    def longest(h: Column) -> Column:
        """The longest title, if only one entry has it."""
        best = T.let(F.array_max(F.transform(h, lambda s: F.length(s["title"]))), lambda n: F.filter(h, lambda s: F.length(s["title"]) == n))
        return T.let(best, lambda x: F.when((F.size(x) >= 1) & (F.size(F.filter(x, lambda s: s["title"] == x[0]["title"])) == 1), x[0]))

    d = d.withColumns({"_title": T.let(held, longest), "_q": F.try_element_at(F.try_element_at(exact, F.lit(1)), F.lit(1)), "_nth": F.when(F.col("_n") >= 1, F.try_element_at(second, F.greatest("_n", F.lit(1))))})
    d = d.withColumn("_sec", F.when(F.col("_n").isNotNull(), F.col("_nth")).otherwise(F.coalesce("_q", "_title")))
    ask = lambda p: F.nullif(F.regexp_extract("_t", p, 1), F.lit(""))
    total = F.when(F.col("_sec").isNotNull(), F.col("_sec.hi") - F.col("_sec.lo") + 1).otherwise(F.coalesce("n_paragraphs", F.lit(0)))
    words = F.array(*[F.lit(o) for o in [*ORDINALS, "last"]])
    after, before = F.lower(ask(r"(?i)\b(?:paragraph|para)\s+([A-Za-z]+)\b")), F.lower(ask(r"(?i)\b([A-Za-z]+)\s+paragraph\b"))
    word = F.when(F.array_contains(words, after), after).when(F.array_contains(words, before), before)
    d = d.withColumns({"_total": total, "_p": F.expr(r"try_cast(regexp_extract(_t, '(?i)\\b(?:paragraph|para)\\s+(\\d+)\\b', 1) AS int)"), "_w": word})
    asked = F.col("_p").isNotNull() | F.col("_w").isNotNull()
    rel = F.when(F.col("_p").isNotNull(), F.when(F.col("_p").between(1, F.col("_total")), F.col("_p"))).otherwise(_ordinal(F.col("_w"), F.col("_total")))
    p = rel + F.coalesce(F.col("_sec.lo"), F.lit(1)) - 1
    has = F.col("_sec").isNotNull()
    lo = F.when(asked, F.when(p.isNotNull(), F.greatest(p - 1, F.coalesce("_sec.lo", F.lit(1))))).when(has, F.col("_sec.lo"))
    hi = F.when(asked, F.when(p.isNotNull(), F.when(has, F.least(p + 1, F.col("_sec.hi"))).otherwise(p + 1))).when(has, F.col("_sec.hi"))
    d = d.withColumns({"exact": p, "lo": lo, "hi": hi, "title": F.col("_sec.title")})
    key = F.when(F.col("exact").isNotNull(), F.col("exact").cast("string")).when(F.col("title").isNotNull(), F.concat(F.lit("H:"), F.col("title"))).otherwise(F.concat(F.lit("?:"), norm))
    window = F.col("lo").isNotNull() & (F.col("lo") <= F.col("hi"))
    d = d.withColumns({"canonical": key, "resolvable": window | has})
    return d.drop("_s", "_t", "_n", "_title", "_q", "_nth", "_sec", "_total", "_p", "_w", "secs", "n_paragraphs")


def truth(defects: DataFrame, lay: DataFrame) -> DataFrame:
    """Planted defects with their paragraph over the document (``at``), last heading (``head``) and sort key (``anchor``).

    ``paragraph`` counts within the section that the last element of the heading path names, if unique, else over the
    document.
    """
    d = defects.join(lay, "artifact_id", "left")
    last = T.normal_heading(F.try_element_at("heading_path", F.lit(-1)))
    mine = F.filter("secs", lambda s: s["title"] == last)
    start = F.when(F.size(mine) == 1, mine[0]["lo"]).otherwise(1)
    at = F.col("paragraph") + F.coalesce(start, F.lit(1)) - 1
    near = F.flatten(F.transform(F.coalesce(mine, F.array().cast("array<struct<title:string,level:int,lo:int,hi:int>>")), lambda s: F.array(s["lo"] - 1, s["lo"])))
    anchor = F.when(F.col("kind") == "paragraph", F.concat(F.lit("p:"), F.lpad(F.coalesce(at, F.lit(0)).cast("string"), 12, "0"))).otherwise(F.concat(F.lit("h:"), F.array_join(F.coalesce("heading_path", F.array().cast("array<string>")), "/")))
    return d.select("defect_id", "artifact_id", "criterion", "kind", at.alias("at"), last.alias("head"), near.alias("near"), anchor.alias("anchor"))


_PLACE = "array<struct<n:bigint,title:string>>"


def claim_places() -> Column:
    """The places a resolved claim stands for: each paragraph of its window, and its title."""
    window = F.when(F.col("lo") <= F.col("hi"), F.sequence(F.col("lo").cast("long"), F.col("hi").cast("long")))
    ps = F.transform(window, lambda n: F.struct(n.alias("n"), F.lit(None).cast("string").alias("title")))
    t = F.when(F.col("title").isNotNull(), F.array(F.struct(F.lit(None).cast("long").alias("n"), F.col("title").alias("title"))))
    none = F.array().cast(_PLACE)
    return F.concat(F.coalesce(ps, none), F.coalesce(t, none))


def truth_places() -> Column:
    """The places where a planted defect is met: its paragraph; for a heading, its title and the paragraphs beside it."""
    one = lambda n, t: F.struct(n.cast("long").alias("n"), t.cast("string").alias("title"))
    para = F.array(one(F.col("at"), F.lit(None)))
    head = F.concat(F.array(one(F.lit(None), F.col("head"))), F.transform(F.coalesce("near", F.array().cast("array<bigint>")), lambda n: one(n, F.lit(None))))
    every = F.when(F.col("kind") == "paragraph", para).when(F.col("kind") == "heading-path", head).otherwise(F.array().cast(_PLACE))
    return F.array_distinct(F.filter(every, lambda x: x["n"].isNotNull() | x["title"].isNotNull()))


def self_match(a: str = "a", b: str = "b") -> Column:
    """Whether two claims name one place: an exact paragraph in the other's window, one section, or the same unresolved text."""
    c = lambda x, f: F.col(f"{x}.{f}")
    inside = lambda x, y: F.coalesce(c(x, "exact").between(c(y, "lo"), c(y, "hi")), F.lit(False))
    section = F.coalesce(c(a, "title") == c(b, "title"), F.lit(False))
    lost = ~c(a, "resolvable") & ~c(b, "resolvable") & (c(a, "canonical") == c(b, "canonical"))
    return inside(a, b) | inside(b, a) | section | lost


def items(df: DataFrame, key: str, text: str) -> DataFrame:
    """String lists to items (index from 0, key, value): arrays of strings, of {key, value} or of [key, value] pairs, or
    an object in source order."""
    t = F.ltrim(F.col(text))
    objects = F.from_json(F.when(t.startswith("["), t), "array<string>")
    el = lambda x: F.struct(F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$.key")).when(F.ltrim(x).startswith("["), F.get_json_object(x, "$[0]")).alias("key"), F.when(F.ltrim(x).startswith("{"), F.get_json_object(x, "$.value")).when(F.ltrim(x).startswith("["), F.get_json_object(x, "$[1]")).otherwise(x).alias("value"))
    whole = F.from_json(F.when(t.startswith("{"), t), "map<string,string>")
    pairs = F.transform(F.map_entries(whole), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    both = F.coalesce(F.transform(objects, el), pairs)
    return df.where(t.startswith("[") | t.startswith("{")).select(F.col(key).alias("doc_id"), F.posexplode(both).alias("index", "x")).select("doc_id", "index", "x.key", "x.value")
