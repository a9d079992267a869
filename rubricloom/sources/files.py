"""Files in and out: artifacts, envelopes, manifests, embedded JSON, and deterministic JSON documents."""

from __future__ import annotations

import json
import os
import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def artifacts(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Artifacts under ``root``: relative path, text without a byte-order mark, SHA-256 of the raw bytes, and an error
    (not UTF-8) in place of an exception. Files without a byte are not listed by the reader."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.escape(os.path.abspath(root).strip("/") + "/")
    text = F.regexp_replace(F.expr("try_validate_utf8(cast(content AS string))"), "^\ufeff", "")
    error = F.when(text.isNull(), "not UTF-8")
    return raw.select(F.regexp_replace("path", f"^(?:file:)?/*{base}", "").alias("path"), text.alias("text"), F.sha2("content", 256).alias("sha256"), error.alias("error"))


def documents(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """JSON documents under ``root``: path, text and kind (envelope, dispositions or invalid); key presence decides."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("doc"))
    return raw.withColumn("kind", kind(F.col("doc"))).where(~F.rlike("path", F.lit(r"(?:^|/)(?:results|variance|[^/]*\.schema)\.json$")))


def kind(doc: Column) -> Column:
    keys = F.json_object_keys(doc)
    return F.when(F.try_parse_json(doc).isNull() | keys.isNull(), "invalid").when(F.array_contains(keys, "dispositions"), "dispositions").otherwise("envelope")


def repetition(path: Column) -> tuple[Column, Column]:
    """(tier, repetition) of a file named <tier>-r<n>.json; nulls for other names."""
    p = r"([A-Za-z0-9.\-]+)-r(\d+)\.json$"
    return F.nullif(F.regexp_extract(path, p, 1), F.lit("")), F.nullif(F.regexp_extract(path, p, 2), F.lit("")).try_cast("int")


def last_object(text: str | None) -> str | None:
    """The last balanced {...} of a response that parses and has findings, run and summary; fences do not matter."""
    if not text:
        return None
    found = None
    at, decoder = text.find("{"), json.JSONDecoder()
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
            continue
        if isinstance(value, dict) and isinstance(value.get("findings"), list) and isinstance(value.get("run"), dict) and isinstance(value.get("summary"), dict):
            found = text[at:end]
        at = text.find("{", end)
    return found


def embedded(df: DataFrame, text: str) -> Column:
    """Arrow-batched column of ``last_object``."""
    import pandas as pd

    @F.pandas_udf("string")
    def pick(s: pd.Series) -> pd.Series:
        return s.map(last_object, na_action="ignore")

    return pick(F.col(text))


def frontmatter(text: Column) -> Column:
    """Keys and values of the flat ``key: value`` block between --- lines at the top of a page."""
    block = F.regexp_extract(text, r"(?s)\A---[^\S\n]*\n(.*?)\n---[^\S\n]*(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda l: F.rlike(l, F.lit(r"^[A-Za-z][\w-]*:")))
    pairs = F.transform(lines, lambda l: F.struct(F.regexp_extract(l, r"^([\w-]+):", 1).alias("key"), F.regexp_replace(F.regexp_replace(l, r"^[\w-]+:\s*", ""), r'^"|"$', "").alias("value")))
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), (F.array_position(F.transform(pairs, lambda q: q["key"]), p["key"]) == i + 1).alias("ok"))), lambda p: p["ok"])
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))


#: Top folders whose runs are kept out of scores, and files that are results themselves.
STEERING, RESULTS = ["steering"], ["results.json", "variance.json"]


def scoring_view(df: DataFrame, path: str = "path") -> DataFrame:
    """``df`` with ``scored``: whether a file counts in scores, by its top folder and its name."""
    p = F.split(path, "/")
    return df.withColumn("scored", ~(F.element_at(p, 1).isin(STEERING) & (F.size(p) > 1)) & ~F.element_at(p, -1).isin(RESULTS))


def findings(doc: Column) -> Column:
    """The findings of a JSON document, as an array of JSON texts: ``{"findings": [...]}`` or a bare list; else null."""
    t = F.ltrim(doc)
    bare = F.from_json(F.when(F.startswith(t, F.lit("[")), t), "array<string>")
    return F.coalesce(bare, F.from_json(F.when(F.startswith(t, F.lit("{")), F.get_json_object(t, "$.findings")), "array<string>"))


def components(doc: Column) -> Column:
    """Names of the skills a registry lists under components.skills, as objects with a name or as bare names."""
    each = F.from_json(F.get_json_object(doc, "$.components.skills"), "array<string>")
    return F.filter(F.transform(each, lambda x: F.when(F.startswith(F.ltrim(x), F.lit("{")), F.get_json_object(x, "$.name")).otherwise(x)), lambda x: x.isNotNull())


def write_text(text: str, path: str) -> None:
    """One page in UTF-8: composed characters, LF line ends, one final line feed."""
    t = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").rstrip("\n") + "\n"
    with open(path, "wb") as f:
        f.write(t.encode())


def write_json(value: object, path: str) -> None:
    """One document: sorted keys, two blanks of indent, other scripts kept, a final line feed; never over a JSON file."""
    if os.path.exists(path):
        raise FileExistsError(path)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def splice(page: str, begin: str, end: str, block: str) -> str:
    """``page`` with the text between two marks replaced; both marks must stand once, in order."""
    if page.count(begin) != 1 or page.count(end) != 1 or page.index(begin) > page.index(end):
        raise ValueError("the marks do not frame one block")
    return page[: page.index(begin) + len(begin)] + "\n" + block + "\n" + page[page.index(end) :]
