"""Microcopy rules over annotated messages (or bare ones): six checks over the messages of a screen.

A block that opens with a known label is one message of labelled lines; unlabelled lines continue the field before.
Where a document has no such block, every paragraph and every list item is a message. Messages are numbered under each
heading; the messages under equally named headings of a document count together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricloom.functions import text as T
from rubricloom.operators import prose

#: Labels, lexicons and tokens.
LABELS = ["Message", "Placement", "Container", "Signal", "Fires", "Predictable mistake", "Input on resubmission", "Suggested fix"]
INSTRUCTIONS = [
    "enter", "re-enter", "reenter", "re-type", "retype", "choose", "select", "remove", "delete", "check", "verify", "confirm", "add",
    "update", "correct", "fix", "provide", "attach", "upload", "click", "tap", "contact", "reduce", "increase", "review", "change",
    "edit", "complete", "fill in", "submit", "reset", "refresh", "sign in", "log in", "close", "clear the", "shorten", "include",
    "specify", "wait",
]
BLAME = ["you failed to", "you forgot", "your mistake", "you should have", "your fault", "you didn't", "you did not", "you neglected", "you incorrectly", "you keep", "your error", "you clearly", "you obviously"]
REPETITION = ["keep", "again", "repeatedly", "every time", "once more", "still"]
JARGON = ["null", "undefined", "nullpointerexception", "stack trace", "stacktrace", "traceback", "segmentation fault", "segfault", "backend", "api error", "runtime error", "internal server error", "regex", "json parse", "syntax error", "sql error"]
CODE = r"(?<![A-Za-z0-9])(?:[A-Z]{2,}[_-][A-Z0-9_-]*|0x[0-9A-Fa-f]+|ERR\d+|E\d{3,4})(?![A-Za-z0-9])"
STATUS = r"(?i)\b(?:status\s+code|error\s+code|http\s+status)\s*[:#]?\s*\d{3}\b"
EARLY = ["mid-keystroke", "on-load-before-input"]
ERROR_TONE = ["invalid", "incorrect", "not valid", "must be", "is required", "wrong", "please enter a valid", "failed", "error"]
_LABEL = "|".join(LABELS)
CRITERIA = ["NNG-EM-CONSTRUCTIVE", "NNG-EM-NEUTRAL-TONE", "NNG-EM-PLAIN-LANGUAGE", "NNG-EM-NOT-COLOR-ONLY", "NNG-EM-PRESERVE-INPUT", "NNG-EM-TIMING"]


def messages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, sec, heading, n, annotated, text, the other fields (null where absent) and the total under the heading's name."""
    t = T.unix_lines(F.col(text))
    any_ = F.rlike(t, F.lit(rf"(?m)(?:\A|\n[^\S\n]*\n|^#{{1,6}}[ \t][^\n]*\n)[^\S\n]*(?:{_LABEL}):"))
    d = df.select(F.struct(F.col(key).alias("id"), any_.alias("mode")).alias("k"), F.col(text).alias("text"))
    s = prose.sections(d, "k", "text")
    blocks = F.filter(F.split("body", r"\n(?:[^\S\n]*\n)++"), lambda b: T.strip(b) != "")
    item = r"^[-*+]\s+"
    lines = lambda b: F.filter(F.transform(F.split(b, "\n"), T.strip), lambda x: x != "")
    # in bare mode a list's items are messages of their own, other lines of a block stay together
    bare = F.flatten(F.transform(blocks, lambda b: F.when(F.rlike(T.strip(b), F.lit(item)), F.transform(F.filter(lines(b), lambda x: F.rlike(x, F.lit(item))), lambda x: T.strip(F.regexp_replace(x, item, "")))).otherwise(F.array(F.array_join(lines(b), " ")))))
    annotated = F.filter(F.transform(blocks, lambda b: F.array_join(lines(b), "\n")), lambda b: F.rlike(b, F.lit(rf"^(?:{_LABEL}):")) & F.rlike(b, F.lit(r"(?m)^Message:")))
    mode = F.col("doc_id.mode")
    m = s.select(F.col("doc_id.id").alias("doc_id"), mode.alias("annotated"), "sec", "heading", F.posexplode(F.when(mode, annotated).otherwise(F.filter(bare, lambda x: x != ""))).alias("i", "b"))
    field = lambda n: F.when(F.rlike("b", F.lit(rf"(?m)^{n}:")), T.strip(F.regexp_replace(F.regexp_extract("b", rf"(?s)(?:^|\n){n}:[ \t]*(.*?)(?=\n(?:{_LABEL}):|$)", 1), "\n", " ")))
    out = m.select("doc_id", "sec", "heading", (F.col("i") + 1).alias("n"), "annotated", F.when(F.col("annotated"), field("Message")).otherwise(F.col("b")).alias("text"), *[F.when(F.col("annotated"), field(n)).alias(n.lower().replace(" ", "_")) for n in LABELS[1:]])
    return out.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "heading")))


def _rules() -> dict[str, tuple[Column, Column, Column, str]]:
    """Test, severity, evidence and named part of each rule over ``messages``."""
    t, hard = F.col("text"), lambda test: F.when(test, 3).otherwise(2)
    last = F.lower(T.strip(F.element_at(F.split("signal", ","), -1)))
    return {
        "NNG-EM-CONSTRUCTIVE": (~T.has(t, T.lexicon(INSTRUCTIONS)), F.when(F.lower("suggested_fix").isin("described", "selectable"), 2).otherwise(3), t, ""),
        "NNG-EM-NEUTRAL-TONE": (T.has(t, T.lexicon(BLAME)), hard(T.has(t, T.lexicon(REPETITION))), t, ""),
        "NNG-EM-PLAIN-LANGUAGE": (F.col("span").isNotNull(), hard(T.words(F.expr("concat_ws(' ', substring(text, 1, locate(span, text) - 1), substring(text, locate(span, text) + length(span)))")) <= 3), F.col("span"), ""),
        "NNG-EM-NOT-COLOR-ONLY": (F.coalesce(last == "none", F.lit(False)), hard(F.lower("container") == "toast"), F.col("signal"), "Signal"),
        "NNG-EM-PRESERVE-INPUT": (F.lower("input_on_resubmission") == "cleared", hard(F.col("total") >= 3), F.col("input_on_resubmission"), "Input on resubmission"),
        "NNG-EM-TIMING": (F.lower("fires").isin(EARLY), hard(T.has(t, T.lexicon(ERROR_TONE))), F.col("fires"), "Fires"),
    }


def findings(m: DataFrame, criteria: list[str]) -> DataFrame:
    """Findings of the given rules over ``messages``, in one pass."""
    t = F.col("text")
    hit = lambda p: F.nullif(F.regexp_extract(t, p, 0), F.lit(""))
    span = F.coalesce(hit(CODE), hit(STATUS), hit(T.lexicon(JARGON)))
    rules, out = _rules(), []
    for c in criteria:
        test, severity, evidence, part = rules[c]
        place = F.concat(F.when(F.coalesce("heading", F.lit("")) != "", F.concat("heading", F.lit(", "))).otherwise(F.lit("")), F.lit("message "), F.col("n").cast("string"), F.lit(f", {part}" if part else ""))
        out.append(F.when(test, F.struct(F.lit(c).alias("criterion"), severity.cast("int").alias("severity"), place.alias("location"), evidence.alias("evidence"))))
    return m.withColumn("span", span).select("doc_id", "sec", "n", F.inline(F.array_compact(F.array(*out))))


def run(m: DataFrame, criterion: str) -> DataFrame:
    """Findings of one rule over ``messages``."""
    return findings(m, [criterion])


def check(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings of all rules; the messages are read and counted once."""
    return findings(messages(df, key, text), CRITERIA)
