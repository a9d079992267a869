"""Deeply nested JSON records to flat tables linked by their positions.

The JVM brings each record into one regular nested shape (``from_json`` with STRING leaves turns an object and its
JSON text into the same text, so both spellings meet there). The flattening works on Arrow buffers: list offsets give
the child arrays, parent indices propagate the keys by ``take``; no row is visited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FINDING = ["id", "criterion", "lane", "severity", "location", "evidence", "violation", "fix", "confidence"]
_INSTANCE = ["location", "evidence"]
_EXAMPLE = ["kind", "artifact", "note", "query"]
_RUN = ["skill", "skill_version", "contract_version", "model", "timestamp"]


def _strings(names: list[str]) -> str:
    return "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"


def _many(text: Column) -> Column:
    """A list's elements as texts; a lone value is a list of one; null is an empty list."""
    t = F.ltrim(text)
    listed = F.when(t.startswith("["), F.from_json(t, "array<string>"))
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(listed, F.array(text)))


def _object(text: Column, names: list[str]) -> Column:
    """The named members of an object as texts; all null where the text is no object."""
    return F.from_json(F.when(F.ltrim(text).startswith("{"), text), _strings(names))


def _each(texts: Column, names: list[str]) -> Column:
    """Each text beside its named members; read once, in a step of its own, as lambdas share no subexpressions."""
    return F.transform(texts, lambda t: F.struct(t.alias("t"), _object(t, names).alias("o")))


def _instance(x: Column) -> Column:
    # text that is no object is the instance's location
    plain = ~F.ltrim(x["t"]).startswith("{") | (x["o"]["location"].isNull() & x["o"]["evidence"].isNull() & F.get_json_object(x["t"], "$").isNull())
    return F.struct(F.when(F.coalesce(plain, F.lit(False)), x["t"]).otherwise(x["o"]["location"]).alias("location"), x["o"]["evidence"].alias("evidence"))


def _finding(x: Column) -> Column:
    o = x["o"]
    return F.struct(*[o[n].alias(n) for n in _FINDING], F.transform(_each(_many(o["instances"]), _INSTANCE), _instance).alias("instances"))


def _examples(texts: Column) -> Column:
    ex = _each(texts, [*_EXAMPLE, "expected_envelope"])
    ex = F.transform(ex, lambda x: F.struct(x["o"].alias("o"), _object(x["o"]["expected_envelope"], ["run", "findings"]).alias("e")))
    ex = F.transform(ex, lambda x: F.struct(x["o"].alias("o"), _object(x["e"]["run"], _RUN).alias("run"), _each(_many(x["e"]["findings"]), [*_FINDING, "instances"]).alias("f")))
    return F.transform(ex, lambda x: F.struct(*[x["o"][n].alias(n) for n in _EXAMPLE], x["o"]["expected_envelope"].isNotNull().alias("has_envelope"), *[x["run"][n].alias(n) for n in _RUN], F.transform(x["f"], _finding).alias("findings")))


def _texts(df: DataFrame, key: str, record: str) -> DataFrame:
    """``record_id`` and the texts of the record's examples (``_t``)."""
    r = F.ltrim(F.col(record).cast("string"))
    r = F.when(r.startswith('"'), F.from_json(F.concat(F.lit("["), r, F.lit("]")), "array<string>")[0]).otherwise(r)
    batch = _object(r, ["examples"])["examples"]
    texts = F.when(r.isNull(), F.array().cast("array<string>")).otherwise(_many(F.coalesce(batch, r)))
    return df.select(F.col(key).cast("long").alias("record_id"), texts.alias("_t"))


def regular(df: DataFrame, key: str = "record_id", record: str = "record") -> DataFrame:
    """``record_id`` and the record's examples in one regular nested shape, by built-in functions only."""
    return _texts(df, key, record).select("record_id", _examples(F.col("_t")).alias("examples"))


def envelopes(df: DataFrame, key: str = "record_id", record: str = "record") -> DataFrame:
    """``record_id``, ``example_no`` and each example's envelope as JSON text (``doc``) with a list of findings and a summary.

    Shapes vary as in ``flatten``; a finding that is no object is null, so that it still counts. Examples without an
    envelope object give no row.
    """
    e = _texts(df, key, record).select("record_id", F.posexplode("_t").alias("example_no", "t"))
    e = e.select("record_id", "example_no", _object(F.col("t"), ["expected_envelope"])["expected_envelope"].alias("t")).where(F.ltrim("t").startswith("{"))
    e = e.select("record_id", "example_no", _object(F.col("t"), ["findings", "summary"]).alias("e"))
    whole = lambda t: F.when(F.ltrim(t).startswith("{") & F.get_json_object(t, "$").isNotNull(), t).otherwise("null")
    doc = F.concat(F.lit('{"findings":['), F.array_join(F.transform(_many(F.col("e.findings")), whole), ","), F.lit('],"summary":'), whole(F.col("e.summary")), F.lit("}"))
    return e.select("record_id", "example_no", doc.alias("doc"))


def _children(lists: pa.Array, outer: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(child values, parent index, position) of a list array; ``outer`` gives an empty list one null child at -1."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values, n = lists.flatten(), len(lengths)
    if not outer:
        parent = np.repeat(np.arange(n), lengths)
        return values, parent, np.arange(len(parent)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    wide = np.maximum(lengths, 1)
    parent = np.repeat(np.arange(n), wide)
    pos = np.arange(len(parent)) - np.repeat(np.cumsum(wide) - wide, wide)
    empty = np.repeat(lengths == 0, wide)
    at = pos + np.repeat(np.cumsum(lengths) - lengths, wide)
    return values.take(pa.array(at, pa.int64(), mask=empty)), parent, np.where(empty, -1, pos)


def _empty_text(a: pa.Array) -> pa.Array:
    return pc.fill_null(a, "")


def _levels(b: pa.RecordBatch, depth: int, outer: bool) -> pa.Table:
    ids, lists = b.column(0), b.column(1)
    ex, parent, ex_no = _children(lists, False)
    ids = ids.take(pa.array(parent))
    cols = {"record_id": ids, "example_no": pa.array(ex_no, pa.int64())}
    if depth == 1:
        return pa.table(cols | {n: ex.field(n) for n in [*_EXAMPLE, "has_envelope", *_RUN]})
    fi, parent, f_no = _children(ex.field("findings"), False)
    take = pa.array(parent)
    cols = {k: v.take(take) for k, v in cols.items()} | {"skill": _empty_text(ex.field("skill").take(take)), "finding_no": pa.array(f_no, pa.int64()), "finding_id": _empty_text(fi.field("id"))}
    if depth == 2:
        return pa.table(cols | {n: fi.field(n) for n in _FINDING[1:]})
    ins, parent, i_no = _children(fi.field("instances"), outer)
    take = pa.array(parent)
    cols = {k: v.take(take) for k, v in cols.items()} | {"instance_no": pa.array(i_no, pa.int64()), "instance_location": _empty_text(ins.field("location"))}
    return pa.table(cols | {"instance_evidence": ins.field("evidence")})


_TABLES = {
    "examples": (1, False, "record_id bigint, example_no bigint, " + ", ".join(f"{n} string" for n in _EXAMPLE) + ", has_envelope boolean, " + ", ".join(f"`{n}` string" for n in _RUN)),
    "findings": (2, False, "record_id bigint, example_no bigint, skill string, finding_no bigint, finding_id string, " + ", ".join(f"{n} string" for n in _FINDING[1:])),
    "instances": (3, False, "record_id bigint, example_no bigint, skill string, finding_no bigint, finding_id string, instance_no bigint, instance_location string, instance_evidence string"),
}


def flatten(df: DataFrame, table: str, key: str = "record_id", record: str = "record", outer: bool = False) -> DataFrame:
    """One of the linked flat tables: ``examples`` (with the envelope's run), ``findings`` or ``instances``.

    Children link to parents by (record_id, example_no, finding_no, instance_no), positions from 0. A record may be
    one example, a list, an object with ``examples``, or JSON text of these. A lone value where a list is due is a
    list of one, JSON text where an object is due is that object, a string as an instance is its location. Null or
    missing parts give no rows below them; missing skill, id and location are empty strings; a null or unreadable
    record gives an example without findings (null: no example). ``outer`` keeps findings without instances, at
    instance_no -1. Other columns of ``df`` are left out. Narrow: no shuffle.
    """
    depth, _, schema = _TABLES[table]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _levels(b, depth, outer).combine_chunks().to_batches()

    return regular(df, key, record).mapInArrow(run, schema)
