"""Delimited lines to typed rows, with every rejected line kept beside its reasons.

Structural rejects come from the invalid-row callback of the Arrow CSV reader; all fields are read as strings and
the cells are validated as vectors afterwards, so a bad cell never costs the row its other values.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of a delivered finding, in order, and the values its checked cells may hold.
FIELDS = ["finding_id", "criterion", "lane", "severity", "location", "evidence", "confidence", "emitted"]
SEPARATORS = {"csv": ",", "ssv": ";", "tsv": "\t"}
ALLOWED = {"severity": ["0", "1", "2", "3", "4"], "confidence": ["high", "medium", "low", ""], "lane": ["scripted", "judged", ""]}

_NAMES = ["key", *FIELDS, "reasons"]
_REST = ", ".join(f"{f} string" for f in FIELDS) + ", reasons array<string>"
#: Characters handed to the CSV reader at once.
_CHUNK = 32_000_000


def _pattern(sep: str) -> str:
    field = rf'(?:"(?:[^"]|"")*"|[^"{sep}]*)'
    return rf"\A{field}(?:{sep}{field})*\z"


def _shield(line: str, sep: str) -> str:
    """Put each field of a well-quoted line in quotes, so that line breaks outside quotes stay in their field."""
    parts = re.findall(rf'(?:^|{re.escape(sep)})("(?:[^"]|"")*"|[^"{re.escape(sep)}]*)', line)
    return sep.join(p if p[:1] == '"' else f'"{p}"' for p in parts)


def _read(lines: pa.Array, rows: pa.Array, sep: str) -> tuple[pa.Table, list[int]]:
    """Fields of the well-quoted ``lines``; the second value lists the row numbers rejected by the callback."""
    stray = pc.match_substring_regex(pc.replace_substring_regex(lines, '"(?:[^"]|"")*"', ""), "[\r\n]")
    if pc.any(stray).as_py():
        lines = pa.array([_shield(x, sep) if s else x for x, s in zip(lines.to_pylist(), stray.to_pylist())], pa.string())
    wrong: list[int] = []

    def invalid(row) -> str:
        wrong.append(int(row.text.split(sep, 1)[0]))
        return "skip"

    records = pc.binary_join_element_wise(pc.cast(rows, pa.string()), lines, sep).cast(pa.large_string())
    data = b"\n".join(x.as_buffer().to_pybytes() for x in records) + b"\n"
    out = pacsv.read_csv(
        pa.BufferReader(data),
        read_options=pacsv.ReadOptions(column_names=["_row", *FIELDS], use_threads=False, block_size=len(data) + 1),
        parse_options=pacsv.ParseOptions(delimiter=sep, newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types={"_row": pa.int64(), **dict.fromkeys(FIELDS, pa.string())}, strings_can_be_null=False),
    )
    return out, wrong


def _reasons(n: int, flags: list[tuple[str, pa.Array]]) -> pa.Array:
    """For each row the names of its set flags, in their order."""
    table = np.stack([f.to_numpy(zero_copy_only=False) for _, f in flags], axis=1)
    offsets = np.concatenate([[0], np.cumsum(table.sum(axis=1))]).astype(np.int32)
    names = pa.array([name for name, _ in flags], pa.string())
    return pa.ListArray.from_arrays(pa.array(offsets), names.take(pa.array(np.nonzero(table)[1])))


def _batch(ids: pa.Array, fmts: pa.Array, lines: pa.Array) -> Iterator[pa.RecordBatch]:
    lines = pc.fill_null(lines, "")
    seps = pc.fill_null(fmts, "csv")
    known = pc.is_in(seps, pa.array(list(SEPARATORS)))
    for name, sep in SEPARATORS.items():
        mine = pc.equal(seps, name)
        if name == "csv":
            mine = pc.or_(mine, pc.invert(known))
        text, own = lines.filter(mine), ids.filter(mine)
        if not len(text):
            continue
        quoted = pc.match_substring_regex(text, _pattern(sep))
        broken = own.filter(pc.invert(quoted))
        rejected = [(broken, "quoting")]
        good, good_ids = text.filter(quoted), own.filter(quoted)
        if len(good):
            rows, wrong = _read(good, pa.array(range(len(good)), pa.int64()), sep)
            rejected.append((good_ids.take(pa.array(wrong, pa.int64())), "column_count"))
            if rows.num_rows:
                rows = rows.combine_chunks()
                flags = [(f, pc.invert(pc.is_in(rows[f].combine_chunks(), pa.array(ok)))) for f, ok in ALLOWED.items()]
                cols = [good_ids.take(rows["_row"].combine_chunks()), *[rows[f].combine_chunks() for f in FIELDS], _reasons(rows.num_rows, flags)]
                yield pa.RecordBatch.from_arrays(cols, names=_NAMES)
        for which, reason in rejected:
            if n := len(which):
                why = pa.ListArray.from_arrays(pa.array(range(n + 1), pa.int32()), pa.array([reason] * n, pa.string()))
                yield pa.RecordBatch.from_arrays([which, *[pa.nulls(n, pa.string())] * len(FIELDS), why], names=_NAMES)


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        start, size = 0, 0
        lengths = pc.fill_null(pc.binary_length(b.column(2)), 0).to_pylist()
        for i, k in enumerate(lengths):
            size += k
            if size > _CHUNK or i + 1 == len(lengths):
                part = b.slice(start, i + 1 - start)
                yield from _batch(part.column(0), part.column(1), part.column(2))
                start, size = i + 1, 0


def parse_lines(df: DataFrame, key: str = "line_id", fmt: str = "fmt", line: str = "line", also: tuple[str, ...] = ()) -> DataFrame:
    """Every line of ``df`` once, split into its fields, with the list of reasons it fails for (empty: loaded).

    ``fmt`` names the separator: csv comma, ssv semicolon, tsv tab; any other or null value is read as csv. A null
    line is an empty line, which is one field (``column_count``). Reasons: ``quoting`` (then no other), else
    ``column_count``, else any of ``severity``, ``confidence`` and ``lane``. Fields are null where the line did not
    split. Repeated rows stay repeated; the columns ``also`` are carried along, the others of ``df`` are left out,
    whatever their names. Texts of any length are read whole. An empty table gives an empty result. Narrow: no shuffle.
    """
    k = F.struct(F.col(key).cast("long").alias("line_id"), *[F.col(c) for c in also])
    rows = df.select(k.alias("key"), F.col(fmt).cast("string").alias("fmt"), F.col(line).cast("string").alias("line"))
    parsed = rows.mapInArrow(_map, f"key {rows.schema['key'].dataType.simpleString()}, {_REST}")
    return parsed.select("key.*", *FIELDS, "reasons")


def rejected(parsed: DataFrame) -> DataFrame:
    """One row for each failed line and reason."""
    return parsed.select("line_id", F.explode("reasons").alias("reason"))


def loaded(parsed: DataFrame) -> DataFrame:
    """The lines without a reason, typed: severity as int, empty lane and confidence as null, emitted as timestamp."""
    ok = parsed.where(F.size("reasons") == 0).drop("reasons")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    return ok.withColumns({"severity": F.expr("try_cast(severity AS int)"), "lane": blank("lane"), "confidence": blank("confidence"), "emitted": F.expr("try_to_timestamp(emitted)")})
