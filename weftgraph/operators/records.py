"""Loading of delimited lines: typed rows for what can be loaded, a reason for what can't.

Each line is one record. It is first assembled quote-aware (which fields are
quoted, line ends kept as ordinary characters), then read by Python's csv
reader in strict mode, whose exceptions become the reason ``quoting``, then
counted (``columns``) and at last handed to the constructors of its typed
fields (``value``). The first reason that applies counts.

Defined cases: a null line or one of a source without a layout has no fields
and is put aside as ``columns``; an empty line has no fields either; lines of
any length are read whole; repeated lines give repeated rows; further columns
of the input are left out; an empty input gives empty outputs.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the line format.
NULL_MARK = "NULL"
U32_MAX = 4294967295

_U32 = re.compile(r"[0-9]{1,10}")
_BAD = re.compile("[\x00-\x08\x0a-\x1f\x7f�]")
_SEGMENTATION = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")
_QUOTED = re.compile(r'"(?:[^"]|"")*"')


def u32(v: str | None) -> int:
    if v is None or not _U32.fullmatch(v) or int(v) > U32_MAX:
        raise ValueError
    return int(v)


def u32_or_null(v: str | None) -> int | None:
    return None if v is None else u32(v)


def name(v: str | None) -> str:
    if v is None or not v.strip(" \t") or _BAD.search(v):
        raise ValueError
    return v


def clean_text(v: str | None) -> str:
    if v is None or _BAD.search(v):
        raise ValueError
    return v


def segmentation(v: str | None) -> str | None:
    if v is not None and not _SEGMENTATION.fullmatch(v):
        raise ValueError
    return v


def anything(v: str | None) -> str | None:
    return v


@dataclass(frozen=True)
class Layout:
    """Fields of a source as (name, Spark type, constructor), and a check over the constructed row."""

    fields: tuple[tuple[str, str, Callable], ...]
    whole: Callable[[dict], bool] = lambda row: True


def _node_holds(r: dict) -> bool:
    return r["left_char"] <= r["right_char"] and not (r["segmentation"] is not None and r["token_index"] is None and r["seg_index"] is None)


TEXT = Layout((("corpus_ref", "bigint", u32), ("text_id", "bigint", u32), ("text_name", "string", name), ("val", "string", clean_text)))
NODE = Layout(
    (
        ("node_id", "bigint", u32), ("text_id", "bigint", u32), ("corpus_ref", "bigint", u32), ("anno_layer", "string", anything), ("node_name", "string", name), ("left_char", "bigint", u32), ("right_char", "bigint", u32),
        ("token_index", "bigint", u32_or_null), ("left_token", "bigint", u32), ("right_token", "bigint", u32), ("seg_index", "bigint", u32_or_null), ("segmentation", "string", segmentation), ("span_text", "string", anything), ("root", "string", anything),
    ),
    _node_holds,
)
LAYOUTS = {"text.annis": TEXT, "node.annis": NODE}


class _Ends(dict):
    """Stand-ins for line ends within a record, which the csv reader would take for the record's end."""

    def __init__(self, line: str):
        free = (chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in line)
        super().__init__({ord(c): next(free) for c in "\r\n"})
        self.back = {ord(v): chr(k) for k, v in self.items()}


def _quoted_flags(line: str) -> list[bool]:
    """Which fields of a well-formed record are quoted."""
    flags, at = [], 0
    while True:
        if quoted := line.startswith('"', at):
            at = _QUOTED.match(line, at).end()
        else:
            at = end if (end := line.find("\t", at)) >= 0 else len(line)
        flags.append(quoted)
        if at >= len(line):
            return flags
        at += 1


def read_records(lines: Iterable[str | None]) -> Iterator[list[str | None] | None]:
    """The fields of each line, with None for an unquoted NULL; None for a line with broken quoting."""
    csv.field_size_limit(sys.maxsize)
    form = {"delimiter": "\t", "quotechar": '"', "doublequote": True, "strict": True}
    for line in lines:
        if line is None:
            yield []
            continue
        ends = _Ends(line) if "\n" in line or "\r" in line else None
        if ends:
            line = line.translate(ends)
        try:
            fields = next(csv.reader([line], **form), [])
        except csv.Error:
            yield None
            continue
        if NULL_MARK in fields:
            quoted = _quoted_flags(line) if '"NULL"' in line else [False] * len(fields)
            fields = [None if f == NULL_MARK and not q else f for f, q in zip(fields, quoted)]
        if ends:
            fields = [f and f.translate(ends.back) for f in fields]
        yield fields


def construct(fields: list[str | None] | None, layout: Layout | None) -> tuple[dict | None, str | None]:
    """The typed row, or the reason why there is none."""
    if fields is None:
        return None, "quoting"
    if layout is None or len(fields) != len(layout.fields):
        return None, "columns"
    try:
        row = {n: make(v) for (n, _, make), v in zip(layout.fields, fields)}
    except ValueError:
        return None, "value"
    return (row, None) if layout.whole(row) else (None, "value")


def parse_lines(lines: DataFrame, layouts: dict[str, Layout] = LAYOUTS, line_id: str = "line_id", src: str = "src_file", raw: str = "raw", wanted: Iterable[str] | None = None) -> DataFrame:
    """One row a line: line_id, src_file, reason (null where it loads) and one struct of typed fields for each layout.

    ``loaded`` and ``rejected`` take their part of it. ``wanted`` names the
    sources whose typed rows are handed on; those of the others are built, as
    that is how their values are checked, and dropped. One narrow pass, no shuffle.
    """
    keys = sorted(layouts if wanted is None else wanted)
    cols = {k: "row_" + re.sub(r"\W", "_", k) for k in keys}
    arrow = {"bigint": pa.int64(), "string": pa.string()}
    structs = {k: pa.struct([(n, arrow[t]) for n, t, _ in layouts[k].fields]) for k in keys}
    ddl = ", ".join(["line_id bigint", "src_file string", "reason string"] + [f"{cols[k]} struct<{', '.join(f'{n}: {t}' for n, t, _ in layouts[k].fields)}>" for k in keys])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sources, raws = (b.column(i) for i in range(3))
            files = sources.to_pylist()
            rows: dict[str, list] = {k: [None] * len(files) for k in keys}
            reasons: list[str | None] = []
            for i, (f, fields) in enumerate(zip(files, read_records(raws.to_pylist()))):
                row, why = construct(fields, layouts.get(f))
                reasons.append(why)
                if row is not None and f in rows:
                    rows[f][i] = row
            yield pa.RecordBatch.from_arrays([ids, sources, pa.array(reasons, pa.string()), *(pa.array(rows[k], structs[k]) for k in keys)], names=["line_id", "src_file", "reason", *cols.values()])

    return lines.select(F.col(line_id).cast("bigint"), F.col(src).cast("string"), F.col(raw).cast("string")).mapInArrow(run, ddl)


def loaded(parsed: DataFrame, source: str) -> DataFrame:
    """The typed rows of one source."""
    c = "row_" + re.sub(r"\W", "_", source)
    return parsed.filter(F.col("reason").isNull() & (F.col("src_file") == source)).select("line_id", f"{c}.*")


def rejected(parsed: DataFrame) -> DataFrame:
    """line_id and reason of the lines put aside."""
    return parsed.filter(F.col("reason").isNotNull()).select("line_id", "reason")
