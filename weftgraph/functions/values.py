"""Cleaning and typing of annotation values, on Arrow arrays."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLANKS = " \t\u00a0"
DATE_FORMS = (r"^(?P<y>[0-9]{4})-(?P<m>[0-9]{2})-(?P<d>[0-9]{2})$", r"^(?P<d>[0-9]{2})\.(?P<m>[0-9]{2})\.(?P<y>[0-9]{4})$", r"^(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})$")


def nfc(val: pa.Array) -> pa.Array:
    """Unicode NFC; only texts beyond ASCII are looked at, each different one once. (Arrow's own function leaves some texts decomposed.)"""
    val = val.cast(pa.string())
    plain = pc.fill_null(pc.string_is_ascii(val), True)
    if pc.all(plain).as_py() is not False:
        return val
    odd = pc.if_else(plain, pa.scalar(None, pa.string()), val).dictionary_encode()
    made = pa.array([unicodedata.normalize("NFC", x) for x in odd.dictionary.to_pylist()], pa.string())
    return pc.coalesce(made.take(odd.indices), val)


def clean(val: pa.Array) -> pa.Array:
    """NFC, without spaces, tabs and U+00A0 at both ends; null where nothing or ``NULL`` is left."""
    v = pc.utf8_trim(nfc(val), characters=BLANKS)
    return pc.if_else(pc.or_(pc.equal(v, ""), pc.equal(v, "NULL")), pa.scalar(None, pa.string()), v)


def cleaned(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``clean`` applied to a column."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([clean(x) if i == at else x for i, x in enumerate(b.columns)], names=b.schema.names)

    return df.mapInArrow(run, df.schema)


def _integer(v: pa.Array) -> pa.Array:
    ok = pc.match_substring_regex(v, r"^[+-]?[0-9]{1,9}$")
    return pc.if_else(ok, pc.cast(pc.cast(pc.replace_substring_regex(pc.if_else(ok, v, "0"), r"^\+", ""), pa.int64()), pa.string()), pa.scalar(None, pa.string()))


def _decimal(v: pa.Array) -> pa.Array:
    """Written without plus sign, needless zeros and a negative zero, so that equal numbers are equal texts at any length."""
    ok = pc.match_substring_regex(v, r"^[+-]?[0-9]+([.,][0-9]+)?$")
    x = pc.replace_substring(pc.if_else(ok, v, "0"), ",", ".")
    x = pc.replace_substring_regex(x, r"^\+", "")
    x = pc.replace_substring_regex(x, r"(\.[0-9]*?)0+$", r"\1")
    x = pc.replace_substring_regex(x, r"\.$", "")
    x = pc.replace_substring_regex(x, r"^(-?)0+([0-9])", r"\1\2")
    x = pc.replace_substring_regex(x, r"^-0$", "0")
    return pc.if_else(ok, x, pa.scalar(None, pa.string()))


def _boolean(v: pa.Array) -> pa.Array:
    low = pc.utf8_lower(v)
    yes, no = (pc.is_in(low, pa.array(x)) for x in (["true", "yes", "1"], ["false", "no", "0"]))
    return pc.if_else(yes, "true", pc.if_else(no, "false", pa.scalar(None, pa.string())))


def _date(v: pa.Array) -> pa.Array:
    out = pa.nulls(len(v), pa.string())
    for form in DATE_FORMS:
        part = pc.extract_regex(v, pattern=form)
        ok = pc.fill_null(pc.is_valid(part), False)
        y, m, d = (pc.if_else(ok, pc.struct_field(part, k), "01") for k in "ymd")
        yn, mn, dn = (pc.cast(x, pa.int32()) for x in (y, m, d))
        zero = pa.scalar(0, pa.int32())
        rest = lambda a, n: pc.subtract(a, pc.multiply(pc.divide(a, n), n))
        leap = pc.and_(pc.equal(rest(yn, 4), zero), pc.or_(pc.not_equal(rest(yn, 100), zero), pc.equal(rest(yn, 400), zero)))
        short = pc.is_in(mn, pa.array([4, 6, 9, 11], pa.int32()))
        last = pc.if_else(pc.equal(mn, 2), pc.if_else(leap, 29, 28), pc.if_else(short, 30, 31))
        real = pc.and_(pc.and_(pc.greater_equal(yn, 1), pc.and_(pc.greater_equal(mn, 1), pc.less_equal(mn, 12))), pc.and_(pc.greater_equal(dn, 1), pc.less_equal(dn, last)))
        out = pc.if_else(pc.and_(ok, real), pc.binary_join_element_wise(y, m, d, "-"), out)
    return out


TYPES = {"integer": _integer, "decimal": _decimal, "boolean": _boolean, "date": _date, "string": lambda v: v}


def typed(val: pa.Array, kind: pa.Array) -> pa.Array:
    """The one written form of each cleaned value under its ``val_type``; null where it isn't valid.

    A type that isn't known counts as ``string``.
    """
    out = val
    for name in ("integer", "decimal", "boolean", "date"):
        mine = pc.fill_null(pc.equal(kind, name), False)
        if pc.any(mine).as_py():
            out = pc.if_else(mine, TYPES[name](pc.if_else(mine, val, pa.scalar(None, pa.string()))), out)
    return out
