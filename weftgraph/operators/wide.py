"""Entity-attribute-value rows into wide tables, as log-structured upserts.

1. A batch of rows becomes sparse wide deltas: each task makes one row an
   entity, with a list of cells (attribute, version, least and greatest valid
   value) in the order of the attributes. An entity with a third of all rows
   so sends a row for some hundred thousand of its rows.
2. The deltas of a batch are brought together by entity and merged into a
   sorted run: one row an entity, in its order.
3. Compaction merges sorted runs in the same way. Of each cell the latest
   version that has a valid value stands; if that version has several that
   differ once typed, or no version has any, the cell has no value and is
   reported.

A version is a number or a column that the caller gives; a batch without one
is of version 0. Since the version decides and not the order of arrival, runs
may be merged in any order and as often as wished. ``Runs`` keeps them in a
shared folder.

An attribute is named by the least of the symbols that stand for one qualified
name.

Defined cases: null, blank and ``NULL`` values and unknown attributes make no
cell; a null entity is an entity of its own; repeated rows change nothing; an
entity without any value has no row; an invalid value never hides a valid one;
wide columns are named ``namespace__name`` (``name`` without namespace), and
attributes beyond ``max_columns`` stand in the column ``further``, a map by
that name; decimals beyond 28 digits before or 10 after the point have no
typed column value and are given by ``unfit``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.files import Files
from ..functions.skew import BROADCAST_ROWS, lookup_join
from ..functions.values import clean, typed

#: Attributes that get a column of their own.
MAX_COLUMNS = 2000
#: Runs that are merged once there are so many.
FAN_IN = 8
#: Cells that a task combines before it sends their deltas.
HELD_CELLS = 200_000
SPARK_TYPES = {"integer": "int", "decimal": "decimal(38,10)", "boolean": "boolean", "date": "date", "string": "string"}

#: ``hi`` is null where it is ``lo``; both are null where no value is valid.
SCHEMA = "node_id bigint, cells array<struct<attr: int, version: bigint, lo: string, hi: string>>"
_CELL = pa.struct([("attr", pa.int32()), ("version", pa.int64()), ("lo", pa.string()), ("hi", pa.string())])


@dataclass
class Attributes:
    """(anno_key, attr, anno_ns, anno_name, val_type) of every symbol, ``attr`` the least one of its qualified name."""

    df: DataFrame
    #: So many rows at least; exact up to BROADCAST_ROWS
    rows: int

    def names(self) -> DataFrame:
        """(attr, anno_ns, anno_name)"""
        return self.df.filter("anno_key = attr").select("attr", "anno_ns", "anno_name")


def attributes(symbols: DataFrame | Attributes) -> Attributes:
    """A table of at most BROADCAST_ROWS symbols is read once; a longer one stays where it is."""
    if isinstance(symbols, Attributes):
        return symbols
    one = symbols.groupBy("anno_key").agg(F.min(F.struct("anno_ns", "anno_name", "val_type")).alias("k")).select(F.col("anno_key").cast("int"), "k.*").na.drop(subset=["anno_key"])
    few = one.limit(BROADCAST_ROWS + 1).collect()
    if len(few) > BROADCAST_ROWS:
        return Attributes(one.withColumn("attr", F.min("anno_key").over(Window.partitionBy("anno_ns", "anno_name"))), len(few))
    least: dict[tuple, int] = {}
    for r in sorted(few, key=lambda r: r.anno_key):
        least.setdefault((r.anno_ns, r.anno_name), r.anno_key)
    rows = [(*r, least[r.anno_ns, r.anno_name]) for r in few]
    return Attributes(symbols.sparkSession.createDataFrame(rows, "anno_key int, anno_ns string, anno_name string, val_type string, attr int"), len(few))


def _wide(node: pa.Array, cells: pa.StructArray, first: np.ndarray) -> pa.RecordBatch:
    """Rows of an entity each, from cells in order; ``first`` says where each begins."""
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(node)], pa.int32()), cells)
    return pa.RecordBatch.from_arrays([node.take(pa.array(first)), lists], names=["node_id", "cells"])


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before in some column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _merged(entity: np.ndarray, attr: pa.Array, version: pa.Array, lo: pa.Array, hi: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """The entity and the state of each cell, in order of both; ``hi`` is given where ``lo`` is."""
    a, v = attr.to_numpy(zero_copy_only=False), version.to_numpy(zero_copy_only=False)
    order = np.lexsort((v, a, entity))
    entity, a, v = entity[order], a[order], v[order]
    take = pa.array(order)
    lo, hi = lo.take(take), hi.take(take)
    begins = _begins(entity, a)
    first, cell = np.flatnonzero(begins), np.cumsum(begins) - 1
    valid = pc.is_valid(lo).to_numpy(zero_copy_only=False)
    decides = valid
    if len(v) and (v != v[0]).any():
        latest = np.maximum.reduceat(np.where(valid, v, np.iinfo(np.int64).min), first)
        decides = valid & (v == latest[cell])
    # rows that decide alone are taken as they are, the others are combined
    at = np.flatnonzero(decides)
    n = np.bincount(cell[at], minlength=len(first))
    alone = at[n[cell[at]] == 1]
    source = np.full(len(first), -1)
    source[cell[alone]] = alone
    several = at[n[cell[at]] > 1]
    if len(several):
        g = pa.table({"c": pa.array(cell[several]), "lo": lo.take(pa.array(several)), "hi": hi.take(pa.array(several))}).group_by("c").aggregate([("lo", "min"), ("hi", "max")]).combine_chunks()
        source[g["c"].to_numpy()] = len(lo) + np.arange(len(g))
        both = lambda x, more: pa.concat_arrays([x, more.combine_chunks() if isinstance(more, pa.ChunkedArray) else more])
        lo, hi = both(lo, g["lo_min"]), both(hi, g["hi_max"])
    pick = pa.array(source, mask=source < 0)
    lo, hi = lo.take(pick), hi.take(pick)
    stands = np.where(n > 0, np.maximum.reduceat(np.where(decides, v, np.iinfo(np.int64).min), first), v[np.r_[first[1:], len(v)] - 1]) if len(first) else v
    hi = pc.if_else(pc.equal(lo, hi), pa.scalar(None, pa.string()), hi)
    return entity[first], pa.StructArray.from_arrays([pa.array(a[first], pa.int32()), pa.array(stands, pa.int64()), lo, hi], fields=list(_CELL))


def deltas(annos: DataFrame, symbols: DataFrame | Attributes, version: int | Column = 0) -> DataFrame:
    """Sparse wide rows (``SCHEMA``) of a batch of (node_id, anno_key, val), several of an entity where several tasks saw it."""
    at = F.lit(version) if isinstance(version, int) else version
    keys = attributes(symbols)
    rows = annos.select("node_id", "anno_key", "val", at.cast("bigint").alias("version"))
    keyed = lookup_join(rows, keys.df.select("anno_key", "attr", "val_type"), ["anno_key"], rows=keys.rows).select("node_id", "attr", "version", "val_type", "val")

    def sent(held: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(held).combine_chunks()
        g = t.group_by(["node_id", "attr", "version"], use_threads=False).aggregate([("t", "min"), ("t", "max")])
        g = g.sort_by("node_id").combine_chunks()
        node = g["node_id"].combine_chunks()
        entity = np.cumsum(_begins(pc.fill_null(node, 0).to_numpy(), pc.is_null(node).to_numpy(zero_copy_only=False)))
        heads, cells = _merged(entity, *(g[c].combine_chunks() for c in ("attr", "version", "t_min", "t_max")))
        first = np.flatnonzero(_begins(heads))
        return _wide(node.take(pa.array(np.searchsorted(entity, heads))), cells, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            val = clean(b.column(4))
            cells = pa.table([*b.columns[:3], typed(val, b.column(3))], names=["node_id", "attr", "version", "t"]).filter(pc.is_valid(val))
            if cells.num_rows:
                held.append(cells)
                n += cells.num_rows
            if n >= HELD_CELLS:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    return keyed.mapInArrow(run, SCHEMA)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of the entity, of which several may have the same, to one an entity."""

    def one(rows: pa.Table) -> pa.RecordBatch:
        node, lists = rows["node_id"].combine_chunks(), rows["cells"].combine_chunks()
        entity = np.cumsum(_begins(pc.fill_null(node, 0).to_numpy(), pc.is_null(node).to_numpy(zero_copy_only=False)))
        cells = lists.flatten()
        attr, version, lo, hi = cells.flatten()
        of = np.repeat(entity, pc.list_value_length(lists).to_numpy())
        heads, merged = _merged(of, attr, version, lo, pc.coalesce(hi, lo))
        return _wide(node.take(pa.array(np.searchsorted(entity, heads))), merged, np.flatnonzero(_begins(heads)))

    held: list[pa.Table] = []
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        node = b.column(0)
        last = node[-1]
        same = pc.is_null(node) if last.as_py() is None else pc.fill_null(pc.equal(node, last), False)
        begin = int(np.argmax(same.to_numpy(zero_copy_only=False)))
        if begin:
            yield one(pa.concat_tables([*held, t.slice(0, begin)]))
            held = []
        elif held and held[-1]["node_id"][0].as_py() != last.as_py():
            yield one(pa.concat_tables(held))
            held = []
        held.append(t.slice(begin))
    if held:
        yield one(pa.concat_tables(held))


def sorted_run(rows: DataFrame, *more: DataFrame) -> DataFrame:
    """Deltas and runs merged into one run: one row an entity, in the entity's order within each partition."""
    for m in more:
        rows = rows.unionByName(m)
    return rows.repartition("node_id").sortWithinPartitions("node_id").mapInArrow(_merge, SCHEMA)


def _conflict(cell: Column) -> Column:
    return cell["lo"].isNull() | cell["hi"].isNotNull()


def conflicts(run: DataFrame, symbols: DataFrame | Attributes) -> DataFrame:
    """(node_id, anno_ns, anno_name) of the cells to which no single typed value can be given."""
    bad = run.select("node_id", F.explode(F.transform(F.filter("cells", _conflict), lambda c: c["attr"])).alias("attr"))
    keys = attributes(symbols)
    return lookup_join(bad, keys.names(), ["attr"], rows=keys.rows).select("node_id", "anno_ns", "anno_name")


def column_name(ns: str | None, name: str | None) -> str:
    return f"{ns}__{name}" if ns else f"{name}"


def _values(run: DataFrame) -> DataFrame:
    """(node_id, value): the single values of each entity, a map by attribute."""
    good = F.filter("cells", lambda c: ~_conflict(c))
    return run.select("node_id", F.map_from_entries(F.transform(good, lambda c: F.struct(c["attr"], c["lo"]))).alias("value"))


def widen(run: DataFrame, symbols: DataFrame | Attributes, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """One row an entity with a typed column for each qualified key of ``symbols``, the first ``max_columns`` by name, and ``further`` if there are more."""
    names = attributes(symbols).df.groupBy("anno_ns", "anno_name", "attr").agg(F.min("val_type").alias("val_type"), F.countDistinct("val_type").alias("n"))
    keys = names.orderBy("anno_ns", "anno_name").limit(max_columns + 1).collect()
    more, keys = keys[max_columns:], keys[:max_columns]

    def column(k) -> Column:
        kind = SPARK_TYPES.get(k.val_type, "string") if k.n == 1 else "string"
        value = F.try_element_at("value", F.lit(k.attr))
        if kind.startswith("decimal"):
            value = F.when(_fits(value), value)
        return value.try_cast(kind).alias(column_name(k.anno_ns, k.anno_name))

    wide = _values(run)
    if not more:
        return wide.select("node_id", *(column(k) for k in keys))
    own = F.array(*[F.lit(k.attr) for k in keys]).cast("array<int>")
    rest = wide.select("node_id", F.explode(F.map_filter("value", lambda a, _: ~F.array_contains(own, a))).alias("attr", "text"))
    called = names.select("attr", F.when(F.coalesce(F.col("anno_ns"), F.lit("")) == "", F.col("anno_name")).otherwise(F.concat_ws("__", "anno_ns", "anno_name")).alias("called")).filter("called is not null")
    further = lookup_join(rest, called, ["attr"]).groupBy("node_id").agg(F.map_from_entries(F.collect_set(F.struct("called", "text"))).alias("further")).withColumnRenamed("node_id", "_n")
    return wide.join(further, F.col("node_id").eqNullSafe(F.col("_n")), "left").select("node_id", *(column(k) for k in keys), "further")


def _fits(value: Column) -> Column:
    return value.rlike(r"\A-?[0-9]{1,28}(\.[0-9]{1,10})?\z")


def unfit(run: DataFrame, symbols: DataFrame | Attributes) -> DataFrame:
    """(node_id, anno_ns, anno_name, value) of the valid decimals that ``widen`` can't type without loss."""
    decimal = attributes(symbols).df.groupBy("anno_ns", "anno_name", "attr").agg(F.min("val_type").alias("lo"), F.max("val_type").alias("hi")).filter("lo = 'decimal' and hi = 'decimal'").select("attr", "anno_ns", "anno_name")
    cells = _values(run).select("node_id", F.explode("value").alias("attr", "value")).filter(~_fits(F.col("value")))
    return lookup_join(cells, decimal, ["attr"]).select("node_id", "anno_ns", "anno_name", "value")


class Runs:
    """Sorted runs in a shared folder, merged once there are ``FAN_IN``; read as one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Files(spark, path)

    def names(self) -> list[str]:
        """The runs that stand: those written to the end and not merged into one that was."""
        whole = [n for n in self.files.names(self.files.root) if n.startswith("run-") and self.files.exists(self.files.at(n, "_SUCCESS"))]
        gone = {m for n in whole if self.files.exists(at := self.files.at(n, "_MERGED")) for m in self.files.read(at).split()}
        return [n for n in whole if n not in gone]

    def _read(self, names: list[str]) -> list[DataFrame]:
        return [self.spark.read.schema(SCHEMA).parquet(self.files.at(n)) for n in names] or [self.spark.createDataFrame([], SCHEMA)]

    def upsert(self, annos: DataFrame, symbols: DataFrame | Attributes, version: int | Column = 0) -> None:
        """Adds a batch as a run of its own. A batch that is added again changes nothing."""
        sorted_run(deltas(annos, symbols, version)).write.parquet(self.files.at(f"run-{uuid.uuid4().hex}"))
        if len(self.names()) >= FAN_IN:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one; they are dropped once it stands."""
        old = self.names()
        if len(old) < 2:
            return
        name = f"run-{uuid.uuid4().hex}"
        self.files.write(self.files.at(name, "_MERGED"), "\n".join(old))
        sorted_run(*self._read(old)).write.mode("append").parquet(self.files.at(name))
        for n in old:
            self.files.delete(self.files.at(n))

    def run(self) -> DataFrame:
        """All runs merged."""
        return sorted_run(*self._read(self.names()))
