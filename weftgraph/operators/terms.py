"""Exact frequency of every distinct term, by heavy-light aggregation.

1. Detection: a sketch of frequent items over all rows, of a fixed size and
   merged from all tasks, names at most ``max_heavy`` terms with more than
   ``share`` of the rows; so few that they are fit to be broadcast.
2. Counting: rows of a light term are shuffled by their term, so that one task
   sees them all and counts them for good. Rows of a heavy term are spread by
   the whole row; each task counts them into its own counters, one for each
   heavy term and record, and only these are added up. Both tables of counts
   are exact and are united.

Repeated rows count once: since equal rows meet in one task either way, they
are dropped there, by the same shuffle. Detection decides only which way a
term goes, never its count.

A term is a value under a qualified key, and a record a ``corpus_ref``.

Defined cases: a null, blank or ``NULL`` value is no term, nor is one under an
unknown key; a null record counts as an occurrence but not as a record; a null
node is a node of its own; an empty input gives no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import lookup_join
from ..functions.values import BLANKS, clean
from ..session import cut
from .wide import Attributes, attributes

#: A term with this share of all rows is heavy.
HEAVY_SHARE = 1 / 1000
MAX_HEAVY = 1000
#: Items that a task's sketch tracks; counts are off by less than 4 of so many parts of the rows.
TRACKED = 16_384

_ROW = "heavy int, attr int, val string, record bigint, node_id bigint, anno_key int, raw string"


def heavy_terms(annos: DataFrame, symbols: DataFrame | Attributes, max_heavy: int = MAX_HEAVY, share: float = HEAVY_SHARE) -> list[tuple[int, str]]:
    """At most ``max_heavy`` terms (attribute, value) with over ``share`` of the rows, values trimmed but otherwise as written."""
    item = F.concat(F.col("anno_key").cast("string"), F.lit("|"), F.btrim(F.col("val"), F.lit(BLANKS)))
    seen = annos.select(item.alias("item")).filter("item is not null").selectExpr(f"approx_top_k(item, {max_heavy}, {max(TRACKED, 2 * max_heavy)}) AS top", "count(*) AS n").first()
    named = [x.item.split("|", 1) for x in seen.top or [] if x["count"] >= max(2, seen.n * share)]
    known = {r.anno_key: r.attr for r in attributes(symbols).df.filter(F.col("anno_key").isin([int(k) for k, _ in named])).select("anno_key", "attr").collect()} if named else {}
    cleaned = clean(pa.array([v for _, v in named], pa.string())).to_pylist()
    return sorted({(known[int(k)], v) for (k, _), v in zip(named, cleaned) if v is not None and int(k) in known})


def _rows(annos: DataFrame, symbols: DataFrame | Attributes, heavy: list[tuple[int, str]]) -> DataFrame:
    """Rows with a value under a known key; ``heavy`` is the place of a heavy term, which then isn't repeated, ``raw`` the value as written where cleaning changed it."""
    keys = attributes(symbols)
    keyed = lookup_join(annos.select("node_id", "anno_key", "val", "corpus_ref"), keys.df.select("anno_key", "attr"), ["anno_key"], rows=keys.rows)
    sent = annos.sparkSession.sparkContext.broadcast([f"{a}|{v}" for a, v in heavy])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(sent.value, pa.string())
        none = pa.scalar(None, pa.string())
        for b in batches:
            node, key, raw, record, attr = b.columns
            val = clean(raw)
            changed = pc.if_else(pc.fill_null(pc.equal(raw, val), False), none, raw)
            at = pc.index_in(pc.binary_join_element_wise(pc.cast(attr, pa.string()), val, "|"), value_set=names)
            light = pc.is_null(at)
            t = pa.Table.from_arrays([at, pc.if_else(light, attr, pa.scalar(None, attr.type)), pc.if_else(light, val, none), record, node, key, changed], names=["heavy", "attr", "val", "record", "node_id", "anno_key", "raw"])
            if not len(names):
                yield from t.filter(pc.is_valid(val)).to_batches()
                continue
            yield from t.filter(pc.and_(light, pc.is_valid(val))).to_batches()
            # a row can only be repeated often if its term is heavy
            yield from t.filter(pc.invert(light)).group_by(t.column_names, use_threads=False).aggregate([]).to_batches()

    return keyed.select("node_id", F.col("anno_key").cast("int"), "val", F.col("corpus_ref").cast("bigint").alias("record"), "attr").mapInArrow(run, _ROW)


def term_counts(annos: DataFrame, symbols: DataFrame | Attributes, heavy: list[tuple[int, str]]) -> DataFrame:
    """(attr, val, n_rows, n_records) of every term."""
    spark = annos.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = [c.split()[0] for c in _ROW.split(", ")]
    is_light = F.col("heavy").isNull()
    shard = F.when(is_light, F.xxhash64("attr", "val")).otherwise(F.pmod(F.xxhash64("heavy", "record", "node_id", "anno_key", "raw"), F.lit(tasks)))
    placed = _rows(annos, symbols, heavy).withColumn("shard", shard).repartition("shard")
    # all of this is local to the task of the shard
    once = placed.select("shard", *own).distinct()
    by_record = once.groupBy("shard", "heavy", "attr", "val", "record").agg(F.count(F.lit(1)).alias("n"))
    counter = F.when(~is_light, F.col("record")).alias("of_record")
    local = cut(by_record.groupBy("shard", "heavy", "attr", "val", counter).agg(F.sum("n").alias("n_rows"), F.count("record").alias("n_records")))
    light = local.filter(is_light).select("attr", "val", "n_rows", "n_records")
    if not heavy:
        return light
    added = local.filter(~is_light).groupBy("heavy", "of_record").agg(F.sum("n_rows").alias("n_rows")).groupBy("heavy").agg(F.sum("n_rows").alias("n_rows"), F.count("of_record").alias("n_records"))
    names = F.broadcast(spark.createDataFrame([(i, *h) for i, h in enumerate(heavy)], "heavy int, attr int, val string"))
    return light.unionByName(added.join(names, "heavy").select("attr", "val", "n_rows", "n_records"))


def banded(counts: DataFrame, symbols: DataFrame | Attributes, rare_below: int = 3, common_above: float = 1 / 20) -> DataFrame:
    """(anno_ns, anno_name, val, n_rows, n_records, key_rows, band); ``band``: rare (in fewer than ``rare_below`` records), else common (more than that share of its key's rows), else null."""
    keys = attributes(symbols)
    sizes = lookup_join(counts.groupBy("attr").agg(F.sum("n_rows").alias("key_rows")), keys.names(), ["attr"], rows=keys.rows)
    band = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_rows") * round(1 / common_above) > F.col("key_rows"), "common")
    return lookup_join(counts, sizes, ["attr"], rows=keys.rows).select("anno_ns", "anno_name", "val", "n_rows", "n_records", "key_rows", band.alias("band"))


def all_terms(annos: DataFrame, symbols: DataFrame | Attributes) -> DataFrame:
    """Every value of every qualified key with its occurrences, its records and its band."""
    keys = attributes(symbols)
    return banded(term_counts(annos, keys, heavy_terms(annos, keys)), keys)
