"""Node searches as scans of the label table.

Every scan has, for node i: its id ``m{i}``, the key that matched (``s{i}``
namespace, ``k{i}`` name) and its value ``v{i}``. Searches for tokens, for any
node and for metadata carry the constant key annis:node_type.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..aql.model import EdgeSearch, Search
from ..aql.regex import to_java
from .graph import ANNIS, Graph

_META = re.compile(r"[\\.^$*+?()\[\]{}|]")


def is_literal(pattern: str) -> bool:
    """A regular expression that only matches itself."""
    return not _META.search(pattern)


def literal_prefix(pattern: str) -> str:
    """What every match begins with."""
    if "|" in pattern or "(?" in pattern:
        return ""
    m = _META.search(pattern)
    if not m:
        return pattern
    head = pattern[: m.start()]
    return head[:-1] if m[0] in "*?{" else head


def value_condition(col: Column, value: str | None, regex: bool, negated: bool) -> Column:
    """Whole-value match; literal expressions become equality, others also a range that Parquet statistics can use."""
    if value is None:
        return F.lit(True)
    if not regex or is_literal(value):
        return col != F.lit(value) if negated else col == F.lit(value)
    hit = col.rlike(to_java(value))
    if negated:
        return ~hit
    head = literal_prefix(value)
    return hit & col.startswith(head) if head else hit


def edge_condition(e: EdgeSearch) -> Column:
    cond = (F.col("name") == e.name) & value_condition(F.col("value"), e.value, e.regex, e.negated)
    return cond & (F.col("ns") == e.ns) if e.ns is not None else cond


def scan(graph: Graph, search: Search, i: int, with_value: bool = False) -> DataFrame:
    def shaped(df: DataFrame, constant: bool, value: Column) -> DataFrame:
        return df.select(
            "corpus", F.col("node_id").alias(f"m{i}"), (F.lit(ANNIS) if constant else F.col("ns")).alias(f"s{i}"), (F.lit("node_type") if constant else F.col("name")).alias(f"k{i}"), value.alias(f"v{i}")
        )

    if search.kind == "any_node":
        return shaped(graph.node.filter(F.col("node_type") == "node"), True, F.lit(None).cast("string"))
    if search.kind == "any_token":
        toks = graph.span.filter("is_token")
        if with_value:
            text = graph.anno.filter((F.col("ns") == ANNIS) & (F.col("name") == "tok")).select("corpus", "node_id", "value")
            return shaped(toks.join(text, ["corpus", "node_id"], "left"), True, F.col("value"))
        return shaped(toks, True, F.lit(None).cast("string"))
    if search.kind == "token":
        hit = graph.anno.filter((F.col("ns") == ANNIS) & (F.col("name") == "tok") & value_condition(F.col("value"), search.value, search.regex, search.negated))
        if search.leafs_only and not graph.texts_are_tokens:
            covering = graph.component("Coverage").select("corpus", F.col("source").alias("node_id")).distinct()
            hit = hit.join(covering, ["corpus", "node_id"], "left_anti")
        return shaped(hit, True, F.col("value"))
    labels = graph.labels if search.ns in (None, ANNIS) and search.name in ("node_name", "node_type") else graph.anno
    hit = labels.filter((F.col("name") == search.name) & value_condition(F.col("value"), search.value, search.regex, search.negated))
    if search.ns is not None:
        hit = hit.filter(F.col("ns") == search.ns)
    return shaped(hit, search.meta, F.col("value"))
