"""Operators as join conditions between two sets of matches.

A relation joins ``left`` (which holds node i) with ``right`` (which holds node
j); ``holds`` is the same test for two nodes of one row, used as a filter and,
negated, for operators that must not apply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..aql.model import Operator, Range
from ..functions.skew import salted_join
from .graph import Graph
from .reach import pairs
from .search import edge_condition

#: Distance ranges up to this width are written out as single distances.
WIDTH = 64
#: Positions of a bucket in which included spans are looked for.
BUCKET = 32
POSITIONAL = {"precedence", "near", "overlap", "inclusion", "ident_cov", "left", "right"}
EDGES = {"dominance": "Dominance", "pointing": "Pointing", "part_of": "PartOf"}


def add_span(graph: Graph, df: DataFrame, i: int, how: str) -> DataFrame:
    s = graph.span.select(
        F.col("corpus").alias("_c"), F.col("node_id").alias("_n"), F.col("chain_id").alias(f"c{i}"), F.col("left_pos").alias(f"l{i}"), F.col("right_pos").alias(f"r{i}"), F.col("left_tok").alias(f"lt{i}"), F.col("right_tok").alias(f"rt{i}")
    )
    return df.join(s, (F.col("corpus") == F.col("_c")) & (F.col(f"m{i}") == F.col("_n")), how).drop("_c", "_n")


def add_segment(graph: Graph, df: DataFrame, i: int, seg: str, how: str) -> DataFrame:
    """Chain and position on a segmentation layer; the node itself must be on it."""
    s = graph.tok_pos.filter(F.col("seg") == seg).select(F.col("corpus").alias("_c"), F.col("node_id").alias("_n"), F.col("chain_id").alias(f"c{i}_{seg}"), F.col("pos").alias(f"p{i}_{seg}"))
    return df.join(s, (F.col("corpus") == F.col("_c")) & (F.col(f"m{i}") == F.col("_n")), how).drop("_c", "_n")


def _places(op: Operator, i: int, j: int) -> tuple[str, str, str, str, str, str]:
    """Columns of both chains, where the first ends and begins, and where the second begins and ends."""
    if op.name:
        return f"c{i}_{op.name}", f"c{j}_{op.name}", f"p{i}_{op.name}", f"p{i}_{op.name}", f"p{j}_{op.name}", f"p{j}_{op.name}"
    return f"c{i}", f"c{j}", f"r{i}", f"l{i}", f"l{j}", f"r{j}"


def _within(gap: Column, d: Range) -> Column:
    return (gap >= d.low) & (F.lit(True) if d.high is None else gap <= d.high)


def holds(op: Operator, i: int, j: int) -> Column:
    """The filter form over one row, for operators that need no table; null counts as no."""
    m = {
        "ident_node": lambda: F.col(f"m{i}") == F.col(f"m{j}"),
        "equal": lambda: F.col(f"v{i}") == F.col(f"v{j}"),
        "not_equal": lambda: F.col(f"v{i}") != F.col(f"v{j}"),
        "overlap": lambda: (F.col(f"c{i}") == F.col(f"c{j}")) & (F.col(f"l{i}") <= F.col(f"r{j}")) & (F.col(f"l{j}") <= F.col(f"r{i}")),
        "inclusion": lambda: (F.col(f"c{i}") == F.col(f"c{j}")) & (F.col(f"l{i}") <= F.col(f"l{j}")) & (F.col(f"r{j}") <= F.col(f"r{i}")),
        "ident_cov": lambda: (F.col(f"lt{i}") == F.col(f"lt{j}")) & (F.col(f"rt{i}") == F.col(f"rt{j}")),
        "left": lambda: F.col(f"lt{i}") == F.col(f"lt{j}"),
        "right": lambda: F.col(f"rt{i}") == F.col(f"rt{j}"),
    }
    if op.kind in ("precedence", "near"):
        ci, cj, end_i, begin_i, begin_j, end_j = _places(op, i, j)
        after = _within(F.col(begin_j) - F.col(end_i), op.dist)
        both = after if op.kind == "precedence" else after | _within(F.col(begin_i) - F.col(end_j), op.dist)
        return F.coalesce((F.col(ci) == F.col(cj)) & both, F.lit(False))
    return F.coalesce(m[op.kind](), F.lit(False))


def edge_pairs(graph: Graph, op: Operator, starts: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(corpus, source, target) of an edge operator; direct edges of several layers come once."""
    ctype = EDGES[op.kind]
    edges = graph.component(ctype) if op.kind == "part_of" else graph.component(ctype, op.name)
    if op.edge is not None:
        labels = graph.edge_anno.filter((F.col("ctype") == ctype) & (F.col("cname") == op.name)).filter(edge_condition(op.edge))
        return labels.select("corpus", "source", "target").distinct()
    return pairs(edges, op.dist, starts, ends, graph.depth.get(ctype), graph.layered, "target" if op.kind == "part_of" else "source")


def _joined(left: DataFrame, right: DataFrame, cond: Column) -> DataFrame:
    r = right.withColumnRenamed("corpus", "_rc")
    return left.join(r, (F.col("corpus") == F.col("_rc")) & cond).drop("_rc")


def _band(left: DataFrame, right: DataFrame, chains: tuple[str, str], end: str, begin: str, d: Range) -> DataFrame:
    """Rows whose ``begin`` (right) lies ``d`` after ``end`` (left) on the same chain."""
    ci, cj = chains
    if d.high is None:
        r = right.withColumnsRenamed({"corpus": "_rc", cj: "_rchain"}).select("*", F.col("_rc").alias("corpus"), F.col("_rchain").alias(ci)).drop("_rc")
        out = salted_join(left, r, ["corpus", ci], "inner", F.col(begin) >= F.col(end) + d.low)
        return out.withColumnRenamed("_rchain", cj)
    if d.high < d.low:
        return _joined(left, right, F.lit(False))
    if d.low == d.high:
        return _joined(left, right, (F.col(ci) == F.col(cj)) & (F.col(begin) == F.col(end) + d.low))
    if d.high - d.low < WIDTH:
        wide = left.withColumn("_at", F.explode(F.sequence(F.col(end) + d.low, F.col(end) + d.high)))
        return _joined(wide, right, (F.col(ci) == F.col(cj)) & (F.col(begin) == F.col("_at"))).drop("_at")
    w = d.high - d.low + 1
    wide = left.withColumn("_at", F.explode(F.sequence(F.floor((F.col(end) + d.low) / w), F.floor((F.col(end) + d.high) / w))))
    return _joined(wide, right, (F.col(ci) == F.col(cj)) & (F.floor(F.col(begin) / w) == F.col("_at")) & _within(F.col(begin) - F.col(end), d)).drop("_at")


def relate(graph: Graph, left: DataFrame, right: DataFrame, op: Operator, i: int, j: int) -> DataFrame:
    """Matches of ``left`` and ``right`` in relation ``op`` from node i to node j."""
    if op.kind in EDGES:
        p = edge_pairs(graph, op, left.select("corpus", F.col(f"m{i}").alias("source")), right.select("corpus", F.col(f"m{j}").alias("target"))).select(F.col("corpus").alias("_pc"), F.col("source").alias("_ps"), F.col("target").alias("_pt"))
        half = left.join(p, (F.col("corpus") == F.col("_pc")) & (F.col(f"m{i}") == F.col("_ps")))
        return _joined(half, right, F.col("_pt") == F.col(f"m{j}")).drop("_pc", "_ps", "_pt")
    if op.kind in ("precedence", "near"):
        ci, cj, end_i, begin_i, begin_j, end_j = _places(op, i, j)
        after = _band(left, right, (ci, cj), end_i, begin_j, op.dist)
        if op.kind == "precedence":
            return after
        before = _band(right, left, (cj, ci), end_j, begin_i, op.dist)
        return after.unionByName(before).dropDuplicates()
    if op.kind == "overlap":
        cov = graph.coverage
        a = left.join(cov.select(F.col("corpus").alias("_ac"), F.col("node_id").alias("_an"), F.col("tok_id").alias("_t")), (F.col("corpus") == F.col("_ac")) & (F.col(f"m{i}") == F.col("_an"))).drop("_ac", "_an")
        b = right.join(cov.select(F.col("corpus").alias("_bc"), F.col("node_id").alias("_bn"), F.col("tok_id").alias("_u")), (F.col("corpus") == F.col("_bc")) & (F.col(f"m{j}") == F.col("_bn"))).drop("_bc", "_bn")
        return _joined(a, b, F.col("_t") == F.col("_u")).drop("_t", "_u").dropDuplicates()
    if op.kind == "inclusion":
        a = left.withColumn("_at", F.explode(F.sequence(F.floor(F.col(f"l{i}") / BUCKET), F.floor(F.col(f"r{i}") / BUCKET))))
        return _joined(a, right, (F.floor(F.col(f"l{j}") / BUCKET) == F.col("_at")) & holds_raw(op, i, j)).drop("_at")
    return _joined(left, right, holds_raw(op, i, j))


def holds_raw(op: Operator, i: int, j: int) -> Column:
    """``holds`` as plain conjuncts, so that equalities become join keys."""
    c = F.col
    return {
        "ident_node": lambda: c(f"m{i}") == c(f"m{j}"),
        "inclusion": lambda: (c(f"c{i}") == c(f"c{j}")) & (c(f"l{i}") <= c(f"l{j}")) & (c(f"r{j}") <= c(f"r{i}")),
        "ident_cov": lambda: (c(f"lt{i}") == c(f"lt{j}")) & (c(f"rt{i}") == c(f"rt{j}")),
        "left": lambda: c(f"lt{i}") == c(f"lt{j}"),
        "right": lambda: c(f"rt{i}") == c(f"rt{j}"),
        "equal": lambda: c(f"v{i}") == c(f"v{j}"),
        "not_equal": lambda: c(f"v{i}") != c(f"v{j}"),
    }[op.kind]()


def restrict(graph: Graph, df: DataFrame, op: Operator, i: int, j: int, negated: bool) -> DataFrame:
    """Rows whose nodes i and j are (or, negated, aren't) in relation."""
    if op.kind in EDGES:
        p = edge_pairs(graph, op, df.select("corpus", F.col(f"m{i}").alias("source")), df.select("corpus", F.col(f"m{j}").alias("target"))).select(F.col("corpus").alias("_pc"), F.col("source").alias("_ps"), F.col("target").alias("_pt"))
        cond = (F.col("corpus") == F.col("_pc")) & (F.col(f"m{i}") == F.col("_ps")) & (F.col(f"m{j}") == F.col("_pt"))
        return df.join(p, cond, "left_anti" if negated else "left_semi")
    cond = holds(op, i, j)
    return df.filter(~cond if negated else cond)
