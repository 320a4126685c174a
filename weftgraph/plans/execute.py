"""Queries over a graph: conjunctions to joins, alternatives to unions, and the verbs.

A result row has, for each shown node p from 1 on, ``m{p}``, ``ns{p}`` and
``name{p}``, besides ``corpus``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..aql.analyze import parse
from ..aql.model import ANY_DISTANCE, Absent, Conjunction, Join, Query, Range
from .graph import ANNIS, Graph
from .joins import POSITIONAL, add_segment, add_span, relate, restrict
from .reach import pairs
from .search import scan
from ..session import cut

_RANK = {"token": 0, "value": 1, "any_token": 3, "any_node": 4}


def _selectivity(conj: Conjunction, i: int) -> float:
    s = conj.nodes[i].search
    return _RANK[s.kind] + (0.5 if s.regex else 0) + (1 if s.kind == "value" and s.value is None else 0) + (1.5 if s.negated else 0)


def _distinct_from(conj: Conjunction) -> list[tuple[int, int]]:
    """Pairs that may not be the same match: an operator that isn't reflexive keeps its right node from all joined before it."""
    group = {i: {i} for i in range(len(conj.nodes))}
    out = []
    for j in conj.joins:
        a, b = group[j.left], group[j.right]
        if j.negated or not j.op.binding or a is b:
            continue
        if not j.op.reflexive:
            out += [(x, j.right) for x in sorted(a if j.global_reflexivity else {j.left})]
        both = a | b
        for x in both:
            group[x] = both
    return out


def _same(a: int, b: int) -> Column:
    return (F.col(f"m{a}") == F.col(f"m{b}")) & (F.col(f"s{a}") == F.col(f"s{b}")) & (F.col(f"k{a}") == F.col(f"k{b}"))


class _Builder:
    def __init__(self, graph: Graph, conj: Conjunction):
        self.graph, self.conj = graph, conj

    def prepared(self, i: int) -> DataFrame:
        """The scan of node i with what its operators need, its own filters applied."""
        conj, graph = self.conj, self.graph
        mine = [j for j in conj.joins if i in (j.left, j.right)]
        absent = [a for a in conj.absent if a.node == i]
        df = scan(graph, conj.nodes[i].search, i, any(j.op.kind in ("equal", "not_equal") for j in mine))
        for node, r in conj.arity:
            if node == i:
                df = self.with_arity(df, i, r)
        df = self.places(df, i, [(j.op, j.negated) for j in mine] + [(a.op, True) for a in absent])
        for a in absent:
            df = self.without(df, a)
        return df

    def places(self, df: DataFrame, i: int, ops: list) -> DataFrame:
        plain = [neg for op, neg in ops if op.kind in POSITIONAL and not op.name]
        if plain:
            df = add_span(self.graph, df, i, "left" if all(plain) else "inner")
        for seg in dict.fromkeys(op.name for op, _ in ops if op.kind in ("precedence", "near") and op.name):
            df = add_segment(self.graph, df, i, seg, "left" if all(neg for op, neg in ops if op.name == seg) else "inner")
        return df

    def with_arity(self, df: DataFrame, i: int, r: Range) -> DataFrame:
        edges = self.graph.edge.filter(F.col("ctype").isin("Dominance", "Pointing")).select("corpus", "source", "target").distinct()
        n = edges.groupBy("corpus", "source").agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") >= r.low) & (F.lit(True) if r.high is None else F.col("_n") <= r.high))
        n = n.select(F.col("corpus").alias("_c"), F.col("source").alias("_s"))
        return df.join(n, (F.col("corpus") == F.col("_c")) & (F.col(f"m{i}") == F.col("_s")), "left_semi")

    def without(self, df: DataFrame, a: Absent) -> DataFrame:
        i, t = a.node, len(self.conj.nodes)
        target = self.places(scan(self.graph, a.target, t), t, [(a.op, False)])
        kept = [c for c in df.columns if c == "corpus" or re.fullmatch(rf"(?:m|c|l|r|lt|rt){i}|[cp]{i}_.*", c)]
        mine = df.select(*kept).distinct()
        hits = relate(self.graph, target, mine, a.op, t, i) if a.target_left else relate(self.graph, mine, target, a.op, i, t)
        hit = hits.select(F.col("corpus").alias("_c"), F.col(f"m{i}").alias("_m")).distinct()
        return df.join(hit, (F.col("corpus") == F.col("_c")) & (F.col(f"m{i}") == F.col("_m")), "left_anti")

    def rows(self) -> DataFrame:
        conj = self.conj
        live = [i for i, n in enumerate(conj.nodes) if not n.optional]
        todo: list[Join] = list(conj.joins)
        apart = _distinct_from(conj)
        first = min(live, key=lambda i: (_selectivity(conj, i), i))
        df, have = self.prepared(first), {first}

        def settle(df: DataFrame) -> DataFrame:
            for j in [j for j in todo if {j.left, j.right} <= have]:
                todo.remove(j)
                df = restrict(self.graph, df, j.op, j.left, j.right, j.negated)
            for a, b in [p for p in apart if set(p) <= have]:
                apart.remove((a, b))
                df = df.filter(~_same(a, b))
            return df

        df = settle(df)
        while len(have) < len(live):
            j = min((j for j in todo if j.op.binding and not j.negated and len({j.left, j.right} & have) == 1), key=lambda j: _selectivity(conj, j.right if j.left in have else j.left))
            todo.remove(j)
            if j.left in have:
                df = relate(self.graph, df, self.prepared(j.right), j.op, j.left, j.right)
                have.add(j.right)
            else:
                df = relate(self.graph, self.prepared(j.left), df, j.op, j.left, j.right)
                have.add(j.left)
            df = settle(df)
        return df


def execute(graph: Graph, query: Query | str, quirks: bool = False) -> DataFrame:
    """All matches; those of several alternatives come once."""
    q = parse(query, quirks) if isinstance(query, str) else query
    width = max(len(c.output()) for c in q.alternatives)
    out = None
    for c in q.alternatives:
        shown = c.output()
        rows = _Builder(graph, c).rows()
        cols = ["corpus"]
        for p in range(1, width + 1):
            i = shown[p - 1] if p <= len(shown) else None
            for to, frm, kind in ((f"m{p}", "m", "bigint"), (f"ns{p}", "s", "string"), (f"name{p}", "k", "string")):
                cols.append(F.col(f"{frm}{i}").alias(to) if i is not None else F.lit(None).cast(kind).alias(to))
        rows = rows.select(*cols)
        out = rows if out is None else out.unionByName(rows)
    return out.distinct() if len(q.alternatives) > 1 else out


def count(graph: Graph, query: Query | str, quirks: bool = False) -> DataFrame:
    return execute(graph, query, quirks).agg(F.count(F.lit(1)).alias("n_matches"))


def count_extra(graph: Graph, query: Query | str, quirks: bool = False) -> DataFrame:
    """Matches, and documents that hold the first node of some match."""
    rows = execute(graph, query, quirks).select("corpus", "m1")
    docs = graph.anno.filter((F.col("ns") == ANNIS) & (F.col("name") == "doc")).select("corpus", F.col("node_id").alias("target")).distinct()
    perm = cut(rows.groupBy("corpus", "m1").agg(F.count(F.lit(1)).alias("n")))
    above = pairs(graph.component("PartOf"), ANY_DISTANCE, perm.select("corpus", F.col("m1").alias("source")), docs, graph.depth.get("PartOf"), graph.layered, "target")
    above = above.join(docs, ["corpus", "target"], "left_semi").select(F.col("corpus").alias("_c"), F.col("source").alias("_s"), F.col("target").alias("doc"))
    held = perm.join(above, (F.col("corpus") == F.col("_c")) & (F.col("m1") == F.col("_s"))).select("corpus", "doc").distinct().agg(F.count(F.lit(1)).alias("n_documents"))
    return perm.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_matches")).crossJoin(F.broadcast(held))


def widths(df: DataFrame) -> int:
    return sum(c[0] == "m" and c[1:].isdigit() for c in df.columns)


#: Characters of a key that a match id writes as %XX, besides controls and what isn't ASCII.
_ENCODED = ':/ %\\<>"|?*'


def _encoded(c: Column) -> Column:
    out = F.replace(c, F.lit("%"), F.lit("%25"))
    for ch in _ENCODED:
        if ch != "%":
            out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return out


def match_ids(graph: Graph, matches: DataFrame) -> DataFrame:
    """Adds ``match``: the ids of a row's nodes, keys before names."""
    n = widths(matches)
    parts = []
    df = matches
    for p in range(1, n + 1):
        names = graph.node.select(F.col("corpus").alias("_c"), F.col("node_id").alias("_n"), F.col("node_name").alias(f"_name{p}"))
        df = df.join(names, (F.col("corpus") == F.col("_c")) & (F.col(f"m{p}") == F.col("_n")), "left").drop("_c", "_n")
        plain = (F.col(f"ns{p}") == ANNIS) & (F.col(f"name{p}") == "node_type")
        ns = F.when(F.coalesce(F.col(f"ns{p}"), F.lit("")) == "", "").otherwise(F.concat(_encoded(F.col(f"ns{p}")), F.lit("::")))
        parts.append(F.when(plain, F.col(f"_name{p}")).otherwise(F.concat(ns, _encoded(F.col(f"name{p}")), F.lit("::"), F.col(f"_name{p}"))))
    return df.withColumn("match", F.concat_ws(" ", *parts))


def find(graph: Graph, query: Query | str, offset: int = 0, limit: int | None = None, order: str = "normal", quirks: bool = False) -> DataFrame:
    """Match ids in text order (``normal``), reversed (``inverted``), ``random`` or ``unsorted``; a page of them if limited.

    Text order: corpus, then for each node its path, chain and position, name
    and id. With a limit Spark keeps only the first rows of each task.
    """
    rows = match_ids(graph, execute(graph, query, quirks))
    n = widths(rows)
    keys: list[Column] = [F.col("corpus")]
    if order in ("normal", "inverted"):
        for p in range(1, n + 1):
            span = graph.span.select(F.col("corpus").alias("_c"), F.col("node_id").alias("_n"), F.col("chain_id").alias(f"_chain{p}"), F.col("left_pos").alias(f"_pos{p}"))
            rows = rows.join(span, (F.col("corpus") == F.col("_c")) & (F.col(f"m{p}") == F.col("_n")), "left").drop("_c", "_n")
            name = F.col(f"_name{p}")
            keys += [F.split(F.regexp_extract(name, r"^(.*?)(?:#[^#]*)?$", 1), "/"), F.col(f"_chain{p}"), F.col(f"_pos{p}"), F.regexp_extract(name, r"([^#]*)$", 1), F.col(f"m{p}"), F.col(f"name{p}"), F.col(f"ns{p}")]
        rows = rows.orderBy(*[k.asc() if order == "normal" else k.desc() for k in keys])
    elif order == "random":
        rows = rows.orderBy(F.rand())
    if limit is not None:
        return rows.offset(offset).limit(limit).select("corpus", "match")
    return _beyond(rows, offset).select("corpus", "match") if offset else rows.select("corpus", "match")


def _beyond(rows: DataFrame, offset: int) -> DataFrame:
    """All but the first rows, which no single task reads: whole partitions are left out or kept, and one is cut."""
    rows = cut(rows.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    left, skip = offset, {}
    for r in rows.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").toLocalIterator():
        skip[r._p] = min(left, r.n)
        left -= skip[r._p]
        if not left:
            break
    last = max(skip, default=-1)
    return rows.filter((F.col("_p") > last) | (F.col("_p") == last) & (F.col("_i") >= skip.get(last, 0)))


def frequency(graph: Graph, query: Query | str, definitions: list[tuple[int, str | None, str]], quirks: bool = False) -> DataFrame:
    """How often each tuple of annotation values occurs; ``definitions`` are (node from 1, namespace or None, name); missing values are ''."""
    df = execute(graph, query, quirks)
    cols = []
    for k, (p, ns, name) in enumerate(definitions, 1):
        labels = graph.labels.filter(F.col("name") == name)
        labels = labels.filter(F.col("ns") == ns) if ns is not None else labels.groupBy("corpus", "node_id").agg(F.min("value").alias("value"))
        labels = labels.select(F.col("corpus").alias("_c"), F.col("node_id").alias("_n"), F.col("value").alias(f"_v{k}"))
        df = df.join(labels, (F.col("corpus") == F.col("_c")) & (F.col(f"m{p}") == F.col("_n")), "left").drop("_c", "_n")
        cols.append(F.coalesce(F.col(f"_v{k}"), F.lit("")).alias(f"value{k}"))
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *[f"value{k}" for k in range(1, len(cols) + 1)])
