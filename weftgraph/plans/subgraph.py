"""Graphs cut out of a graph, and listings of what a graph holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..aql.model import ANY_DISTANCE, Query
from ..session import cut
from .execute import execute, widths
from .graph import ANNIS, Graph
from .reach import pairs

GAP = "datasource-gap"
#: Components that are derived and not shown.
_DERIVED_TYPES = ("LeftToken", "RightToken")
_INHERITED = "inherited-coverage"


def matched_nodes(matches: DataFrame) -> DataFrame:
    """Distinct (corpus, node_id) of all nodes of all matches."""
    each = F.explode(F.array(*[F.col(f"m{p}") for p in range(1, widths(matches) + 1)]))
    return matches.select("corpus", each.alias("node_id")).filter("node_id is not null").distinct()


def among(graph: Graph, keep: DataFrame, ctypes: list[str] | None = None, gaps: DataFrame | None = None) -> Graph:
    """The graph of the nodes ``keep`` and the edges between them, without derived components."""
    keep = cut(keep.select("corpus", "node_id").distinct())
    of = lambda df: df.join(keep, ["corpus", "node_id"], "left_semi")
    edges = graph.edge.filter(~F.col("ctype").isin(*_DERIVED_TYPES) & (F.col("cname") != _INHERITED))
    if ctypes is not None:
        edges = edges.filter(F.col("ctype").isin(*ctypes))

    def inside(df: DataFrame) -> DataFrame:
        a = keep.withColumnRenamed("node_id", "source")
        b = keep.withColumnRenamed("node_id", "target")
        return df.join(a, ["corpus", "source"], "left_semi").join(b, ["corpus", "target"], "left_semi").select(*df.columns)

    kept = inside(edges)
    return Graph(of(graph.node), of(graph.anno), kept if gaps is None else kept.unionByName(gaps), inside(graph.edge_anno))


def _ancestors(graph: Graph, nodes: DataFrame) -> DataFrame:
    part_of = graph.component("PartOf")
    above = pairs(part_of, ANY_DISTANCE, nodes.select("corpus", F.col("node_id").alias("source")), None, graph.depth.get("PartOf"), graph.layered, "target")
    return above.join(nodes.select("corpus", F.col("node_id").alias("source")).distinct(), ["corpus", "source"], "left_semi").select("corpus", F.col("target").alias("node_id")).distinct()


def windows(graph: Graph, nodes: DataFrame, left: int, right: int, seg: str | None = None) -> DataFrame:
    """(corpus, chain_id, first, last): the positions around each node, cut to what the chain has.

    With a segmentation the borders are counted on its chain and taken back to
    tokens; a node without a segment there has no window.
    """
    at = graph.span.join(nodes.select("corpus", "node_id").distinct(), ["corpus", "node_id"], "left_semi").filter("chain_id is not null").select("corpus", "node_id", "chain_id", "left_pos", "right_pos")
    ends = graph.tok_pos.filter(F.col("seg") == (seg or "")).groupBy("corpus", "chain_id").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    if seg is None:
        return at.join(ends, ["corpus", "chain_id"]).select("corpus", "chain_id", F.greatest(F.col("left_pos") - left, "low").alias("first"), F.least(F.col("right_pos") + right, "high").alias("last")).distinct()
    segments = graph.tok_pos.filter(F.col("seg") == seg).select("corpus", F.col("chain_id").alias("seg_chain"), F.col("pos").alias("seg_pos"), "node_id")
    placed = segments.join(graph.span.select("corpus", "node_id", "chain_id", F.col("left_pos").alias("sl"), F.col("right_pos").alias("sr")), ["corpus", "node_id"]).drop("node_id")
    over = at.join(placed, ["corpus", "chain_id"]).filter((F.col("sl") <= F.col("right_pos")) & (F.col("left_pos") <= F.col("sr")))
    border = over.groupBy("corpus", "node_id", "chain_id", "seg_chain").agg(F.min("seg_pos").alias("a"), F.max("seg_pos").alias("b"))
    near = placed.withColumnsRenamed({"chain_id": "token_chain"})
    wide = border.join(near, ["corpus", "seg_chain"]).filter(F.col("seg_pos").between(F.col("a") - left, F.col("b") + right) & (F.col("chain_id") == F.col("token_chain")))
    return wide.groupBy("corpus", "node_id", "chain_id").agg(F.min("sl").alias("first"), F.max("sr").alias("last")).select("corpus", "chain_id", "first", "last").distinct()


def context(graph: Graph, matches: DataFrame, left: int, right: int, seg: str | None = None) -> Graph:
    """Tokens around the matches, what covers them, the matches themselves and the corpora above.

    Where two regions of a chain don't touch, an edge of the component
    Ordering/annis/datasource-gap leads from the end of one to the next.
    """
    nodes = matched_nodes(matches)
    win = windows(graph, nodes, left, right, seg)
    at = win.select("corpus", "chain_id", F.explode(F.sequence("first", "last")).alias("pos")).distinct()
    toks = cut(graph.tok_pos.filter("seg = ''").join(at, ["corpus", "chain_id", "pos"]).select("corpus", "chain_id", "pos", "node_id"))
    shown = toks.select("corpus", F.col("node_id").alias("tok_id")).distinct()
    covering = graph.coverage.join(shown, ["corpus", "tok_id"], "left_semi").select("corpus", "node_id")
    body = cut(toks.select("corpus", "node_id").unionByName(covering).unionByName(nodes).distinct())
    keep = body.unionByName(_ancestors(graph, body))
    by_pos = Window.partitionBy("corpus", "chain_id").orderBy("pos")
    steps = toks.withColumn("before", F.lag("pos").over(by_pos)).withColumn("source", F.lag("node_id").over(by_pos)).filter(F.col("pos") - F.col("before") > 1)
    gaps = steps.select("corpus", F.lit("Ordering").alias("ctype"), F.lit(ANNIS).alias("layer"), F.lit(GAP).alias("cname"), "source", F.col("node_id").alias("target"))
    return among(graph, keep, gaps=gaps)


def for_query(graph: Graph, query: Query | str, ctypes: list[str] | None = None) -> Graph:
    """All nodes of all matches and the edges between them."""
    return among(graph, matched_nodes(execute(graph, query)), ctypes)


def subcorpus(graph: Graph, names: list[str]) -> Graph:
    """The (sub)corpora named, and all nodes and datasources below them."""
    roots = graph.node.filter(F.col("node_name").isin(names)).select("corpus", F.col("node_id").alias("target"))
    below = pairs(graph.component("PartOf"), ANY_DISTANCE, None, roots, graph.depth.get("PartOf"), graph.layered, "target").join(roots, ["corpus", "target"], "left_semi").select("corpus", F.col("source").alias("node_id"))
    kinds = graph.node.filter(F.col("node_type").isin("node", "datasource", "corpus")).select("corpus", "node_id")
    return among(graph, below.join(kinds, ["corpus", "node_id"], "left_semi").unionByName(roots.withColumnRenamed("target", "node_id")))


def corpora(graph: Graph) -> Graph:
    """The corpus nodes and their PartOf edges."""
    return among(graph, graph.node.filter("node_type = 'corpus'"), ["PartOf"])


def _values(labels: DataFrame, only_most_frequent: bool) -> DataFrame:
    counts = labels.groupBy("ns", "name", "value").agg(F.count(F.lit(1)).alias("n"))
    if not only_most_frequent:
        return counts
    best = counts.groupBy("ns", "name").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("value"))).alias("b"))
    return best.select("ns", "name", F.col("b.value").alias("value"), (-F.col("b.less")).alias("n"))


def node_values(graph: Graph, only_most_frequent: bool = False) -> DataFrame:
    """(ns, name, value, n) of the node annotations, of each key its most frequent value only if wanted."""
    return _values(graph.anno, only_most_frequent)


def edge_values(graph: Graph, ctype: str, layer: str, cname: str, only_most_frequent: bool = False) -> DataFrame:
    return _values(graph.edge_anno.filter((F.col("ctype") == ctype) & (F.col("layer") == layer) & (F.col("cname") == cname)), only_most_frequent)


def components(graph: Graph) -> DataFrame:
    """Each component with its edges, sources, greatest fan-out and whether any node has two parents."""
    key = ["corpus", "ctype", "layer", "cname"]
    out = graph.edge.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(F.sum("n").alias("n_edges"), F.count(F.lit(1)).alias("n_sources"), F.max("n").alias("max_fan_out"))
    into = graph.edge.groupBy(*key, "target").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg((F.max("n") <= 1).alias("single_parent"))
    return out.join(into, key)
