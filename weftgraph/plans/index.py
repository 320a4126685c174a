"""Derived tables of a graph: chain positions, inherited coverage, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..aql.model import ANY_DISTANCE
from ..operators.hierarchy import forest, numbered
from ..session import cut
from .graph import ANNIS, Graph
from .reach import pairs


def chains(graph: Graph) -> DataFrame:
    """tok_pos: every ordering component as chains, the chain named by its first node.

    A chain is a path of links, so its positions are depths of the hierarchy
    operator. Tokens without an ordering edge are chains of their own.
    """
    by = ["corpus", "layer", "cname"]
    links = graph.component("Ordering").filter((F.col("layer") != ANNIS) | (F.col("cname") == "")).select(*by, "source", "target").na.drop(subset=["source", "target"])
    n = numbered(links, by, "target", "source")
    placed = forest(n.links, "node", "up").filter("not cyclic").select("node", "root", "depth")
    first = n.links.select(F.col("up").alias("node")).distinct().join(n.links.select("node"), "node", "left_anti")
    rows = placed.unionByName(first.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth")))
    on = cut(n.named(rows, "node", "root").select("corpus", F.col("cname").alias("seg"), F.col("root").alias("chain_id"), F.col("depth").alias("pos"), F.col("node").alias("node_id")))
    lone = tokens(graph).join(on.filter("seg = ''"), ["corpus", "node_id"], "left_anti")
    return on.unionByName(lone.select("corpus", F.lit("").alias("seg"), F.col("node_id").alias("chain_id"), F.lit(0).cast("bigint").alias("pos"), "node_id"))


def tokens(graph: Graph) -> DataFrame:
    """Nodes with a text and no outgoing coverage."""
    text = graph.anno.filter((F.col("ns") == ANNIS) & (F.col("name") == "tok")).select("corpus", "node_id").distinct()
    return text.join(graph.component("Coverage").select("corpus", F.col("source").alias("node_id")).distinct(), ["corpus", "node_id"], "left_anti")


def coverage(graph: Graph) -> DataFrame:
    """Each node and the tokens it covers, directly or through coverage and dominance; a token covers itself."""
    toks = tokens(graph)
    down = graph.edge.filter(F.col("ctype").isin("Coverage", "Dominance"))
    own = toks.select("corpus", "node_id", F.col("node_id").alias("tok_id"))
    reached = pairs(down, ANY_DISTANCE, None, toks.select("corpus", F.col("node_id").alias("target"))).select("corpus", F.col("source").alias("node_id"), F.col("target").alias("tok_id"))
    return own.unionByName(reached.join(toks.withColumnRenamed("node_id", "tok_id"), ["corpus", "tok_id"], "left_semi").select("corpus", "node_id", "tok_id")).distinct()


def spans(tok_pos: DataFrame, cover: DataFrame) -> DataFrame:
    """First and last token of each node that covers some, on the first of its chains."""
    base = tok_pos.filter("seg = ''").select("corpus", "chain_id", "pos", F.col("node_id").alias("tok_id"))
    on = cover.join(base, ["corpus", "tok_id"]).groupBy("corpus", "node_id", "chain_id").agg(F.min(F.struct("pos", "tok_id")).alias("a"), F.max(F.struct("pos", "tok_id")).alias("b"))
    one = on.groupBy("corpus", "node_id").agg(F.min("chain_id").alias("chain_id"), F.min_by("a", "chain_id").alias("a"), F.min_by("b", "chain_id").alias("b"))
    return one.select("corpus", "node_id", (F.col("node_id") == F.col("a.tok_id")).alias("is_token"), "chain_id", F.col("a.pos").alias("left_pos"), F.col("b.pos").alias("right_pos"), F.col("a.tok_id").alias("left_tok"), F.col("b.tok_id").alias("right_tok"))


def indexed(graph: Graph) -> Graph:
    """The graph with its derived tables, each worked out once when first used."""
    kept: dict[str, DataFrame] = {}

    def once(name: str, make) -> DataFrame:
        if name not in kept:
            kept[name] = cut(make())
        return kept[name]

    graph.derive = {
        "tok_pos": lambda: once("tok_pos", lambda: chains(graph)),
        "coverage": lambda: once("coverage", lambda: coverage(graph)),
        "span": lambda: once("span", lambda: spans(graph.tok_pos, graph.coverage)),
    }
    return graph


def hints(graph: Graph) -> dict:
    """What a stored graph is known to be like, so that its queries can do without some joins."""
    covering = graph.component("Coverage").select("corpus", F.col("source").alias("node_id"))
    text = graph.anno.filter((F.col("ns") == ANNIS) & (F.col("name") == "tok")).select("corpus", "node_id")
    twice = graph.edge.groupBy("corpus", "ctype", "cname", "source", "target").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    part_of = graph.component("PartOf").select("corpus", "source", "target")
    depth = {}
    if not part_of.groupBy("corpus", "source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count():
        tree = forest(numbered(part_of, ["corpus"], "source", "target").links, "node", "up").agg(F.max("depth").alias("depth"), F.max(F.col("cyclic").cast("int")).alias("cyclic")).first()
        if not tree.cyclic:
            depth = {"PartOf": tree.depth or 0}
    return {"depth": depth, "layered": bool(twice.limit(1).count()), "texts_are_tokens": not text.join(covering, ["corpus", "node_id"], "left_semi").limit(1).count()}
