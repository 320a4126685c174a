"""The tables of an annotation graph."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANNIS = "annis"
SCHEMAS = {
    "node": "corpus string, node_id bigint, node_name string, node_type string",
    "anno": "corpus string, node_id bigint, ns string, name string, value string",
    "edge": "corpus string, ctype string, layer string, cname string, source bigint, target bigint",
    "edge_anno": "corpus string, ctype string, layer string, cname string, source bigint, target bigint, ns string, name string, value string",
    "tok_pos": "corpus string, seg string, chain_id bigint, pos bigint, node_id bigint",
    "span": "corpus string, node_id bigint, is_token boolean, chain_id bigint, left_pos bigint, right_pos bigint, left_tok bigint, right_tok bigint",
    "coverage": "corpus string, node_id bigint, tok_id bigint",
}


@dataclass
class Graph:
    """Nodes, labels, typed edges, and the derived positions.

    ``tok_pos`` has each member of an ordering chain (``seg`` is '' for tokens),
    ``span`` the first and last token of every node that covers some, and
    ``coverage`` all tokens a node covers, itself if it is a token. Tables that
    a graph lacks are empty. A view may give its derived tables by functions,
    so that a query pays only for those it uses.
    """

    node: DataFrame
    anno: DataFrame
    edge: DataFrame
    edge_anno: DataFrame
    derive: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)
    #: Of component types known to be without cycles, the steps of their longest path
    depth: dict[str, int] = field(default_factory=dict)
    #: Whether an edge may come in several layers of one component name, so that pairs must be made distinct
    layered: bool = True
    #: Whether each node with a text is known to be a token, so that none covers others
    texts_are_tokens: bool = False

    @cached_property
    def tok_pos(self) -> DataFrame:
        return self._derived("tok_pos")

    @cached_property
    def span(self) -> DataFrame:
        return self._derived("span")

    @cached_property
    def coverage(self) -> DataFrame:
        return self._derived("coverage")

    def _derived(self, name: str) -> DataFrame:
        if name in self.derive:
            return self.derive[name]()
        return self.node.sparkSession.createDataFrame([], SCHEMAS[name])

    @cached_property
    def labels(self) -> DataFrame:
        """All annotations, node names and types included."""
        own = [self.node.select("corpus", "node_id", F.lit(ANNIS).alias("ns"), F.lit(n).alias("name"), F.col(n).alias("value")) for n in ("node_name", "node_type")]
        return self.anno.select("corpus", "node_id", "ns", "name", "value").unionByName(own[0]).unionByName(own[1]).filter("value is not null")

    def component(self, ctype: str, name: str | None = None, layer: str | None = None) -> DataFrame:
        e = self.edge.filter(F.col("ctype") == ctype)
        if name is not None:
            e = e.filter(F.col("cname") == name)
        return e if layer is None else e.filter(F.col("layer") == layer)


def united(graphs: list[Graph]) -> Graph:
    """One graph over several corpora."""
    if len(graphs) == 1:
        return graphs[0]

    def union(t: str) -> DataFrame:
        out = getattr(graphs[0], t)
        for g in graphs[1:]:
            out = out.unionByName(getattr(g, t))
        return out

    depth = {c: max(g.depth[c] for g in graphs) for c in graphs[0].depth if all(c in g.depth for g in graphs)}
    derive = {t: (lambda t=t: union(t)) for t in ("tok_pos", "span", "coverage")}
    return Graph(*(union(t) for t in ("node", "anno", "edge", "edge_anno")), derive, depth, any(g.layered for g in graphs), all(g.texts_are_tokens for g in graphs))
