"""Graphs from and to GraphML files.

A file of any file system is read as a stream by the driver, like the format
demands (keys before nodes before edges), and written to Parquet tables batch
by batch, from which everything else is distributed. Nodes come before edges
whatever their order in the file.
"""

from __future__ import annotations

from collections.abc import Iterator
from io import TextIOWrapper
from pathlib import PurePath
from typing import BinaryIO
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import Files
from ..plans.graph import ANNIS, Graph

#: Component types by name.
CTYPES = ("Coverage", "Dominance", "Pointing", "Ordering", "LeftToken", "RightToken", "PartOf")
_NODE_TYPE, _NODE_NAME = f"{ANNIS}::node_type", f"{ANNIS}::node_name"


def _qname(text: str) -> tuple[str, str]:
    ns, sep, name = text.partition("::")
    return (ns, name) if sep else ("", text)


def read_events(file: BinaryIO) -> Iterator[tuple]:
    """("node", name, type), ("label", node, ns, name, value), ("edge", source, target, ctype, layer, cname), ("edge_label", the edge's five, ns, name, value), ("config", text)."""
    keys: dict[str, str] = {}
    graph = None
    for step, el in ElementTree.iterparse(file, ("start", "end")):
        tag = el.tag.rpartition("}")[2]
        if step == "start":
            graph = el if tag == "graph" else graph
        else:
            if tag == "key":
                keys[el.get("id")] = el.get("attr.name")
            elif tag in ("node", "edge"):
                data = [(keys.get(d.get("key"), d.get("key")), d.text or "") for d in el if d.tag.rpartition("}")[2] == "data"]
                if tag == "node":
                    labels = dict(data)
                    yield "node", el.get("id"), labels.get(_NODE_TYPE, "node")
                    for k, v in labels.items():
                        if k not in (_NODE_TYPE, _NODE_NAME):
                            yield "label", el.get("id"), *_qname(k), v
                else:
                    parts = (el.get("label") or "").split("/", 2)
                    if len(parts) == 3 and parts[0] in CTYPES:
                        edge = (el.get("source"), el.get("target"), *parts)
                        yield "edge", *edge
                        for k, v in dict(data).items():
                            yield "edge_label", *edge, *_qname(k), v
                el.clear()
                if graph is not None:  # what was read doesn't stay there either
                    graph.clear()
            elif tag == "data" and el.get("key") == "k0" and el.text and "k0" not in keys:
                yield "config", el.text


def import_graphml(spark: SparkSession, path: str, corpus: str | None = None, file: BinaryIO | None = None) -> Graph:
    """The graph of a file under the name of ``corpus`` (the file's name without ending); ``file`` where it was opened already."""
    from .updates import graph_of_events

    with file or Files(spark, path).open(path) as f:
        return graph_of_events(spark, read_events(f), corpus or PurePath(path).stem)


def export_graphml(graph: Graph, path: str, stable: bool = False, config: str | None = None, file: BinaryIO | None = None) -> None:
    """Writes one file; ``stable`` orders nodes by name and edges by their ends. Derived components are left out."""
    node = graph.node.select("corpus", "node_id", "node_name", "node_type")
    names = graph.node.select("corpus", F.col("node_id"), F.col("node_name"))
    shown = graph.edge.filter(~F.col("ctype").isin("LeftToken", "RightToken") & (F.col("cname") != "inherited-coverage"))
    label_of = F.concat_ws("/", "ctype", "layer", "cname")
    labels = graph.anno.groupBy("corpus", "node_id").agg(F.sort_array(F.collect_list(F.struct("ns", "name", "value"))).alias("labels"))
    edge_key = ["corpus", "ctype", "layer", "cname", "source", "target"]
    edge_labels = graph.edge_anno.groupBy(*edge_key).agg(F.sort_array(F.collect_list(F.struct("ns", "name", "value"))).alias("labels"))
    a, b = (names.select("corpus", F.col("node_id").alias(k), F.col("node_name").alias(f"{k}_name")) for k in ("source", "target"))
    nodes = node.join(labels, ["corpus", "node_id"], "left")
    edges = shown.join(edge_labels, edge_key, "left").join(a, ["corpus", "source"]).join(b, ["corpus", "target"]).select("source_name", "target_name", label_of.alias("label"), "labels")
    if stable:
        nodes, edges = nodes.orderBy("node_name"), edges.orderBy("label", "source_name", "target_name")
    keys: dict[str, str] = {}

    def key_rows(df: DataFrame, of: str) -> list[str]:
        rows = df.select("ns", "name").distinct().orderBy("ns", "name").collect()
        out = []
        for q in [*([_NODE_TYPE] if of == "node" else []), *(f"{r.ns}::{r.name}" if r.ns else r.name for r in rows)]:
            keys.setdefault(f"{of} {q}", f"k{len(keys) + 1}")
            out.append(f'    <key id="{keys[f"{of} {q}"]}" for="{of}" attr.name={quoteattr(q)} attr.type="string"/>\n')
        return out

    def data(of: str, q: str, value: str) -> str:
        return f'      <data key="{keys[f"{of} {q}"]}">{escape(value)}</data>\n'

    def qname(x) -> str:
        return f"{x.ns}::{x.name}" if x.ns else x.name

    with TextIOWrapper(file or Files(graph.node.sparkSession, path).create(path), "utf-8", newline="\n") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml>\n')
        f.writelines([*key_rows(graph.anno, "node"), *key_rows(graph.edge_anno, "edge")])
        f.write('  <graph edgedefault="directed" parse.order="nodesfirst" parse.nodeids="free" parse.edgeids="canonical">\n')
        if config is not None:
            f.write(f"    <data key=\"k0\"><![CDATA[{config.replace(']]>', ']]]]><![CDATA[>')}]]></data>\n")
        for r in nodes.toLocalIterator():
            f.write(f"    <node id={quoteattr(r.node_name)}>\n{data('node', _NODE_TYPE, r.node_type)}{''.join(data('node', qname(x), x.value) for x in r.labels or [])}    </node>\n")
        for i, r in enumerate(edges.toLocalIterator()):
            f.write(f"    <edge id=\"e{i}\" source={quoteattr(r.source_name)} target={quoteattr(r.target_name)} label={quoteattr(r.label)}>\n{''.join(data('edge', qname(x), x.value) for x in r.labels or [])}    </edge>\n")
        f.write("  </graph>\n</graphml>\n")


__all__ = ["export_graphml", "import_graphml", "read_events"]
